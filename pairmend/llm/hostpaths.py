"""Main text of web pages by consensus host paths.

Each page's containers are scored by the prose that they hold; the best container's generalised tag and
class path gets a vote for its host, and Spark counts the votes. Each page is then read again with its
host's winning path, so a page with little prose or much noise is cut like its neighbours.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairmend.llm.common import settle, small

# How elements behave.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CONTAINERS = frozenset("article body center div main section td".split())
#: Elements and words in classes, ids and roles that mark what is not the article.
BOILERPLATE = frozenset("nav header footer aside form script style noscript template iframe object svg canvas button select textarea menu dialog title head noembed noframes xmp input".split())
NOISE = frozenset(
    "ad ads adbox adbanner adsense adslot advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup "
    "modal overlay newsletter subscribe subscription signup sidebar aside menu nav navbar navigation topnav breadcrumb breadcrumbs footer header masthead topbar comment comments "
    "commentlist disqus respond reply replies reviews kommentare commentaires comentarios share sharing social related recommended recommendations widget widgets pagination pager toolbar skip login search contentinfo complementary".split()
)

#: Words that say nothing beside those: a class or id is noise if it has words of NOISE and else only these.
NEUTRAL = frozenset(
    "area bar block body bottom box col column container content div element fixed float form foot global group head inner item items js left link links list main module outer page "
    "panel post primary reader readers right rail row secondary section site small slot space sticky strip text thread top unit user users wrap wrapper zone".split()
)

#: An article with less of a page's prose than this is not what the page is about.
LITTLE = 0.05

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([^\s=/\"'>]+)")
_RAW_END = {t: re.compile(rf"</{t}\s*/?>", re.I) for t in RAW}
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_UNSEEN = re.compile(r"display\s*:\s*none")
_UNTIL_P, _UNTIL_ITEM = CONTAINERS | {"li", "blockquote", "table"}, ("ul", "ol", "dl", "table", "select")
_SAME = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}


class _Scanner:
    """Gives a page's text and tags in one pass: its pointer only moves on, whatever the page is like.

    A tag ends at the first > outside quotes. Where that is missing, quotes count for nothing from there on,
    and where there is no > any more, the rest is text.
    """

    def __init__(self, html: str):
        self.html, self.loose = html, False

    def __iter__(self) -> Iterator[tuple[str, str, str]]:
        """(kind, text or tag name, attributes): kinds are text, open and close."""
        html, at, held = self.html, 0, 0
        while (k := html.find("<", at)) >= 0:
            start, made = k, None
            if html.startswith("<!--", k):
                end = html.find("-->", k + 4)
                at = len(html) if end < 0 else end + 3
            elif html.startswith("<![CDATA[", k) and (end := html.find("]]>", k)) >= 0:
                at, made = end + 3, ("text", html[k + 9 : end], "")
            elif html.startswith(("<!", "<?"), k):
                if (end := html.find(">", k)) < 0:
                    break
                at = end + 1
            else:
                close = html.startswith("/", k + 1)
                name = _NAME.match(html, k + 1 + close)
                if not name:
                    at = k + 1
                    continue
                if (end := self._end(name.end())) < 0:
                    break
                at, made = end + 1, ("close" if close else "open", name[0].lower(), html[name.end() : end])
            if start > held:
                yield "text", html[held:start], ""
            if made:
                yield made
                if made[0] == "open" and made[1] in RAW and not made[2].rstrip().endswith("/"):
                    end = _RAW_END[made[1]].search(html, at)
                    at = end.end() if end else len(html)
            held = at
        if held < len(html):
            yield "text", html[held:], ""

    def _end(self, at: int) -> int:
        html, first = self.html, at
        while not self.loose:
            stop = _STOP.search(html, at)
            if not stop:
                self.loose = True
            elif stop[0] == ">":
                return stop.start()
            else:
                close = html.find(stop[0], stop.end())
                if close < 0:
                    self.loose = True
                at = close + 1
        return html.find(">", first)


class _Page:
    """A page's elements (tag, parent, path, noise) and its text, each piece with its element.

    A path is a number; `paths` has the number of each path and label that continues it.
    """

    def __init__(self, html: str):
        self.tag, self.parent, self.path, self.noise, self.link = ["#root"], [-1], [0], [False], [False]
        self.paths: dict[tuple[int, str], int] = {}
        self.label = [""]
        self.hard = [False]  # noise, were forms containers
        self.form = [0]  # the outermost form around
        self.text: list[tuple[int, str] | None] = []  # None: a block ends
        self.stack: list[int] = [0]
        self.open: dict[str, list[int]] = {}  # for each tag where it stands in the stack
        self.boxes: list[int] = []  # where containers stand there
        for kind, what, raw in _Scanner(html):
            if kind == "text":
                self.text.append((self.stack[-1], what))
                continue
            if what not in INLINE:
                self.text.append(None)
            elif what == "br":
                self.text.append((self.stack[-1], " "))
            if kind == "close":
                self._close(what)
                continue
            self._open(what, raw)
            bare = raw.rstrip().endswith("/")
            if what in RAW and not bare or what in VOID or bare and what not in CONTAINERS and what != "p":
                self._cut(len(self.stack) - 1)
        self._spare_form()

    def _spare_form(self) -> None:
        """A form with more prose than all the rest of the page is what the page is wrapped in, and no noise."""
        inside: dict[int, int] = {}
        for piece in self.text:
            if piece and not self.hard[piece[0]]:
                k = self.form[piece[0]]
                inside[k] = inside.get(k, 0) + len(piece[1].strip())
        most = max((k for k in inside if k), key=inside.get, default=0)
        if most and inside[most] > inside.get(0, 0):
            for k, form in enumerate(self.form):
                if form == most:
                    self.noise[k] = self.hard[k]

    def _cut(self, at: int) -> None:
        """Close the elements of the stack from there on."""
        while len(self.stack) > at:
            tag = self.tag[self.stack.pop()]
            self.open[tag].pop()
            if tag in CONTAINERS:
                self.boxes.pop()

    def _last(self, tags) -> int:
        """Where the innermost open element of these tags stands; 0 if there is none."""
        last, stands = 0, self.open
        for t in tags:
            if (at := stands.get(t)) and at[-1] > last:
                last = at[-1]
        return last

    def _open(self, tag: str, raw: str) -> None:
        if tag in CLOSES_P:
            self._implied(("p",), _UNTIL_P)
        elif tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
            self._implied(_SAME.get(tag, (tag,)), _UNTIL_ITEM)
        up = self.stack[-1]
        given = {(m[1] or m[5]).lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(raw)} if raw.strip() else {}
        name = given.get("class", "").split() if tag not in ("html", "body") else []
        label = (tag + "".join("." + re.sub(r"\d+", "#", c) for c in name[:1])).replace(">", "#")
        self.tag.append(tag)
        self.parent.append(up)
        self.label.append(label)
        self.path.append(self.paths.setdefault((self.path[up], label), len(self.paths) + 1))
        noisy = self._is_noise(tag, given)
        self.noise.append(self.noise[up] or noisy)
        self.hard.append(self.hard[up] or noisy and tag != "form")
        self.form.append(self.form[up] or (len(self.tag) - 1) * (tag == "form"))
        self.link.append(self.link[up] or tag == "a")
        self.open.setdefault(tag, []).append(len(self.stack))
        if tag in CONTAINERS:
            self.boxes.append(len(self.stack))
        self.stack.append(len(self.tag) - 1)

    def _is_noise(self, tag: str, given: dict[str, str]) -> bool:
        if tag in ("html", "body", "main"):
            return False
        if tag == "header" and self._last(("article", "main")):
            return False
        if tag in BOILERPLATE:
            return True
        if not given:
            return False
        if "hidden" in given or given.get("aria-hidden") == "true" or "style" in given and _UNSEEN.search(given["style"]):
            return True
        own = bool(self._last(("article",)))  # inside an article a header is its own, and a section's id is where links to it go
        for name in " ".join([given[a] for a in ("class", "id", "role") if a in given and not (own and tag == "section" and a == "id")]).split():
            words = {w.lower() for w in _WORDS.findall(name)}
            told = words & {"comment", "comments", "reply", "reviews"} if tag == "article" else words & NOISE - ({"header"} if own else set())
            if told and words <= NOISE | NEUTRAL:
                return True
        return False

    def _implied(self, tags, until) -> None:
        if (at := self._last(tags)) and (at > self._last(until) or tags[0] in until):
            self._cut(at)

    def _close(self, tag: str) -> None:
        at = self.open.get(tag)
        if at and not (tag in INLINE and self.boxes and self.boxes[-1] > at[-1]):
            self._cut(at[-1])

    def best(self) -> tuple[int, float]:
        """The container of the page's article, and its part of all scores.

        A page that marks its article says where it is: the outermost article with most prose, if it has half of what all articles have
        (else they are a list), or without articles the main part with most; it wins unless it holds next to nothing of the page. On
        other pages a container scores the prose under it, less links, halved by each container between; the highest
        score wins, the first of equals (the root if there is none), and an article or main part around it stands for it."""
        mass = [0.0] * len(self.tag)
        for piece in self.text:
            if piece and not self.noise[piece[0]] and not self.link[piece[0]]:
                mass[piece[0]] += len(piece[1].strip())
        prose = list(mass)
        top, total = 0, 0.0
        for k in range(len(mass) - 1, 0, -1):  # what is inside comes after what is around
            box = self.tag[k] in CONTAINERS
            prose[self.parent[k]] += prose[k]
            mass[self.parent[k]] += mass[k] / 2 if box else mass[k]
            if box and mass[k]:
                total += mass[k]
                if not top or mass[k] >= mass[top]:
                    top = k
        inside = [False] * len(self.tag)  # an article
        outer: dict[str, list[int]] = {"article": [], "main": []}
        for k in range(1, len(self.tag)):
            inside[k] = inside[self.parent[k]]
            if self.tag[k] in outer and not inside[k] and not self.noise[k] and prose[k]:
                outer[self.tag[k]].append(k)
                inside[k] = self.tag[k] == "article"
        for tag in ("article", "main"):
            if outer[tag]:
                k = max(outer[tag], key=lambda k: (prose[k], -k))
                if prose[k] * 2 >= sum(prose[x] for x in outer[tag]) and prose[k] >= LITTLE * prose[0]:
                    return k, prose[k] / prose[0]
        part, k = mass[top] / total if top else 0.0, top
        around = {self.tag[top]: top}
        while k > 0:
            around[self.tag[k]] = k  # the outermost of each tag
            k = self.parent[k]
        return around.get("article", around.get("main", top)), part

    def path_of(self, k: int) -> str:
        labels = []
        while k > 0:
            labels.append(self.label[k])
            k = self.parent[k]
        return "".join(f">{x}" for x in reversed(labels))

    def number_of(self, path: str) -> int:
        """The number of a written path; -1 if the page doesn't have it."""
        at = 0
        for label in path.split(">")[1:]:
            at = self.paths.get((at, label), -1)
        return at

    def blocks(self, roots: set[int]) -> list[str]:
        """The text under the roots, without noise, block by block."""
        inside = [False] * len(self.tag)
        for k in range(len(self.tag)):
            inside[k] = k in roots or k > 0 and inside[self.parent[k]]
        out, now = [], []
        for piece in [*self.text, None]:
            if piece is None:
                if block := " ".join(unescape("".join(now)).split()):
                    out.append(block)
                now = []
            elif inside[piece[0]] and not self.noise[piece[0]]:
                now.append(piece[1])
        return out


def vote(html: str | None) -> tuple[str, float]:
    """The generalised path of a page's best container, and its part of the page's prose."""
    page = _Page(html or "")
    k, part = page.best()
    return page.path_of(k), part


def extract(html: str | None, path: str | None) -> str:
    """The main text: what the path's containers hold, or, where that is under half of the page's best
    container (or there are none), what that one holds. Blocks are joined by an empty line."""
    page = _Page(html or "")
    own = page.blocks({page.best()[0]})
    if path and (number := page.number_of(path)) > 0:
        won = page.blocks({k for k, x in enumerate(page.path) if x == number and not page.noise[k]})
        if sum(map(len, won)) * 2 >= sum(map(len, own)):
            own = won
    return "\n\n".join(own)


#: Hosts whose winning paths may be broadcast.
BROADCAST_HOSTS = 200_000


def host_of(url: str = "url") -> F.Column:
    """The host in lower case; empty where there is none."""
    return F.regexp_extract(F.lower(F.coalesce(F.col(url), F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)


def winning_paths(pages: DataFrame) -> DataFrame:
    """(host, path): for each host the path with most votes, a vote counting its part of the prose."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            votes = [vote(h) for h in batch["html"]]
            yield pd.DataFrame({"host": batch["host"], "path": [v[0] for v in votes], "part": [v[1] for v in votes]})

    cast = pages.select(host_of().alias("host"), F.col("html").cast("string").alias("html")).mapInPandas(run, "host string, path string, part double")
    counted = cast.filter("path <> ''").groupBy("host", "path").agg(F.sum(F.round("part", 6).cast("decimal(20,6)")).alias("votes"))
    return counted.groupBy("host").agg(F.max_by("path", F.struct("votes", "path")).alias("path"))


def main_text(pages: DataFrame) -> DataFrame:
    """One row a page: page_id, url, text, n_chars (code points).

    White space in a block is one space, blocks are joined by an empty line, nothing is cut. A null or
    empty page, or one with no prose, has an empty text. Pages without a host vote together. Rows that repeat
    a page_id are pages of their own; other columns are left alone. No rows in, no rows out.
    """
    paths = small(settle(winning_paths(pages)), BROADCAST_HOSTS)
    rows = pages.select("page_id", "url", host_of().alias("host"), F.col("html").cast("string").alias("html")).join(paths, "host", "left")

    @F.pandas_udf("string")
    def text(html: pd.Series, path: pd.Series) -> pd.Series:
        return pd.Series([extract(h, p) for h, p in zip(html, path, strict=True)], dtype=object)

    return rows.select("page_id", "url", text("html", "path").alias("text")).withColumn("n_chars", F.length("text").cast("long"))

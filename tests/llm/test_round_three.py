"""Importance resampling, the Merkle manifest and URL filters against plain Python, odd rows included."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairmend.llm import anchors, hostpaths, importance, merkle, minhash, mixing, nbsvm, prefixcrc, secrets, urlcascade
from pairmend.llm import kernels as K
from pairmend.llm.common import small
from pairmend.llm.order import placed
from pairmend.llm.queries import URL_RULES

DOCS = "doc_id long, text string, lang string, source string, n_chars long, rank string, leaf string, node array<string>"
FEATURE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def texts(n=120, seed=5):
    rng = random.Random(seed)
    out = ["".join(rng.choice("abCd ,.\n9éß日\x00") for _ in range(rng.randrange(0, 700))) for _ in range(n)]
    return [*out, None, "", " \n ", "word", "A-B", "x" * 3000 + " y", "long tale " * 20_000, out[0], out[0]]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", ["clash"]) for r in rows], DOCS)


def test_runs_of_words_have_the_crc_of_their_text():
    given = [t or "" for t in texts()]
    raw = [t.encode() for t in given]
    n, runs = prefixcrc.word_runs(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), 3)
    for i, t in enumerate(given):
        words = FEATURE_WORD.findall(lowered(t))
        assert n[i] == len(words)
        for k, (text, crc) in enumerate(runs):
            assert crc[text == i].tolist() == [zlib.crc32(" ".join(words[j : j + k + 1]).encode()) for j in range(len(words) - k)]


def test_a_state_shifts_over_any_length():
    for n in (0, 1, 255, 256, 257, 65_536, 1_000_003):
        start = zlib.crc32(b"before")
        both = zlib.crc32(b"\1" * n, start)
        assert int(prefixcrc.shifted(np.array([start], np.uint32), np.array([n]))[0]) == both ^ zlib.crc32(b"\1" * n)


def resampled(rows, target, percent=25, least=20):
    def features(text):
        w = FEATURE_WORD.findall(lowered(text))
        return len(w), [zlib.crc32(f.encode()) % 10_000 for f in w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]]

    s, t, own = [0] * 10_000, [0] * 10_000, [(i, *features(x)) for i, x in rows]
    for _, _, found in own:
        for b in found:
            s[b] += 1
    for x in target:
        for b in features(x)[1]:
            t[b] += 1
    gain = [math.floor(1000 * math.log((b + 1.0) * (sum(s) + 10_000) / ((a + 1.0) * (sum(t) + 10_000)))) for a, b in zip(s, t, strict=True)]
    out = []
    for i, n, found in own:
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    rank = {id(r): k + 1 for k, r in enumerate(able[: percent * len(able) // 100])}
    return [(*r[:4], rank.get(id(r))) for r in out]


def test_resampling_is_the_definition(spark):
    rows = [(k, t) for k, t in enumerate(texts())]
    target = ["abC 9éß, tale long", None, "", "a b d tale"]
    goal = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    got = importance.resample(frame(spark, [(i, t, "en", "s", 1) for i, t in rows]), goal).select("doc_id", "n_features", "weight", "score", "rank")
    assert sorted(map(tuple, got.collect())) == sorted(resampled(rows, target))


def test_resampling_of_odd_rows(spark):
    many = " ".join(f"w{k}" for k in range(30))
    rows = [(None, many)] * 12 + [(3, many)] * 9 + [(4, many + " z")] * 2 + [(5, None)]
    goal = spark.createDataFrame([], "item_id long, text string")
    got = importance.resample(frame(spark, [(i, t, "en", "s", 1) for i, t in rows]), goal, percent=50).collect()
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted((key((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"])) for r in got)) == sorted(map(key, resampled(rows, [], 50)))
    assert importance.resample(frame(spark, []), goal).collect() == []


def test_places_are_exact_whatever_repeats(spark):
    rows = [(k % 7, None if k % 5 == 0 else k) for k in range(500)]
    got = placed(spark.createDataFrame(rows, "a int, b int").repartition(5), F.desc("a"), F.asc("b"), into="k", sums={"before": "a"}).collect()
    want = sorted(rows, key=lambda r: (-r[0], r[1] is not None, r[1] or 0))
    got = sorted(got, key=lambda r: r["k"])
    assert [tuple(r)[:2] for r in got] == want
    assert [r["before"] for r in got] == [sum(x[0] for x in want[:k]) for k in range(500)]


def digest(*x):
    return hashlib.sha256("".join(x).encode()).hexdigest()


def leaf(row):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def manifest(rows, fanout=3):
    """(doc_id, leaf): sorted (subroot, root, proof, folded, verified), straight from the definition."""

    def up(nodes):
        while len(nodes) > 1:
            above = []
            for i in range(0, len(nodes), fanout):
                run = nodes[i : i + fanout]
                for k, (_, under) in enumerate(run):
                    for m in under:
                        m["path"].append(("".join(h for h, _ in run[:k]), "".join(h for h, _ in run[k + 1 :])))
                above.append((digest(*[h for h, _ in run]), [m for _, under in run for m in under]))
            nodes = above
        return nodes[0]

    groups, tops, every = {}, [], []
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    for g in sorted(groups, key=lambda s: (s is not None, (s or "").encode())):
        own = []
        for r in sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))):
            cut = r[4] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            own.append({"id": r[0], "leaf": leaf(r), "seen": leaf((*r[:4], r[4].replace("\n", "") if cut else r[4])), "path": []})
        subroot, _ = up([(m["leaf"], [m]) for m in own])
        for m in own:
            m["subroot"] = subroot
        tops.append((subroot, own))
        every += own
    root, out = up(tops)[0], {}
    for m in every:
        h = m["seen"]
        for left, right in m["path"]:
            h = digest(left, h, right)
        out.setdefault((m["id"], m["leaf"]), []).append((m["subroot"], root, digest(*[a + b for a, b in m["path"]]), h, h == root))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("n", [1, 2, 40, 1500])
def test_manifest_is_the_definition(spark, monkeypatch, n):
    whole = merkle.manifest
    monkeypatch.setattr(merkle, "manifest", lambda *a, **k: whole(*a, **{**k, "levels": 2}))  # so that many blocks exchange
    rng = random.Random(n)
    sources = ["hot"] * 40 + ["b", "ü", None, "Z", "q", "r", "s", "t", "u", "v", "w"]
    rows = [(k, rng.choice(sources), rng.choice(["en", None]), rng.choice([1, None]), rng.choice(["a\nb", "x", None, "é\n", ""])) for k in range(n)]
    if n > 40:
        rows += [(None, "hot", "en", 1, "n\n")] * 5 + [(5, "hot", "en", 1, "x")] * 12
    given = frame(spark, [(i, text, lang, source, chars) for i, source, lang, chars, text in rows])
    got = {}
    for r in merkle.tamper_evidence(given).collect():
        got.setdefault((r["doc_id"], r["leaf"]), []).append(tuple(r)[2:])
    assert {k: sorted(v) for k, v in got.items()} == manifest(rows)


def test_manifest_with_another_fanout_and_none(spark):
    rows = frame(spark, [(k, f"t{k}", "en", "s", 1) for k in range(100)])
    got = merkle.manifest(rows, merkle.leaf(F.col("text")), fanout=2, levels=3).withColumn("up", merkle.fold(F.col("leaf"), F.col("path"))).collect()
    assert len(got) == 100 and all(r["up"] == r["root"] == r["subroot"] and len(r["path"]) == 7 for r in got)
    assert merkle.tamper_evidence(frame(spark, [])).collect() == []


def judged(url, rules, otherwise="allow"):
    at = (url or "").find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    host = re.match("[^/?#]*", rest)[0]
    path, host, best = re.match("[^?#]*", rest[len(host) :])[0], lowered(host), None
    for h, p, verdict in rules:
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            best = max(best or (0, 0, "", ""), (len(h + p), len(h), h + p, verdict))
    return (host, path, best[2] if best else None, best[3] if best else otherwise)


ODD = [None, "", "no address", "://", "http://", "HTTP://EXAMPLE.org/es/x", "x://a.ORG", "x://a.org/", "http://org/", "http://example.org?/es/", "http://a.example.org/en/1#/", "http://.org/", "http://a..com/de/\n/x", "ftp://fr.com/fr", "a://b://c.com/fr/?", "http://ÉA.com/de/é", "http://org./", "http://notorg/", "//example.com/de/", "http://" + "a." * 500 + "com/de/" + "x" * 5000]


def pages(spark, urls):
    return spark.createDataFrame([(k, u, "clash", "clash", "clash") for k, u in enumerate(urls)], "page_id long, url string, rule string, host string, key string")


def test_given_rules_on_odd_urls(spark):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    got = urlcascade.judge(pages(spark, ODD + ODD[5:7]), rules).collect()
    assert [tuple(r) for r in sorted(got)] == [(k, *judged(u, URL_RULES)) for k, u in enumerate(ODD + ODD[5:7])]
    assert urlcascade.judge(pages(spark, []), rules).collect() == []
    none = urlcascade.judge(pages(spark, ODD), rules.limit(0), "block").collect()
    assert {(r["rule"], r["verdict"]) for r in none} == {(None, "block")} and len(none) == len(ODD)


def test_long_lists_by_cascade_and_by_key(spark):
    rng = random.Random(2)
    hosts = [".".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 5))) for _ in range(400)]
    urls = [f"http://{rng.choice(hosts)}/{rng.choice('xyz')}{rng.choice(['', '/', '/1', 'ab'])}" for _ in range(3000)]
    rules = sorted({(h, rng.choice(["/", "/x", "/y/1", ""]), rng.choice(["allow", "block"])) for h in hosts[::3]} | {(f"h{k}.net", "/x", "block") for k in range(300)})
    rules = list({(h, p): (h, p, v) for h, p, v in rules}.values())
    given = spark.createDataFrame([*rules, ("", "/", "block"), (None, "/", "block"), ("a", "/", "maybe")], "host string, path string, verdict string")
    want = [(k, *judged(u, rules)) for k, u in enumerate(urls)]
    for limits in ({}, {"most_bits": 64}, {"most_tests": 1}):
        assert sorted(map(tuple, urlcascade.judge(pages(spark, urls), given, **limits).collect())) == want
    both = spark.createDataFrame([("a", "/", "allow"), ("A", "/", "block")], "host string, path string, verdict string")
    assert {r["verdict"] for r in urlcascade.judge(pages(spark, ["http://a/"]), both).collect()} == {"block"}


def test_a_cascade_is_exact_over_its_corpus(spark):
    corpus = spark.range(4000).selectExpr("concat('k', id) as key")
    listed = corpus.filter("pmod(hash(key), 9) = 0")
    made = urlcascade.cascade(listed, corpus.union(corpus))
    assert len(made.levels) > 2
    assert corpus.filter(made.holds(F.col("key")) != (F.expr("pmod(hash(key), 9) = 0"))).isEmpty()
    assert corpus.filter(urlcascade.cascade(listed.limit(0), corpus).holds(F.col("key"))).isEmpty()


# Two words that a hash which cancels eight bytes by eight others takes for one.
ALIKE = ("rs18bf38tailtail", "a04z92z4ze,kol<q")


def test_words_that_were_made_to_collide(spark):
    data = np.frombuffer(" ".join(ALIKE).encode(), np.uint8)
    starts, ends, _ = K.word_bounds(data, np.array([0, len(data)]))
    for lane in (0, 1):
        assert len(set(K.word_hashes(data, starts, ends, lane=lane).tolist())) == 2
    a, b = ALIKE
    got = minhash.near_duplicates(frame(spark, [(1, f"{a} w {b} w", "en", "s", 1)]), shingle_words=2).first()
    assert got["n_shingles"] == 3
    passage = [f"w{k}" for k in range(40)]
    texts_ = [" ".join([*passage[:20], x, *passage[20:]]) for x in ALIKE]
    got = anchors.repeated_passages(frame(spark, [(k, t, "en", "s", 1) for k, t in enumerate(texts_)])).collect()
    assert all(r["n_removed"] == 0 for r in got)


def test_many_secrets_in_one_text(spark):
    """A megabyte with thousands of secrets and tokens takes seconds, and every span is the definition's."""
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abcdefghijkABCDEFGHIJK0123456789+/") for _ in range(n))
    parts = []
    for k in range(20_000):
        parts += [f"password = {word(rng.randrange(4, 12))}", word(24), "plain words", f"token:{word(30)}" if k % 3 else f"x{word(25)}AKIA{'B' * 20}"]
    text, model = " ".join(parts), [rng.random() for _ in range(secrets.CLASSES**2)]
    docs = frame(spark, [(1, text, "en", "s", 1), (2, None, "en", "s", 1), (3, "token = abcdef9 token = abcdef9", "en", "s", 1)])
    got = {r["doc_id"]: r for r in secrets.scan(docs, model).collect()}
    base = secrets.brute_force(text)
    assert [tuple(s) for s in got[1]["base"]] == base and [tuple(s) for s in got[2]["spans"]] == []
    covered = np.zeros(len(text) + 1, np.int32)
    for _, a, b in base:
        covered[a:b] = 1
    free = []
    for m in re.finditer(secrets.TOKEN, text):
        codes = [0, *[secrets.ALPHABET.index(c) + 1 for c in m[0]], 0]
        nats = sum(float(f"{model[x * secrets.CLASSES + y]:.6f}") for x, y in zip(codes, codes[1:], strict=False)) / len(m[0])
        if not covered[m.start() : m.end()].any() and len(set(m[0])) >= secrets.DIFFERENT and nats > secrets.MARGIN:
            free.append(("random", *m.span()))
    want = sorted(base + free, key=lambda s: (s[1], secrets.ORDER.index(s[0])))
    assert [tuple(s) for s in got[1]["spans"]] == want and free
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(docs, model=model).collect()}
    runs = []
    for _, a, b in want:
        if runs and a < runs[-1][1]:
            runs[-1][1] = max(b, runs[-1][1])
        else:
            runs.append([a, b])
    cuts = [0, *[x for r in runs for x in r], len(text)]
    assert clean[1] == "<SECRET>".join(text[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True))
    assert clean[2] is None and clean[3] == "<SECRET> <SECRET>"


@pytest.mark.parametrize("n", [1, 2, 3, 5, 682, 1023, 1024, 1_048_576])
def test_neighbouring_blocks_part(n):
    strides = set()
    for rank in range(20):
        for e in (0, 1):
            turned = [mixing.PRIMES[(rank * 5 + e * 3 + k) % 16] for k in range(16)]
            stride = next((p for p in turned if n // 4 <= p % n <= n - n // 4), mixing.PRIMES[0])
            assert math.gcd(stride, n) == 1 and n // 4 <= stride % n <= n - n // 4
            strides.add(stride % n)
    assert n < 600 or len(strides) > 3


def test_bounds_hold_with_a_repeated_id(spark, monkeypatch):
    rows = [(7 if k % 2 else None, f"good words {k % 3}", "en", "s", 1) for k in range(400)] + [(8, "bad x", "en", "s", 1)]
    fitted = []
    labels = spark.createDataFrame([(7, 1), (8, 0)], "doc_id long, quality int")
    monkeypatch.setattr(nbsvm, "fit", lambda rows, y, real=nbsvm.fit: (_ for _ in ()).throw(ValueError(f"{len(rows)} rows")) if len(rows) > 2 else real(rows, y))
    nbsvm.train(frame(spark, rows), labels)
    copies = [(None, " ".join(f"w{k}" for k in range(50)), "en", "s", 1)] * 300
    monkeypatch.setattr(anchors, "BUNDLE_CHARS", 2_000)
    got = anchors.repeated_passages(frame(spark, copies)).collect()
    assert len(got) == 300 and all(r["n_removed"] == 50 for r in got)
    wide = spark.range(4).selectExpr("id", "array_repeat(id, 2000000) AS many")
    assert "Broadcast" not in spark.range(4).join(small(wide), "id")._jdf.queryExecution().optimizedPlan().toString()
    assert fitted == []


def test_the_article_wins_over_what_readers_wrote(spark):
    para = lambda x, n=1: "".join(f"<p>{x}{k} {'words of prose ' * 12}</p>" for k in range(n))
    whole = f'<body><article>{para("own", 2)}</article><div class="user-reviews">{para("review", 9)}</div></body>'
    other = f'<body><article>{para("more", 6)}</article><div class="user-reviews">{para("review", 1)}</div></body>'
    strange = f'<body><main><article>{para("own", 2)}</article><div class="stimmen">{para("review", 9)}</div></main></body>'
    pages_ = spark.createDataFrame([(k, "http://h/", p) for k, p in enumerate([whole, whole, other, strange])], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in hostpaths.main_text(pages_).collect()}
    assert all("review" not in t for t in got.values()) and got[2].count("more") == 6 and got[0].count("own") == got[3].count("own") == 2
    listing = "<body><main>" + "".join(f"<article>{para(f'a{k}-')}</article>" for k in range(5)) + "</main></body>"
    assert all(f"a{k}-0" in hostpaths.extract(listing, None) for k in range(5))


def test_a_page_inside_a_form_and_an_article_s_own_parts():
    prose = "words of prose " * 20
    page = f'<body><form runat="server"><div class="menu">no</div><div class="text"><p>{prose}</p></div><button>no</button></form><form><label>no</label></form></body>'
    assert hostpaths.extract(page, None) == prose.strip()
    assert hostpaths.extract(f"<body><div><p>{prose}</p></div><form><p>Your name</p></form></body>", None) == prose.strip()
    page = f'<article><div class="post-header"><h1>Head</h1></div><p>{prose}</p><section id="social"><h2>Social life</h2><p>{prose}</p></section><div class="social">no</div><ul class="share">no</ul></article>'
    assert hostpaths.extract(f"<body>{page}</body>", None) == "\n\n".join(["Head", prose.strip(), "Social life", prose.strip()])

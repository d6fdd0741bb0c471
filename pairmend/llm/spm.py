"""SentencePiece encoding and decoding by suffix-array matching.

A batch's distinct units (runs of word marks with what follows them; no piece reaches over a unit's
end) are joined to one text. Its suffixes are sorted to the depth of the longest piece, and every
piece of the vocabulary is looked up in them by binary search: the range it finds holds all its
occurrences. The resulting edges are sorted by where they end and relaxed from left to right: the pieces
of a prefix are those of a shorter prefix and one edge more, namely the edge whose piece the merges
would leave beside the last piece of that shorter prefix. Exactly one edge at each reachable place is
such, so one pass gives what merging by rank gives.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairmend.llm.kernels import released

MARK = "▁"
_PAIR = 1 << 22  # above the number of any piece or character
#: Characters of distinct units indexed at a time; characters of text encoded at a time.
INDEX_CHARS, TEXT_CHARS = 200_000, 1_000_000
#: Units and pairs of pieces that a worker remembers, and the longest unit remembered: a bound in bytes.
REMEMBERED, SHORT = 80_000, 48
#: Fewer units than this at one length are relaxed one by one.
FEW = 24
#: What parts the units of an index: no character.
_GAP = 0x110000


class Vocabulary:
    """A byte-pair model: pieces with ranks (lower merges first), unknown characters as bytes."""

    def __init__(self, pieces: dict[str, tuple[int, float]], byte_ids: list[int], specials: dict[int, str]):
        self.id_of = {p: i for p, (i, _) in pieces.items()}
        self.score = {p: s for p, (_, s) in pieces.items()}
        self.byte_ids = byte_ids
        self.depth = max(map(len, pieces), default=1)
        self.split: dict[str, tuple[str, str] | None] = {}
        self.fits: dict[int, bool] = {}
        # Pieces that merging can make, by number; a character by itself has the number - 1 - its code.
        self.names = sorted((p for p in pieces if len(p) > 1 and self.parts(p)), key=lambda p: [*map(ord, p)])
        self.number = {p: k for k, p in enumerate(self.names)}
        self.numbers = np.array([self.id_of[p] for p in self.names], np.int32)
        self.lengths = np.array([len(p) for p in self.names], np.int64)
        self._tables()
        self.raw = [b""] * (1 + max([*byte_ids, *specials, *(i for i, _ in pieces.values())], default=0))
        for p, i in self.id_of.items():
            self.raw[i] = p.encode()
        for b, i in enumerate(byte_ids):
            self.raw[i] = bytes([b])

    def _number(self, x: str) -> int | None:
        return -1 - ord(x) if len(x) == 1 else self.number.get(x)

    def _tables(self) -> None:
        """The tree of the pieces' prefixes by level, the pieces' parts, and which two numbers make a piece."""
        self.levels, known = [], {"": 0}
        for depth in range(1, self.depth + 1):
            longer = [k for k, p in enumerate(self.names) if len(p) >= depth]
            prefixes = list(dict.fromkeys(self.names[k][:depth] for k in longer))
            place = {p: k for k, p in enumerate(prefixes)}
            above = np.array([known[p[:-1]] for p in prefixes], np.int64)
            ends = [(place[self.names[k]], k) for k in longer if len(self.names[k]) == depth]
            full = np.array(ends, np.int64).reshape(-1, 2)
            self.levels.append((above, np.array([ord(p[-1]) for p in prefixes], np.int64), full[:, 0], full[:, 1]))
            known = place
        halves = [self.parts(p) for p in self.names]
        self.left = np.array([self._number(x) for x, _ in halves], np.int64)
        self.right = np.array([self._number(y) for _, y in halves], np.int64)
        self.scores = np.array([self.score[p] for p in self.names], float)
        made = []
        for p in self.score:
            for k in range(1, len(p)):
                x, y = self._number(p[:k]), self._number(p[k:])
                if x is not None and y is not None:
                    made.append((x * _PAIR + y, self.score[p]))
        made.sort()
        self.made = np.array([k for k, _ in made] + [np.iinfo(np.int64).max], np.int64)
        self.made_score = np.array([x for _, x in made] + [0.0])

    def stay_all(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """stay() for paired numbers, all at once."""
        out, live = np.ones(len(a), bool), np.arange(len(a))
        a, b, over, equal = a.copy(), b.copy(), np.full(len(a), -np.inf), np.zeros(len(a), bool)
        while len(live):
            key = a * _PAIR + b
            at = np.searchsorted(self.made, key)
            score = np.where(self.made[at] == key, self.made_score[at], np.nan)
            lost = (score > over) | (equal & (score == over))
            out[live[lost]] = False
            go = ~lost & ((a >= 0) | (b >= 0))
            live, a, b = live[go], a[go], b[go]
            of_a, of_b = np.where(a >= 0, self.scores[a], np.inf), np.where(b >= 0, self.scores[b], np.inf)
            back = (b < 0) | ((a >= 0) & (of_a < of_b))  # the later merge is taken back
            over, equal = np.where(back, of_a, of_b), ~back
            a, b = np.where(back, self.right[a], a), np.where(back, b, self.left[b])
        return out

    @classmethod
    def parse(cls, model: bytes) -> Vocabulary:
        """From a model file's bytes."""
        import sentencepiece

        given = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces, specials, byte_ids = {}, {}, [0] * 256
        for i in range(given.get_piece_size()):
            p = given.id_to_piece(i)
            if given.is_byte(i):
                byte_ids[int(p[3:5], 16)] = i
            elif given.is_control(i) or given.is_unknown(i) or given.is_unused(i):
                specials[i] = p
            else:
                pieces[p] = (i, given.get_score(i))
        return cls(pieces, byte_ids, specials)

    def parts(self, piece: str) -> tuple[str, str] | None:
        """The two pieces whose merge makes this one from its characters; None if merging doesn't make it."""
        if piece not in self.split:
            self.split[piece] = None
            for k in range(1, len(piece)):
                left, right = piece[:k], piece[k:]
                made = all(len(x) == 1 or x in self.score and self.parts(x) for x in (left, right))
                if made and self.stay(left, right, below=self.score[piece]):
                    self.split[piece] = left, right
                    break
        return self.split[piece]

    def beside(self, left: int, right: int) -> bool:
        """Whether merging leaves the pieces of these numbers beside each other; the answers are remembered."""
        if len(self.fits) > REMEMBERED:
            self.fits.clear()
        key = left * _PAIR + right
        self.fits[key] = self.stay(self.names[left] if left >= 0 else chr(-left - 1), self.names[right])
        return self.fits[key]

    def single(self, char: str) -> list[int]:
        """A character's id, or its bytes'."""
        i = self.id_of.get(char)
        return [i] if i is not None else [self.byte_ids[b] for b in char.encode("utf-8", "replace")]

    def stay(self, a: str, b: str, below: float = -np.inf) -> bool:
        """Whether merging leaves these two beside each other: no merge over the seam comes before theirs.

        It takes back the merges at the seam, the latest first. A merge over the seam that is better
        than the one taken back would have come first; of equals the leftmost comes first. With
        `below`, merges over the seam no better than that don't count.
        """
        over, equal = below, False  # what a merge over the seam must beat, or also match
        while True:
            joined = self.score.get(a + b)
            if joined is not None and (joined > over or equal and joined == over):
                return False
            if len(a) == 1 and len(b) == 1:
                return True
            if len(b) == 1 or len(a) > 1 and self.score[a] < self.score[b]:
                over, equal, a = self.score[a], False, self.parts(a)[1]
            else:
                over, equal, b = self.score[b], True, self.parts(b)[0]


def suffixes(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of all suffixes in order of their first `depth` characters."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    step, order = 1, np.argsort(rank, kind="stable")
    while step < depth:
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1
        both = rank * (n + 1) + after
        order = np.argsort(both, kind="stable")
        ranked = both[order]
        new = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if n and new[-1] == n - 1:
            break
        step *= 2
    return order


def occurrences(text: np.ndarray, order: np.ndarray, levels: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """(place, piece number) of every occurrence of every piece, by binary search among the suffixes.

    All prefixes of a length are looked up at once, each in the range of the one it continues.
    """
    padded = np.concatenate([text, np.full(len(levels), _GAP, text.dtype)]).astype(np.int64)
    low, high = np.zeros(1, np.int64), np.full(1, len(order), np.int64)
    places, pieces = [], []
    for depth, (above, char, ends, numbers) in enumerate(levels):
        bounds = []
        for goal in (char, char + 1):
            a, b = low[above], high[above]
            live = np.flatnonzero(a < b)
            x, y, z = a[live], b[live], goal[live]
            while len(live):
                mid = (x + y) // 2
                less = padded[order[mid] + depth] < z
                x, y = np.where(less, mid + 1, x), np.where(less, y, mid)
                done = x >= y
                a[live[done]] = x[done]
                live, x, y, z = live[~done], x[~done], y[~done], z[~done]
            bounds.append(a)
        low, high = bounds[0], np.maximum(bounds[0], np.where(low[above] < high[above], bounds[1], 0))
        found = high[ends] - low[ends]
        at = np.arange(found.sum()) - np.repeat(np.cumsum(found) - found, found) + np.repeat(low[ends], found)
        places.append(order[at])
        pieces.append(np.repeat(numbers, found))
    return np.concatenate(places), np.concatenate(pieces)


def encode_units(units: list[str], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The piece ids of all units, one after another, and how many each has."""
    ids, counts, at = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], 0
    while at < len(units):
        size, to = 0, at
        while to < len(units) and (size < INDEX_CHARS or to == at):
            size += len(units[to]) + 1
            to += 1
        own, n = _encode(units[at:to], vocabulary)
        ids.append(own)
        counts.append(n)
        at = to
    return np.concatenate(ids), np.concatenate(counts)


def _encode(units: list[str], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, units), np.int64, len(units))
    text = np.frombuffer(("\0".join(units) + "\0").encode("utf-32-le"), np.uint32).astype(np.int64)
    base = np.cumsum(sizes + 1) - sizes - 1
    text[base + sizes] = _GAP
    starts, which = occurrences(text, suffixes(text, v.depth), v.levels)
    order = np.argsort((starts + v.lengths[which]) * (v.depth + 1) - v.lengths[which])  # by end, the longest first
    starts, which = starts[order], which[order]
    first = np.searchsorted(starts + v.lengths[which], np.arange(len(text) + 2))
    last = np.empty(len(text) + 1, np.int64)  # the last piece of the prefix that ends there
    last[1:] = -1 - text
    # Prefixes of one length of all units are relaxed together, while there are many such units.
    by_size = np.argsort(-sizes, kind="stable")
    ends = np.bincount(sizes)
    left = len(units) - np.cumsum(ends)  # units longer than k
    k, most = 1, len(ends) - 1
    while k <= most and left[k - 1] >= FEW:
        _relax(base[by_size[: left[k - 1]]], k, starts, which, first, last, v)
        k += 1
    for u in by_size[: left[k - 1]] if k <= most else ():
        _relax_one(int(base[u]), k, int(sizes[u]), starts, which, first, last, v)
    # Back from the ends: where pieces begin.
    cut = np.zeros(len(text) + 1, bool)
    at, bottom = base + sizes, base
    while len(at) >= FEW:
        cut[at] = True
        piece = last[at]
        at = at - np.where(piece >= 0, v.lengths[piece], 1)
        go = at > bottom
        at, bottom = at[go], bottom[go]
    for x, least in zip(at.tolist(), bottom.tolist(), strict=True):
        while x > least:
            cut[x] = True
            x -= int(v.lengths[last[x]]) if last[x] >= 0 else 1
    where = np.flatnonzero(cut)
    pieces, unit = last[where], np.searchsorted(base, where, side="left") - 1
    return _ids(pieces, unit, len(units), v)


def _relax(base: np.ndarray, k: int, starts: np.ndarray, which: np.ndarray, first: np.ndarray, last: np.ndarray, v: Vocabulary) -> None:
    """Set the last pieces of the prefixes of length k, for units that start at base."""
    here = base + k
    edge, stop = first[here], first[here + 1]
    go = np.flatnonzero(edge < stop)
    here, base, edge, stop = here[go], base[go], edge[go], stop[go]
    while len(here):
        piece, start = which[edge], starts[edge]
        whole = start == base
        stays = whole.copy()
        some = np.flatnonzero(~whole)
        stays[some] = v.stay_all(last[start[some]], piece[some])
        last[here[stays]] = piece[stays]
        edge = edge + 1
        go = ~stays & (edge < stop)
        here, base, edge, stop = here[go], base[go], edge[go], stop[go]


def _relax_one(base: int, k: int, size: int, starts: np.ndarray, which: np.ndarray, first: np.ndarray, last: np.ndarray, v: Vocabulary) -> None:
    """The same for one unit, from length k on."""
    cuts = first[base + k : base + size + 2].tolist()
    begins, pieces = starts[cuts[0] : cuts[-1]].tolist(), which[cuts[0] : cuts[-1]].tolist()
    own, fits = last[base : base + size + 1].tolist(), v.fits
    for at in range(k, size + 1):
        for edge in range(cuts[at - k] - cuts[0], cuts[at - k + 1] - cuts[0]):
            before = begins[edge] - base
            if before:
                key = own[before] * _PAIR + pieces[edge]
                stays = fits.get(key)
                if stays is None:
                    stays = v.beside(own[before], pieces[edge])
                if not stays:
                    continue
            own[at] = pieces[edge]
            break
    last[base : base + size + 1] = own


def _ids(pieces: np.ndarray, unit: np.ndarray, n: int, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The ids of numbered pieces, and how many each unit has; unknown characters give their bytes' ids."""
    alone = np.flatnonzero(pieces < 0)
    ids = v.numbers[np.maximum(pieces, 0)] if len(v.numbers) else np.zeros(len(pieces), np.int32)
    chars, of = np.unique(-1 - pieces[alone], return_inverse=True)
    own = [v.single(chr(c)) for c in chars.tolist()]
    ids[alone] = np.array([x[0] for x in own] or [0], np.int32)[of] if len(alone) else 0
    width = np.ones(len(pieces), np.int64)
    width[alone] = np.array([len(x) for x in own], np.int64)[of] if len(alone) else 1
    if (width > 1).any():
        flat = np.repeat(ids, width)
        head = np.cumsum(width) - width
        for k in alone[width[alone] > 1].tolist():
            flat[head[k] : head[k] + width[k]] = v.single(chr(-1 - pieces[k]))
        ids = flat
    return ids.astype(np.int32), np.bincount(unit, weights=width, minlength=n).astype(np.int64)


_UNIT = re.compile(f"{MARK}+[^{MARK}]*")


def units_of(text: str) -> list[str]:
    """Units of a text, spaces as word marks and one mark before it: runs of marks with what follows."""
    return _UNIT.findall(MARK + text.replace(" ", MARK)) if text else []


def decode(ids: list[int], v: Vocabulary) -> str:
    """The text of piece ids: bytes joined as UTF-8, marks as spaces, the first one dropped; specials give nothing."""
    text = b"".join([v.raw[i] for i in ids]).decode("utf-8", "replace")
    return (text[1:] if text.startswith(MARK) else text).replace(MARK, " ")


class Encoder:
    """Encodes texts, and remembers the ids of short units that it met twice lately: at most REMEMBERED of
    them, so its memory has a bound whatever the texts. A worker keeps one."""

    def __init__(self, model: bytes):
        self.vocabulary = Vocabulary.parse(model)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.met = np.zeros(0, np.int32)
        self.ids, self.counts = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """The piece ids of each text; units not known are encoded together."""
        known, old, own = self.known, len(self.known), []
        for t in texts:
            own.append(np.array([known.setdefault(u, len(known)) for u in units_of(t)], np.int64))
        units = list(islice(known, old, None))
        ids, counts = encode_units(units, self.vocabulary)
        self.ids, self.counts = np.concatenate([self.ids, ids]), np.concatenate([self.counts, counts])
        head = np.cumsum(self.counts) - self.counts
        out = [self.ids[_runs(head[x], self.counts[x])] for x in own]
        self.met = np.concatenate([self.met, np.zeros(len(units), np.int32)])
        for x in own:
            np.add.at(self.met, x, 1)
        if len(known) > REMEMBERED or any(len(u) > SHORT for u in units):
            self._shrink(head)
        return out

    def _shrink(self, head: np.ndarray) -> None:
        """Forget long units; when there are too many, those met once, and all if too many are left."""
        full = len(self.known) > REMEMBERED
        kept = [(u, k) for u, k in self.known.items() if len(u) <= SHORT and (not full or self.met[k] > 1)]
        if len(kept) > REMEMBERED // 2:
            kept = [(u, k) for u, k in kept if self.met[k] > 2]
        if len(kept) > REMEMBERED // 2:
            self.forget()
            return
        at = np.array([k for _, k in kept], np.int64)
        self.ids, self.counts = self.ids[_runs(head[at], self.counts[at])], self.counts[at]
        self.known, self.met = {u: k for k, (u, _) in enumerate(kept)}, self.met[at] // 2 if full else self.met[at]


def _runs(head: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places head, head + 1, ... of each run."""
    return np.arange(counts.sum()) + np.repeat(head - (np.cumsum(counts) - counts), counts)


@lru_cache(maxsize=1)
def encoder_of(model: bytes) -> Encoder:
    """A worker's encoder."""
    return Encoder(model)


def _parts(texts: pd.Series) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about TEXT_CHARS characters; a longer text is alone in its range."""
    at = np.cumsum([0, *texts.str.len()])
    i = 0
    while i < len(texts):
        j = min(max(int(np.searchsorted(at, at[i] + TEXT_CHARS, side="right")) - 1, i + 1), len(texts))
        yield i, j
        i = j


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """docs with two more columns, tokens (array of ids) and n_tokens (replacing columns of these names), like the
    model's own encoding.

    The model file is read on the driver and goes with the tasks (its size does not depend on the
    data). A null or empty text has no tokens. Whole texts are encoded; there is no shuffle.
    """
    with open(model_path, "rb") as file:
        model = file.read()

    @F.pandas_udf("array<int>")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = encoder_of(model)
        for text in released(batches):
            out: list[np.ndarray] = []
            for i, j in _parts(text):
                out += encoder(text.iloc[i:j].tolist())
            yield pd.Series(out, dtype=object)

    out = docs.withColumn("tokens", tokens(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    return out.withColumn("n_tokens", F.size("tokens").cast("long"))


def decoded(docs: DataFrame, model_path: str) -> DataFrame:
    """docs, which has tokens, with one more column, decoded (replacing one of this name): their text; null tokens give
    an empty one."""
    with open(model_path, "rb") as file:
        model = file.read()

    @F.pandas_udf("string")
    def text(tokens: pd.Series) -> pd.Series:
        return pd.Series([decode(x, encoder_of(model).vocabulary) if x is not None else "" for x in tokens], dtype=object)

    return docs.withColumn("decoded", text("tokens"))


def coded(docs: DataFrame, model_path: str) -> DataFrame:
    """docs with tokens and n_tokens as from encode() (columns of docs by the names of these four are replaced), and what decoding these gives: decoded_sha256, and
    round_trip, whether it is the text (an empty one for a null). One pass, no shuffle."""
    with open(model_path, "rb") as file:
        model = file.read()

    @F.pandas_udf("tokens array<int>, decoded_sha256 string, round_trip boolean")
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = encoder_of(model)
        for text in released(batches):
            ids: list[np.ndarray] = []
            sums, same = [], []
            for i, j in _parts(text):
                own = text.iloc[i:j].tolist()
                found = encoder(own)
                for t, x in zip(own, found, strict=True):
                    back = decode(x.tolist(), encoder.vocabulary)
                    sums.append(hashlib.sha256(back.encode()).hexdigest())
                    same.append(back == t)
                ids += found
            yield pd.DataFrame({"tokens": pd.Series(ids, dtype=object), "decoded_sha256": sums, "round_trip": same})

    out = docs.withColumn("__coded", both(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    fields = [F.col(f"__coded.{c}").alias(c) for c in ("tokens", "decoded_sha256", "round_trip")]
    given = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("tokens", "decoded_sha256", "round_trip", "n_tokens")]
    return out.select(*given, *fields).withColumn("n_tokens", F.size("tokens").cast("long"))


CHECKED = "doc_id long, n_chars long, n_tokens long, tokens_sha256 string, decoded_sha256 string, round_trip boolean"


def round_trips(docs: DataFrame, model_path: str) -> DataFrame:
    """CHECKED rows: how each text was encoded, and whether decoding gives it back, in one pass.

    tokens_sha256 is of the ids as little-endian 32-bit integers. A text that holds the word mark
    itself comes back with a space in its place, so it makes no round trip.
    """
    with open(model_path, "rb") as file:
        model = file.read()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = encoder_of(model)
        for batch in released(batches):
            for i, j in _parts(batch["text"]):
                part = batch.iloc[i:j]
                ids = encoder(part["text"].tolist())
                back = [decode(x.tolist(), encoder.vocabulary) for x in ids]
                yield pd.DataFrame({
                    "doc_id": part["doc_id"], "n_chars": part["text"].str.len(), "n_tokens": [len(x) for x in ids],
                    "tokens_sha256": [hashlib.sha256(x.tobytes()).hexdigest() for x in ids],
                    "decoded_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in back],
                    "round_trip": [a == b for a, b in zip(part["text"], back, strict=True)],
                })

    return rows.mapInPandas(run, CHECKED)

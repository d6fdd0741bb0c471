"""Repeated passages by fixed-block anchors.

Every document's words are cut into non-overlapping reference blocks of half a window. Any repeated
window holds one whole block of its other occurrence, so probing the block index with every rolling
window of block length finds a hit inside each repeat. Only around hits are whole windows compared: a
window repeats if its word sequence starts at two places or more, and the runs of such windows are the
maximal exact repeats.

Both look-ups are exchanges of packed keys. Documents are dealt into bundles; a bundle sends each
distinct key once to the key's part, so a passage that a third of all documents hold arrives once from
each bundle, and gets back one bit a key. Bundles and parts are dealt one to a partition.
"""

from __future__ import annotations

import hashlib
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairmend.llm import kernels as K

WINDOW = 35
#: Characters of text in a bundle, which one task holds; a longer document is a bundle of its own size.
BUNDLE_CHARS = 6_000_000
#: Keys of one part come from all bundles; so many bundles at most share a part's number of keys.
KEYS_IN_PART = 4_000_000

SENT = "part int, bundle int, keys binary, marks binary"
REPLY = "bundle int, part int, hits binary"


class _Bundle:
    """The words of some documents, their hashes, and where windows may start."""

    def __init__(self, table: pa.Table, window: int):
        order = pc.sort_indices(table, sort_keys=[("doc_id", "ascending"), ("text", "ascending")])
        table = table.take(order)
        self.ids, self.window, self.block = table.column("doc_id").combine_chunks(), window, (window + 1) // 2
        self.data, self.at = K.text_bytes(table.column("text"))
        words, second, self.starts, self.ends, first, total = [], [], [], [], [np.zeros(1, np.int64)], 0
        for i, j in K.slices(self.at):
            part = self.data[self.at[i] : self.at[j]]
            starts, ends, words_at = K.word_bounds(part, self.at[i : j + 1] - self.at[i])
            for into, hashes in zip((words, second), K.word_lanes(part, starts, ends), strict=True):
                into.append(hashes)
            self.starts.append(starts + self.at[i])
            self.ends.append(ends + self.at[i])
            first.append(words_at[1:] + total)
            total += len(starts)
        none = [np.zeros(0, np.int64)]
        self.words, self.second = (np.concatenate(x or [np.zeros(0, np.uint64)]) for x in (words, second))
        self.starts, self.ends = np.concatenate(self.starts or none), np.concatenate(self.ends or none)
        self.first = np.concatenate(first)
        sizes = np.diff(self.first)
        self.place = np.arange(total) - np.repeat(self.first[:-1], sizes)
        self.left = np.repeat(sizes, sizes) - self.place

    def probes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of all rolling windows of block length, their keys, and which are reference blocks."""
        at = np.flatnonzero(self.left >= self.block)
        keys = K.window_hashes(self.words, self.block)[at] if len(at) else np.zeros(0, np.uint64)
        return at, keys, self.place[at] % self.block == 0

    def candidates(self, hit_at: np.ndarray) -> np.ndarray:
        """Starts of the windows that hold a hit."""
        hits = np.zeros(len(self.words) + 1, np.int64)
        hits[hit_at + 1] = 1
        hits = np.cumsum(hits)
        at = np.flatnonzero(self.left >= self.window)
        return at[hits[at + self.window - self.block + 1] > hits[at]]

    def windows(self, at: np.ndarray) -> np.ndarray:
        """128-bit keys of the windows that start there, of two independent hashes of each word."""
        out = np.zeros((len(at), 2), np.uint64)
        if len(at):
            out[:, 0] = K.window_hashes(self.words, self.window)[at]
            out[:, 1] = K.window_hashes(self.second, self.window)[at]
        return out


def _part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys >> np.uint64(40)) % np.uint64(parts)).astype(np.int64)


def _by_part(keys: np.ndarray, parts: int):
    """(part, places of its keys) over sorted distinct keys, parts ascending."""
    part = _part_of(keys, parts)
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    return [(k, order[a:b]) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and each key's place among them."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    inverse = np.empty(len(keys), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return ranked[new], inverse


def _batch(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
    return pa.table({n: pa.array(c, kinds[k]) for (n, k), c in zip(fields, columns, strict=True)})


def _send_probes(parts: int, window: int):
    def run(table: pa.Table) -> pa.Table:
        bundle = _Bundle(table, window)
        _, keys, is_block = bundle.probes()
        each, inverse = _distinct(keys)
        count = np.bincount(inverse, minlength=len(each)) if len(each) else np.zeros(0, np.int64)
        blocks = np.bincount(inverse, weights=is_block, minlength=len(each)) if len(each) else np.zeros(0)
        marks = (count > 1) + 2 * (blocks > 0).astype(np.uint8)
        low = each.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]  # a part and 40 bits: false hits only cost time
        name = table.column("bundle")[0].as_py()
        return _batch([(k, name, low[at].tobytes(), marks[at].astype(np.uint8).tobytes()) for k, at in _by_part(each, parts)], SENT)

    return run


def _answer(width: int, need_block: bool):
    """For each bundle's keys one bit: the key is met twice (and, for probes, is a reference block somewhere)."""

    def run(table: pa.Table) -> pa.Table:
        names, part = table.column("bundle").to_pylist(), table.column("part")[0].as_py()
        sent = [np.frombuffer(x.as_buffer(), np.uint8).reshape(-1, width) for x in table.column("keys")]
        marks = np.concatenate([np.frombuffer(x.as_buffer(), np.uint8) for x in table.column("marks")])
        every = np.concatenate(sent)
        if width <= 8:
            wide = np.zeros((len(every), 8), np.uint8)
            wide[:, :width] = every
            keys = wide.view("<u8").ravel()
        else:
            two = np.ascontiguousarray(every).view("<u8").reshape(-1, 2)
            low, high = _distinct(two[:, 0])[1], _distinct(two[:, 1])[1]
            keys = (low.astype(np.uint64) << np.uint64(32)) | high.astype(np.uint64)
        each, inverse = _distinct(keys)
        twice = np.bincount(inverse, weights=1 + (marks & 1), minlength=len(each)) > 1
        if need_block:
            twice &= np.bincount(inverse, weights=marks >> 1, minlength=len(each)) > 0
        hit, cuts = twice[inverse], np.cumsum([0, *map(len, sent)])
        return _batch([(n, part, np.packbits(hit[a:b]).tobytes()) for n, a, b in zip(names, cuts[:-1], cuts[1:], strict=True)], REPLY)

    return run


def _hits(each: np.ndarray, replies: pa.Table, parts: int) -> np.ndarray:
    """Which of the bundle's distinct keys the parts called hits."""
    out = np.zeros(len(each), bool)
    said = dict(zip(replies.column("part").to_pylist(), replies.column("hits").to_pylist(), strict=True))
    for k, at in _by_part(each, parts):
        out[at] = np.unpackbits(np.frombuffer(said[k], np.uint8), count=len(at)).astype(bool)
    return out


def _probe_hits(bundle: _Bundle, replies: pa.Table, parts: int) -> np.ndarray:
    at, keys, _ = bundle.probes()
    each, inverse = _distinct(keys)
    return at[_hits(each, replies, parts)[inverse]] if len(at) else at


def _send_windows(parts: int, window: int):
    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _batch([], SENT)
        bundle = _Bundle(docs, window)
        keys = bundle.windows(bundle.candidates(_probe_hits(bundle, replies, parts)))
        each, inverse = _distinct(keys[:, 0])
        first = np.zeros(len(each), np.int64)
        first[inverse[::-1]] = np.arange(len(keys))[::-1]
        marks = (np.bincount(inverse, minlength=len(each)) > 1).astype(np.uint8) if len(each) else np.zeros(0, np.uint8)
        name = docs.column("bundle")[0].as_py()
        return _batch([(k, name, keys[first[at]].astype("<u8").tobytes(), marks[at].tobytes()) for k, at in _by_part(each, parts)], SENT)

    return run


def _cover(parts: int, window: int, out: str):
    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        rows = {"doc_id": [], "n_words": [], "n_removed": [], "text": []}
        if docs.num_rows:
            bundle = _Bundle(docs, window)
            probes = replies.filter(pc.equal(replies.column("stage"), 1))
            at = bundle.candidates(_probe_hits(bundle, probes, parts))
            each, inverse = _distinct(bundle.windows(at)[:, 0])
            again = at[_hits(each, replies.filter(pc.equal(replies.column("stage"), 2)), parts)[inverse]] if len(at) else at
            depth = np.zeros(len(bundle.words) + window + 1, np.int64)
            np.add.at(depth, again, 1)
            np.add.at(depth, again + window, -1)
            gone = np.cumsum(depth)[: len(bundle.words)] > 0
            raw = bundle.data.tobytes()
            for k, doc_id in enumerate(bundle.ids.to_pylist()):
                a, b = bundle.first[k], bundle.first[k + 1]
                kept = np.flatnonzero(~gone[a:b]) + a
                text = b" ".join([raw[i:j] for i, j in zip(bundle.starts[kept].tolist(), bundle.ends[kept].tolist(), strict=True)])
                rows["doc_id"].append(doc_id)
                rows["n_words"].append(int(b - a))
                rows["n_removed"].append(int(b - a - len(kept)))
                rows["text"].append(hashlib.sha256(text).hexdigest() if out == "kept_sha256" else text.decode())
        made = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "text": pa.string()}
        return pa.table({n: pa.array(v, made[n]) for n, v in rows.items()}).rename_columns(["doc_id", "n_words", "n_removed", out])

    return run


def repeated_passages(docs: DataFrame, window: int = WINDOW, digest: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, and the kept words joined by one space.

    A word goes if it is in a run of `window` words whose sequence also starts anywhere else, in the
    same document or another; runs are judged on the input. The last column is kept_text, or with
    digest kept_sha256 (of its UTF-8). A null or empty text has no words; a document shorter than a
    window loses none; every occurrence of a repeat goes, copies of a document wholly, and rows that repeat a
    doc_id, or have none, are documents of their own. Other columns of docs are left alone. No rows in, no rows out.
    """
    if window < 2:
        raise ValueError("a window has two words at least")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    n, chars = rows.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    bundles = max(1, ceil(chars / BUNDLE_CHARS))
    parts = max(1, ceil(chars / 5 / KEYS_IN_PART))
    parts = max(parts, min(bundles, 16))
    held = rows.withColumn("bundle", F.pmod(F.xxhash64("doc_id", F.length("text"), F.monotonically_increasing_id()), F.lit(bundles)).cast("int"))  # copies part too
    dealt = held.repartitionById(bundles, "bundle")  # shuffled once: later uses in the plan read the same files
    sent = dealt.groupBy("bundle").applyInArrow(_send_probes(parts, window), SENT)
    probes = sent.repartitionById(parts, "part").groupBy("part").applyInArrow(_answer(5, True), REPLY)
    first = probes.repartitionById(bundles, "bundle").groupBy("bundle")
    sent = dealt.groupBy("bundle").cogroup(first).applyInArrow(_send_windows(parts, window), SENT)
    found = sent.repartitionById(parts, "part").groupBy("part").applyInArrow(_answer(16, False), REPLY)
    replies = probes.withColumn("stage", F.lit(1)).union(found.withColumn("stage", F.lit(2)))
    out = "kept_sha256" if digest else "kept_text"
    last = replies.repartitionById(bundles, "bundle").groupBy("bundle")
    return dealt.groupBy("bundle").cogroup(last).applyInArrow(_cover(parts, window, out), f"doc_id long, n_words long, n_removed long, {out} string")

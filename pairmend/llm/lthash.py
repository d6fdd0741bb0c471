"""Document fingerprints: homomorphic multiset hashes of paragraphs.

A paragraph is a maximal run without newlines; it is hashed to a wide vector. A text's fingerprint is
the sum of its paragraphs' vectors, modulo a power of two in each lane, so the order of the paragraphs
does not matter, and a paragraph is added or removed by adding or subtracting its vector.

A vector has two parts. A digest of the whole paragraph, as wide as the lanes, fills the first lanes (modulo
2 ** 64), by which multisets of paragraphs are told apart. The other lanes (modulo 2 ** 16) get +1 or -1 for each pair of
neighbouring words, at a lane that the pair's hash picks; sums of these keep inner products, so two
fingerprints tell how much two texts share.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairmend.llm import kernels as K

WIDE, NEAR = 16, 256


def vectors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each text the sums of its paragraphs' wide lanes (uint64) and near lanes (int64)."""
    wide, near = np.zeros((len(texts), WIDE), np.uint64), np.zeros((len(texts), NEAR), np.int64)
    at = np.cumsum([0, *map(len, texts)])
    every = np.frombuffer(b"".join(texts), np.uint8)
    for i, j in K.slices(at):
        data, offsets = every[at[i] : at[j]], at[i : j + 1] - at[i]
        _add(data, offsets, wide[i:j], near[i:j])
    return wide, near


def _add(data: np.ndarray, offsets: np.ndarray, wide: np.ndarray, near: np.ndarray) -> None:
    line = data == 10
    cut = np.union1d(offsets, np.flatnonzero(line) + 1)
    starts = cut[:-1]
    ends = cut[1:] - ((cut[1:] > 0) & line[cut[1:] - 1])
    starts, ends = starts[ends > starts], ends[ends > starts]
    if not len(starts):
        return
    text_of = np.searchsorted(offsets, starts, side="right") - 1
    raw = data.tobytes()
    digests = b"".join([hashlib.shake_128(raw[a:b]).digest(8 * WIDE) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
    own, first = np.unique(text_of, return_index=True)
    wide[own] += np.add.reduceat(np.frombuffer(digests, "<u8").reshape(-1, WIDE), first, axis=0)
    first, last, _ = K.word_bounds(data, offsets)
    words = K.word_hashes(data, first, last)
    home = np.searchsorted(starts, first, side="right") - 1
    pair = np.flatnonzero(home[:-1] == home[1:]) if len(home) > 1 else np.zeros(0, np.int64)
    lone = np.flatnonzero(np.bincount(home, minlength=len(starts))[home] == 1)
    keys = np.concatenate([K.mix(words[pair] * np.uint64(0x9E3779B97F4A7C15) + words[pair + 1]), words[lone]])
    lane = (keys >> np.uint64(8)) % np.uint64(NEAR)
    of = text_of[home[np.concatenate([pair, lone])]]
    sign = 1 - 2 * (keys & np.uint64(1)).astype(np.int64)
    sums = np.bincount(of * NEAR + lane.astype(np.int64), weights=sign, minlength=len(near) * NEAR)
    near += sums.reshape(near.shape).astype(np.int64)


def pack(wide: np.ndarray, near: np.ndarray) -> str:
    """The fingerprint as text."""
    return base64.b64encode(wide.astype("<u8").tobytes() + (near & 0xFFFF).astype("<u2").tobytes()).decode()


def unpack(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    raw = base64.b64decode(fingerprint)
    near = np.frombuffer(raw, "<u2", offset=WIDE * 8).astype(np.int64)
    return np.frombuffer(raw, "<u8", WIDE).astype(np.uint64), np.where(near >= 1 << 15, near - (1 << 16), near)


def fingerprint(text: str | None) -> str:
    wide, near = vectors([(text or "").encode()])
    return pack(wide[0], near[0])


def add(left: str, right: str, sign: int = 1) -> str:
    """The fingerprint of both texts' paragraphs together; with sign -1, of left without right's."""
    (a, x), (b, y) = unpack(left), unpack(right)
    return pack(a + b if sign > 0 else a - b, x + sign * y)


def likeness(x: np.ndarray, y: np.ndarray) -> float:
    """From near lanes as a fingerprint holds them: shared over all word pairs, estimated, in 0..1; 1 for equal lanes."""
    x, y = (((v + (1 << 15)) & 0xFFFF) - (1 << 15) for v in (x, y))
    size = float(x @ x + y @ y)
    return 1.0 if not size or np.array_equal(x, y) else min(1.0, max(0.0, 2.0 * float(x @ y) / size))


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs' doc_id, n_chars (code points) and fingerprint, one row each; a null text is empty."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            wide, near = vectors([t.encode() for t in batch["text"]])
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_chars": batch["text"].str.len(), "fingerprint": [pack(a, b) for a, b in zip(wide, near, strict=True)]})

    return rows.mapInPandas(run, "doc_id long, n_chars long, fingerprint string")


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
#: Rows in a run of neighbours, and the most runs (their bounds are all that the driver holds).
RUN_ROWS, MOST_RUNS = 5_000, 10_000
_NULL = -(1 << 63)


def _pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """EDITED rows from rows (run, copied, doc_id, text) in order: each row with the one after it."""
    held = None
    for batch in batches:
        if held is not None:
            batch = pd.concat([held, batch], ignore_index=True)
        held = batch.iloc[-1:]
        for i, j in K.slices(np.cumsum([0, *batch["text"].str.len()])):
            made = _edit(batch.iloc[i : j + 1])
            if len(made):  # an empty frame has no string columns
                yield made


def _edit(rows: pd.DataFrame) -> pd.DataFrame:
    """For all rows but the last: what it and its successor give; copied rows only follow."""
    texts = rows["text"].tolist()
    wide, near = vectors([t.encode() for t in texts])
    own = [k for k in range(len(texts) - 1) if not rows["copied"].iat[k]]
    new = [texts[k][: len(texts[k]) - len(texts[k]) // 2] + texts[k + 1][: len(texts[k]) // 2] for k in own]
    raw = [t.encode() for t in new]
    wide_new, near_new = vectors(raw)
    out = {
        "doc_id": rows["doc_id"].iloc[own].to_numpy(),
        "n_chars": [len(texts[k]) for k in own],
        "edited_sha256": [hashlib.sha256(t).hexdigest() for t in raw],
        "fingerprint": [pack(wide[k], near[k]) for k in own],
        "edited_fingerprint": [pack(a, b) for a, b in zip(wide_new, near_new, strict=True)],
        "near_edited": [likeness(near[k], b) for k, b in zip(own, near_new, strict=True)],
        "near_next": [likeness(near[k], near[k + 1]) for k in own],
    }
    return pd.DataFrame(out)


def edited(docs: DataFrame) -> DataFrame:
    """EDITED rows: each text's fingerprint, that of its edited text, and how alike they are.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many (or all)
    of the next document, by ascending doc_id; the first follows the last. Documents are dealt by ranges
    of doc_id into runs, each with a copy of the next run's first document, so texts are shuffled once
    and no task orders them all.

    Rows of one doc_id are in one run, which is read in order and never held whole.
    Defined results: a null text is empty; a null doc_id comes first; rows that repeat a doc_id go by
    text; a document alone follows itself; equal texts have equal fingerprints, and two texts without
    words are alike by 1. No rows in, no rows out.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.coalesce("doc_id", F.lit(_NULL)))
    runs = min(max(1, rows.count() // RUN_ROWS), MOST_RUNS)
    cuts = rows.agg(F.percentile_approx("key", [k / runs for k in range(1, runs)], 20 * runs)).first()[0] if runs > 1 else None
    bounds = np.array(sorted(set(cuts or [])), np.int64)

    @F.pandas_udf("long")
    def run_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, key.to_numpy(), side="right"))

    firsts = sorted(rows.groupBy(run_of("key").alias("run")).agg(F.min("key").alias("first")).collect())
    before = {r["first"]: firsts[k - 1]["run"] for k, r in enumerate(firsts)}

    @F.pandas_udf("array<long>")
    def runs_of(key: pd.Series) -> pd.Series:
        own = np.searchsorted(bounds, key.to_numpy(), side="right")
        return pd.Series([[r, before[k]] if k in before else [r] for r, k in zip(own.tolist(), key.tolist(), strict=True)])

    dealt = rows.select("doc_id", "key", "text", F.posexplode(runs_of("key")).alias("copied", "run"))
    dealt = dealt.withColumn("copied", F.col("copied") > 0).repartitionById(runs, F.col("run").cast("int"))  # one run a partition
    return dealt.sortWithinPartitions("run", "copied", "key", "text").select("run", "copied", "doc_id", "text").mapInPandas(_pairs, EDITED)

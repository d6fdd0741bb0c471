"""Importance resampling towards a target distribution, over hashed runs of words.

Every text's features are its runs of one and more consecutive words; each falls into a bucket by CRC-32, derived from running
CRCs (prefixcrc). Buckets weigh by how much likelier they are in the target's texts than in the corpus; a document's
weight is its features' mean, and a draw without replacement takes the highest weights plus Gumbel noise.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairmend.llm import kernels as K
from pairmend.llm.common import delete, settle, written_at
from pairmend.llm.order import placed
from pairmend.llm.prefixcrc import word_runs

BUCKETS, LONGEST, SCALE = 10_000, 2, 1000
LEAST_WORDS, PERCENT, SEED = 20, 25, 7

COUNTED = "doc_id long, n_words long, n_features long, buckets array<int>, counts array<int>"


def counted(docs: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """doc_id, n_words, n_features and the text's buckets with their counts: at most `buckets` entries, however long a text is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.released(batches):
            data, offsets = K.text_bytes(batch.column(1))
            for i, j in K.slices(offsets):
                n_words, runs = word_runs(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], longest)
                keys = np.concatenate([text * buckets + crc % np.uint32(buckets) for text, crc in runs])
                keys, counts = np.unique(keys, return_counts=True)
                bounds = np.searchsorted(keys, np.arange(j - i + 1) * buckets).astype(np.int32)
                lists = [pa.ListArray.from_arrays(bounds, x.astype(np.int32)) for x in (keys % buckets, counts)]
                n_features = sum(np.maximum(n_words - k, 0) for k in range(longest))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n_words), pa.array(n_features), *lists], COUNTED_NAMES)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, COUNTED)


COUNTED_NAMES = [c.split(" ")[0] for c in COUNTED.split(", ")]


def totals(rows: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in all rows of counted(): summed in each task, then by bucket; `buckets` numbers come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(buckets, np.int64)
        for batch in batches:
            np.add.at(own, batch.column(0).flatten().to_numpy(), batch.column(1).flatten().to_numpy())
        there = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(own[there])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in rows.select("buckets", "counts").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(target: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """For each bucket, in thousandths, the log of its smoothed share of the target over that of the corpus, floored."""
    t, s, n = float(target.sum()), float(corpus.sum()), len(corpus)
    return np.array([math.floor(SCALE * math.log((a + 1.0) * (s + n) / ((b + 1.0) * (t + n)))) for a, b in zip(target.tolist(), corpus.tolist(), strict=True)], np.int64)


def weighed(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight, the floored mean of the gains of a text's features; 0 without any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(2).to_numpy()
            # Running sums tell each text's sum, empty ones included.
            sums = np.concatenate([[0], np.cumsum(gain[batch.column(3).flatten().to_numpy()] * batch.column(4).flatten().to_numpy())])
            sizes = np.cumsum([0, *np.diff(batch.column(3).offsets.to_numpy())])
            whole = sums[sizes[1:]] - sums[sizes[:-1]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(whole // np.maximum(n, 1))], ["doc_id", "n_words", "n_features", "weight"])

    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def gumbel(doc_id: str = "doc_id", seed: int = SEED) -> F.Column:
    """Standard Gumbel noise in thousandths, floored: a fixed function of the id; a null id counts as empty text."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-SCALE * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every row of docs, towards the texts of target.

    Of documents with at least least_words words, percent in a hundred are drawn, by score and then by smaller doc_id;
    rank counts them from 1, undrawn ones have none. Texts are scanned once: their bucket counts, at most
    `buckets` a text, are written to the shared folder and read from there for the corpus's counts and for the weights.

    Defined results: a null or empty text has no features and weight 0; a null doc_id comes before others of its score; rows that repeat
    a doc_id are judged by their own texts, and rows alike in score and id are ranked in any order among them; columns other than doc_id
    and text aren't read; without rows in target all its counts are 0; no documents give no rows.
    """
    own, path = written_at(counted(docs, buckets, longest), "bucket-counts")
    gain = gains(totals(counted(target.select(F.lit(None).alias("doc_id"), "text"), buckets, longest), buckets), totals(own, buckets))
    scored = settle(weighed(own, gain).withColumn("score", F.col("weight") + gumbel("doc_id", seed)))
    delete(docs.sparkSession, path)
    able = scored.filter(F.col("n_words") >= least_words).withColumn("__row", F.monotonically_increasing_id())
    drawn = able.count() * percent // 100
    ranked = placed(able, F.desc("score"), F.asc("doc_id"), F.asc("__row"), into="rank").drop("__row")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") < drawn, F.col("rank") + 1))
    return ranked.unionByName(scored.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))

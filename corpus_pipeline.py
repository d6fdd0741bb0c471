"""From raw documents to a tokenised training mix, in stages that each apply one operator.

Every stage takes documents with null or empty texts, null or repeated ids, and no documents at all. Rows
that repeat a doc_id are documents of their own to the classifier, the secret scan and the encoding; near-dedup
keeps one of those whose text (or set of shingles) repeats as well; the mix draws rows that repeat doc_id and text
as one document. Columns beyond those of documents go along; only the last stage returns columns of its own.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairmend.llm import minhash, mixing, nbsvm, secrets, spm
from pairmend.llm.common import delete, table, written_at
from pairmend.llm.queries import TOKENIZER


#: Rows of whole texts that go to a Python worker at a time, and the setting that says so.
BATCH_ROWS, BATCH = 1_000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def _in_small_batches(stage):
    """The stage, with Arrow batches of texts that leave a worker's memory to its work.

    What it returns is computed later, so the session keeps the setting; run() puts it back. (A session of
    the stage's own would start Python workers of its own beside those that are there.)
    """

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set(BATCH, BATCH_ROWS)
        return stage(spark, docs, sf_dir)

    return run


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones, doesn't reject."""
    return nbsvm.accepted(docs, nbsvm.train(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8 or more)."""
    return minhash.deduplicate(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their secrets replaced."""
    return _measured(secrets.redact(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: each document's drawn pieces, shard by shard."""
    return _measured(mixing.mix(docs).select(docs.columns))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces' tokens, and whether decoding them gives the pieces back."""
    return spm.coded(docs, TOKENIZER).select("doc_id", "lang", "source", "n_tokens", "tokens", "decoded_sha256", "round_trip")


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long"))


STAGES = [
    ("quality classifier", _in_small_batches(quality)),
    ("MinHash near-dedup", _in_small_batches(near_dedup)),
    ("secret scans", secret_scan),
    ("mixing sources to target weights", mix),
    ("SentencePiece encoding", _in_small_batches(encode)),
]

#: Training, signatures and tokens are not SQL: the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each one's result is written and read again, and deleted when the next one's is there; the session's settings stay as they were."""
    docs, given, last = table(spark, sf_dir, "documents"), spark.conf.get(BATCH), None
    try:
        for name, stage in STAGES:
            docs, path = written_at(stage(spark, docs, sf_dir), name.replace(" ", "-"))
            if last:
                delete(spark, last)
            last = path
    finally:
        spark.conf.set(BATCH, given)
    return docs

"""Reading and writing the stages' tables; names of artifacts."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairmend.schema import LOG, PLAN, QUEUE, RAW

# Artifact names by stem of the input.
ARTIFACTS = {
    "sieve": "sieve_results_{stem}.csv",
    "flagged": "flagged_rows_{stem}.csv",
    "embeddings": "clip_embeddings_{stem}.parquet",
    "reports": "mismatch_reports_{stem}.jsonl",
    "queue": "arbiter_queue_{stem}.csv",
    "plan": "arbiter_plan_{stem}.csv",
    "repaired": "repaired_{stem}.parquet",
    "log": "repair_log_{stem}.csv",
}
#: What another reader of the same files takes for a missing value.
NA_WORDS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def stem_of(path: str) -> str:
    """A path's last part without its suffix and without an artifact's own prefix."""
    stem = re.sub(r"\.[^.]*$", "", path.rstrip("/").rsplit("/", 1)[-1])
    for pattern in ARTIFACTS.values():
        stem = stem.removeprefix(pattern.split("{")[0])
    return stem


def artifact(kind: str, folder: str, source: str) -> str:
    return f"{folder.rstrip('/')}/{ARTIFACTS[kind].format(stem=stem_of(source))}"


def read_csv(spark: SparkSession, path: str, schema: str, pandas_na: bool = False) -> DataFrame:
    """A CSV with a header as `schema`: columns by name, those that the file lacks null, ids kept as text."""
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", True)
    given = reader.option("inferSchema", False).csv(path)
    kinds = [f.strip().rsplit(" ", 1) for f in schema.split(",")]
    value = lambda c: F.when(~F.col(f"`{c}`").isin(*NA_WORDS), F.col(f"`{c}`")) if pandas_na else F.col(f"`{c}`")
    return given.select(*[(value(c) if c in given.columns else F.lit(None)).try_cast(k.lower()).alias(c) for c, k in kinds])


def read_raw(spark: SparkSession, path: str, **how) -> DataFrame:
    return read_csv(spark, path, RAW, **how)


def read_queue(spark: SparkSession, path: str, **how) -> DataFrame:
    return read_csv(spark, path, QUEUE, **how)


def read_plan(spark: SparkSession, path: str, **how) -> DataFrame:
    return read_csv(spark, path, PLAN, **how)


def read_log(spark: SparkSession, path: str, **how) -> DataFrame:
    return read_csv(spark, path, LOG, **how)


def write_csv(df: DataFrame, path: str) -> None:
    """With a header, also when there are no rows."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').option("quoteAll", True).csv(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """One object a line, absent parts left out."""
    df.write.mode("overwrite").json(path)

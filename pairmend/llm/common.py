"""What the operators of this package share: reading, cutting lineage, checked broadcasts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairmend.sources.shared import delete, kept, set_shared_folder, settle  # noqa: F401  delete, kept and settle are for this package's operators

#: A word is a maximal run of bytes other than space and tab..carriage return.
SPACE = r"[\x20\x09-\x0D]+"

#: Rows of (id) or (id, small value) that may be broadcast: about 64 MB on each executor; and the bytes of
#: their strings and binaries, where they have some.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir."""
    set_shared_folder(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame, name: str) -> DataFrame:
    """df as Parquet in the shared folder, read again."""
    return written_at(df, name)[0]


def written_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The same with the path, for who deletes it when nothing reads it any more."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


#: Bytes of an element of an array that may be broadcast.
_ELEMENTS = {"bigint": 8, "double": 8, "int": 4, "float": 4}


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a settled df for broadcast if it has few enough rows and bytes of strings, binaries and arrays of numbers; else leave the join to a shuffle."""
    wide = []
    for c, kind in df.dtypes:
        element = kind.removeprefix("array<").removesuffix(">")
        if kind in ("string", "binary"):
            wide.append(F.coalesce(F.octet_length(c), F.lit(0)).cast("long"))
        elif element != kind and element in _ELEMENTS:
            wide.append(F.coalesce(F.size(c).cast("long") * _ELEMENTS[element], F.lit(0)))
        elif "<" in kind:
            return df
    if not wide:
        return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
    n, size = df.limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum(sum(wide[1:], wide[0])), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and size <= BROADCAST_BYTES else df


def words_of(text) -> F.Column:
    """The words of a text, in order; none for a null text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def n_words(text) -> F.Column:
    """How many words a text has, as long; null counts 0."""
    text = F.coalesce(text, F.lit(""))
    blank = lambda c: c.isin(" ", "\t", "\n", "\x0b", "\x0c", "\r").cast("int")
    between = F.size(F.split(text, SPACE)) - blank(F.substring(text, 1, 1)) - blank(F.right(text, F.lit(1)))
    return F.when(text == "", 0).otherwise(between).cast("long")

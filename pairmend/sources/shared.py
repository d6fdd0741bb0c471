"""Cutting lineage in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def set_shared_folder(spark: SparkSession) -> None:
    """See to it that the session has the folder that the cluster names in spark.checkpoint.dir.

    A session on one machine (tests, a laptop) without one gets a temporary folder. On a cluster that would be
    another folder on each machine, so there the setting must be there.
    """
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isEmpty():
        return
    named = context.getConf().get("spark.checkpoint.dir")
    if not named and not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))


def settle(df: DataFrame) -> DataFrame:
    """Compute df once and cut its lineage, in the shared folder.

    Spark removes such files when nothing refers to them any more if
    spark.cleaner.referenceTracking.cleanCheckpoints is set, as it should be in long sessions.
    """
    set_shared_folder(df.sparkSession)
    return df.checkpoint()


@contextmanager
def kept(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A function that writes a table to the shared folder and reads it again, for the rounds of a loop; leaving deletes what it wrote.

    Unlike a checkpoint, which hands on the plan's estimate of its size (a product at every join, so its digits double with
    each round), a file has the size it has. What is to outlive the loop must be settled before it is left.
    """
    set_shared_folder(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/rounds-{uuid.uuid4().hex}"
    n = 0

    def keep(df: DataFrame) -> DataFrame:
        nonlocal n
        n += 1
        df.write.parquet(f"{folder}/{n}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{n}")

    try:
        yield keep
    finally:
        delete(spark, folder)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a file or folder, wherever Spark reads it from."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)

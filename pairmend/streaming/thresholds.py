"""Thresholds that keep up with a stream of scores: a mergeable quantile sketch for each category, held as streaming state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from pairmend.config import SieveConfig

#: Size of a sketch: quantiles are off by about 0.4 % of the ranks at most, whatever the number of scores.
SIZE = 800


def sketches(scored: DataFrame, size: int = SIZE, category: str = "category", value: str = "sim_score") -> DataFrame:
    """category, overall, n, sketch for each category with a score, and one row of all scores (overall, with no category).

    Of a table or of a stream; rows without a score count for nothing, those without a category for the whole alone. Partial sketches are
    merged, so a category that holds most rows is spread like any other.
    """
    own = F.struct(F.col(category).cast("string").alias("category"), F.lit(False).alias("overall"))
    every = F.struct(F.lit(None).cast("string").alias("category"), F.lit(True).alias("overall"))
    both = F.when(F.col(category).isNull(), F.array(every)).otherwise(F.array(own, every))
    valid = scored.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    rows = valid.select(F.explode(both).alias("of"), F.col(value).cast("double").alias("v")).select("of.*", "v")
    return rows.groupBy("category", "overall").agg(F.count("*").alias("n"), F.kll_sketch_agg_double("v", size).alias("sketch"))


def thresholds(made: DataFrame, config: SieveConfig = SieveConfig()) -> tuple[DataFrame, DataFrame]:
    """What operators.sieve.category_thresholds and global_threshold give, from sketches: within their error of the exact ones."""
    at = lambda q: F.kll_sketch_get_quantile_double("sketch", F.lit(q))
    fence = lambda iqr, q: at(0.25) - config.iqr_k * (at(0.75) - at(0.25)) if iqr else at(q)
    overall = made.filter("overall").select(fence(config.global_threshold_method == "iqr", config.global_quantile_q).alias("t")).agg(F.coalesce(F.max("t"), F.lit(-1.0)).alias("global_threshold"))
    few = F.col("n") < config.min_category_samples
    own = made.filter("not overall").join(F.broadcast(overall)).select(  # one row
        "category", F.col("n").alias("n_scored"),
        F.when(few, F.col("global_threshold")).otherwise(fence(config.threshold_method != "quantile", config.quantile_q)).alias("sieve_threshold"),
        F.when(few, "global").otherwise("category").alias("threshold_source"),
    )
    return own, overall


def keeping_up(scored: DataFrame, folder: str, checkpoint: str, size: int = SIZE) -> DataStreamWriter:
    """A writer that, started, adds to the folder the sketches that each batch of a stream of scores has changed.

    The state is Spark's, under checkpoint: a query that is started again goes on where it ended, and a batch that is
    run twice overwrites its own part.
    """

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return sketches(scored, size).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(save)


def latest(spark: SparkSession, folder: str) -> DataFrame:
    """The newest sketch of each category in a folder that keeping_up fills."""
    found = spark.read.parquet(folder)
    return found.groupBy("category", "overall").agg(F.max_by(F.struct("n", "sketch"), "batch").alias("s")).select("category", "overall", "s.n", "s.sketch")

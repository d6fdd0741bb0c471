"""Exact places in a global order, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairmend.llm.common import settle


def placed(rows: DataFrame, *order: Column | str, into: str = "place", sums: dict[str, str] | None = None) -> DataFrame:
    """rows with `into`, their place (from 0) in the order, and for each of sums {new: column} that column's sum over all earlier rows.

    Rows are dealt by ranges of the order and sorted in their tasks; a row's number within its task is
    what Spark's own row ids count, so only the ranges' sizes and sums, a row a task, meet in one place. The order
    should end in columns that tell rows apart, else rows that are alike in it all go to one range. The rows are
    settled, so places hold wherever they are used. Columns __own, __id, __part and __n are this function's.
    """
    sums = sums or {}
    spread = settle(rows.repartitionByRange(*order).sortWithinPartitions(*order))
    spread = spread.withColumn("__id", F.monotonically_increasing_id())
    part = F.shiftright("__id", 33).cast("int")
    sizes = spread.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"), *[F.sum(c).alias(f"__{new}") for new, c in sums.items()])
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("__part", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in ("__n", *[f"__{new}" for new in sums])])
    out = spread.withColumn("__part", part).join(F.broadcast(before), "__part")
    out = out.withColumn(into, F.col("__n") + F.col("__id").bitwiseAND((1 << 33) - 1))
    within = Window.partitionBy("__part").orderBy("__id").rowsBetween(Window.unboundedPreceding, -1)
    for new, c in sums.items():
        out = out.withColumn(new, F.col(f"__{new}") + F.coalesce(F.sum(c).over(within), F.lit(0)))
    return out.drop("__id", "__part", "__n", *[f"__{new}" for new in sums])

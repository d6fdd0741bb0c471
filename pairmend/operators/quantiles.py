"""Exact quantiles of groups of any size.

Groups that are small enough for a task go to the built-in aggregate. If one is not, an approximate pass
brackets each quantile's rank, and only the distinct values inside the bracket are ordered, so no task
holds a group, however hot.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The bracket is a few parts in ACCURACY of the group wide.
ACCURACY = 2_000
#: If no group has more rows, each is aggregated in a task.
IN_TASK = 1_000_000
#: Beside larger groups, those with fewer rows are ordered whole.
SMALL = 100_000


def exact_quantiles(df: DataFrame, group: str | None, value: str, qs: Sequence[float]) -> DataFrame:
    """One row a group: its key, n (rows with a value) and q0, q1, ... for qs.

    Quantiles interpolate linearly between the ranks around (n - 1) * q. Null and NaN values are left
    out, as are groups without a value; the null key is a group. Without a group there is one row, or none.
    """
    key = F.col(group) if group else F.lit(0)
    v = F.col(value).cast("double")
    rows = df.select(key.alias("g"), v.alias("v")).filter("v is not null and not isnan(v)")
    most = rows.groupBy("g").count().agg(F.max("count")).first()[0]
    if (most or 0) <= IN_TASK:
        whole = rows.groupBy("g").agg(F.count("*").alias("n"), F.percentile("v", F.array(*map(F.lit, map(float, qs)))).alias("x"))
        return whole.select(*([F.col("g").alias(group)] if group else []), "n", *[F.col("x")[k].alias(f"q{k}") for k in range(len(qs))])
    counted = rows.groupBy("g", "v").agg(F.count("*").alias("c"))
    slack = 2 / ACCURACY
    edges = [min(max(q + s, 0.0), 1.0) for q in qs for s in (-slack, slack)]
    rough = rows.groupBy("g").agg(F.count("*").alias("n"), F.percentile_approx("v", edges, ACCURACY).alias("e"), F.min("v").alias("least"), F.max("v").alias("most"))
    wanted = []
    for k, q in enumerate(qs):
        low = F.when(F.lit(q - slack <= 0) | (F.col("n") < SMALL), F.col("least")).otherwise(F.col("e")[2 * k])
        high = F.when(F.lit(q + slack >= 1) | (F.col("n") < SMALL), F.col("most")).otherwise(F.col("e")[2 * k + 1])
        wanted.append(F.struct(F.lit(k).alias("k"), F.lit(float(q)).alias("q"), low.alias("low"), high.alias("high")))
    ranges = rough.select(F.col("g").alias("key"), "n", F.explode(F.array(*wanted)).alias("w")).select("key", "n", "w.*")
    met = counted.join(ranges, F.col("g").eqNullSafe(F.col("key"))).drop("key")
    below = met.groupBy("g", "k").agg(F.sum(F.when(F.col("v") < F.col("low"), F.col("c")).otherwise(0)).alias("below"))
    inside = met.filter("v >= low and v <= high")
    run = Window.partitionBy("g", "k").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("upto", F.sum("c").over(run)).join(below.select(F.col("g").alias("bg"), F.col("k").alias("bk"), "below"), F.col("g").eqNullSafe(F.col("bg")) & (F.col("k") == F.col("bk")))
    rank = (F.col("n") - 1) * F.col("q")
    first, last = F.col("below") + F.col("upto") - F.col("c"), F.col("below") + F.col("upto") - 1
    at = lambda r: F.max(F.when((first <= r) & (r <= last), F.col("v")))
    found = inside.groupBy("g", "n", "k", "q").agg(at(F.floor(rank)).alias("a"), at(F.least(F.floor(rank) + 1, F.col("n") - 1)).alias("b"))
    exact = F.col("a") + (F.col("b") - F.col("a")) * (rank - F.floor(rank))
    out = found.withColumn("x", exact).groupBy("g", "n").agg(*[F.max(F.when(F.col("k") == k, F.col("x"))).alias(f"q{k}") for k in range(len(qs))])
    names = [F.col("g").alias(group)] if group else []
    return out.select(*names, "n", *[f"q{k}" for k in range(len(qs))])

"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairmend.llm.common import kept, settle, small


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component_id) for every id on an edge; component_id is the smallest id reachable.

    Each round hangs every node's larger neighbours under its smallest one (large star), then
    its smaller neighbours and itself (small star), until nothing changes. Rounds grow with the
    logarithm of the longest path. A node with many neighbours is met through a partial minimum, which
    is computed first, so it is broadcast if counted small, and else joined in a join that Spark splits where
    a node has many rows: never as one group in a task. Self-loops and repeated edges
    are harmless; rows with a null end are ignored; no edges give no rows.
    """
    ends = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).filter("u <> v")
    with kept(edges.sparkSession) as keep:
        now = _packed(ends.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), keep)
        while True:
            both = now.union(now.select("v", "u"))
            least = small(keep(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))))
            large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            lower = small(keep(large.groupBy("u").agg(F.min("v").alias("m"))))
            met = large.join(lower, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            now = _packed(met.union(lower.select("u", F.col("m").alias("v"))).distinct(), keep)
            if _flat(now):
                break
        roots = now.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component_id"))
        return settle(now.select(F.col("u").alias("id"), F.col("v").alias("component_id")).union(roots))


def _packed(edges: DataFrame, keep: Callable[[DataFrame], DataFrame], rows: int = 200_000) -> DataFrame:
    """The edges, computed, in partitions of about as many rows."""
    done = keep(edges)
    return done.coalesce(1 + done.count() // rows)


def _flat(stars: DataFrame) -> bool:
    """Whether every node is a leaf of one star or a root: no second edge, and no leaf that is a root."""
    twice = stars.groupBy("u").count().filter("count > 1").select("u")
    return twice.union(stars.join(stars.select(F.col("v").alias("u")), "u", "left_semi").select("u")).isEmpty()

"""As-of look-ups: for each question the last earlier event of its key, with no task that holds all of a key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Places that go to one task with a key, where a key has more rows than that: it is dealt over many
#: tasks, and what earlier stretches end with is carried on.
STRETCH = 100_000


def last_before(asked: DataFrame, events: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """asked (key, at, ...) with found: the struct of at and the other columns of the last event (key, at, ...) before at, or null.

    Rows are dealt by key, those of a key with more than a stretch of rows by stretches of places as well, so no group is larger than
    two stretches, whatever share of the rows a key has; only the last event of each stretch of such a key meets the others of the key. An event at the
    same place isn't before; one without a place is before all others. Null keys find nothing; events of one key and place are told apart by their values.
    Both tables are read twice, so they should be settled.
    """
    mine, given = [c for c in asked.columns if c not in ("key", "at")], [c for c in events.columns if c not in ("key", "at")]
    event = F.struct("at", *given)
    kind = events.select(event.alias("e")).schema["e"].dataType
    question = F.struct("at", *mine)
    rows = events.select("key", "at", F.lit(True).alias("past"), event.alias("e"), F.lit(None).cast(asked.select(question.alias("q")).schema["q"].dataType).alias("q"))
    rows = rows.union(asked.select("key", "at", F.lit(False).alias("past"), F.lit(None).cast(kind).alias("e"), question.alias("q")))
    # One key for each stretch of rows at most.
    crowded = rows.filter("key is not null").groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > stretch).select("key", F.lit(True).alias("crowded"))
    rows = rows.join(F.broadcast(crowded), "key", "left")
    # Null keys find nothing, so any place will do for them.
    rows = rows.withColumn("s", F.when(F.col("crowded") | F.col("key").isNull(), F.floor(F.col("at") / stretch)))
    run = Window.partitionBy("key", "s").orderBy("at", "past").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = rows.withColumn("near", F.max("e").over(run)).filter("not past").select("key", "s", "q", "near")
    ends = rows.filter("crowded").groupBy("key", "s").agg(F.max("e").alias("end"))
    carried = ends.withColumn("far", F.max("end").over(Window.partitionBy("key").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)))
    met = near.join(carried.filter("far is not null").select("key", "s", "far"), ["key", "s"], "left")
    return met.select("key", F.col("q.at").alias("at"), *[F.col(f"q.{c}").alias(c) for c in mine], F.when(F.col("key").isNotNull(), F.coalesce("near", "far")).alias("found"))

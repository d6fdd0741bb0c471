"""Sharding through a permutation-filled lookup table."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A prime; it bounds the broadcast table whatever the data's size.
SLOTS = 65_537


def fill(shards: Sequence[str], slots: int = SLOTS) -> list[int]:
    """For each slot the place of its shard in `shards`.

    Every shard prefers the slots offset, offset + skip, offset + 2 skip, ... (modulo the prime), which
    its name alone decides. Shards take turns, each claiming the first slot it prefers that is free.
    """
    if not 0 < len(shards) <= slots or len(set(shards)) < len(shards):
        raise ValueError("shards must be distinct, at least one and at most one for each slot")
    if slots > 1_000_000 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime of at most a million")
    digests = [hashlib.sha256(s.encode()).digest() for s in shards]
    at = [int.from_bytes(d[:8], "big") % slots for d in digests]
    skip = [int.from_bytes(d[8:16], "big") % (slots - 1) + 1 for d in digests]
    owner, left = [-1] * slots, slots
    while left:
        for k in range(len(shards)):
            while owner[at[k]] >= 0:
                at[k] = (at[k] + skip[k]) % slots
            owner[at[k]] = k
            left -= 1
            if not left:
                break
    return owner


def lookup(spark: SparkSession, shards: Sequence[str], slots: int = SLOTS) -> DataFrame:
    """(slot, shard) for every slot, decoded from one packed literal."""
    packed = "".join(f"{k:05x}" for k in fill(shards, slots))
    names = F.split(F.lit("\x1f".join(shards)), "\x1f")
    # rows of 100 slots first: a substring of the whole literal for each slot would scan it each time
    rows = spark.range((slots + 99) // 100).select("id", F.substring(F.lit(packed), F.col("id").cast("int") * 500 + 1, F.lit(500)).alias("part"))
    each = rows.select("id", F.posexplode(F.regexp_extract_all("part", F.lit("[0-9a-f]{5}"), 0)).alias("k", "code"))
    owner = F.conv("code", 16, 10).cast("int")
    return each.select((F.col("id") * 100 + F.col("k")).alias("slot"), F.element_at(names, owner + 1).alias("shard"))


def place(docs: DataFrame, shards: Sequence[str], key: str = "doc_id", spread_by: str | None = None, spread: int = 1, slots: int = SLOTS) -> DataFrame:
    """docs with two more columns, slot and shard (replacing columns of these names).

    Rows of one key go to one slot. A key that may hold a large part of the rows can be dealt over
    `spread` slots by the hash of another column. The table is broadcast: `slots` rows, whatever the
    data, so rows are placed where they are read, with no shuffle. A null key is a key like any
    other. When the shards change, only about the slots of those that came or went change hands.
    """
    keys = [F.col(key).cast("string")]
    if spread_by is not None and spread > 1:
        keys.append(F.pmod(F.xxhash64(spread_by), F.lit(spread)).cast("string"))
    at = F.pmod(F.xxhash64(*keys), F.lit(slots))
    table = lookup(docs.sparkSession, shards, slots).select(F.col("slot").alias("__slot"), F.col("shard").alias("__shard"))
    out = docs.withColumn("__at", at).join(F.broadcast(table), F.col("__at") == F.col("__slot"))
    kept = [c for c in docs.columns if c.lower() not in ("slot", "shard")]
    return out.select(*[F.col(f"`{c}`") for c in kept], F.col("__slot").alias("slot"), F.col("__shard").alias("shard"))

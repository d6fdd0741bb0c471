"""Labelled noise: replicate rows, then swap images or change colours of a part of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairmend.functions.text import TYPED, canonical_text, dump, json_map, json_values, merge
from pairmend.operators.arbitrate import number
from pairmend.operators.asof import last_before
from pairmend.sources.shared import kept, settle

# The colours that noise picks from.
NOISE_COLORS = ("red", "blue", "black", "white", "green", "yellow", "pink", "gray")


def replicate(rows: DataFrame, copies: int = 15) -> DataFrame:
    """Each row `copies` times, as row_id_0, row_id_1, ..., labelled clean.

    Rows are dealt out first: a small file is read by a few tasks, which then would make all copies. The number of parts is given,
    three a core, as it would be cut down to what the rows need before they are copied.
    """
    parts = 3 * rows.sparkSession.sparkContext.defaultParallelism
    many = rows.repartition(parts, "row_id").withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)) if copies > 0 else F.array().cast("array<int>")))
    return many.withColumns({"row_id": F.concat_ws("_", F.col("row_id").cast("string"), F.col("__k").cast("string")), "noise_label": F.lit("clean")}).drop("__k")


def chance(*keys: Column | str, seed: int) -> Column:
    """A number in [0, 1) from the keys and the seed, the same in every run."""
    return F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def other_color(attributes: Column, pick: Column) -> Column:
    """Another colour of the palette than the attributes'; pick, in [0, 1), decides which."""
    palette = F.array(*map(F.lit, NOISE_COLORS))
    own = F.coalesce(attributes["color"], F.lit(""))
    other = F.array_except(palette, F.array(own))
    return F.element_at(other, (F.floor(pick * F.size(other)) + 1).cast("int"))


def exchanged(swaps: DataFrame) -> DataFrame:
    """position, origin: whose thing lies where after all swaps (step, a, b) were made in order, for every position that one names.

    What a step puts at one of its positions is what lay at the other before it: the work of the last earlier step there, which
    an as-of look-up finds, or what was there at first. Such pointers are doubled, so rounds grow with the logarithm of the
    longest row of exchanges. A swap of a position with itself changes nothing; steps are told apart by their numbers.
    """
    real = settle(swaps.filter("a <> b").select(F.col("step").cast("long").alias("step"), F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")))
    ends = real.select("step", "a", "b").union(real.select("step", "b", "a")).toDF("step", "position", "other")
    events = ends.select(F.col("position").alias("key"), F.col("step").alias("at"))
    before = last_before(ends.select(F.col("other").alias("key"), F.col("step").alias("at"), "position"), events)
    with kept(swaps.sparkSession) as keep:
        # A node is a step and one of its positions; up is the node whose thing it holds, or null with the origin known.
        links = keep(before.select(F.col("at").alias("step"), "position", F.col("key").alias("origin"), F.col("found.at").alias("up")))
        while not links.filter("up is not null").isEmpty():
            above = links.select(F.col("step").alias("up"), F.col("position").alias("origin"), F.col("origin").alias("next_origin"), F.col("up").alias("next"))
            links = keep(links.join(above, ["up", "origin"], "left").select("step", "position", F.coalesce("next_origin", "origin").alias("origin"), F.col("next").alias("up")))
        return settle(links.groupBy("position").agg(F.max_by("origin", "step").alias("origin")))


def _with_free_partners(drawn: DataFrame, seed: int) -> DataFrame:
    """drawn with __image, for the rows whose image changed: swap rows, in a random order, exchange images with any row of the table."""
    rows = settle(number(drawn, "__u", "__place"))
    swaps = rows.filter("__kind = 'swap_image'").select("row_id", F.col("__place").alias("a"), chance("row_id", "__place", seed=seed + 4).alias("__o"))
    partner = F.floor(chance("row_id", "a", seed=seed + 5) * F.lit(rows.count())).alias("b")
    moved = exchanged(number(swaps, "__o").select("step", "a", partner))
    images = rows.select(F.col("__place").alias("origin"), F.col("image_path").alias("__image"))
    given = moved.join(images, "origin").select(F.col("position").alias("__place"), "__image")
    return rows.join(given, "__place", "left").drop("__place")


def add_noise(rows: DataFrame, rate: float = 0.30, seed: int = 7, exact: bool = True, partners: str = "paired") -> DataFrame:
    """rows (row_id, title, category, attributes, canonical_text, image_path, noise_label) with noise.

    A part `rate` of them, half each way: swap_image rows exchange images in disjoint pairs (an odd one
    out keeps its own but is labelled), mutate_text rows get another colour in attributes and text.
    exact takes the floor(n * rate) rows of lowest hash: counts of 4,096 ranges of hashes name the range where they end, and only
    that one is ordered, up to the last row taken; otherwise each row is taken by its own hash alone. Reruns agree.

    With partners="free" a swap row exchanges its image with any row, itself and clean ones included (those keep
    their label), one swap after the other; what the exchanges come to is found without making them in turn.
    """
    if partners not in ("paired", "free"):
        raise ValueError("partners are paired or free")
    drawn = rows.withColumn("__u", chance("row_id", seed=seed))
    if exact:
        slot = F.floor(F.col("__u") * 4096)
        cut = drawn.groupBy(slot.alias("b")).count().orderBy("b").collect()
        left, edge = int(sum(row["count"] for row in cut) * rate), 0
        for row in cut:
            if row["count"] > left:
                edge = row["b"]
                break
            left, edge = left - row["count"], row["b"] + 1
        noisy = slot < edge
        if left:
            taken = drawn.filter(slot == edge).select("__u", "row_id").orderBy("__u", "row_id").limit(left)
            last = taken.orderBy(F.desc("__u"), F.desc("row_id")).first()
            at, u = F.lit(last["row_id"]), F.lit(last["__u"])
            noisy = noisy | (F.col("__u") < u) | ((F.col("__u") == u) & F.coalesce(F.col("row_id") <= at, F.col("row_id").isNull()))
        drawn = drawn.withColumn("__noisy", noisy)
    else:
        drawn = drawn.withColumn("__noisy", F.col("__u") < rate)
    swap = F.col("__noisy") & (chance("row_id", seed=seed + 1) < 0.5)
    drawn = drawn.withColumn("__kind", F.when(swap, "swap_image").when(F.col("__noisy"), "mutate_text").otherwise(F.col("noise_label")))

    if partners == "free":
        out = _with_free_partners(drawn, seed)
    else:
        out = _with_paired_partners(drawn, seed)
    mutated = F.col("__kind") == "mutate_text"
    color = F.create_map(F.lit("color"), other_color(json_map("attributes"), chance("row_id", seed=seed + 3)))
    out = out.withColumn("__attributes", F.when(mutated, merge(json_map("attributes"), color)))
    out = out.withColumn("__typed", F.when(mutated, dump(merge(json_values("attributes"), F.from_json(F.to_json(color), TYPED)))))
    out = out.withColumns({
        "image_path": F.coalesce("__image", "image_path"),
        "attributes": F.when(mutated, F.col("__typed")).otherwise(F.col("attributes")),
        "canonical_text": F.when(mutated, canonical_text(F.col("title"), F.col("category"), F.col("__attributes"))).otherwise(F.col("canonical_text")),
        "noise_label": F.col("__kind"),
    })
    return out.select(rows.columns)


def _with_paired_partners(drawn: DataFrame, seed: int) -> DataFrame:
    """drawn with __image, for swap rows: that of the other one of their pair. Other rows stay where they are."""
    # Pairs are made within buckets of the hash, so the pairing spreads over tasks.
    bucket = F.pmod(F.xxhash64("row_id", F.lit(seed + 2)), F.lit(1024))
    order = Window.partitionBy("__b").orderBy("__u", "row_id")
    swaps = F.coalesce(F.col("__kind") == "swap_image", F.lit(False))
    other = F.when(F.row_number().over(order) % 2 == 1, F.lead("image_path").over(order)).otherwise(F.lag("image_path").over(order))
    swapped = drawn.filter(swaps).withColumn("__b", bucket).withColumn("__image", F.coalesce(other, "image_path")).drop("__b")
    return drawn.filter(~swaps).withColumn("__image", F.lit(None).cast("string")).unionByName(swapped)


def noise_counts(rows: DataFrame) -> DataFrame:
    """One row: rows, and noisy ones."""
    return rows.agg(F.count("*").alias("rows"), F.count_if(F.col("noise_label") != "clean").alias("noisy"))

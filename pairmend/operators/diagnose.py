"""What is wrong with a flagged row: a cascade of rules, the first that holds decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairmend.functions.text import json_map, text_color
from pairmend.functions.vectors import dot, normalize
from pairmend.operators.retrieval import best_other
from pairmend.schema import ensure_columns

#: Another row's text must match the image better than the row's own by more than this.
MARGIN = 0.01

# What reports say, and the caption that a missing text gets.
NO_IMAGE = "Image is missing."
NO_TEXT = "Text is missing; likely generate/fill text from image."
NO_FILE = "Image file not found at: "
SWAPPED = "Image seems to match another row's text better; likely swapped."
CAPTION = "NEEDS_CAPTION"


def last_of_each(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    latest = Window.partitionBy(key).orderBy(F.col(order).desc())
    return rows.withColumn("__n", F.row_number().over(latest)).filter("__n = 1").drop("__n")


def evidence(sieved: DataFrame, embeddings: DataFrame | None = None, position: str | None = None) -> DataFrame:
    """The flagged rows with own_sim, best_other_row, best_other_sim and margin.

    Vectors are sieved's own columns or a table by row_id. Only flagged rows whose two parts are there
    go into the retrieval; a row without vectors has nulls. Of vectors that repeat a row_id the last by
    position asks (without one, the one of the largest hash); as rivals of other rows all of them count.
    """
    vectors = sieved if embeddings is None else embeddings
    flagged = sieved.filter("flagged")
    both = ~F.coalesce(F.col("is_image_missing"), F.lit(False)) & ~F.coalesce(F.col("is_text_missing"), F.lit(False))
    asked = flagged.filter(both).select("row_id")
    queries = vectors.join(asked.withColumnRenamed("row_id", "__id").distinct(), F.col("row_id") == F.col("__id"), "left_semi")
    order = F.col(position) if position else F.xxhash64("image_emb", "text_emb")
    queries = last_of_each(queries.withColumn("__order", order), "row_id", "__order").drop("__order")
    best = best_other(queries, vectors)
    own = queries.select("row_id", dot(normalize(F.col("image_emb")), normalize(F.col("text_emb"))).alias("own_sim"))
    met = own.join(best, "row_id", "left")
    met = met.withColumn("margin", F.col("best_other_sim") - F.col("own_sim"))
    return flagged.join(met, "row_id", "left")


def _fix(**given: Column) -> Column:
    kinds = {"text_patch": "map<string,string>", "observed_image_rgb": "array<int>"}
    names = ("text_patch", "image_replacement_candidate_row_id", "notes", "observed_image_color", "observed_image_rgb", "text_color")
    return F.struct(*[given.get(n, F.lit(None)).cast(kinds.get(n, "string")).alias(n) for n in names])


def _report(error: str, aspect: str, direction: str, image: float, text: float, fix: Column, notes: Column | str | None) -> Column:
    return F.struct(
        F.lit(error).alias("error_type"),
        F.array(F.lit(aspect)).alias("mismatch_aspects"),
        F.lit(direction).alias("suggested_direction"),
        F.struct(F.lit(image).alias("image_trust"), F.lit(text).alias("text_trust")).alias("confidence"),
        fix.alias("proposed_fix"),
        (notes if isinstance(notes, Column) else F.lit(notes)).cast("string").alias("notes"),
    )


def diagnose(rows: DataFrame) -> DataFrame:
    """One report a row: row_id, error_type, mismatch_aspects, suggested_direction, confidence, proposed_fix, notes, debug.

    rows are evidence()'s, with attributes and title, and optionally image_exists (else true),
    img_color and img_rgb (else no colour is known).
    """
    rows = ensure_columns(rows, {"attributes": "{}", "title": "", "image_path": "", "image_exists": True, "img_color": "", "own_sim": None, "best_other_row": None, "best_other_sim": None, "margin": None})
    if "img_rgb" not in rows.columns:
        rows = rows.withColumn("img_rgb", F.lit(None).cast("array<int>"))
    rows = rows.withColumn("text_color", text_color(json_map("attributes"), F.coalesce("title", F.lit(""))))
    true = lambda c: F.coalesce(F.col(c).cast("boolean"), F.lit(False))
    image, text = F.coalesce("img_color", F.lit("")), F.col("text_color")
    swapped = F.coalesce(F.col("best_other_sim") > F.col("own_sim") + MARGIN, F.lit(False))
    patch = lambda key, value: F.create_map(F.lit(key), value)
    path = F.coalesce("image_path", F.lit(""))
    report = (
        F.when(true("is_image_missing"), _report("Type III", "missing_image", "HUMAN", 0.0, 0.5, _fix(), NO_IMAGE))
        .when(true("is_text_missing"), _report("Type III", "missing_text", "V2T", 0.7, 0.0, _fix(text_patch=patch("title", F.lit(CAPTION))), NO_TEXT))
        .when(~true("image_exists"), _report("Type III", "missing_image_file", "HUMAN", 0.0, 0.5, _fix(), F.concat(F.lit(NO_FILE), path)))
        .when(swapped, _report("Type I", "image_relevance", "T2V", 0.3, 0.8, _fix(image_replacement_candidate_row_id=F.col("best_other_row"), notes=F.lit(SWAPPED)), None))
        .when((text != "") & (image != "") & (text != image), _report("Type II", "color", "V2T", 0.75, 0.4, _fix(text_patch=patch("attributes.color", image), observed_image_color=image, observed_image_rgb=F.col("img_rgb"), text_color=text), None))
        .otherwise(_report("Unknown", "unknown", "HUMAN", 0.5, 0.5, _fix(), None))
    )
    unknown = F.col("r.error_type") == "Unknown"
    debug = F.struct(
        "own_sim", F.col("best_other_row").cast("string").alias("best_other_row"), "best_other_sim", "margin",
        F.when(unknown, image).alias("img_color"), F.when(unknown, text).alias("text_color"),
    )
    seen = F.when(F.col("r.error_type") != "Type III", debug)
    return rows.withColumn("r", report).select(F.col("row_id").cast("string").alias("row_id"), "r.*", seen.alias("debug"))


def queue(reports: DataFrame) -> DataFrame:
    """Reports flattened for the arbiter; the fix as JSON without what it lacks."""
    return reports.select(
        "row_id", "error_type", "suggested_direction", F.array_join("mismatch_aspects", ",").alias("mismatch_aspects"),
        F.col("confidence.image_trust").alias("image_trust"), F.col("confidence.text_trust").alias("text_trust"),
        F.to_json("proposed_fix").alias("proposed_fix"),
    )

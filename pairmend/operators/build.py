"""Raw catalog rows to processed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairmend.functions.text import canonical_text, clean, dump, is_text_missing, json_map, json_values
from pairmend.schema import ensure_columns

RAW_COLUMNS = ("row_id", "title", "category", "attributes_json", "image_path", "image_url")


def normalize(raw: DataFrame) -> DataFrame:
    """raw's six columns, absent ones added, stripped, never null, and attributes as a map; extra columns go."""
    rows = ensure_columns(raw, dict.fromkeys(RAW_COLUMNS, ""))
    text = [clean(c).alias(c) for c in RAW_COLUMNS]
    return rows.select(*text, json_map(F.col("attributes_json").cast("string")).alias("attributes"))


def image_source(rows: DataFrame) -> DataFrame:
    """rows with image_source: local if there is a path (a broken one never falls back to the URL), url, or none."""
    source = F.when(F.col("image_path") != "", "local").when(F.col("image_url") != "", "url").otherwise("none")
    return rows.withColumn("image_source", source)


def build(raw: DataFrame, images: DataFrame | None = None, images_dir: str = "data/processed/images") -> DataFrame:
    """The processed table.

    images has row_id and ok: which rows' images exist, were read and normalized (see sources.images).
    Without it, a row's image counts as there if it names one.
    """
    rows = image_source(normalize(raw))
    if images is None:
        rows = rows.withColumn("ok", F.col("image_source") != "none")
    else:
        given = images.groupBy(F.col("row_id").alias("__id")).agg(F.max("ok").alias("ok"))
        rows = rows.join(given, F.col("row_id") == F.col("__id"), "left").drop("__id")
    there = F.coalesce(F.col("ok") & (F.col("image_source") != "none"), F.lit(False))
    return rows.select(
        "row_id",
        "title",
        "category",
        dump(json_values("attributes_json")).alias("attributes"),
        canonical_text(F.col("title"), F.col("category"), F.col("attributes")).alias("canonical_text"),
        F.when(there, F.concat(F.lit(images_dir.rstrip("/") + "/"), "row_id", F.lit(".jpg"))).otherwise("").alias("image_path"),
        (~there).alias("is_image_missing"),
        is_text_missing(F.col("title"), F.col("attributes")).alias("is_text_missing"),
        F.col("image_path").alias("source_image_path"),
        F.col("image_url").alias("source_image_url"),
    )


def counters(processed: DataFrame) -> DataFrame:
    """One row: rows, normalized_images, missing_images, missing_text."""
    return processed.agg(
        F.count("*").alias("rows"),
        F.count_if(~F.col("is_image_missing")).alias("normalized_images"),
        F.count_if(F.col("is_image_missing")).alias("missing_images"),
        F.count_if(F.col("is_text_missing")).alias("missing_text"),
    )


def downloads(processed: DataFrame) -> DataFrame:
    """One row: downloaded, how many images came from a URL."""
    from_url = (F.col("source_image_path") == "") & (F.col("source_image_url") != "")
    return processed.agg(F.count_if(from_url & ~F.col("is_image_missing")).alias("downloaded"))

"""Tables that the queries derive from the given ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairmend.functions.text import canonical_text, json_map


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog rows with text and image vectors: a row's image is its text with half of another's added.

    Rows 4 and 5 of each 20 have exchanged images; of each 50 row 0 has no image and row 1 no text.
    """
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("i"), F.transform("embedding", lambda x: x.cast("double")).alias("v"), "label")
    n = e.count()
    other = e.select(F.col("i").alias("k"), F.col("v").alias("w"))
    clean = e.join(other, F.col("k") == (7 * F.col("i") + 3) % n)
    clean = clean.select("i", "v", "label", F.zip_with("v", "w", lambda x, y: x + 0.5 * y).alias("image"))
    partner = F.when(F.col("i") % 20 == 4, F.col("i") + 1).when(F.col("i") % 20 == 5, F.col("i") - 1).otherwise(F.col("i"))
    given = clean.select(F.col("i").alias("p"), F.col("image").alias("given"))
    no_image = F.col("i") % 50 == 0
    return clean.join(given, partner == F.col("p")).select(
        F.col("i").cast("string").alias("row_id"),
        F.col("label").cast("string").alias("category"),
        F.concat(F.lit("item "), F.col("i").cast("string")).alias("title"),
        F.lit("{}").alias("attributes"),
        F.concat(F.lit("item "), F.col("i").cast("string"), F.lit(". Category: "), F.col("label").cast("string"), F.lit(". Attributes: .")).alias("canonical_text"),
        F.when(no_image, "").otherwise(F.concat(F.lit("images/"), F.col("i").cast("string"), F.lit(".jpg"))).alias("image_path"),
        no_image.alias("is_image_missing"),
        (F.col("i") % 50 == 1).alias("is_text_missing"),
        F.col("v").alias("text_emb"),
        F.when(~no_image, F.col("given")).alias("image_emb"),
    )


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw catalog rows from part: some without a title, attributes or image, some with broken JSON."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    good = F.concat(F.lit('{"brand": "'), F.col("p_brand"), F.lit('", "size": '), F.col("p_size").cast("string"), F.lit("}"))
    return p.select(
        F.concat(F.lit("p"), k.cast("string")).alias("row_id"),
        F.when(k % 10 == 3, "  ").otherwise(F.concat(F.lit(" "), F.col("p_name"), F.lit("\t"))).alias("title"),
        F.col("p_type").alias("category"),
        F.when(k % 5 == 3, "").when(k % 7 == 2, "{broken").when(k % 7 == 4, "[1, 2]").otherwise(good).alias("attributes_json"),
        F.when(k % 3 == 0, F.concat(F.lit("img/"), k.cast("string"), F.lit(".png"))).otherwise("").alias("image_path"),
        F.when(k % 2 == 0, F.concat(F.lit("https://images.example/"), k.cast("string"))).otherwise("").alias("image_url"),
    )


def plain_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Processed rows from part, with brand and size, and for every fourth a colour."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    color = F.when(k % 4 == 0, ', "color": "red"').otherwise("")
    attributes = F.concat(F.lit('{"brand": "'), F.col("p_brand"), F.lit('", "size": "'), F.col("p_size").cast("string"), F.lit('"'), color, F.lit("}"))
    rows = p.select(k.cast("string").alias("row_id"), F.col("p_name").alias("title"), F.col("p_type").alias("category"), attributes.alias("attributes"))
    text = canonical_text(F.col("title"), F.col("category"), json_map("attributes"))
    return rows.withColumns({"canonical_text": text, "image_path": F.concat(F.lit("images/"), "row_id", F.lit(".jpg"))})

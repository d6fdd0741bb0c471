"""Images as rows: listing, decoding, colours, fetching and copying."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from pairmend.functions.colors import DARK, LIGHT, MANY, SIDE, is_kept, nearest_color
from pairmend.functions.text import resolve_path
from pairmend.operators.repair import IMAGES


def listing(spark: SparkSession, folder: str, root: str = "") -> DataFrame:
    """path of every file under a folder, relative to root if given; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    path = F.regexp_replace("path", "^file:/+", "/")
    return files.select((F.regexp_replace(path, "^" + root.rstrip("/") + "/", "") if root else path).alias("path"))


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """origin, height, width, channels, data (rows of blue, green, red bytes), ok: whether it could be read."""
    i = spark.read.format("image").option("recursiveFileLookup", True).load(folder)
    return i.select(
        F.regexp_replace("image.origin", "^file:/+", "/").alias("origin"), F.col("image.height").alias("height"), F.col("image.width").alias("width"),
        F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"), (F.col("image.height") > 0).alias("ok"),
    )


def images_of(spark: SparkSession, rows: DataFrame, folder: str, path: str = "image_path", root: str = "") -> DataFrame:
    """row_id, ok, img_rgb, img_color for the rows that name an image under the folder, relative to root or not.

    Images are read and averaged where they are, and only their colours are shuffled to the rows.
    """
    seen = dominant_colors(read_images(spark, folder)).select("origin", "ok", "img_rgb", "img_color")
    named = rows.select(F.col("row_id").alias("row_id"), resolve_path(root or folder, F.col(path)).alias("origin")).filter(F.coalesce(F.col(path), F.lit("")) != "")
    return named.join(seen, "origin").select("row_id", "ok", "img_rgb", "img_color")


def average_rgb(data: bytes, height: int, width: int, channels: int) -> list[int] | None:
    """The mean colour of an image averaged down to SIDE x SIDE, its darkest and lightest pixels left out
    if more than MANY remain; whole numbers, cut off. None for what could not be read."""
    if data is None or height is None or height <= 0 or width <= 0:
        return None
    pixels = np.frombuffer(data, np.uint8).reshape(height, width, channels).astype(np.float32)
    pixels = pixels[:, :, [2, 1, 0]] if channels >= 3 else np.repeat(pixels[:, :, :1], 3, 2)
    rows, cols = (np.arange(SIDE) * n // SIDE for n in (height, width))
    ends = [np.maximum((np.arange(SIDE) + 1) * n // SIDE, start + 1) for n, start in ((height, rows), (width, cols))]
    total = np.zeros((height + 1, width + 1, 3))
    total[1:, 1:] = pixels.cumsum(0).cumsum(1)
    box = total[np.ix_(ends[0], ends[1])] - total[np.ix_(rows, ends[1])] - total[np.ix_(ends[0], cols)] + total[np.ix_(rows, cols)]
    small = (box / np.outer(ends[0] - rows, ends[1] - cols)[:, :, None]).reshape(-1, 3)
    bright = small.mean(1)
    kept = small[(bright > DARK) & (bright < LIGHT)]
    return [int(x) for x in (kept if len(kept) > MANY else small).mean(0)]


def dominant_colors(images: DataFrame) -> DataFrame:
    """images with img_rgb and img_color."""

    @F.pandas_udf("array<int>")
    def rgb(data: pd.Series, height: pd.Series, width: pd.Series, channels: pd.Series) -> pd.Series:
        return pd.Series([average_rgb(*x) for x in zip(data, height, width, channels, strict=True)], dtype=object)

    out = images.withColumn("img_rgb", rgb("data", "height", "width", "channels"))
    return out.withColumn("img_color", nearest_color(F.col("img_rgb")[0], F.col("img_rgb")[1], F.col("img_rgb")[2]))


def pixel_colors(pixels: DataFrame, key: str = "row_id") -> DataFrame:
    """The same from one row a pixel (red, green, blue): key, red, green, blue, img_color."""
    kept = is_kept(F.col("red"), F.col("green"), F.col("blue"))
    many = F.count_if(kept) > MANY
    mean = lambda c: F.when(many, F.avg(F.when(kept, F.col(c)))).otherwise(F.avg(c)).cast("int").alias(c)
    out = pixels.groupBy(key).agg(mean("red"), mean("green"), mean("blue"))
    return out.withColumn("img_color", nearest_color(F.col("red"), F.col("green"), F.col("blue")))


def fetch(rows: DataFrame, fetcher: Callable[[str], bytes | None], url: str = "image_url") -> DataFrame:
    """rows with content: what fetcher(url) gives, null if it fails or there is no URL. It runs on the executors."""

    @F.pandas_udf("binary")
    def get(urls: pd.Series) -> pd.Series:
        return pd.Series([_try(fetcher, u) for u in urls], dtype=object)

    return rows.withColumn("content", get(F.col(url)))


def _try(fetcher: Callable[[str], bytes | None], url: str | None) -> bytes | None:
    if not url:
        return None
    try:
        return fetcher(url)
    except Exception:  # a failed download leaves the row without an image, whatever the reason
        return None


def copy_jobs(repaired: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """source and target paths of the copies that a repair asks for, each target once.

    A repair says itself which file an image comes from; rows, the table before it, is only asked where it doesn't.
    """
    moved = repaired.filter("image_origin_row_id is not null").withColumn("target", F.concat(F.lit(IMAGES + "/"), F.col("row_id").cast("string"), F.lit(".jpg")))
    if "image_origin_path" in repaired.columns:
        return moved.select(F.col("image_origin_path").alias("source"), "target").filter("source <> target").distinct()
    origin = rows.select(F.col("row_id").alias("image_origin_row_id"), F.col("image_path").alias("source")).dropDuplicates(["image_origin_row_id"])
    return moved.join(origin, "image_origin_row_id").select("source", "target").filter("source <> target").distinct()


def embed(rows: DataFrame, embedder: Callable[[], Callable[[list[str], list[bytes]], tuple[np.ndarray, np.ndarray]]], text: str = "canonical_text", image: str = "content") -> DataFrame:
    """rows with text_emb and image_emb from a model; null where there is no image.

    embedder() makes the model once in each worker; the model takes a batch of texts and images. Rows
    without an image don't reach it.
    """
    vector = ArrayType(FloatType())
    schema = StructType([*rows.schema.fields, StructField("text_emb", vector), StructField("image_emb", vector)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = embedder()
        for batch in batches:
            if len(batch):
                a, b = model(batch[text].fillna("").tolist(), batch[image].tolist())
                yield batch.assign(text_emb=list(np.asarray(a, np.float32)), image_emb=list(np.asarray(b, np.float32)))

    there = rows.filter(F.col(image).isNotNull()).mapInPandas(run, schema)
    none = rows.filter(F.col(image).isNull())
    return there.unionByName(none.withColumns({"text_emb": F.lit(None).cast("array<float>"), "image_emb": F.lit(None).cast("array<float>")}))

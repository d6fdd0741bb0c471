"""From files to vectors: images named by rows, read where they lie, go through a model in batches."""

from __future__ import annotations

import importlib
from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from pairmend.functions.text import resolve_path

#: A model: encode_texts and encode_images take a list (of str, of bytes) and give a row of numbers for each.
Factory = Callable[[], object]


def factory_of(name: str) -> Factory:
    """The factory that module:function names; the module is imported where it is called."""
    module, _, attribute = name.partition(":")
    if not module or not attribute:
        raise ValueError("a model is named module:function")
    return lambda: getattr(importlib.import_module(module), attribute)()


def _each_or_nan(encode: Callable[[list], np.ndarray], given: list) -> np.ndarray:
    """A vector for each thing; if the batch fails, one by one, so that a thing that can't be read costs its own row alone (numbers that are none)."""
    try:
        return np.asarray(encode(given), np.float32)
    except Exception:  # a broken image may raise anything
        rows = []
        for one in given:
            try:
                rows.append(np.asarray(encode([one]), np.float32)[0])
            except Exception:
                rows.append(None)
        size = max((len(r) for r in rows if r is not None), default=1)
        return np.stack([np.full(size, np.nan, np.float32) if r is None else r for r in rows])


def _encoder(factory: Factory, method: str, kind: type, batch_size: int):
    def make():
        encode = getattr(factory(), method)
        return lambda given: _each_or_nan(encode, [kind(x) for x in given])

    return predict_batch_udf(make, return_type=ArrayType(FloatType()), batch_size=batch_size)


def with_vectors(rows: DataFrame, factory: Factory, batch_size: int = 16, text: str = "canonical_text", content: str = "content") -> DataFrame:
    """rows with text_emb and image_emb in place of content: the model's vectors, one model a worker, batch_size things at a time.

    A row whose image is missing or can't be decoded has a null image_emb and takes part no further; a null text is
    an empty one. Vectors of numbers that are none are null.
    """
    texts, images = (_encoder(factory, m, k, batch_size) for m, k in (("encode_texts", str), ("encode_images", bytes)))
    there = rows.filter(F.col(content).isNotNull()).withColumn("image_emb", images(F.col(content)))
    none = rows.filter(F.col(content).isNull()).withColumn("image_emb", F.lit(None).cast("array<float>"))
    out = there.unionByName(none).drop(content)
    out = out.withColumn("text_emb", texts(F.coalesce(F.col(text), F.lit(""))))
    fine = lambda c: F.when(~F.exists(c, lambda x: F.isnan(x)), F.col(c))
    return out.withColumns({c: fine(c) for c in ("text_emb", "image_emb")})


def embedded(spark: SparkSession, rows: DataFrame, root: str, factory: Factory, batch_size: int = 16, path: str = "image_path") -> DataFrame:
    """rows (not marked as lacking their image) with the vectors of their texts and of the image files that they name, relative to root.

    Files are read by Spark in the folders that rows name, and joined to the rows by path.
    """
    rows = rows.drop("text_emb", "image_emb")
    origin = F.when(F.coalesce(F.col(path), F.lit("")) != "", resolve_path(root, F.col(path)))
    named = rows.withColumn("__origin", origin)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    files = files.select(F.regexp_replace("path", "^file:/+", "/").alias("__path"), "content")
    return with_vectors(named.join(files, F.col("__origin") == F.col("__path"), "left").drop("__origin", "__path"), factory, batch_size)

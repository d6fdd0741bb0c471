"""Flagging rows whose text and image disagree: cosine scores, robust thresholds, flags and reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairmend.config import SieveConfig
from pairmend.functions.vectors import cosine, fit
from pairmend.operators.quantiles import exact_quantiles
from pairmend.schema import SIEVE_DEFAULTS, ensure_columns
from pairmend.sources.shared import settle


def score(rows: DataFrame, text: str = "text_emb", image: str = "image_emb") -> DataFrame:
    """rows with sim_score, the cosine of its two vectors; null where one is missing."""
    return rows.withColumn("sim_score", cosine(F.col(text), F.col(image)))


def _fence(method: str, k: float, q: float) -> tuple[list[float], Column]:
    """The quantiles that a method needs, and its threshold from q0, q1."""
    if method == "iqr":
        return [0.25, 0.75], F.col("q0") - F.lit(k) * (F.col("q1") - F.col("q0"))
    return [q], F.col("q0")


def global_threshold(scored: DataFrame, config: SieveConfig = SieveConfig(), value: str = "sim_score") -> DataFrame:
    """One row, global_threshold: the fence of all scores; -1 if there are none. A method other than iqr is quantile."""
    qs, fence = _fence(config.global_threshold_method, config.iqr_k, config.global_quantile_q)
    found = exact_quantiles(scored, None, value, qs).select(fence.alias("t"))
    return found.agg(F.coalesce(F.max("t"), F.lit(-1.0)).alias("global_threshold"))


def category_thresholds(scored: DataFrame, config: SieveConfig = SieveConfig(), category: str = "category", value: str = "sim_score", overall: DataFrame | None = None) -> DataFrame:
    """category, n_scored, sieve_threshold, threshold_source, one row for each category with a score.

    Categories with fewer than min_category_samples scores take the global threshold. A method other
    than quantile is iqr. Rows without a category make none.
    """
    method = "quantile" if config.threshold_method == "quantile" else "iqr"
    qs, fence = _fence(method, config.iqr_k, config.quantile_q)
    own = exact_quantiles(scored.filter(F.col(category).isNotNull()), category, value, qs)
    few = F.col("n") < config.min_category_samples
    both = own.join(F.broadcast(global_threshold(scored, config, value) if overall is None else overall))  # one row, not a product
    return both.select(
        category,
        F.col("n").alias("n_scored"),
        F.when(few, F.col("global_threshold")).otherwise(fence).alias("sieve_threshold"),
        F.when(few, "global").otherwise("category").alias("threshold_source"),
    )


def attach(rows: DataFrame, thresholds: DataFrame, overall: DataFrame, category: str = "category") -> DataFrame:
    """rows with sieve_threshold, threshold_source (unknown without a category's threshold) and global_threshold."""
    given = thresholds.select(F.col(category).alias("__c"), "sieve_threshold", "threshold_source")
    out = rows.join(given, F.col(category) == F.col("__c"), "left").drop("__c")
    out = out.withColumn("threshold_source", F.coalesce("threshold_source", F.lit("unknown")))
    return out.join(F.broadcast(overall))  # one row


def flag(rows: DataFrame) -> DataFrame:
    """rows with flagged and flag_reason: a missing image, then a missing text, then a score below its threshold."""
    low = F.coalesce(F.col("sim_score") < F.col("sieve_threshold"), F.lit(False))
    no_image, no_text = (F.coalesce(F.col(c).cast("boolean"), F.lit(False)) for c in ("is_image_missing", "is_text_missing"))
    reason = F.when(no_image, "missing_image").when(no_text, "missing_text").when(low, "low_similarity").otherwise("ok")
    return rows.withColumns({"flagged": no_image | no_text | low, "flag_reason": reason})


def sieve(rows: DataFrame, config: SieveConfig = SieveConfig()) -> DataFrame:
    """Rows with vectors or with sim_score, through thresholds to flags; other columns pass through.

    Text-missing rows that have a score count for the thresholds like any other.
    """
    rows = ensure_columns(rows, SIEVE_DEFAULTS)
    scored = rows if "sim_score" in rows.columns else score(rows)
    scored = scored.withColumn("sim_score", F.when(~F.isnan("sim_score"), F.col("sim_score")))
    overall = settle(global_threshold(scored, config))
    return flag(attach(scored, category_thresholds(scored, config, overall=overall), overall))


def export_embeddings(sieved: DataFrame, size: int) -> DataFrame:
    """The embedding cache: vectors of exactly `size` floats, -1 for a missing score or threshold, flagged 0 or 1."""
    return sieved.select(
        F.col("row_id").cast("string").alias("row_id"),
        fit(F.col("text_emb"), size).alias("text_emb"),
        fit(F.col("image_emb"), size).alias("image_emb"),
        F.coalesce("sim_score", F.lit(-1.0)).cast("float").alias("sim_score"),
        F.coalesce("sieve_threshold", F.lit(-1.0)).cast("float").alias("sieve_threshold"),
        F.coalesce(F.col("flagged").cast("int"), F.lit(0)).alias("flagged"),
    )


def summary(sieved: DataFrame) -> DataFrame:
    """What a reader looks at first."""
    return sieved.select("row_id", "category", "sim_score", "sieve_threshold", "threshold_source", "flagged", "flag_reason")

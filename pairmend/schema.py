"""Table schemas, and adding the columns that a table lacks."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RAW = "row_id STRING, title STRING, category STRING, attributes_json STRING, image_path STRING, image_url STRING"
PROCESSED = (
    "row_id STRING, title STRING, category STRING, attributes STRING, canonical_text STRING, image_path STRING, "
    "is_image_missing BOOLEAN, is_text_missing BOOLEAN, source_image_path STRING, source_image_url STRING"
)
NOISY = f"{PROCESSED}, noise_label STRING"
SIEVED = f"{PROCESSED}, sim_score DOUBLE, sieve_threshold DOUBLE, threshold_source STRING, global_threshold DOUBLE, flagged BOOLEAN, flag_reason STRING"
EMBEDDINGS = "row_id STRING, text_emb ARRAY<FLOAT>, image_emb ARRAY<FLOAT>, sim_score FLOAT, sieve_threshold FLOAT, flagged INT"
QUEUE = "row_id STRING, error_type STRING, suggested_direction STRING, mismatch_aspects STRING, image_trust DOUBLE, text_trust DOUBLE, proposed_fix STRING"
PLAN = "row_id STRING, error_type STRING, mismatch_aspects STRING, suggested_direction STRING, action STRING, tier INT, cost_units DOUBLE, proposed_fix STRING, notes STRING, step BIGINT"
LOG = "step BIGINT, row_id STRING, status STRING, reason STRING, action STRING"

SIEVE_DEFAULTS = {"row_id": "", "category": "", "canonical_text": "", "image_path": "", "is_image_missing": False, "is_text_missing": False}
REPAIR_DEFAULTS = dict.fromkeys(("row_id", "title", "category", "attributes", "canonical_text", "image_path"), "")


def ensure_columns(df: DataFrame, defaults: dict[str, Any]) -> DataFrame:
    """df with each absent column added, filled with its default."""
    absent = {c: F.lit(d) for c, d in defaults.items() if c not in df.columns}
    return df.withColumns(absent) if absent else df

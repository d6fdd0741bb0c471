"""Flagging new rows as they arrive, against thresholds that are there already."""

from __future__ import annotations

from pyspark.sql import DataFrame

from pairmend.operators.sieve import attach, flag, score
from pairmend.schema import SIEVE_DEFAULTS, ensure_columns


def sieve_stream(rows: DataFrame, thresholds: DataFrame, overall: DataFrame) -> DataFrame:
    """A stream of rows with vectors or sim_score, flagged by fixed thresholds; there is no state to keep.

    thresholds and overall are what operators.sieve made of the rows so far. A category without a
    threshold is unknown, and its rows are flagged only for what they lack.
    """
    rows = ensure_columns(rows, SIEVE_DEFAULTS)
    scored = rows if "sim_score" in rows.columns else score(rows)
    return flag(attach(scored, thresholds, overall))

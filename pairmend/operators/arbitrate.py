"""Turning diagnoses into a plan of actions with tiers and costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairmend.functions.text import clean, json_map

# Each action's tier, cost and notes ({} stands for the candidate row).
ACTIONS = {
    "replace_image_from_row": (1, 1.0, "Replace image using candidate row {}"),
    "t2v_generate_image_unimplemented": (3, 10.0, "Would require generative T2V editing; not implemented in MVP."),
    "apply_text_patch": (1, 0.5, "Apply text_patch to row fields/attributes."),
    "v2t_generate_text_unimplemented": (2, 4.0, "Would require VLM-based text generation; not implemented in MVP."),
    "human_review": (0, 0.0, "Low confidence or missing modalities."),
}


def candidate(fix: Column | str) -> Column:
    """The row whose image is proposed, from a fix in JSON; empty if none is."""
    return clean(F.get_json_object(fix, "$.image_replacement_candidate_row_id"))


def text_patch(fix: Column | str) -> Column:
    """The text patch of a fix in JSON; empty if there is none or it is no object."""
    return json_map(F.get_json_object(fix, "$.text_patch"))


def _plan(action: str, row: Column | None = None) -> Column:
    tier, cost, notes = ACTIONS[action]
    text = F.lit(notes) if row is None else F.concat(F.lit(notes.removesuffix("{}")), row)
    return F.struct(F.lit(action).alias("action"), F.lit(tier).alias("tier"), F.lit(cost).alias("cost_units"), text.alias("notes"))


def arbitrate(queue: DataFrame, order_by: str = "row_id") -> DataFrame:
    """The plan: one row a queue row, with step, its place in the order of execution (by order_by).

    A fix that is no JSON object counts as empty. An empty queue gives an empty plan.
    """
    direction = F.upper(clean("suggested_direction"))
    cand = candidate("proposed_fix")
    chosen = (
        F.when((direction == "T2V") & (cand != ""), _plan("replace_image_from_row", cand))
        .when(direction == "T2V", _plan("t2v_generate_image_unimplemented"))
        .when((direction == "V2T") & (F.size(text_patch("proposed_fix")) > 0), _plan("apply_text_patch"))
        .when(direction == "V2T", _plan("v2t_generate_text_unimplemented"))
        .otherwise(_plan("human_review"))
    )
    plan = queue.withColumn("p", chosen).select(
        clean("row_id").alias("row_id"), clean("error_type").alias("error_type"), clean("mismatch_aspects").alias("mismatch_aspects"),
        direction.alias("suggested_direction"), "p.action", "p.tier", "p.cost_units", F.col("proposed_fix"), "p.notes", F.col(order_by).alias("__o"),
    )
    return number(plan, "__o").drop("__o")


def number(rows: DataFrame, order_by: str, into: str = "step") -> DataFrame:
    """rows with their places, from 0, in the order of a column, the rest of the row deciding between equals.

    Rows are ordered by ranges, each range in its own task; only the ranges' sizes meet in one place.
    """
    from pyspark.sql import Window

    from pairmend.sources.shared import settle

    if not rows.columns:
        raise ValueError("rows have no columns")
    spread = settle(rows.repartitionByRange(order_by).withColumn("__r", F.spark_partition_id()))
    sizes = spread.groupBy("__r").agg(F.count("*").alias("c"))
    sizes = sizes.select("__r", (F.sum("c").over(Window.orderBy("__r")) - F.col("c")).alias("before"))
    within = Window.partitionBy("__r").orderBy(order_by, *[c for c in rows.columns if c != order_by])
    return spread.join(F.broadcast(sizes), "__r").withColumn(into, F.col("before") + F.row_number().over(within) - 1).drop("__r", "before")


def cost_by_action(plan: DataFrame) -> DataFrame:
    """action, tier, steps, cost_units."""
    return plan.groupBy("action", "tier").agg(F.count("*").alias("steps"), F.sum("cost_units").alias("cost_units"))

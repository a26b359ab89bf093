"""Workflow metrics: one aggregate per item over the log, then one global row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from .overlays import event_order


def first_decisions(events: DataFrame) -> DataFrame:
    """Per item: first autonomous decision, whether a human acted, whether that confirmed need."""
    decided = F.col("action").isin(*K.DECISION_ACTIONS)
    human = F.col("actor") == "human"
    return events.groupBy("invoice_id").agg(
        F.min_by(F.when(decided, F.col("action")),
                 F.when(decided, event_order())).alias("first_decision"),
        F.max(human).alias("human_touched"),
        F.max(human & F.col("action").isin(*K.CONFIRMING_ACTIONS)).alias("human_confirmed"),
        F.array_sort(F.collect_set(F.when(human, F.col("action")))).alias("human_actions"))


def workflow_metrics(items: DataFrame, events: DataFrame) -> DataFrame:
    """items(invoice_id, status) and the log → one row of counts and nullable rates."""
    return rates(items.select("invoice_id", "status").join(
        first_decisions(events).drop("human_actions"), "invoice_id", "left"))


def rates(df: DataFrame) -> DataFrame:
    """Items with status, first decision and human marks → one row of counts and nullable rates."""
    auto, held = F.col("first_decision") == "posted", F.col("first_decision") == "held"

    def n(cond, name):
        return F.count_if(F.coalesce(cond, F.lit(False))).alias(name)

    counts = df.agg(
        F.count(F.lit(1)).alias("total"), n(F.col("status") == "posted", "submitted"),
        n(F.col("status") == "held", "held"), n(F.col("status") == "failed", "failed"),
        n(auto, "_auto"), n(held, "_hold"), n(auto & F.col("human_confirmed"), "_false"),
        n(held & F.col("human_touched"), "_reviewed"),
        n(held & F.col("human_confirmed"), "_confirmed"))

    def rate(num, den):
        return F.round(F.col(num).cast("double") / F.nullif(den, F.lit(0)).cast("double"), 3)

    counts = counts.withColumn("_decided", F.col("_auto") + F.col("_hold"))
    return counts.select(
        "total", "submitted", "held", "failed",
        rate("_auto", F.col("_decided")).alias("auto_submit_rate"),
        rate("_false", F.col("_auto")).alias("false_submit_rate"),
        rate("_confirmed", F.col("_reviewed")).alias("hold_precision"))


def percent_text(c):
    """Whole-percent display of a rate; a dash when there is none."""
    return F.coalesce(F.concat(F.round(c * 100, 0).cast("int").cast("string"), F.lit("%")),
                      F.lit("—"))

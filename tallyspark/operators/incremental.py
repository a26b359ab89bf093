"""Overlays, statuses and metrics that follow a growing log: states that add up.

An item's state holds what the figures need of its events: the latest moving event, the first decision, what a human has
done, the latest override per field. Two states of an item merge by latest, first and any, so a batch of
events, late ones included, costs the buckets of its items (``sources.buckets``) and no second look at the log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from . import metrics, overlays, review


def item_rows(events: DataFrame) -> DataFrame:
    """One state per item of a batch of events."""
    return merge_items(events.select(
        "invoice_id",
        F.when(F.col("action").isin(*K.ACTION_STATUS), F.struct(overlays.event_order().alias("o"), "action")).alias("moved"),
        F.when(F.col("action").isin(*K.DECISION_ACTIONS), F.struct(overlays.event_order().alias("o"), "action")).alias("decided"),
        (F.col("actor") == "human").alias("human_touched"),
        ((F.col("actor") == "human") & F.col("action").isin(*K.CONFIRMING_ACTIONS)).alias("human_confirmed")))


def merge_items(rows: DataFrame) -> DataFrame:
    return rows.groupBy("invoice_id").agg(
        F.max_by("moved", "moved.o").alias("moved"), F.min_by("decided", "decided.o").alias("decided"),
        F.max("human_touched").alias("human_touched"), F.max("human_confirmed").alias("human_confirmed"))


def status_of(rows: DataFrame) -> DataFrame:
    """``overlays.current_status`` of the log so far."""
    pairs = [F.lit(x) for kv in K.ACTION_STATUS.items() for x in kv]
    return rows.where("moved is not null").select(
        "invoice_id", F.try_element_at(F.create_map(*pairs), F.col("moved.action")).alias("status"))


def metrics_of(rows: DataFrame) -> DataFrame:
    """``metrics.workflow_metrics`` of the log so far, without a join."""
    pairs = [F.lit(x) for kv in K.ACTION_STATUS.items() for x in kv]
    return metrics.rates(rows.where("moved is not null").select(
        F.try_element_at(F.create_map(*pairs), F.col("moved.action")).alias("status"),
        F.col("decided.action").alias("first_decision"), "human_touched", "human_confirmed"))


def override_rows(events: DataFrame) -> DataFrame:
    """The latest override per item and field of a batch of events."""
    return merge_overrides(overlays.correction_rows(events).select(
        "invoice_id", "field", F.struct(overlays.event_order().alias("o"), "value").alias("latest")))


def merge_overrides(rows: DataFrame) -> DataFrame:
    return rows.groupBy("invoice_id", "field").agg(F.max_by("latest", "latest.o").alias("latest"))


def overlay_of(rows: DataFrame) -> DataFrame:
    """``overlays.metadata_overlay`` of the log so far."""
    return rows.select("invoice_id", "field", F.col("latest.value").alias("value"))


def merge_samples(rows: DataFrame, k: int = K.SPOT_CHECK_K, seed: int = 0) -> DataFrame:
    """The spot check over several batches from the samples of each: the least hashes of the least hashes."""
    return review.spot_check(rows, k, seed)

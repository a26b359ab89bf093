"""Reviewer read models: tags, lists, queue, digest, trace, detail, spot checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.spread import ranked
from .decide import is_retryable
from .overlays import detail, effective_metadata


def exception_summary(exceptions: DataFrame) -> DataFrame:
    """Per item: exception count, low-confidence flag and the primary (earliest) exception."""
    low = F.col("type").isin(*K.LOW_CONFIDENCE_CODES)
    return exceptions.groupBy("invoice_id").agg(
        F.count(F.lit(1)).alias("exception_count"), F.max(low).alias("_low"),
        F.min_by(F.struct("type", "message"), F.struct("created_at", "id")).alias("_primary"))


def tagged(items: DataFrame, exceptions: DataFrame) -> DataFrame:
    """items(invoice_id, status, decision, decision_confidence, …) with sorted ``filter_tags``,
    ``exception_count``, ``reason`` and ``reason_title``."""
    df = items.join(exception_summary(exceptions), "invoice_id", "left")
    watch = (F.col("decision") == "submit") & (F.col("decision_confidence") < K.SUBMIT_WATCH)
    tags = F.array(
        F.col("status"),
        F.when(F.col("status").isin("held", "failed"), "needs_review"),
        F.when(F.coalesce("_low", F.lit(False)) | F.coalesce(watch, F.lit(False)),
               "low_confidence"))
    return (df.withColumn("filter_tags", F.array_sort(F.array_distinct(F.array_compact(tags))))
            .withColumn("exception_count", F.coalesce("exception_count", F.lit(0)))
            .withColumn("reason", F.col("_primary.type"))
            .withColumn("reason_title", F.col("_primary.message"))
            .drop("_low", "_primary"))


def summaries(items: DataFrame, exceptions: DataFrame, overlay: DataFrame) -> DataFrame:
    """List rows showing corrected values: items carry ``fields``; amounts are shown as text."""
    rows = effective_metadata(tagged(items, exceptions), overlay)
    return rows.select(
        "invoice_id", "status", "decision", "decision_confidence",
        F.expr("fields['invoice_number']").alias("invoice_number"),
        F.expr("fields['vendor_name']").alias("vendor_name"),
        F.expr("fields['total_amount']").alias("total_amount"), "exception_count", "filter_tags",
        "updated_at")


def filtered(tag_rows: DataFrame, key: str | None) -> DataFrame:
    if key is None:
        return tag_rows
    if key not in K.FILTER_KEYS:
        raise ValueError(f"unknown filter '{key}'")
    return tag_rows.filter(F.array_contains("filter_tags", key))


def chip_counts(tag_rows: DataFrame) -> DataFrame:
    """Items per triage key; one pass, zero-filled by construction."""
    counted = tag_rows.agg(*[
        F.count_if(F.array_contains("filter_tags", k)).alias(k) for k in K.FILTER_KEYS])
    pairs = ", ".join(f"'{k}', {k}" for k in K.FILTER_KEYS)
    return counted.select(F.expr(f"stack({len(K.FILTER_KEYS)}, {pairs}) as (tag, items)"))


def review_queue(tag_rows: DataFrame) -> DataFrame:
    """Held items by reason, oldest first inside a reason."""
    return tag_rows.filter("status = 'held'").orderBy(
        F.coalesce("reason", F.lit("")), "updated_at", "invoice_id")


def held_digest(items: DataFrame, exceptions: DataFrame) -> DataFrame:
    """(reason, n): exception rows of held items by type, and the held total as ``held_count``."""
    held = items.filter("status = 'held'").select("invoice_id")
    by_type = (exceptions.groupBy("invoice_id", "type").agg(F.count(F.lit(1)).alias("n"))
               .join(held, "invoice_id", "left_semi")
               .groupBy(F.col("type").alias("reason")).agg(F.sum("n").alias("n")))
    total = held.agg(F.count(F.lit(1)).alias("n")).select(F.lit("held_count").alias("reason"), "n")
    return by_type.unionByName(total)


def trace(events: DataFrame) -> DataFrame:
    """Numbered steps per item with ok flag, and kind, error, retryable on failures."""
    rows = ranked(events.withColumn("_minute", F.date_trunc("minute", "ts")),
                  ["invoice_id"], ["_minute"], ["ts", "seq", "event_id"], "step")
    failed = F.col("action") == "failed"
    kind = F.when(failed, detail("kind"))
    return rows.select(
        "invoice_id", "step", F.col("action").alias("stage"), "actor", "ts", (~failed).alias("ok"),
        kind.alias("kind"), F.when(failed, detail("reason")).alias("error"),
        F.when(kind.isNotNull(), is_retryable(kind)).alias("retryable"))


def item_detail(items: DataFrame, lines: DataFrame, exceptions: DataFrame,
                events: DataFrame) -> DataFrame:
    """Everything about every item as (invoice_id, section, sort_key, payload JSON) rows.

    Kept in rows rather than nested arrays: an item with very many events stays a splittable
    sorted run instead of one huge cell. Sections sort as item, line, exception, event.
    """
    def part(df, section, sort_key, *cols):
        return df.select("invoice_id", F.lit(section).alias("section"),
                         sort_key.cast("string").alias("sort_key"),
                         F.to_json(F.struct(*cols)).alias("payload"))
    stamp = F.lpad(F.unix_micros("ts").cast("string"), 20, "0")
    made = F.lpad(F.unix_micros("created_at").cast("string"), 20, "0")
    return (part(items, "1_item", F.lit(""), *[c for c in items.columns if c != "invoice_id"])
            .unionByName(part(lines, "2_line", F.lpad(F.col("pos").cast("string"), 10, "0"),
                              *[c for c in lines.columns if c != "invoice_id"]))
            .unionByName(part(exceptions, "3_exception", F.concat_ws("|", made, "id"),
                              "type", "severity", "message"))
            .unionByName(part(events, "4_event", F.concat_ws(
                "|", stamp, F.lpad(F.col("seq").cast("string"), 20, "0"), "event_id"),
                "actor", "action", "details")))


def spot_check(posted: DataFrame, k: int = K.SPOT_CHECK_K, seed: int = 0) -> DataFrame:
    """Uniform sample of at most k posted items, the same for the same seed (a top-k by hash)."""
    if k <= 0:
        return posted.limit(0)
    mixed = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("invoice_id")))
    return posted.orderBy(mixed, "invoice_id").limit(k)


def spot_check_events(sample: DataFrame) -> DataFrame:
    """Rows for the log: sampled items get a system note."""
    return sample.select(
        "invoice_id", F.lit("system").alias("actor"), F.lit("note").alias("action"),
        F.to_json(F.struct(F.lit(True).alias("spot_check"),
                           F.lit("spot-check sample").alias("reason"))).alias("details"))

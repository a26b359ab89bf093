"""State derived from the append-only event log: latest-wins overlays and statuses.

Events: event_id, invoice_id, seq, actor, action, details (JSON text), ts. Order is (ts, seq,
event_id). Latest-wins is ``max_by`` — a partial aggregate, so a busy item costs no hot task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.spread import previous
from ..functions.text import MONEY, non_empty


def event_order() -> Column:
    return F.struct("ts", "seq", "event_id")


def detail(path: str) -> Column:
    return F.get_json_object("details", "$." + path)


def corrections(events: DataFrame, target: str) -> DataFrame:
    return events.filter((F.col("actor") == "human") & (F.col("action") == "corrected")
                         & (detail("target") == target))


def correction_rows(events: DataFrame) -> DataFrame:
    """One row per (event, corrected metadata field): ``field``, ``value`` (may be null)."""
    after = F.from_json(detail("after"), "map<string,string>")
    return corrections(events, "metadata").select(
        "invoice_id", "ts", "seq", "event_id", F.explode(after).alias("field", "value"))


def metadata_overlay(events: DataFrame) -> DataFrame:
    """(invoice_id, field, value): the latest override; an explicit null wins over older values."""
    latest = correction_rows(events).groupBy("invoice_id", "field").agg(
        F.max_by(F.struct("value"), event_order()).alias("_v"))
    return latest.select("invoice_id", "field", F.col("_v.value").alias("value"))


def overlay_maps(overlay: DataFrame) -> DataFrame:
    """(invoice_id, overrides map). At most one entry per header field."""
    known = overlay.filter(F.col("field").isin(*K.HEADER_FIELDS))
    return known.groupBy("invoice_id").agg(F.map_from_entries(
        F.array_sort(F.collect_list(F.struct("field", "value")))).alias("overrides"))


def category_overlay(events: DataFrame) -> DataFrame:
    """(invoice_id, corrected_category): latest non-empty reviewer category."""
    rows = corrections(events, "category").withColumn("_c", detail("after.category"))
    return rows.filter("coalesce(_c, '') <> ''").groupBy("invoice_id").agg(
        F.max_by("_c", event_order()).alias("corrected_category"))


def line_overlay(events: DataFrame) -> DataFrame:
    """(invoice_id, line_item_id, catalog_item_id, catalog_description) latest per line."""
    rows = corrections(events, "line_item").select(
        "invoice_id", detail("line_item_id").alias("line_item_id"), "ts", "seq", "event_id",
        F.struct(detail("after.catalog_item_id").alias("catalog_item_id"),
                 detail("after.catalog_description").alias("catalog_description")).alias("_a"))
    return rows.filter("coalesce(line_item_id, '') <> ''").groupBy(
        "invoice_id", "line_item_id").agg(F.max_by("_a", event_order()).alias("_a")).select(
        "invoice_id", "line_item_id", "_a.*")


def effective_metadata(items: DataFrame, overlay: DataFrame) -> DataFrame:
    """items(invoice_id, fields map, …) with non-empty overrides applied and amounts re-typed.

    ``invalid_override`` marks an override that is no decimal; the item then fails its stage.
    """
    df = items.join(overlay_maps(overlay), "invoice_id", "left")
    names = ", ".join(f"'{f}'" for f in K.HEADER_FIELDS)
    df = df.withColumn("overrides", F.coalesce("overrides", F.create_map().cast(
        "map<string,string>")))
    df = df.withColumn("fields", F.expr(f"""map_from_arrays(array({names}),
        transform(array({names}),
            f -> coalesce(nullif(try_element_at(overrides, f), ''), try_element_at(fields, f))))"""))

    def amount(name):
        return F.expr(f"try_cast(trim(fields['{name}']) as {MONEY})")

    wrong = " or ".join(
        f"(fields['{f}'] is not null and try_cast(trim(fields['{f}']) as {MONEY}) is null)"
        for f in K.DECIMAL_FIELDS)
    return (df.withColumn("total_amount", amount("total_amount")).withColumn("tax", amount("tax"))
            .withColumn("invalid_override", F.expr(wrong)))


def apply_line_overlay(matches: DataFrame, overlay: DataFrame) -> DataFrame:
    """Corrected lines keep the reviewer's item as a fixed, confident input."""
    ov = overlay.select("invoice_id", "line_item_id",
                        F.struct("catalog_item_id", "catalog_description").alias("_o"))
    df = matches.join(ov, ["invoice_id", "line_item_id"], "left")
    hit = F.col("_o").isNotNull()
    return (df.withColumn("catalog_item_id", F.when(hit, F.col("_o.catalog_item_id"))
                          .otherwise(F.col("catalog_item_id")))
            .withColumn("catalog_description", F.when(hit, F.col("_o.catalog_description"))
                        .otherwise(F.col("catalog_description")))
            .withColumn("confidence", F.when(hit, 1.0).otherwise(F.col("confidence")))
            .withColumn("requires_exception_review",
                        F.when(hit, False).otherwise(F.col("requires_exception_review")))
            .withColumn("exceptions", F.when(hit, F.array().cast("array<string>"))
                        .otherwise(F.col("exceptions")))
            .withColumn("rationale", F.when(hit, K.REVIEWER_EVIDENCE)
                        .otherwise(F.col("rationale")))
            .drop("_o"))


def latest_details(events: DataFrame, actions: Sequence[str] | None = None,
                   per_action: bool = True) -> DataFrame:
    """Details of the latest event per item (and action)."""
    df = events if actions is None else events.filter(F.col("action").isin(*actions))
    keys = ["invoice_id", "action"] if per_action else ["invoice_id"]
    picked = df.groupBy(*keys).agg(
        F.max_by(F.struct("action", "details", "ts"), event_order()).alias("_e"))
    keep = [F.col("_e.details").alias("details"), F.col("_e.ts").alias("ts")]
    if not per_action:
        keep.insert(0, F.col("_e.action").alias("action"))
    return picked.select(*keys, *keep)


def rerun_inputs(events: DataFrame) -> DataFrame:
    """Confidence map, evidence map and missing list as stored at extraction, with every
    non-empty correction counted as verified (1.0, no longer missing)."""
    stored = latest_details(events, ["extracted"]).select(
        "invoice_id", F.from_json("details", (
            "field_confidence map<string,double>, field_evidence map<string,string>,"
            " missing_fields array<string>")).alias("d"))
    ov = overlay_maps(metadata_overlay(events).filter("coalesce(value, '') <> ''"))
    df = stored.join(ov, "invoice_id", "left").select(
        "invoice_id",
        F.coalesce("overrides", F.create_map().cast("map<string,string>")).alias("overrides"),
        F.coalesce("d.field_confidence", F.create_map().cast("map<string,double>")).alias("fc"),
        F.coalesce("d.field_evidence", F.create_map().cast("map<string,string>")).alias("fe"),
        F.coalesce("d.missing_fields", F.array().cast("array<string>")).alias("mf"))
    keep = "map_filter({0}, (k, v) -> not map_contains_key(overrides, k))"
    return df.select(
        "invoice_id", "overrides",
        F.expr(f"map_concat({keep.format('fc')}, transform_values(overrides, (k, v) -> 1.0D))")
        .alias("field_confidence"),
        F.expr(f"map_concat({keep.format('fe')}, transform_values(overrides,"
               f" (k, v) -> '{K.REVIEWER_EVIDENCE}'))").alias("field_evidence"),
        F.expr("filter(mf, f -> not map_contains_key(overrides, f))").alias("missing_fields"))


def before_after(events: DataFrame, base: DataFrame) -> DataFrame:
    """Each metadata correction with the effective value it replaced.

    base(invoice_id, field, ai_value). The previous correction is found per minute bucket, so an
    item with very many corrections is not sorted by one task.
    """
    rows = correction_rows(events).withColumn("_minute", F.date_trunc("minute", "ts"))
    rows = previous(rows, ["invoice_id", "field"], ["_minute"], ["ts", "seq", "event_id"],
                    "value", "_prev")
    return rows.join(base, ["invoice_id", "field"], "left").select(
        "invoice_id", "field", "event_id",
        F.coalesce(non_empty(F.col("_prev.value")), F.col("ai_value")).alias("before_value"),
        F.col("value").alias("after_value"))


def current_status(events: DataFrame) -> DataFrame:
    """State is the latest state-changing event."""
    moves = events.filter(F.col("action").isin(*K.ACTION_STATUS))
    pairs = [F.lit(x) for kv in K.ACTION_STATUS.items() for x in kv]
    return moves.groupBy("invoice_id").agg(
        F.max_by("action", event_order()).alias("_a")).select(
        "invoice_id", F.try_element_at(F.create_map(*pairs), F.col("_a")).alias("status"))


def terminal_events(events: DataFrame) -> DataFrame:
    """Latest of posted/held/failed/rejected with its displayed rationale and risk flags."""
    last = latest_details(events, K.TERMINAL_ACTIONS, per_action=False)
    return last.select("invoice_id", "action", F.coalesce(
        detail("reason"), detail("rationale"), detail("error")).alias("rationale"),
        F.coalesce(detail("risk_flags"), F.lit("[]")).alias("risk_flags"), "ts")


def ai_versus_human(items: DataFrame, overlay: DataFrame) -> DataFrame:
    """(invoice_id, field, ai_value, human_value, shown_value, corrected) for every header field."""
    names = ", ".join(f"'{f}'" for f in K.HEADER_FIELDS)
    base = items.select("invoice_id", F.explode(F.expr(
        f"transform(array({names}), f -> struct(f as field,"
        " nullif(try_element_at(fields, f), '') as ai_value))")).alias("c")).select(
        "invoice_id", "c.*")
    ov = overlay.select("invoice_id", "field", F.struct("value").alias("_o"))
    return base.join(ov, ["invoice_id", "field"], "left").select(
        "invoice_id", "field", "ai_value", F.col("_o.value").alias("human_value"),
        F.when(F.col("_o").isNotNull(), F.col("_o.value")).otherwise(F.col("ai_value"))
        .alias("shown_value"), F.col("_o").isNotNull().alias("corrected"))


def confidence_band(c: Column) -> Column:
    (low, low_b), (mid, mid_b) = K.CONFIDENCE_BANDS
    return (F.when(c.isNull(), "muted").when(c < low_b, low).when(c < mid_b, mid)
            .otherwise("conf-high"))


def ledger_status(status: Column, ref: Column, reason: Column) -> Column:
    """Ledger line of an item: reference when posted, reason when failed."""
    return (F.when((status == "posted") & ref.isNotNull(),
                   F.concat(F.lit("Posted to ledger (ref "), ref, F.lit(")")))
            .when(status == "posted", "Posted to ledger")
            .when(status == "failed", F.concat(F.lit("Failed: "),
                                               F.coalesce(reason, F.lit("unknown error"))))
            .when(status == "held", "Held — not posted")
            .when(status == "rejected", "Rejected — not a receipt")
            .otherwise("Pending"))


def correction_diff(edits: DataFrame, effective: DataFrame) -> DataFrame:
    """edits(invoice_id, edits map) reduced to non-empty changes against the effective value."""
    df = edits.join(effective.select("invoice_id", "fields"), "invoice_id", "left")
    return df.withColumn("updates", F.expr(
        "map_filter(edits, (k, v) -> v <> '' and v <> coalesce(try_element_at(fields, k), ''))"))


def category_options(category: Column, alternates: Column) -> Column:
    """AI category, then its alternates; first occurrence kept, nulls dropped."""
    return F.array_distinct(F.array_compact(F.concat(F.array(category), alternates)))


def validate_corrections(batch: DataFrame, line_items: DataFrame) -> DataFrame:
    """batch(request_id, invoice_id, target, line_item_id, updates map) → ``error`` or null.

    Unknown metadata fields and unknown line items are rejected.
    """
    lines = line_items.select("invoice_id", F.col("id").alias("line_item_id")).distinct() \
        .withColumn("_known", F.lit(True))
    df = batch.join(lines, ["invoice_id", "line_item_id"], "left")
    df = df.withColumn("_unknown", F.array_sort(F.array_except(
        F.map_keys("updates"), F.array(*[F.lit(f) for f in K.HEADER_FIELDS]))))
    return df.withColumn("error", F.expr("""case
        when target = 'metadata' and size(_unknown) > 0
            then concat('unknown field(s): ', array_join(_unknown, ', '))
        when target = 'line_item' and not coalesce(_known, false)
            then 'line item not found' end""")).drop("_known", "_unknown")


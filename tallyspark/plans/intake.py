"""The document run: messages in, outcomes, exceptions, events and ledger rows out.

Everything up to the duplicate guard is row-local: one scan, no shuffle. The guard and the ledger
numbering are the only exchanges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.rows import written
from ..operators import audit, categorize, citations, decide, duplicates, overlays
from ..operators.extract import extract
from ..operators.parse import parse, register
from ..sources import ledger

_OPTIONAL = {"channel": "string", "subject": "string", "sender": "string",
             "attachment": "string", "attachment_path": "string", "attachment_b64": "string",
             "document": "string", "body": "string", "source_body": "string",
             "pdf_text": "string"}


# columns nothing after the decision reads
_HEAVY = ("document", "body", "source_body", "pdf_text", "attachment_b64", "text", "doc_text",
          "header", "candidates", "descriptions", "line_sources", "annotations")


def complete(messages: DataFrame) -> DataFrame:
    """Missing optional envelope columns as typed nulls."""
    for name, kind in _OPTIONAL.items():
        if name not in messages.columns:
            messages = messages.withColumn(name, F.lit(None).cast(kind))
    return messages


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage of a frame that several branches use: a Parquet table in the shared folder.

    Readers of few columns read few. See ``functions.rows.shared_folder`` for where it goes.
    """
    return written(df, "judged")


def read_documents(messages: DataFrame) -> DataFrame:
    return extract(parse(register(complete(messages))))


def with_text(extracted: DataFrame) -> DataFrame:
    df = extracted.withColumn("descriptions", F.col("lines.raw_description"))
    return df.withColumn("doc_text", categorize.doc_text(
        F.col("vendor_name"), F.expr("fields['sponsor_name']"), F.expr("fields['study_name']"),
        F.col("descriptions"), F.col("subject"), F.col("sender"), F.col("source_body")))


def judge(extracted: DataFrame, answers: DataFrame | None = None,
          overlay: DataFrame | None = None) -> DataFrame:
    """Classify, categorise and decide. Failures become ``error_kind``/``error_message``."""
    df = categorize.classify(decide.line_signals(with_text(extracted)))
    if answers is not None:
        df = categorize.merge_advice(df, answers)
    else:
        df = df.withColumn("advice_error", F.lit(None).cast("string"))
    for name in ("category", "category_confidence", "category_evidence"):
        df = df.withColumn(f"ai_{name}", F.col(name))
    if overlay is not None:
        df = categorize.pin_category(df, overlay)
    df = decide.decide(df)
    overflow = F.col("amount_overflow") if "amount_overflow" in df.columns else F.lit(False)
    kind = (F.when(F.col("extract_error"), "extraction_failed")
            .when(overflow | F.col("advice_error").isNotNull(), "stage_failure"))
    message = (F.when(F.col("extract_error"), "invalid document values")
               .when(overflow, "amount beyond the supported range")
               .otherwise(F.col("advice_error")))
    return df.withColumn("error_kind", kind).withColumn("error_message", message)


def _able() -> Column:
    return F.col("error_kind").isNull() & (F.col("decision") == "submit")


def outcomes(judged: DataFrame, posted: DataFrame | None = None,
             check_duplicates: bool = True, ready: bool = False) -> DataFrame:
    """Adds ``status``, ``duplicate_of`` and ``hold_reason``: every document ends in exactly one
    of posted, held, failed.

    ``ready``: a written table that has the guard's keys. What is derived from a column that the frame lacks
    is left out: ``hold_reason`` of ``decision_rationale``, ``confidence``.
    """
    if check_duplicates:
        df = duplicates.guard(judged, posted, _able(), ready)
    else:
        df = judged.withColumn("duplicate_of", F.lit(None).cast("string")).withColumn(
            "duplicate_label", F.lit(None).cast("string"))
    status = (F.when(F.col("error_kind").isNotNull(), "failed")
              .when((F.col("decision") == "hold") | F.col("duplicate_of").isNotNull(), "held")
              .otherwise("posted"))
    df = df.withColumn("status", status)
    if "decision_rationale" in df.columns:
        df = df.withColumn("hold_reason", F.when(F.col("duplicate_of").isNotNull(), duplicates.duplicate_message())
                           .when(F.col("decision") == "hold", F.col("decision_rationale")))
    if "confidence" in df.columns:
        df = df.withColumn("confidence", F.when(F.col("error_kind").isNull(), F.col("confidence")))
    return (df.withColumn("decision", F.when(F.col("error_kind").isNull(), F.when(
                F.col("status") == "held", "hold").otherwise(F.col("decision")))))


# what the guard and the status read of the judged documents
_OUTCOME = ("invoice_id", "created_at", "vendor_name", "total_amount_raw", "error_kind", "decision",
            "vendor_key", "total_key", "day")


def process(messages: DataFrame, answers: DataFrame | None = None,
            posted: DataFrame | None = None, pages: DataFrame | None = None,
            columns: Sequence[str] | None = None) -> DataFrame:
    """messages(message_id, created_at, …) → one outcome row per document.

    ``pages`` (doc_id, page_number, words) adds the citations of the extracted values. ``columns``: what the caller
    reads beside the ids, keys and the outcome; the table between deciding and the guard holds no others.
    """
    extracted = read_documents(messages)
    judged = duplicates.keyed(judge(extracted, answers).drop(*_HEAVY), _able())
    if columns is not None:
        judged = judged.select(*[c for c in judged.columns if c in _OUTCOME or c in columns])
    if pages is not None:  # deciding does not look at them, and judged documents are smaller
        judged = judged.join(citations.of_documents(extracted, pages), "invoice_id", "left")
    return outcomes(settle(judged), posted, ready=True)


def counted(done: DataFrame) -> tuple[DataFrame, Observation]:
    """Outcome rows and the run's counters, which the first action over the rows fills in the same pass."""
    counts = Observation()
    return done.observe(
        counts, F.count(F.lit(1)).alias("documents"),
        *(F.count_if(F.col("status") == status).alias(status) for status in ("posted", "held", "failed")),
        F.count_if(F.col("duplicate_of").isNotNull()).alias("duplicates"),
        F.count_if(F.col("error_kind") == "extraction_failed").alias("extraction_failed"),
        F.count_if(F.col("error_kind") == "stage_failure").alias("stage_failure")), counts


def exceptions_of(done: DataFrame, at: Column | None = None) -> DataFrame:
    """Exception rows of a run: hold flags, duplicate holds and failures.

    ``at`` is the run's time (default: the item's). Ids sort in flag order within a run, so the
    earliest exception by (created_at, id) is the primary reason.
    """
    if at is not None:
        done = done.withColumn("created_at", at)
    failed, twin = F.col("error_kind").isNotNull(), F.col("duplicate_of").isNotNull()
    one = (lambda code, severity, message: F.array(F.struct(
        code.alias("type"), severity.alias("severity"), message.alias("message"))))
    reported = (F.when(failed, one(F.col("error_kind"), F.lit(None).cast("string"), F.col("error_message")))
                .when(twin, one(F.lit("suspected_duplicate"), F.lit("high"), duplicates.duplicate_message()))
                .when(F.col("decision") == "hold", F.filter("risk_flags", lambda f: f["severity"].isin("medium", "high"))))
    rows = done.select("invoice_id", "created_at", F.posexplode(reported).alias("ordinal", "f")).select(
        "invoice_id", "created_at", "ordinal", "f.*")
    rows = decide.build_exceptions(rows, "invoice_id", "created_at", "ordinal")
    stem = F.sha2(F.concat_ws("|", "invoice_id", F.unix_micros("created_at").cast("string")), 256)
    return rows.withColumn("id", F.concat(
        F.lit("exc_"), stem, F.lit("_"),
        F.lpad(F.col("ordinal").cast("string"), 3, "0"))).drop("ordinal")


def file_rows(done: DataFrame, recorded: DataFrame, row_count: DataFrame) -> DataFrame:
    """Ledger rows of the posted items with their reference; repeats keep the stored one."""
    rows = ledger.ledger_rows(done.filter("status = 'posted'"), "created_at").withColumnRenamed(
        "invoice_id", "idempotency_key")
    return ledger.append_refs(rows, recorded, row_count)


def file_attempts(done: DataFrame, attempts: DataFrame) -> DataFrame:
    """The run after its ledger appends: attempts(item_id, attempt, ok) of the posted items.

    Items whose appends all failed become ``failed`` with ``sheet_write_failed``; items without attempts stay as they are.
    """
    tried = audit.attempt_outcomes(attempts).select(
        F.col("item_id").alias("invoice_id"), (F.col("status") == "failed").alias("_lost"), "attempts_used")
    lost = (F.col("status") == "posted") & F.coalesce("_lost", F.lit(False))
    return (done.join(tried, "invoice_id", "left").withColumn("_lost", lost)
            .withColumn("status", F.when(F.col("_lost"), "failed").otherwise(F.col("status")))
            .withColumn("error_kind", F.when(F.col("_lost"), "sheet_write_failed").otherwise(F.col("error_kind")))
            .withColumn("error_message", F.when(F.col("_lost"), F.concat(
                F.lit("ledger append failed after "), F.col("attempts_used").cast("string"), F.lit(" attempts")))
                .otherwise(F.col("error_message")))
            .drop("_lost", "attempts_used"))


def recover_filings(filed: DataFrame, attempts: DataFrame) -> DataFrame:
    """Append again what ``file_attempts`` lost; everything else is untouched."""
    again = F.coalesce(F.col("error_kind") == "sheet_write_failed", F.lit(False))
    retried = (filed.withColumn("_again", again)
               .withColumn("status", F.when(F.col("_again"), "posted").otherwise(F.col("status")))
               .withColumn("error_kind", F.when(~F.col("_again"), F.col("error_kind")))
               .withColumn("error_message", F.when(~F.col("_again"), F.col("error_message"))).drop("_again"))
    return file_attempts(retried, attempts)


def with_refs(done: DataFrame, filed: DataFrame) -> DataFrame:
    refs = filed.select(F.col("idempotency_key").alias("invoice_id"), "sheet_row_ref", "deduped")
    return done.join(refs, "invoice_id", "left")


def events_of(done: DataFrame, run_id: str, run_ts: Column) -> DataFrame:
    return audit.stage_events(done.withColumn("run_ts", run_ts), run_id)


def reconstruct(stored: DataFrame, events: DataFrame) -> DataFrame:
    """Stored extraction with the reviewer's corrections as verified inputs.

    stored(invoice_id, fields, lines, created_at, …). The source comes from the received event,
    without the body, as it is kept in the log.
    """
    effective = overlays.effective_metadata(stored, overlays.metadata_overlay(events))
    inputs = overlays.rerun_inputs(events).drop("overrides")
    received = overlays.latest_details(events, ["received"]).select("invoice_id", F.from_json(
        "details", "channel string, message_id string, subject string, sender string,"
                   " attachment string").alias("src"))
    base = effective.drop("overrides", "channel", "message_id", "subject", "sender",
                          "attachment", "source_body", "field_confidence", "field_evidence",
                          "least_confidence", "missing_fields", "total_amount_raw")
    df = base.join(inputs, "invoice_id", "left").join(received, "invoice_id", "left")
    df = df.select("*", "src.*").drop("src")
    return (df.withColumn("source_body", F.lit(None).cast("string"))
            .withColumn("total_amount_raw", F.expr("fields['total_amount']"))
            .withColumn("vendor_name", F.expr("fields['vendor_name']"))
            .withColumn("invoice_date", F.expr("fields['invoice_date']"))
            .withColumn("invoice_number", F.expr("fields['invoice_number']"))
            .withColumn("extract_error", F.col("invalid_override"))
            .drop("invalid_override"))


def rerun(stored: DataFrame, events: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """Re-decide items with corrected inputs; the duplicate guard is off on purpose."""
    judged = judge(reconstruct(stored, events), answers, overlays.category_overlay(events))
    # a malformed correction is a stage failure here, not an extraction failure
    judged = judged.withColumn("error_kind", F.when(
        F.col("error_kind").isNotNull(), "stage_failure"))
    return outcomes(judged, check_duplicates=False)


def rerun_events(items: DataFrame, events: DataFrame, at: Column, run_id: str) -> DataFrame:
    """The reviewer's ``rerun`` events with the sorted corrected fields."""
    ov = overlays.overlay_maps(overlays.metadata_overlay(events))
    rows = items.select("invoice_id").join(ov, "invoice_id", "left")
    fields = F.coalesce(F.array_sort(F.map_keys("overrides")), F.array().cast("array<string>"))
    return audit.single_events(rows.select(
        "invoice_id", F.lit("rerun").alias("action"), F.to_json(F.struct(
            fields.alias("corrected_fields"),
            F.lit("rerun with corrected data").alias("reason"))).alias("details"),
        at.alias("ts"), F.lit(run_id).alias("request_id")), "human")


def recover_events(failed: DataFrame, at: Column, run_id: str) -> DataFrame:
    """The system's ``recovered`` events, written before failed items are tried again."""
    return audit.single_events(failed.select(
        "invoice_id", F.lit("recovered").alias("action"), F.to_json(F.struct(
            F.col("status").alias("from_status"),
            F.lit("retry failed stage").alias("reason"))).alias("details"),
        at.alias("ts"), F.lit(run_id).alias("request_id")), "system")


def recoverable(items: DataFrame) -> DataFrame:
    """Only failed items may be retried."""
    return items.filter("status = 'failed'")


def recover(failed: DataFrame, events: DataFrame, posted: DataFrame | None = None,
            answers: DataFrame | None = None) -> DataFrame:
    """Resume failed items: reuse a stored extraction if its event exists, else extract again
    from the stored text. The duplicate guard is on.

    failed(invoice_id, text, format, structured, is_real_pdf, fields, lines, created_at, …)
    """
    done = events.filter("action = 'extracted'").select("invoice_id").distinct()
    reuse = reconstruct(failed.join(done, "invoice_id", "left_semi"), events)
    fresh = failed.join(done, "invoice_id", "left_anti").drop("fields", "lines")
    fresh = with_source(fresh, events)
    again = extract(fresh)
    shared = [c for c in reuse.columns if c in again.columns]
    both = narrow(reuse.select(*shared)).unionByName(narrow(again.select(*shared)))
    judged = judge(both, answers, overlays.category_overlay(events))
    return outcomes(settle(judged), posted)


def narrow(df: DataFrame) -> DataFrame:
    """Line items reduced to what deciding needs, so stored and fresh ones line up."""
    return df.withColumn("lines", F.transform("lines", lambda x: F.struct(*[
        x[c].alias(c) for c in ("id", "raw_description", "total", "extraction_confidence")])))


def with_source(df: DataFrame, events: DataFrame) -> DataFrame:
    received = overlays.latest_details(events, ["received"]).select("invoice_id", F.from_json(
        "details", "channel string, message_id string, subject string, sender string,"
                   " attachment string").alias("src"))
    df = df.drop("channel", "message_id", "subject", "sender", "attachment", "source_body")
    return (df.join(received, "invoice_id", "left").select("*", "src.*").drop("src")
            .withColumn("source_body", F.lit(None).cast("string")))


def posted_view(done: DataFrame) -> DataFrame:
    """Columns the duplicate guard needs from already posted items."""
    return done.filter("status = 'posted'").select(
        "invoice_id", "created_at", "vendor_name", "total_amount", "total_amount_raw", "invoice_date")

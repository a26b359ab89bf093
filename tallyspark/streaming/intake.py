"""Continuous intake with Structured Streaming.

Each micro-batch runs the batch job inside ``foreachBatch`` against state tables on shared
storage. A batch writes only its own ``batch_id=N`` folder, by overwrite, and reads only earlier
batches, so a replayed batch reproduces the same rows: at-least-once delivery, exactly-once
effects. Nothing is held on the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import constants as K
from ..operators import parse, receipts
from ..plans import intake
from ..sources import inbox, ledger

SEEN = "message_id string, batch_id bigint"
POSTED = ("invoice_id string, created_at timestamp, vendor_name string,"
          " total_amount decimal(38,10), total_amount_raw string, invoice_date string,"
          " status string, batch_id bigint")
COUNTERS = ("documents bigint, posted bigint, held bigint, failed bigint, duplicates bigint, extraction_failed bigint,"
            " stage_failure bigint, batch_id bigint")
LEDGER = "idempotency_key string, sheet_row_ref string, deduped boolean, batch_id bigint"


def state(spark: SparkSession, root: str, name: str, ddl: str, before: int | None = None
          ) -> DataFrame:
    """A state table, optionally as it was before a batch; empty when nothing was written yet."""
    try:
        df = spark.read.option("basePath", f"{root}/{name}").schema(ddl).parquet(f"{root}/{name}")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":  # unreadable state must stop the stream
            raise
        df = spark.createDataFrame([], ddl)
    return df if before is None else df.filter(F.col("batch_id") < before)


def _ddl(df: DataFrame, *more: str) -> str:
    return ", ".join([*(f"`{name}` {kind}" for name, kind in df.dtypes), *more])


def _write(df: DataFrame, root: str, name: str, batch_id: int) -> DataFrame:
    path = f"{root}/{name}/batch_id={batch_id}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def run_batch(batch: DataFrame, batch_id: int, root: str, mailbox: bool = False,
              advise: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """One fetch: skip seen messages, filter receipts (mailbox only), decide, file, log.

    ``advise`` answers the receipt questions of the mailbox path (see ``plans.advisory.ask``).
    Messages whose question failed go to a retry table, which the next batch takes up.
    """
    spark = batch.sparkSession
    seen = state(spark, root, "items", SEEN, batch_id).select("message_id").unionByName(
        state(spark, root, "dropped", SEEN, batch_id).select("message_id"))
    messages = intake.complete(batch)
    waiting = state(spark, root, "retry", _ddl(messages, "batch_id bigint")).filter(
        F.col("batch_id") == batch_id - 1).drop("batch_id") if mailbox else None
    if waiting is not None:
        messages = messages.unionByName(waiting)
    fresh = inbox.unseen_in_history(
        inbox.first_per_message(messages, ["received_at"]), seen)
    if mailbox:
        answers = advise(receipts.undecided(fresh, body=None)) if advise else None
        judged = receipts.verdicts(fresh, answers, body=None)
        if advise:  # the questions are asked once: everything below reads the answers back
            judged = _write(judged, root, "judged", batch_id)
        _write(judged.filter("advisory_error is not null").select(*messages.columns), root, "retry", batch_id)
        _write(receipts.dropped(judged), root, "dropped", batch_id)
        fresh = receipts.survivors(judged).drop(
            "is_receipt", "confidence", "reason", "advisory_error")
    # the original files, before the run lets go of them
    content = F.col("content") if "content" in fresh.columns else F.lit(None).cast("binary")
    blobs = fresh.select(parse.item_id(F.col("channel"), F.col("message_id")).alias("invoice_id"), inbox.stored_blob(
        F.col("attachment_b64"), F.col("attachment"), F.col("attachment_path"), content).alias("source_pdf"))
    _write(blobs.filter("source_pdf is not null"), root, "blobs", batch_id)
    posted = intake.posted_view(state(spark, root, "items", POSTED, batch_id))
    done = intake.process(fresh.withColumn("created_at", F.col("received_at")), posted=posted)
    # the written table is the batch's result; everything after reads it back
    done, counts = intake.counted(done.drop("received_at"))
    items = _write(done, root, "items", batch_id)
    names = [c.split()[0] for c in COUNTERS.split(", ")][:-1]
    got = counts.get  # filled by the write, with no second look at the rows
    _write(spark.createDataFrame([tuple(got.get(c, 0) for c in names)], ", ".join(f"{c} bigint" for c in names)),
           root, "counters", batch_id)
    # repeats stand in the table for the events' sake; only new rows are ledger rows
    recorded = state(spark, root, "ledger", LEDGER, batch_id).filter("not deduped")
    filed = _write(intake.file_rows(items, recorded, recorded.agg(F.count(F.lit(1)).alias("n"))),
                   root, "ledger", batch_id)
    _write(intake.exceptions_of(items), root, "exceptions", batch_id)
    routed = items.select("invoice_id", "message_id", "attachment", "attachment_path", ledger.destination(
        F.col("status"), F.col("decision")).alias("dest"))
    _write(routed, root, "routed", batch_id)
    events = intake.events_of(intake.with_refs(items, filed),
                              f"batch-{batch_id}", F.col("created_at"))
    _write(events, root, "events", batch_id)


def start(messages: DataFrame, root: str, checkpoint: str, mailbox: bool = False,
          poll_seconds: int | None = K.POLL_SECONDS,
          advise: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Start the stream; ``poll_seconds=None`` drains what is there and stops."""
    writer = (messages.writeStream.option("checkpointLocation", checkpoint)
              .foreachBatch(lambda df, n: run_batch(df, n, root, mailbox, advise)))
    if poll_seconds is None:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=f"{poll_seconds} seconds").start()


def outcome_counts(spark: SparkSession, root: str) -> DataFrame:
    """Items per status over all batches."""
    return state(spark, root, "items", POSTED).groupBy("status").count()


def run_counters(spark: SparkSession, root: str) -> DataFrame:
    """The counters of all batches, added up from one small row each; the items are not read."""
    rows = state(spark, root, "counters", COUNTERS)
    return rows.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in rows.columns if c != "batch_id"))


__all__ = ["start", "run_batch", "state", "outcome_counts", "run_counters"]

"""Forms for growing input: streams, sinks, tables updated batch by batch, indexes in place of scans.

Most of these queries deal a given table out to batches, take them one after the other and must end where the query over
the whole table does: the reference SQL is that query's.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.rows import scratch, written
from ..operators import categorize, dictionary, incremental, word_index
from ..sources import buckets, inbox, ledger_sink, mailbox, seen
from ..streaming import duplicates as stream_guard
from .anchors import document_pages, document_values
from .core import ORACLES, QUERIES, bind, query, table
from .decisions import _GUARD_SQL
from .messages import _cursor, _labelled


def _same_as(name: str):
    """The result of another query, reached another way."""
    def add(fn):
        QUERIES[fn.__name__] = fn
        ORACLES[fn.__name__] = ORACLES[name]
        return fn
    return add


def _part(column: str, batches: int = 3):
    return F.pmod(F.xxhash64(column), F.lit(batches))


@query("duplicate_guard_stream", _GUARD_SQL + "select invoice_id, duplicate_of from walk")
def duplicate_guard_stream(spark, sf):
    """Transactions arrive in three files, in order of time; the guard keeps its state between them."""
    items, root = bind(spark, sf, "transactions"), scratch(spark, "stream-guard")
    ends = items.agg(F.percentile_approx(F.unix_micros(F.col("created_at").cast("timestamp")), F.array(F.lit(0.3), F.lit(0.7)))).head()[0] or []
    at = F.unix_micros(F.col("created_at").cast("timestamp"))
    items = items.select("invoice_id", F.col("created_at").cast("timestamp").alias("created_at"), "vendor_name", "total_amount",
                         "total_amount_raw", "invoice_date")
    part = sum((F.coalesce(at > e, F.lit(False)).cast("int") for e in ends), F.lit(0))
    for k in range(len(ends) + 1):
        items.where(part == k).write.mode("append").parquet(f"{root}/in")
        stream_guard.start_guard(spark.readStream.schema(items.schema).parquet(f"{root}/in"), f"{root}/out", f"{root}/cp",
                                 drain=True).awaitTermination()
    return stream_guard.decisions(spark, f"{root}/out").select("invoice_id", "duplicate_of")


def _mailbox(spark, sf, kept: str):
    """The changes as a mailbox folder that keeps those from a day on, and the messages behind them."""
    changes, root = bind(spark, sf, "changes"), scratch(spark, "mailbox")
    changes.where(f"ts >= timestamp_ntz'{kept} 00:00:00'").select("history_id", "message_id").repartitionByRange(
        8, "history_id").write.mode("append").parquet(f"{root}/changes")
    changes.select("message_id", F.col("ts").alias("received_at")).write.mode("append").parquet(f"{root}/messages")
    spark.dataSource.register(mailbox.MailboxHistory)
    return spark.read.format("mailbox_history").option("path", root).option("year", 2024)


@_same_as("incremental_delta")
def mailbox_history_delta(spark, sf):
    """Changes after the stored cursor, through the mailbox source."""
    cursor = _cursor(spark, sf, "2024-01-26").head()[0]
    rows = _mailbox(spark, sf, "2000-01-01").option("after", cursor).load()
    return rows.groupBy("message_id").agg(F.min("history_id").alias("first_history_id"))


@_same_as("expired_cursor_sync")
def mailbox_history_expired(spark, sf):
    """A cursor older than what the mailbox keeps: the source turns to a backfill."""
    cursor = _cursor(spark, sf, "2024-01-05").head()[0]
    rows = _mailbox(spark, sf, "2024-01-10").option("after", cursor).load()
    known = table(spark, sf, "events").filter("value > 250").select(F.col("user_id").cast("string").alias("message_id"))
    return inbox.unseen(rows.select("message_id").distinct(), known)


@query("ledger_sink_rows", """
  select invoice_id as idempotency_key, vendor_name, total_amount_raw,
         cast(case when left(md5(invoice_id), 1) < '8' then 0 else 1 end as bigint) as batch_id from {filings}""")
def ledger_sink_rows(spark, sf):
    """Filed rows through the ledger sink, in two batches."""
    rows, root = bind(spark, sf, "filings"), scratch(spark, "ledger-sink")
    rows = rows.select(F.col("invoice_id").alias("idempotency_key"), "vendor_name", "total_amount_raw")
    spark.dataSource.register(ledger_sink.LedgerFiles)
    for early in (True, False):
        rows.where((F.substring(F.md5(F.col("idempotency_key").cast("binary")), 1, 1) < "8") == early).write.mode("append").parquet(f"{root}/in")
        (spark.readStream.schema(rows.schema).parquet(f"{root}/in").writeStream.format("ledger_files")
         .option("path", f"{root}/ledger").option("checkpointLocation", f"{root}/cp").trigger(availableNow=True).start().awaitTermination())
    found = ledger_sink.read_ledger(spark, f"{root}/ledger")
    return (found if found is not None else rows.limit(0).withColumn("batch_id", F.lit(0).cast("long"))).select(
        "idempotency_key", "vendor_name", "total_amount_raw", "batch_id")


@_same_as("unseen_messages")
def unseen_messages_indexed(spark, sf):
    """The labelled ids enter the seen index in two batches; the documents are held against it."""
    docs, known = _labelled(spark, sf)
    index = seen.SeenIndex(spark, scratch(spark, "seen"), ranges=32)
    for k in range(2):
        index.add(known.where(_part("message_id", 2) == k), k)
    return index.unseen(docs, 2).select("message_id", "source")


@_same_as("fetch_counts")
def fetch_counts_observed(spark, sf):
    """Counted while the new messages are written: one pass over the messages, no second join."""
    docs, known = _labelled(spark, sf)
    fresh, counts = inbox.unseen_counted(docs, known)
    written(fresh, "fetched")
    return spark.createDataFrame([(counts.get["received"], counts.get["skipped"])], "received bigint, skipped bigint")


@_same_as("latest_items")
def upserted_items(spark, sf):
    """Versions arrive in three batches, in any order."""
    versions = bind(spark, sf, "versions").withColumn("updated_at", F.struct("updated_at", "linenumber", "l_partkey"))
    held = buckets.BucketTable(spark, scratch(spark, "items"), "invoice_id", buckets.merge_versions, buckets=16)
    for k in range(3):
        held.update(buckets.version_rows(versions.where(_part("l_partkey") == k)), k)
    return buckets.latest_of(held.rows()).select(
        "invoice_id", "status", F.col("amount").cast("double").alias("amount"),
        F.unix_micros("updated_at.updated_at").alias("updated_us"), F.unix_micros("created_at").alias("created_us"))


@_same_as("replaced_line_items")
def replaced_children_table(spark, sf):
    old = bind(spark, sf, "lines").select("invoice_id", "id", F.col("total").cast("double").alias("total"))
    new = bind(spark, sf, "listed").filter("status = 'failed'").select(
        "invoice_id", F.concat("invoice_id", F.lit("#new")).alias("id"), F.col("total_amount").cast("double").alias("total"))
    held = buckets.BucketTable(spark, scratch(spark, "children"), "invoice_id", buckets.merge_children, buckets=16)
    held.update(buckets.child_rows(old, 0), 0)
    held.update(buckets.child_rows(new, 1), 1)
    return held.rows().select("invoice_id", "id", "total")


def _followed(spark, log, rows_of, merge, name):
    held = buckets.BucketTable(spark, scratch(spark, name), "invoice_id", merge, buckets=16)
    for k in range(3):  # by event, so that events of an item come late
        held.update(rows_of(log.where(_part("event_id") == k)), k)
    found = held.rows()
    return rows_of(log.limit(0)) if found is None else found


@_same_as("workflow_metrics")
def workflow_metrics_followed(spark, sf):
    return incremental.metrics_of(_followed(spark, bind(spark, sf, "audit"), incremental.item_rows, incremental.merge_items, "metrics"))


@_same_as("metadata_overlay")
def metadata_overlay_followed(spark, sf):
    return incremental.overlay_of(_followed(spark, bind(spark, sf, "correction_log"), incremental.override_rows,
                                            incremental.merge_overrides, "overrides"))


@_same_as("spot_check_sample")
def spot_check_followed(spark, sf):
    """The sample is kept batch by batch: never more than its own rows and a batch's."""
    posted = bind(spark, sf, "listed").filter("status = 'posted'").select("invoice_id", "vendor_name")
    held = posted.limit(0)
    for k in range(3):
        held = written(incremental.merge_samples(held.unionByName(
            incremental.merge_samples(posted.where(_part("invoice_id") == k)))), "sample")
    return held


@_same_as("locate_values")
def locate_values_indexed(spark, sf):
    """Values by their rarest word in the document's positional index."""
    return word_index.locate_indexed(document_values(spark, sf), document_pages(spark, sf)).select(
        "doc_id", "target_id", "page_number", F.array_join("word_indices", ",").alias("word_indices"))


@_same_as("category_candidates")
def category_candidates_by_dictionary(spark, sf):
    """The keyword dictionary as a table."""
    words = spark.createDataFrame([(w, k, c) for k, (c, ws) in enumerate(K.CATEGORY_KEYWORDS.items()) for w in ws],
                                  "word string, ordinal int, category string")
    return categorize.candidate_rows(dictionary.score_with_dictionary(
        bind(spark, sf, "purchases"), words, "invoice_id", "text"), "invoice_id")

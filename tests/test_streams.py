"""The mailbox history as a source and the ledger as a sink: restarts, expiry, repeated delivery, killed batches."""

import datetime
import json

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tallyspark.sources import ledger_sink, mailbox


def write_changes(folder, first, last, name=None):
    (folder / "changes").mkdir(parents=True, exist_ok=True)
    ids = list(range(first, last + 1))
    pq.write_table(pa.table({"history_id": ids, "message_id": [f"m{i % 40}" for i in ids]}), folder / "changes" / f"{name or first:08}.parquet")


def write_messages(folder, n):
    (folder / "messages").mkdir(parents=True, exist_ok=True)
    start = datetime.datetime(2023, 12, 1)
    for k in range(2):
        ids = range(k, n, 2)
        pq.write_table(pa.table({"message_id": [f"m{i}" for i in ids], "received_at": [start + datetime.timedelta(days=i) for i in ids]}),
                       folder / "messages" / f"{k}.parquet")


@pytest.fixture
def box(spark, tmp_path):
    spark.dataSource.register(mailbox.MailboxHistory)
    write_changes(tmp_path / "box", 100, 199)
    write_messages(tmp_path / "box", 40)
    return tmp_path / "box"


def read(spark, box, **options):
    rows = spark.read.format("mailbox_history").options(path=str(box), year=2024, slice=7, **options).load().collect()
    return sorted((r.history_id, r.message_id, r.origin) for r in rows)


def test_batch_read(spark, box):
    changes = [(i, f"m{i % 40}", "change") for i in range(100, 200)]
    assert read(spark, box, after=149) == changes[50:]
    assert read(spark, box, after=99) == changes  # the oldest change kept is the next one
    assert read(spark, box, after=149, upto=160) == changes[50:61]
    assert read(spark, box, after=199) == read(spark, box, after=250) == []
    january = [(199, f"m{i}", "backfill") for i in range(31, 40)]
    assert read(spark, box) == read(spark, box, after=98) == sorted(january)
    parts = spark.read.format("mailbox_history").options(path=str(box), after=149, slice=7).load().rdd.getNumPartitions()
    assert parts == 8


def test_stream_restarts_where_it_was(spark, box, tmp_path):
    def drain(**options):
        got = []
        query = (spark.readStream.format("mailbox_history").options(path=str(box), year=2024, slice=9, **options).load()
                 .writeStream.option("checkpointLocation", str(tmp_path / "cp"))
                 .foreachBatch(lambda df, n: got.extend((r.history_id, r.message_id, r.origin) for r in df.collect()))
                 .trigger(availableNow=True).start())
        query.awaitTermination()
        return sorted(got)

    assert drain(after=180) == [(i, f"m{i % 40}", "change") for i in range(181, 200)]
    assert mailbox.cursor_in(str(tmp_path / "cp")) == 199
    assert drain(after=180) == []
    write_changes(box, 200, 220)
    assert drain(after=180) == [(i, f"m{i % 40}", "change") for i in range(200, 221)]
    # the mailbox has let go of what lies between the cursor and 299: a backfill, up to date as of the newest change
    for f in (box / "changes").iterdir():
        f.unlink()
    write_changes(box, 300, 310)
    assert drain(after=180) == sorted((310, f"m{i}", "backfill") for i in range(31, 40))
    write_changes(box, 311, 312)
    assert drain(after=180) == [(i, f"m{i % 40}", "change") for i in (311, 312)]
    # a batch whose commit is lost is delivered again, and seen messages are left out of it
    last = max((f for f in (tmp_path / "cp/commits").iterdir() if f.name.isdigit()), key=lambda f: int(f.name))
    last.unlink()
    (tmp_path / "cp/commits" / f".{last.name}.crc").unlink(missing_ok=True)
    again = drain(after=180)
    assert again == [(i, f"m{i % 40}", "change") for i in (311, 312)]
    from tallyspark.sources import inbox
    ids = spark.createDataFrame(again, "history_id long, message_id string, origin string")
    assert inbox.unseen(ids, ids.limit(1)).count() == 1


def test_empty_mailbox(spark, tmp_path):
    spark.dataSource.register(mailbox.MailboxHistory)
    box = tmp_path / "box"
    write_messages(box, 0)
    (box / "changes").mkdir(parents=True)
    assert read(spark, box) == []
    assert mailbox.cursor_in(str(tmp_path / "none")) is None


ROWS = "idempotency_key string, Vendor string"


def append(spark, folder, batches, stop_after=None, **options):
    """Each list of keys becomes a file, and so a batch of the sink."""
    spark.dataSource.register(ledger_sink.LedgerFiles)
    for keys in batches:
        spark.createDataFrame([(k, f"v{k}") for k in keys], ROWS).repartition(3).write.mode("append").parquet(str(folder / "in"))
    stream = spark.readStream.schema(ROWS).parquet(str(folder / "in"))
    query = (stream.repartition(4).writeStream.format("ledger_files").option("path", str(folder / "ledger")).options(**options)
             .option("checkpointLocation", str(folder / "cp")).trigger(availableNow=True).start())
    query.awaitTermination()


def rows(spark, folder):
    found = ledger_sink.read_ledger(spark, str(folder / "ledger"))
    return sorted((r.idempotency_key, r.Vendor, r.sheet_row_ref) for r in found.collect())


def test_ledger_rows_and_refs(spark, tmp_path):
    assert ledger_sink.read_ledger(spark, str(tmp_path / "ledger")) is None
    append(spark, tmp_path, [[f"a{i}" for i in range(20)]])
    first = rows(spark, tmp_path)
    assert sorted(int(r[2].split("!A")[1].split(":")[0]) for r in first) == list(range(1, 21))
    append(spark, tmp_path, [[f"b{i}" for i in range(5)]])
    both = rows(spark, tmp_path)
    assert [r for r in both if r[0].startswith("a")] == first
    assert sorted(int(r[2].split("!A")[1].split(":")[0]) for r in both) == list(range(1, 26))


def test_replayed_batch_keeps_rows_and_refs(spark, tmp_path):
    """The manifest was written, the engine's own commit was lost: the batch comes again."""
    append(spark, tmp_path, [[f"a{i}" for i in range(20)]])
    append(spark, tmp_path, [[f"b{i}" for i in range(9)]])
    before, files = rows(spark, tmp_path), len(list((tmp_path / "ledger/data").iterdir()))
    last = max((f for f in (tmp_path / "cp/commits").iterdir() if f.name.isdigit()), key=lambda f: int(f.name))
    last.unlink()
    (tmp_path / "cp/commits" / f".{last.name}.crc").unlink(missing_ok=True)
    append(spark, tmp_path, [])
    assert rows(spark, tmp_path) == before
    assert len(list((tmp_path / "ledger/data").iterdir())) == files


def test_killed_batch_is_never_seen(spark, tmp_path):
    """Tasks have written, the commit has not happened: nothing shows, and the batch's second try counts once."""
    append(spark, tmp_path, [["a1", "a2"]])
    writer = ledger_sink._Writer(str(tmp_path / "ledger"), 20)
    lost = pa.table({"idempotency_key": ["x"], "Vendor": ["lost"]})
    pq.write_table(lost.append_column(ledger_sink.POSITION, pa.array([0])), tmp_path / "ledger/data/lost.parquet")
    (tmp_path / "ledger/manifests/_draft").write_text(json.dumps({"files": [], "next": 99})[:7])
    assert [r[0] for r in rows(spark, tmp_path)] == ["a1", "a2"]
    append(spark, tmp_path, [["b1"]])
    assert [(r[0], r[2]) for r in rows(spark, tmp_path)][-1] == ("b1", "Ledger!A3:F3")
    pq.write_table(lost, tmp_path / "ledger/data/gone.parquet")
    writer.abort([ledger_sink.Written("gone.parquet", 0, 1), None], 7)
    assert not (tmp_path / "ledger/data/gone.parquet").exists()
    writer.abort([ledger_sink.Written(f.name, 0, 1) for f in (tmp_path / "ledger/data").iterdir()], 0)  # committed: stays
    assert len(rows(spark, tmp_path)) == 3


def test_manifests_are_folded(spark, tmp_path):
    for k in range(7):
        append(spark, tmp_path, [[f"k{k}-{i}" for i in range(3)]], fold=2)
    names = [f.name for f in (tmp_path / "ledger/manifests").iterdir() if not f.name.startswith(("_", "."))]
    assert len(names) <= 4 and sum(n.endswith(".snapshot") for n in names) == 1
    found = rows(spark, tmp_path)
    assert len(found) == 21 and len({r[2] for r in found}) == 21
    assert ledger_sink.Manifests(str(tmp_path / "ledger")).committed(0)

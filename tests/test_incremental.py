"""Bucket tables, the seen index and states that add up, against the operators over everything."""

import random

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import incremental, metrics, overlays, review
from tallyspark.sources import buckets, inbox, ledger, seen

VERSION = "invoice_id string, updated_at long, status string, amount double, created_at long, source_text string"


def random_versions(seed, n=300):
    rng = random.Random(seed)
    return [(f"i{rng.randrange(60)}", rng.randrange(40), rng.choice("ABC"), float(rng.randrange(5)), rng.randrange(9), rng.choice(["x", None]))
            for _ in range(n)]


def files(folder):
    return {str(p.relative_to(folder)): p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}


def same(a, b):
    assert sorted(a.columns) == sorted(b.columns)
    assert sorted(map(str, a.select(*sorted(a.columns)).collect())) == sorted(map(str, b.select(*sorted(a.columns)).collect()))


@pytest.mark.parametrize("batches", [1, 4])
def test_upserts_equal_the_view_over_all_versions(spark, tmp_path, batches):
    rows = random_versions(batches)
    held = buckets.BucketTable(spark, str(tmp_path), "invoice_id", buckets.merge_versions, buckets=5, files=2)
    assert held.rows() is None
    for k in range(batches):
        held.update(buckets.version_rows(spark.createDataFrame(rows[k::batches], VERSION)), k)
    same(buckets.latest_of(held.rows()), ledger.latest_versions(spark.createDataFrame(rows, VERSION)))


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    held = buckets.BucketTable(spark, str(tmp_path), "invoice_id", buckets.merge_versions, buckets=8)
    rows = random_versions(3)
    assert held.update(buckets.version_rows(spark.createDataFrame(rows, VERSION)), 0) == list(range(8))
    before = files(tmp_path)
    one = [r for r in rows if r[0] == rows[0][0]][:1]
    touched = held.update(buckets.version_rows(spark.createDataFrame([(one[0][0], 99, "Z", 1.0, 0, "new")], VERSION)), 1)
    assert len(touched) == 1
    new = {f for f in files(tmp_path) if f not in before}
    assert new and all(f.startswith(f"data/batch=1/_bucket={touched[0]}/") for f in new)
    assert len(held.folders()) == 8 and sum(n == 0 for n in held.folders().values()) == 7
    same(buckets.latest_of(held.rows()), ledger.latest_versions(spark.createDataFrame([*rows, (one[0][0], 99, "Z", 1.0, 0, "new")], VERSION)))
    assert held.update(buckets.version_rows(spark.createDataFrame([], VERSION)), 2) == []
    held.update(buckets.version_rows(spark.createDataFrame(rows, VERSION)), 3)
    held.update(buckets.version_rows(spark.createDataFrame(rows[:1], VERSION)), 4)
    assert not (tmp_path / "data/batch=0").exists() and held.batches() == [3, 4]


def test_replayed_and_killed_batches(spark, tmp_path):
    held = buckets.BucketTable(spark, str(tmp_path), "invoice_id", buckets.merge_children, buckets=4)
    def child(ids, tag):
        return spark.createDataFrame([(i, f"{i}{tag}{k}") for i in ids for k in range(2)], "invoice_id string, id string")
    old, new = child("abcdef", "-"), child("bd", "+")
    held.update(buckets.child_rows(old, 0), 0)
    for _ in range(2):
        held.update(buckets.child_rows(new, 1), 1)
        same(held.rows().drop("_turn"), ledger.replace_children(old, new))
    # a batch that has written its folder and no manifest shows nothing, and its second try counts once
    child("a", "!").withColumn("_turn", F.lit(2)).write.parquet(f"{tmp_path}/data/batch=2/_bucket=0")
    same(held.rows().drop("_turn"), ledger.replace_children(old, new))
    more = child("ag", "*")
    held.update(buckets.child_rows(more, 2), 2)
    same(held.rows().drop("_turn"), ledger.replace_children(ledger.replace_children(old, new), more))
    with pytest.raises(ValueError, match="4 buckets"):
        buckets.BucketTable(spark, str(tmp_path), "invoice_id", buckets.merge_children, buckets=5).rows()


def messages(spark, ids):
    return spark.createDataFrame([(i, "x") for i in ids], "message_id string, body string")


@pytest.mark.parametrize("bits", [64, 1 << 16])
def test_seen_index(spark, tmp_path, bits):
    """No false skip and no lost repeat, also with filters so small that most tests hit and many are closed."""
    index = seen.SeenIndex(spark, str(tmp_path), ranges=4, bits=bits)
    rng, known = random.Random(bits), set()
    for batch in range(4):
        ids = [f"m{rng.randrange(120)}" for _ in range(40)] + [None, ""]
        got = [r.message_id for r in index.unseen(messages(spark, ids), batch).collect()]
        assert sorted(map(str, got)) == sorted(str(i) for i in ids if i is None or i not in known)
        index.add(messages(spark, ids), batch)
        known |= set(ids) - {None}
    index.add(messages(spark, ids), 3)  # a replay changes nothing
    again = [r.message_id for r in index.unseen(messages(spark, ids), 3).collect()]
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert index.unseen(messages(spark, sorted(known)), 9).count() == 0
    assert index.unseen(messages(spark, []), 9).count() == 0


def test_seen_index_reads_ids_only_where_a_filter_hits(spark, tmp_path):
    index = seen.SeenIndex(spark, str(tmp_path), ranges=16)
    for batch in range(3):
        index.add(messages(spark, [f"old{batch}-{k}" for k in range(300)]), batch)
    ids = seen.hashed(messages(spark, [f"new{k}" for k in range(200)] + ["old1-7"]), 16)
    hits = index.maybe_seen(ids, 3).collect()
    assert {r.message_id for r in hits} >= {"old1-7"} and len(hits) <= 10
    assert index.seen_ids([], 3) is None
    (hit,) = [r.range for r in hits if r.message_id == "old1-7"]
    scanned = index.seen_ids([hit], 3)
    assert all(f"/range={hit}/" in f for f in scanned.select(F.input_file_name().alias("f")).distinct().toPandas()["f"])
    assert "PartitionFilters: [" in scanned._jdf.queryExecution().toString() and 0 < scanned.count() < 150
    fresh = [f"new{k}" for k in range(200)]
    assert index.unseen(messages(spark, fresh + ["old1-7"]), 3).count() == 200
    same(index.unseen(messages(spark, fresh + ["old1-7"]), 3),
         inbox.unseen(messages(spark, fresh + ["old1-7"]), messages(spark, [f"old{b}-{k}" for b in range(3) for k in range(300)])))


EVENT = "event_id string, invoice_id string, seq long, actor string, action string, details string, ts timestamp"


def random_log(spark, seed, n=400):
    import datetime
    rng = random.Random(seed)
    out = []
    for k in range(n):
        action = rng.choice(["posted", "held", "failed", "corrected", "escalated", "note", "reviewed", "received"])
        details = '{"target":"metadata","after":{"vendor_name":%s}}' % rng.choice(['"A"', '"B"', '""', "null"]) if action == "corrected" else "{}"
        out.append((f"e{k}", f"i{rng.randrange(25)}", rng.randrange(50), rng.choice(["human", "ai", "system"]), action, details,
                    datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=rng.randrange(200))))
    return out


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_states_of_a_growing_log(spark, tmp_path, batches):
    """Any split of the log, events in any order: the same statuses, rates and overlays as of the whole log."""
    events = random_log(spark, batches)
    random.Random(1).shuffle(events)
    whole = spark.createDataFrame(events, EVENT)
    items = buckets.BucketTable(spark, str(tmp_path / "items"), "invoice_id", incremental.merge_items, buckets=3)
    fields = buckets.BucketTable(spark, str(tmp_path / "fields"), "invoice_id", incremental.merge_overrides, buckets=3)
    for k in range(batches):
        part = spark.createDataFrame(events[k::batches], EVENT)
        items.update(incremental.item_rows(part), k)
        fields.update(incremental.override_rows(part), k)
    same(incremental.status_of(items.rows()), overlays.current_status(whole))
    same(incremental.metrics_of(items.rows()), metrics.workflow_metrics(overlays.current_status(whole), whole))
    same(incremental.overlay_of(fields.rows()), overlays.metadata_overlay(whole))


def test_samples_merge(spark):
    posted = spark.createDataFrame([(f"i{k}",) for k in range(200)], "invoice_id string")
    held = posted.limit(0)
    for k in range(4):
        part = posted.where(F.pmod(F.xxhash64("invoice_id"), F.lit(4)) == k)
        held = incremental.merge_samples(held.unionByName(incremental.merge_samples(part, 7, 3)), 7, 3)
    same(held, review.spot_check(posted, 7, 3))

"""Tables that are updated in place: hash buckets, of which a batch rewrites only those it touches.

A table holds the rows that its ``merge`` makes of all rows it was given: ``merge`` takes old and new rows
together and must give the same result however the rows are dealt out to batches. A batch reads the buckets that its
keys fall into, merges, and writes them to a folder of its own; then a manifest names the folder of each
bucket. Until it is there readers see the table as it was. A replayed batch starts from the manifest before it and
overwrites its own folder. Manifests and folders that are no longer named go after ``keep`` batches.

The driver handles one number per bucket. Rows of a bucket spread over ``files`` tasks by their keys, over more as the
table grows, and a task gets one such part of one bucket, so that what one task holds does not grow. A merge marked ``in_place`` gets the rows after this exchange,
with its columns ``near``, and keeps those; others combine first and are exchanged afterwards.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.rows import Folder, drop_written, written

BUCKET, TASK = "_bucket", "_task"
#: So many rows at most, on average, are merged and written by one task.
TASK_ROWS = 250_000


def near(rows: DataFrame) -> list[str]:
    """Columns by which rows already lie together: a merge that groups by them too needs no exchange of its own."""
    return [c for c in (BUCKET, TASK) if c in rows.columns]


class BucketTable:
    """``key``: column that says which bucket a row belongs to; ``merge``: rows → rows, equal keys together."""

    def __init__(self, spark: SparkSession, root: str, key: str, merge: Callable[[DataFrame], DataFrame],
                 buckets: int = 64, files: int = 1, keep: int = 2) -> None:
        self.spark, self.root, self.key, self.merge = spark, root, key, merge
        self.buckets, self.files, self.keep = buckets, files, keep
        self.manifests = Folder(spark, f"{root}/manifests")

    def bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def batches(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self.manifests.names() if n.endswith(".json") and not n.startswith("."))

    def folders(self, before: int | None = None) -> dict[int, int]:
        """Bucket → batch that wrote it last, as of all batches or of those before one."""
        known = [n for n in self.batches() if before is None or n < before]
        if not known:
            return {}
        manifest = json.loads(self.manifests.read(f"{known[-1]}.json"))
        if manifest["of"] != self.buckets:
            raise ValueError(f"the table has {manifest['of']} buckets, not {self.buckets}")
        return {int(b): n for b, n in manifest["buckets"].items()}

    def rows(self, buckets: list[int] | None = None, before: int | None = None) -> DataFrame | None:
        """The table's rows, of all or some buckets; null while there are none."""
        places = [f"{self.root}/data/batch={n}/{BUCKET}={b}" for b, n in sorted(self.folders(before).items())
                  if buckets is None or b in buckets]
        return self.spark.read.parquet(*places) if places else None

    def update(self, batch: DataFrame, batch_id: int) -> list[int]:
        """Merge a batch of rows into the table; the buckets that were rewritten."""
        new = written(batch.withColumn(BUCKET, self.bucket()), "batch")
        touched = sorted(r[0] for r in new.select(BUCKET).distinct().collect())
        if touched:
            old = self.rows(touched, batch_id)
            both = new.drop(BUCKET) if old is None else old.unionByName(new.drop(BUCKET))
            files = max(self.files, -(-both.count() // (len(touched) * TASK_ROWS)))  # counted from the files' footers

            def dealt(rows: DataFrame) -> DataFrame:
                # numbered, not hashed: hashes would put several parts into one task and none into others
                place = F.array_position(F.lit(touched), self.bucket()).cast("int") - 1
                spread = F.pmod(F.xxhash64(F.lit(1), self.key), F.lit(files)).cast("int")
                return rows.withColumn(BUCKET, self.bucket()).withColumn(TASK, place * files + spread).repartitionById(
                    len(touched) * files, TASK)

            merged = self.merge(dealt(both)) if getattr(self.merge, "in_place", False) else dealt(self.merge(both))
            merged.drop(TASK).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.root}/data/batch={batch_id}")
        drop_written(new)
        made = {int(n.partition("=")[2]) for n in Folder(self.spark, f"{self.root}/data/batch={batch_id}").names()
                if n.startswith(BUCKET)} if touched else set()
        folders = self.folders(batch_id)
        folders = {b: n for b, n in folders.items() if b not in touched} | {b: batch_id for b in made}
        self.manifests.write(f"{batch_id}.json", json.dumps({"of": self.buckets, "buckets": folders}))
        self._clean()
        return touched

    def _clean(self) -> None:
        known = self.batches()
        for n in known[:-self.keep]:
            self.manifests.delete(f"{n}.json")
        named = {(b, n) for k in known[-self.keep:] for b, n in self.folders(k + 1).items()}
        data = Folder(self.spark, f"{self.root}/data")
        for name in data.names():
            n = int(name.partition("=")[2])
            if n > known[-1]:
                continue  # a batch that is being written
            inside = [x for x in Folder(self.spark, f"{self.root}/data/{name}").names() if x.startswith(BUCKET)]
            gone = [x for x in inside if (int(x.partition("=")[2]), n) not in named]
            for x in gone:
                data.delete(f"{name}/{x}")
            if len(gone) == len(inside):
                data.delete(name)


# ---- what the tables hold -------------------------------------------------------------------


def version_rows(versions: DataFrame) -> DataFrame:
    """Versions as rows of an upsert table: the latest version of an item whole, and the first where it is another one.

    Order as in ``ledger.latest_versions``: ``updated_at``, then the content, whose text is made when versions are
    compared and neither kept nor exchanged.
    """
    whole = F.struct(*[F.lit(None).cast(versions.schema[c].dataType).alias(c) if c == "invoice_id" else F.col(c)
                       for c in versions.columns])  # the item's id is beside it
    return versions.select("invoice_id", whole.alias("latest"), F.when(F.lit(False), whole).alias("first"))


def _order(version: str, columns: list[str]) -> Column:
    content = [F.col("invoice_id") if c == "invoice_id" else F.col(f"{version}.{c}") for c in columns if c != "updated_at"]
    return F.struct(F.col(f"{version}.updated_at"), F.to_json(F.struct(*content)))


def merge_versions(rows: DataFrame) -> DataFrame:
    columns, schema = rows.schema["latest"].dataType.names, rows.schema["latest"].dataType
    rows = rows.withColumn("first", F.coalesce("first", "latest"))
    merged = rows.groupBy(*near(rows), "invoice_id").agg(
        F.max_by("latest", _order("latest", columns)).alias("latest"), F.min_by("first", _order("first", columns)).alias("first"))
    return merged.withColumn("first", F.when(~F.col("first").eqNullSafe(F.col("latest")), F.col("first")).cast(schema))


merge_versions.in_place = True


def latest_of(rows: DataFrame, keep_first: tuple[str, ...] = ("created_at", "source_text")) -> DataFrame:
    """The upsert view: ``ledger.latest_versions`` of all versions so far."""
    columns = [c for c in rows.schema["latest"].dataType.names if c != "invoice_id"]
    keep = [c for c in keep_first if c in columns]
    first = F.coalesce("first", "latest")
    return rows.select("invoice_id", *[first[c].alias(c) for c in keep], *[f"latest.{c}" for c in columns if c not in keep])


def child_rows(children: DataFrame, turn: int) -> DataFrame:
    """Children of a batch; a later turn replaces all children of its parents."""
    return children.withColumn("_turn", F.lit(turn).cast("long"))


def merge_children(rows: DataFrame) -> DataFrame:
    newest = F.max("_turn").over(Window.partitionBy(*near(rows), "invoice_id"))
    return rows.withColumn("_newest", newest).where("_turn = _newest").drop("_newest")


merge_children.in_place = True

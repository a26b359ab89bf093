"""The ledger as a streaming sink: files become rows of the ledger by one manifest per batch.

Tasks write Parquet files under ``data/``; nobody reads that folder as a whole. The driver's commit of a batch writes
``manifests/<batch>.json``, one small file that appears whole or not at all: it names the batch's files,
the ledger row each begins with and the next free row. Readers go by manifests, so files of lost tasks, killed batches
and speculative copies are never seen. A batch whose manifest is there is committed: a replay's files
are deleted, and rows and references stay as they were.

A batch looks at the manifest before it only, and every ``FOLD`` batches the manifests so far are folded
into a snapshot, so neither a commit nor a read slows down with the age of the ledger.

    spark.dataSource.register(LedgerFiles)
    rows.writeStream.format("ledger_files").option("path", ...).option("checkpointLocation", ...).start()
    read_ledger(spark, path)
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamArrowWriter, WriterCommitMessage

from ..functions import constants as K
from .mailbox import file_system

FOLD = 20
POSITION = "_position"


@dataclass
class Written(WriterCommitMessage):
    """A task's file, null if it had no rows, with the task's number and its rows."""

    file: str | None
    task: int
    rows: int


class Manifests:
    """The folder of manifests and snapshots of one ledger."""

    def __init__(self, path: str) -> None:
        self.system, self.root = file_system(path)
        self.folder = f"{self.root}/manifests"

    def numbers(self, kind: str) -> list[int]:
        found = self.system.get_file_info(fs.FileSelector(self.folder, allow_not_found=True))
        return sorted(int(f.base_name.split(".")[0]) for f in found if f.base_name.endswith(kind) and f.base_name.split(".")[0].isdigit())

    def load(self, name: str) -> dict:
        with self.system.open_input_stream(f"{self.folder}/{name}") as f:
            return json.loads(f.read())

    def save(self, name: str, content: dict) -> None:
        """The file under its name appears by a move, whole."""
        self.system.create_dir(self.folder, recursive=True)
        draft = f"{self.folder}/_{uuid.uuid4().hex}"
        with self.system.open_output_stream(draft) as f:
            f.write(json.dumps(content).encode())
        self.system.move(draft, f"{self.folder}/{name}")

    def committed(self, batch: int) -> bool:
        return batch in self.numbers(".json") or any(batch <= n for n in self.numbers(".snapshot"))

    def next_row(self) -> int:
        last = max(self.numbers(".json"), default=None)
        if last is not None:
            return self.load(f"{last}.json")["next"]
        folded = self.numbers(".snapshot")
        return self.load(f"{folded[-1]}.snapshot")["next"] if folded else 1

    def files(self) -> list[dict]:
        """All files of the ledger: the newest snapshot and the manifests after it."""
        folded = self.numbers(".snapshot")
        out = self.load(f"{folded[-1]}.snapshot")["files"] if folded else []
        for n in self.numbers(".json"):
            if not folded or n > folded[-1]:
                out = out + self.load(f"{n}.json")["files"]
        return out

    def fold(self) -> None:
        """A snapshot of all manifests; the newest manifest stays for the next commit."""
        numbers = self.numbers(".json")
        self.save(f"{numbers[-1]}.snapshot", {"files": self.files(), "next": self.next_row()})
        for n in self.numbers(".snapshot")[:-1]:
            self.system.delete_file(f"{self.folder}/{n}.snapshot")
        for n in numbers[:-1]:
            self.system.delete_file(f"{self.folder}/{n}.json")


class _Writer(DataSourceStreamArrowWriter):
    def __init__(self, path: str, fold: int) -> None:
        self.path, self.fold = path, fold

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        system, root = file_system(self.path)
        name, rows, out = f"{uuid.uuid4().hex}.parquet", 0, None
        for batch in iterator:
            if not batch.num_rows:
                continue
            position = pa.array(range(rows, rows + batch.num_rows), pa.int64())
            table = pa.Table.from_batches([batch]).append_column(POSITION, position)
            if out is None:
                system.create_dir(f"{root}/data", recursive=True)
                out = pq.ParquetWriter(f"{root}/data/{name}", table.schema, filesystem=system)
            out.write_table(table)
            rows += batch.num_rows
        if out is not None:
            out.close()
        return Written(name if rows else None, TaskContext.get().partitionId(), rows)

    def _drop(self, messages: list) -> None:
        system, root = file_system(self.path)
        for m in messages:
            if m is not None and m.file:
                system.delete_file(f"{root}/data/{m.file}")

    def commit(self, messages: list, batchId: int) -> None:
        manifests = Manifests(self.path)
        if manifests.committed(batchId):
            self._drop(messages)
            return
        files, at = [], manifests.next_row()
        for m in sorted((m for m in messages if m is not None and m.file), key=lambda m: m.task):
            files.append({"file": m.file, "first": at, "rows": m.rows, "batch": batchId})
            at += m.rows
        manifests.save(f"{batchId}.json", {"files": files, "next": at})
        if len(manifests.numbers(".json")) > self.fold:
            manifests.fold()

    def abort(self, messages: list, batchId: int) -> None:
        if not Manifests(self.path).committed(batchId):
            self._drop(messages)


class LedgerFiles(DataSource):
    """Options: ``path``; ``fold``: batches per snapshot."""

    @classmethod
    def name(cls) -> str:
        return "ledger_files"

    def schema(self) -> str:
        raise NotImplementedError("read a ledger with read_ledger")

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamArrowWriter:
        return _Writer(self.options["path"], int(self.options.get("fold", FOLD)))


def read_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """The committed rows with their ``sheet_row_ref``; null while there are none."""
    files = Manifests(path).files()
    if not files:
        return None
    starts = spark.createDataFrame([(f["file"], f["first"], f["batch"]) for f in files], "_file string, _first long, batch_id long")
    rows = spark.read.parquet(*[f"{path}/data/{f['file']}" for f in files]).withColumn("_file", F.col("_metadata.file_name"))
    at = (F.col("_first") + F.col(POSITION)).cast("string")
    return rows.join(starts, "_file").withColumn(
        "sheet_row_ref", F.concat(F.lit(f"{K.LEDGER_TAB}!A"), at, F.lit(":F"), at)).drop("_file", "_first", POSITION)

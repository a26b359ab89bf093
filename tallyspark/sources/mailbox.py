"""A mailbox's change history as a Spark data source, for batch reads and streams.

The offset is a history id. A read covers the changes in ``(after, upto]``, cut into slices of ids, one partition each. A
mailbox keeps only part of its history: where the cursor is missing or older than what is kept, the read is a
backfill, all messages received since January 1 of ``year``, instead of the changes. Whether it
is, is decided when a batch is planned, so a restart whose cursor has expired meanwhile turns to a backfill by itself.
Deliveries repeat then, as they do after a crash: readers drop messages seen before (``inbox.unseen``).

    spark.dataSource.register(MailboxHistory)
    spark.readStream.format("mailbox_history").options(path=..., year=2024).load()

``FolderMailbox`` reads a mailbox stored as two Parquet folders, through any file system that Arrow knows;
a client of a provider takes its place by overriding ``MailboxHistory.client``.
"""

from __future__ import annotations

import datetime
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "history_id long, message_id string, origin string"
ARROW = pa.schema([("history_id", pa.int64()), ("message_id", pa.string()), ("origin", pa.string())])
SLICE = 50_000
NO_CURSOR = -1


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system and path of a URI or a local path."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class FolderMailbox:
    """``changes/`` (history_id, message_id) and ``messages/`` (message_id, received_at) under a folder."""

    def __init__(self, path: str) -> None:
        self.path = path

    def _files(self, part: str) -> ds.Dataset:
        system, path = file_system(f"{self.path}/{part}")
        return ds.dataset(path, filesystem=system, format="parquet")

    def kept(self) -> tuple[int, int] | None:
        """Oldest and newest history id, from the files' footers; nothing is read of the rows."""
        least, most = [], []
        for fragment in self._files("changes").get_fragments():
            column = fragment.metadata.schema.to_arrow_schema().get_field_index("history_id")
            for group in range(fragment.metadata.num_row_groups):
                figures = fragment.metadata.row_group(group).column(column).statistics
                if figures is not None and figures.has_min_max:
                    least.append(figures.min)
                    most.append(figures.max)
        return (min(least), max(most)) if least else None

    def changes(self, after: int, upto: int) -> Iterator[pa.RecordBatch]:
        field = ds.field("history_id")
        for batch in self._files("changes").to_batches(columns=["history_id", "message_id"], filter=(field > after) & (field <= upto)):
            yield batch

    def message_files(self) -> list[str]:
        return sorted(self._files("messages").files)

    def messages(self, file: str, year: int) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(f"{self.path}/messages")
        start = pa.scalar(datetime.datetime(year, 1, 1))
        data = ds.dataset(file, filesystem=system, format="parquet")
        kind = data.schema.field("received_at").type
        start = start.cast(pa.timestamp("us")).cast(pa.timestamp(kind.unit, kind.tz)) if pa.types.is_timestamp(kind) else start
        yield from data.to_batches(columns=["message_id"], filter=ds.field("received_at") >= start)


@dataclass
class ChangeSlice(InputPartition):
    after: int
    upto: int


@dataclass
class BackfillFile(InputPartition):
    file: str
    upto: int


class _History:
    """What batch and stream reader share: planning and reading of a range of history ids."""

    def __init__(self, client, options: dict) -> None:
        self.client = client
        self.after = int(options.get("after", NO_CURSOR))
        self.upto = int(options["upto"]) if "upto" in options else None
        self.year = int(options.get("year", 1970))
        self.slice = int(options.get("slice", SLICE))

    def plan(self, after: int, upto: int) -> list[InputPartition]:
        kept = self.client.kept()
        if after != NO_CURSOR and after >= upto:
            return []
        if after == NO_CURSOR or kept is None or after < kept[0] - 1:
            return [BackfillFile(f, upto) for f in self.client.message_files()]
        return [ChangeSlice(a, min(a + self.slice, upto)) for a in range(after, upto, self.slice)]

    def read(self, part: InputPartition) -> Iterator[pa.RecordBatch]:
        if isinstance(part, BackfillFile):  # a backfilled message is up to date as of the batch's end
            for batch in self.client.messages(part.file, self.year):
                ids = batch.column(0).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([part.upto] * len(ids), pa.int64()), ids,
                                                  pa.array(["backfill"] * len(ids))], schema=ARROW)
        else:
            for batch in self.client.changes(part.after, part.upto):
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.string()),
                                                  pa.array(["change"] * batch.num_rows)], schema=ARROW)


class _BatchReader(_History, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        kept = self.client.kept()
        upto = self.upto if self.upto is not None else kept[1] if kept else 0
        return self.plan(self.after, upto) or [ChangeSlice(upto, upto)]


class _StreamReader(_History, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"history_id": self.after}

    def latestOffset(self) -> dict:
        kept = self.client.kept()
        return {"history_id": max(self.after, kept[1] if kept else NO_CURSOR)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return self.plan(start["history_id"], end["history_id"])

    def commit(self, end: dict) -> None:
        """Nothing to let go of: the mailbox prunes its history itself."""


class MailboxHistory(DataSource):
    """Options: ``path``; ``after``: the stored cursor; ``upto`` (batch); ``year`` of a backfill; ``slice``: ids per partition."""

    @classmethod
    def name(cls) -> str:
        return "mailbox_history"

    def schema(self) -> str:
        return SCHEMA

    def client(self):
        return FolderMailbox(self.options["path"])

    def reader(self, schema) -> DataSourceReader:
        return _BatchReader(self.client(), dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.client(), dict(self.options))


def cursor_in(checkpoint: str) -> int | None:
    """The history id up to which a stream's last planned batch reads, from its checkpoint."""
    system, path = file_system(checkpoint)
    found = system.get_file_info(fs.FileSelector(f"{path}/offsets", allow_not_found=True))
    batches = [f for f in found if f.base_name.isdigit()]
    if not batches:
        return None
    last = max(batches, key=lambda f: int(f.base_name))
    with system.open_input_stream(last.path) as f:
        return json.loads(f.read().decode().splitlines()[-1])["history_id"]

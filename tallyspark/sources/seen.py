"""Which messages have been processed before: Bloom filters per hash range, exact look-ups only where they hit.

Ids are appended once, under ``ids/range=R/batch_id=N``. Each range has filters of ``BITS`` bits in a bucket table, so a
batch rewrites only those of the ranges it touches; a filter that holds ``BITS / 10`` ids is closed and the
next one of its range begun, which keeps false hits near one in a hundred for every filter. A batch tests its ids against the filters of
its ranges, and reads ids only of ranges in which one hit: without repeats nothing of the history is scanned but filters.

The test per range sees that range's share of a batch and its filters; ids are made distinct first, so no range is hot.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rows import drop_written, written
from .buckets import BucketTable

RANGES = 256
BITS = 1 << 20
PROBES = 7
_ID = "message_id string, range int, h1 long, h2 long"
_FILTER = "range int, number int, n long, bits binary"


def hashed(ids: DataFrame, ranges: int) -> DataFrame:
    """Distinct ids with their range and two hashes."""
    return ids.select(F.col("message_id").cast("string").alias("message_id")).where("message_id is not null").distinct().select(
        "message_id", F.pmod(F.xxhash64("message_id"), F.lit(ranges)).cast("int").alias("range"),
        F.xxhash64(F.lit(1), "message_id").alias("h1"), F.xxhash64(F.lit(2), "message_id").alias("h2"))


def _places(h1, h2, size: int) -> np.ndarray:
    """Bit numbers of each id, one row per probe."""
    step = np.asarray(h2, np.int64).astype(np.uint64) | np.uint64(1)
    return np.stack([(np.asarray(h1, np.int64).astype(np.uint64) + np.uint64(k) * step) % np.uint64(size) for k in range(PROBES)]).astype(np.int64)


class SeenIndex:
    """The index under a folder; ``bits`` a multiple of eight."""

    def __init__(self, spark: SparkSession, root: str, ranges: int = RANGES, bits: int = BITS) -> None:
        self.spark, self.root, self.ranges, self.bits = spark, root, ranges, bits
        # the newest state of a filter is the one that holds most ids
        self.filters = BucketTable(spark, f"{root}/filters", "range", lambda rows: rows.groupBy("range", "number").agg(
            F.max_by(F.struct("n", "bits"), "n").alias("x")).select("range", "number", "x.*"), buckets=ranges)

    def _filters_of(self, ids: DataFrame, before: int) -> DataFrame:
        """Filters of the ranges that some ids fall into, as they were before a batch."""
        buckets = [r[0] for r in ids.select(self.filters.bucket()).distinct().collect()]  # at most as many as ranges
        found = self.filters.rows(buckets, before)
        return found if found is not None else self.spark.createDataFrame([], _FILTER)

    def maybe_seen(self, ids: DataFrame, batch_id: int) -> DataFrame:
        """The hashed ids that a filter of their range holds: all that were seen and about one in a hundred others."""
        bits = self.bits

        def test(mine: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
            places = _places(mine["h1"], mine["h2"], bits)
            hit = np.zeros(len(mine), bool)
            for content in filters["bits"]:
                field = np.frombuffer(content, np.uint8)
                hit |= ((field[places >> 3] >> (places & 7)) & 1).all(axis=0)
            return mine[hit]

        return ids.groupBy("range").cogroup(self._filters_of(ids, batch_id).groupBy("range")).applyInPandas(test, _ID)

    def seen_ids(self, ranges: list[int], batch_id: int) -> DataFrame | None:
        """Ids of earlier batches in some ranges: only their folders are listed in the scan."""
        if not ranges:
            return None
        try:
            rows = self.spark.read.option("basePath", f"{self.root}/ids").schema(
                "message_id string, range int, batch_id long").parquet(f"{self.root}/ids")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        return rows.where(F.col("range").isin(ranges) & (F.col("batch_id") < batch_id))

    def unseen(self, messages: DataFrame, batch_id: int) -> DataFrame:
        """The messages of a batch that no earlier batch has added; null ids are never seen."""
        ids = written(hashed(messages, self.ranges), "ids")
        hits = written(self.maybe_seen(ids, batch_id), "hits")
        known = self.seen_ids([r[0] for r in hits.select("range").distinct().collect()], batch_id)
        if known is None:
            return messages
        again = written(known.join(hits, ["message_id", "range"], "left_semi").select("message_id").distinct(), "again")
        drop_written(ids)
        return messages.join(again, messages["message_id"].cast("string") == again["message_id"], "left_anti")

    def add(self, messages: DataFrame, batch_id: int) -> None:
        """Record the ids of a batch; a replay records the same."""
        ids = written(hashed(messages, self.ranges), "ids")
        capacity, size = self.bits // 10, self.bits

        def extend(mine: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
            if not len(mine):
                return pd.DataFrame({"range": [], "number": [], "n": [], "bits": []})
            mine = mine.sort_values("message_id")
            places = _places(mine["h1"], mine["h2"], size)
            last = filters.sort_values("number").iloc[-1] if len(filters) else None
            number, n = (int(last["number"]), int(last["n"])) if last is not None else (0, 0)
            field = np.frombuffer(last["bits"], np.uint8).copy() if last is not None else np.zeros(size // 8, np.uint8)
            out, at = [], 0
            while at < len(mine):
                if n >= capacity:
                    number, n, field = number + 1, 0, np.zeros(size // 8, np.uint8)
                some = places[:, at:at + capacity - n].ravel()
                np.bitwise_or.at(field, some >> 3, (1 << (some & 7)).astype(np.uint8))
                taken = min(capacity - n, len(mine) - at)
                n, at = n + taken, at + taken
                out.append((int(mine["range"].iloc[0]), number, n, field.tobytes()))
            return pd.DataFrame(out, columns=["range", "number", "n", "bits"])

        old = self._filters_of(ids, batch_id)
        new = ids.groupBy("range").cogroup(old.groupBy("range")).applyInPandas(extend, _FILTER)
        ids.select("message_id", "range", F.lit(batch_id).cast("long").alias("batch_id")).repartition("range").write.mode(
            "overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("range", "batch_id").parquet(f"{self.root}/ids")
        self.filters.update(new, batch_id)
        drop_written(ids)

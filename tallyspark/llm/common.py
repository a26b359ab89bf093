"""Helpers of the training-data operators: batch walking, word splitting, written tables."""

from __future__ import annotations

import gc
import time
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions import rows

#: Python-side memory bounds of one task: bytes of text walked at once, entries of a word cache.
CHUNK_BYTES = 4 << 20
CACHE_ENTRIES = 300_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Cut lineage: write ``df`` as a Parquet table in the shared folder and read it back."""
    drop_finished_shuffles(df.sparkSession)
    return rows.written(df, name, **options)


_collected = 0.0


def drop_finished_shuffles(spark: SparkSession, at_once: bool = False) -> None:
    """Let Spark's cleaner delete shuffle files of earlier steps: it does so when their plans are collected.

    Steps of a second or two leave little behind, so this runs every few seconds at most, or ``at_once`` before large steps.
    """
    global _collected
    if at_once or time.monotonic() - _collected > 3:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        _collected = time.monotonic()


def id_and_bytes(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The key and the text as UTF-8 bytes, under names of our own; nothing else is read."""
    return docs.select(F.col(key).alias("id"), F.col(text).cast("binary").alias("text"))


def chunks(batches: Iterable[pa.RecordBatch], limit: int = CHUNK_BYTES) -> Iterator[tuple[list, ...]]:
    """Column lists of consecutive rows that hold about ``limit`` bytes of text together.

    The last column is the text; a longer text is a chunk of its own, never cut.
    """
    for batch in batches:
        columns, size, start = batch.columns, 0, 0
        sizes = [0 if x is None else x for x in pc.binary_length(columns[-1]).to_pylist()]
        for i, n in enumerate(sizes):
            if size and size + n > limit:
                yield tuple(c.slice(start, i - start).to_pylist() for c in columns)
                start, size = i, 0
            size += n
        if start < len(sizes):
            yield tuple(c.slice(start).to_pylist() for c in columns)


class WordHashes(dict):
    """Word bytes to their 64-bit hash; forgets everything when full, so memory stays bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def words_of(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``: exactly what ``bytes.split()`` splits."""
    return text.split() if text else []


def record_batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)],
        schema=schema)


def runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Start index of each run of equal values."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]])

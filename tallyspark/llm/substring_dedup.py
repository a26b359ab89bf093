"""Operator 7, substring dedup by relative Lempel-Ziv parsing.

A word goes if a window of ``WINDOW`` consecutive words that covers it also starts earlier: in a document of
smaller id, or earlier in the same one.

Parsing: every window has an anchor, the least hashed run of ``ANCHOR`` words in it (the leftmost of
equals); neighbouring windows mostly share it. A document is thus cut into phrases, one per anchor:
all words of the windows that share it. The reference index is a table of phrases keyed by their
anchors, over all documents, so a phrase meets every reference that could hold any of its windows.
Phrases that equal an earlier one continue a factor as a whole; the longest possible factors are runs of them. Where a
factor ends, phrases differ though their anchors agree; there, and only there, each window is
looked up by itself. So long copies cost one row per phrase, and no window is missed:
equal windows have equal anchors.

Skew: counts and first places are aggregates with map-side combining; what joins back to them are
written tables, so a hot key's many rows are split over tasks. No step lists the pairs of a group.
Anchors and phrases, and both halves of a window's key, are independent 64-bit hashes (128 bits).

Defined results: null and empty texts have no words. Rows with a null id are left as they are. Rows
that repeat an id are one document to this operator: what is marked in one goes from each.
Texts are read whole, whatever their length. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.rows import drop_written
from tallyspark.llm.common import WordHashes, chunks, id_and_bytes, record_batch, words_of, written

WINDOW = 20
ANCHOR = 6
SHIFT = 8  # a span is start << SHIFT | further windows

PHRASES = pa.schema([("anchor", pa.int64()), ("phrase", pa.int64()), ("doc_id", pa.int64()), ("span", pa.int64())])
WINDOWS = pa.schema([("w1", pa.int64()), ("w2", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64())])
DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()),
                     ("kept_sha256", pa.string())])
WORD = re.compile(r"[^\x20\x09-\x0D]+")

BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Rolling:
    """Hashes of any run of words from prefix sums: polynomials modulo 2**64 with an odd base."""

    powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, hashes: np.ndarray, base: int) -> None:
        n = len(hashes) + 1
        up, down = self.powers.get(base, (np.zeros(0, np.uint64),) * 2)
        if len(up) < n:
            size = 1 << (n - 1).bit_length()
            inverse = pow(base, -1, 1 << 64)
            up, down = (np.cumprod(np.r_[np.uint64(1), np.full(size - 1, b, np.uint64)], dtype=np.uint64)
                        for b in (base, inverse))
            self.powers[base] = up, down
        self.down = down
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(hashes * up[:n - 1], out=self.sums[1:])

    def of(self, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        raw = (self.sums[stops] - self.sums[starts]) * self.down[starts]
        return mixed(raw + (stops - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))

    def of_all(self, length: int) -> np.ndarray:
        """Hashes of all runs of ``length`` words, without gathering places."""
        n = len(self.sums) - length
        raw = (self.sums[length:] - self.sums[:n]) * self.down[:n]
        return mixed(raw + np.uint64(length * 0xA0761D6478BD642F & (1 << 64) - 1))


def least_in_span(values: np.ndarray, span: int) -> np.ndarray:
    """Index of the leftmost least value of ``values[i:i + span]`` for each i."""
    at = np.arange(len(values))
    have = 1
    while have < span:
        step = min(have, span - have)
        less = values[step:] < values[:-step]
        at = np.where(less, at[step:], at[:-step])
        values = np.where(less, values[step:], values[:-step])
        have += step
    return at


class Parsed:
    """Documents of one chunk, laid side by side as word hashes."""

    def __init__(self, texts: list[bytes | None], hashes: WordHashes) -> None:
        words = [words_of(t) for t in texts]
        self.lengths = np.fromiter(map(len, words), np.int64, len(words))
        total = int(self.lengths.sum())
        flat = np.empty(total, np.uint64)
        self.firsts = np.cumsum(self.lengths) - self.lengths
        for first, own in zip(self.firsts.tolist(), words, strict=True):
            flat[first:first + len(own)] = np.fromiter(map(hashes.__getitem__, own), np.uint64, len(own))
        self.rolling = [Rolling(flat, base) for base in BASES]
        self.total = total

    def anchored(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per phrase: row of its document, anchor hash, places of its first and its last window."""
        if self.total < WINDOW:
            return (np.zeros(0, np.int64),) * 4
        grams = self.rolling[0].of_all(ANCHOR)
        anchors = least_in_span(grams, WINDOW - ANCHOR + 1)
        per_doc = np.maximum(self.lengths - WINDOW + 1, 0)
        doc = np.repeat(np.arange(len(per_doc)), per_doc)
        start = np.arange(len(doc)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc) + self.firsts[doc]
        own = anchors[start]
        if not len(own):
            return (np.zeros(0, np.int64),) * 4
        begin = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (doc[1:] != doc[:-1])])
        end = np.r_[begin[1:], len(own)] - 1
        return doc[begin], grams[own[begin]], start[begin], start[end]

    def phrases(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per phrase: row of its document, anchor hash, phrase hash, first window, further windows."""
        doc, anchors, s0, s1 = self.anchored()
        return doc, anchors, self.rolling[1].of(s0, s1 + WINDOW), s0 - self.firsts[doc], s1 - s0


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def list_phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for ids, texts in chunks(batches):
        doc, anchors, phrases, start, more = Parsed(texts, hashes).phrases()
        yield record_batch(PHRASES, _signed(anchors.astype(np.uint64)), _signed(phrases.astype(np.uint64)),
                           np.array(ids, np.int64)[doc], start << SHIFT | more)


def list_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of the phrases in ``spans``; rows of (id, spans, text)."""
    hashes = WordHashes()
    for ids, spans, texts in chunks(batches):
        parsed = Parsed(texts, hashes)
        doc = np.repeat(np.arange(len(ids)), [len(s) for s in spans])
        span = np.fromiter((x for s in spans for x in s), np.int64, len(doc))
        count = (span & ((1 << SHIFT) - 1)) + 1
        doc, first = np.repeat(doc, count), np.repeat(span >> SHIFT, count)
        start = first + np.arange(len(first)) - np.repeat(np.cumsum(count) - count, count)
        fits = start + WINDOW <= parsed.lengths[doc]  # always, unless rows repeat an id with another text
        doc, start = doc[fits], start[fits]
        at = parsed.firsts[doc] + start
        w1, w2 = (r.of(at, at + WINDOW) for r in parsed.rolling)
        yield record_batch(WINDOWS, _signed(w1), _signed(w2), np.array(ids, np.int64)[doc], start)


def removed_words(n: int, marks: list[int]) -> np.ndarray:
    """Which of ``n`` words lie inside ``marks`` (start, stop, start, stop, ...)."""
    gone = np.zeros(n + 1, np.int64)
    edges = np.minimum(np.array(marks, np.int64).reshape(-1, 2), n)
    np.add.at(gone, edges[:, 0], 1)
    np.add.at(gone, edges[:, 1], -1)
    return np.cumsum(gone)[:-1] > 0


def digest_kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts and the digest of what stays; rows of (id, spans, text)."""
    for ids, spans, texts in chunks(batches):
        rows = []
        for i, marks, text in zip(ids, spans, texts, strict=True):
            words = kept = words_of(text)
            if marks:
                gone = removed_words(len(words), marks).tolist()
                kept = [w for w, g in zip(words, gone, strict=True) if not g]
            rows.append((i, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
        yield record_batch(DIGESTS, *map(list, zip(*rows, strict=True)))


def cut_text(text: str | None, marks) -> str | None:
    """The text without the marked words and the white space behind them; all else stays as it is."""
    if text is None or marks is None:
        return text
    places = [m.start() for m in WORD.finditer(text)]
    gone = removed_words(len(places), marks)
    edges = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8))).tolist()
    parts, at = [], 0
    for first, stop in zip(edges[::2], edges[1::2], strict=True):
        parts.append(text[at:places[first]])
        at = places[stop] if stop < len(places) else len(text)
    return "".join([*parts, text[at:]])


def cut_texts(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for texts, spans in parts:
        yield pd.Series([cut_text(t, s) for t, s in zip(texts, spans, strict=True)], dtype=object)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(id, spans): the word spans of each document that also start earlier; ``docs``: (id, text bytes)."""
    own = docs.where("id is not null")
    # texts are parsed once: what that costs is more than a table of all phrases takes
    parsed = written(own.mapInArrow(list_phrases, "anchor long, phrase long, doc_id long, span long"), "parsed")
    shared = written(parsed.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "anchors")
    phrases = written(parsed.join(shared, "anchor"), "phrases")
    drop_written(parsed)
    drop_written(shared)
    firsts = written(phrases.groupBy("anchor", "phrase").agg(
        F.min(F.struct("doc_id", "span")).alias("first")), "first-phrases")
    whole = written(phrases.join(firsts, ["anchor", "phrase"])
                    .where(F.struct("doc_id", "span") != F.col("first")).select("doc_id", "span"), "whole")
    # factor boundaries: phrases that differ around one anchor
    several = written(firsts.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "several")
    edges = firsts.join(several, "anchor").groupBy(F.col("first.doc_id").alias("id")).agg(
        F.collect_set("first.span").alias("spans"))
    windows = own.join(edges, "id").select("id", "spans", "text").mapInArrow(
        list_windows, "w1 long, w2 long, doc_id long, start long")
    windows = written(windows, "windows")
    first = written(windows.groupBy("w1", "w2").agg(F.min(F.struct("doc_id", "start")).alias("first"),
                                                    F.count("*").alias("n")).where("n > 1"), "first-windows")
    single = windows.join(first, ["w1", "w2"]).where(F.struct("doc_id", "start") != F.col("first")).select(
        "doc_id", "start", (F.col("start") + WINDOW).alias("stop"))
    start = F.shiftright("span", SHIFT)
    spans = whole.select("doc_id", start.alias("start"), (
        start + WINDOW + F.col("span").bitwiseAND((1 << SHIFT) - 1)).alias("stop")).union(single)
    return written(spans.groupBy(F.col("doc_id").alias("id")).agg(
        F.flatten(F.collect_list(F.array("start", "stop"))).alias("spans")), "spans")


def documents(docs: DataFrame, key: str, text: str) -> DataFrame:
    return id_and_bytes(docs, key, text).withColumn("id", F.col("id").cast("long"))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every row (kept words joined by one space)."""
    rows = documents(docs, key, text)
    joined = rows.join(repeated_spans(rows), "id", "left").select("id", "spans", "text")
    return joined.mapInArrow(digest_kept, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def shorten(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs``, all columns, with the repeated words cut out of ``text``."""
    spans = repeated_spans(documents(docs, key, text)).select(
        F.col("id").alias("__llm_id"), F.col("spans").alias("__llm_spans"))
    joined = docs.join(spans, F.col(key) == F.col("__llm_id"), "left")
    return joined.withColumn(text, F.pandas_udf(cut_texts, "string")(text, "__llm_spans")).select(*docs.columns)

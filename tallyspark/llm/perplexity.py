"""Operator 10, quality rules with n-gram perplexity.

Base rules fail documents of fewer than 50 words or with more than half of their words in repeated
three-word windows. The rest is judged by the perplexity of a modified Kneser-Ney model of characters, per
language: n-grams of ``ORDER`` characters over a text's words joined by single spaces, so that they cross
word ends (padded at the start, with an end mark).

No document is judged by a model that has seen it: texts are dealt to two folds by a hash of the text (copies
share a fold), and each fold is scored by the model counted on the other one. Only documents that pass the base rules
are counted. Two values of a document are judged: the log-perplexity of all its characters, and that of the first characters
of its words after the first, given the end of the word before (the joints: words in a wrong order show there). A band
belongs to the documents that one model judges: from their median value down and up by ``WIDTH`` (joints: ``JOINT_WIDTH``)
times the distance to the quartiles, which stay where they are while junk is under a quarter; ``1 + 4 / sqrt(n)`` times wider
for the uncertain quartiles of n documents.

Steps: tasks reduce their documents to bags (one row per few megabytes of one language and fold: distinct n-grams,
how often they are learned from, and the compressed words). Spark sums the n-grams, derives the continuation counts, discounts, context weights
and probabilities of all orders by joins on the n-grams themselves. The model is kept as hash arrays: its entries are cut
by hash range into rows of about ``SHARD`` sorted 64-bit hashes with their values; as many rows as the corpus needs, nothing of it
passes through the driver. The distinct n-grams that documents ask for meet the row of their range and are found by bisection;
those that are new there ask for their shorter forms and contexts. Each bag then asks every hash range once for the values of all its
n-grams there (one packed row of sorted hashes, answered by one packed row of values), and its texts are read again.

Defined results: a null or empty text has no words and fails the base rules. A null language is a
language of its own. Null ids and repeated rows are judged like any others. Where a fold's model has no text, all its
documents have equal perplexities and stay. No rows: no rows. U+0000 counts as U+FFFF.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.rows import drop_written
from tallyspark.llm.common import CHUNK_BYTES, chunks, drop_finished_shuffles, record_batch, runs, words_of, written

ORDER = 5
MIN_WORDS = 50
WIDTH, JOINT_WIDTH = 10.0, 6.0  # from measured rejection of planted shuffled texts and of labelled documents
START, END = "\x02", "\x03"
SYMBOLS = [b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">"]
SPACES = [b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"]
VOCABULARY = 1 << 21  # characters, for the uniform base distribution
SHARD = 1 << 16  # entries of one hash array
STEP = 1 << 24  # parts of a nat in which log-probabilities are added up, so that sums have no order
BAG_BYTES = 2 * CHUNK_BYTES  # text of a bag
HELD_BYTES = 6 * CHUNK_BYTES  # text that waits in a task for its bag
SLICE = 1 << 20  # characters that are counted at once
TABLE = 1 << 24  # numbers below this are ranked by a table
PART = 1 << 18  # pairs that are compressed and read at once
FILES = 4  # files of bags whose n-grams are summed in one task
ROUNDS = 4  # bags are finished in so many parts: only one part's texts lie on disk twice
ASKED = 1 << 22  # n-grams that all bags together may ask of one hash range

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
BASE = f"doc_id long, {', '.join(c + ' long' for c in COUNTS)}, base_failed boolean, model string, log_perplexity double, joint_perplexity double"
BASE_ARROW = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in COUNTS), ("base_failed", pa.bool_()),
                        ("model", pa.string()), ("log_perplexity", pa.float64()), ("joint_perplexity", pa.float64())])
BAG = ("bag long, model string, grams array<string>, trained array<long>, ids array<long>, "
       + "".join(f"{c} array<long>, " for c in COUNTS) + "base_failed array<boolean>, texts binary")
BAG_ARROW = pa.schema([
    ("bag", pa.int64()), ("model", pa.string()), ("grams", pa.list_(pa.string())),
    ("trained", pa.list_(pa.int64())), ("ids", pa.list_(pa.int64())), *((c, pa.list_(pa.int64())) for c in COUNTS),
    ("base_failed", pa.list_(pa.bool_())), ("texts", pa.binary())])
WANTED_ARROW = pa.schema([("shard", pa.int64()), ("bag", pa.int64()), ("n", pa.int64()), ("hashes", pa.binary())])
ANSWERED_ARROW = pa.schema([("bag", pa.int64()), ("shard", pa.int64()), ("costs", pa.binary())])
FOUND_ARROW = pa.schema([("model", pa.string()), ("kind", pa.int32()), ("part", pa.string()), ("value", pa.float64())])


def base_counts(text: bytes | None, words: list[bytes], ids: dict) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    if not text:
        return 0, 0, 0, 0
    symbols = sum(map(text.count, SYMBOLS))
    if not words:
        return 0, symbols, 0, 0
    inner = len(text) if text.isascii() else int(np.count_nonzero(np.frombuffer(text, np.uint8) & 0xC0 != 0x80))
    chars = inner - sum(map(text.count, SPACES))  # code points that are no white space
    lines = [line for line in text.split(b"\n") if line.strip()] if b"\n" in text else []
    repeats, n = 0, len(words)
    if n >= 4:
        at = np.fromiter(map(ids.__getitem__, words), np.int64, n)
        if len(ids) < 1 << 21:  # three numbers fit side by side
            key = at[:-2] << 42 | at[1:-1] << 21 | at[2:]
        else:  # pairs are numbered before the third word is added
            _, pair = np.unique(at[:-1] << 32 | at[1:], return_inverse=True)
            key = pair[:-1].astype(np.int64) << 32 | at[2:]
        ordered = np.sort(key)
        if (ordered[1:] == ordered[:-1]).any():
            order = np.argsort(key, kind="stable")
            starts = runs(key[order])
            size = np.diff(np.r_[starts, len(order)])
            twice = np.zeros(n - 2, bool)
            twice[order] = np.repeat(size > 1, size)
            covered = np.zeros(n, bool)
            for k in range(3):
                covered[k:n - 2 + k] |= twice
            repeats = int(covered.sum())
    return chars, symbols, len(lines) - len(set(lines)), repeats


class Numbers(dict):
    """Numbers for words in order of appearance."""

    def __init__(self, numbers: Iterator[int]) -> None:
        super().__init__()
        self.numbers = numbers

    def __missing__(self, word: str) -> int:
        value = self[word] = next(self.numbers)
        return value


# Bags of n-grams

def model_name(lang: str | None, fold: int) -> str:
    return f"{fold}" if lang is None else f"{fold}:{lang}"


def fold_of(text: bytes | None) -> int:
    return xxhash.xxh64_intdigest(text or b"") & 1


def slices(texts: list[str], limit: int) -> Iterator[tuple[int, list[str]]]:
    """Consecutive texts of about ``limit`` characters together, with the number of texts before them."""
    start, size = 0, 0
    for k, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, texts[start:k]
            start, size = k, 0
        size += len(t) + ORDER
    if start < len(texts):
        yield start, texts[start:]


def text_codes(texts: list[str], order: int) -> np.ndarray:
    """Code points of some texts, each padded at its start and ended."""
    whole = "".join(START * (order - 1) + t + END for t in texts).replace("\x00", "\uffff")
    return np.frombuffer(whole.encode("utf-32-le"), np.uint32)


def gram_numbers(codes: np.ndarray, n: int, seen: np.ndarray) -> np.ndarray:
    """A number for every window of ``n`` codes: its codes' places in ``seen`` as digits; there must be room for them."""
    place = np.zeros(int(seen[-1]) + 1, np.int32)
    place[seen] = np.arange(len(seen))
    place = place[codes]
    key = place[:len(codes) - n + 1].astype(np.int64)
    for k in range(1, n):
        key *= len(seen)
        key += place[k:len(codes) - n + 1 + k]
    return key


def ranks(key: np.ndarray, size: int) -> tuple[np.ndarray, int]:
    """The place of every number (all are below ``size``) among the distinct ones in order, and how many those are; unsorted where a table fits."""
    if size > TABLE:
        distinct, rank = np.unique(key, return_inverse=True)
        return rank, len(distinct)
    there = np.zeros(size, bool)
    there[key] = True
    there = np.flatnonzero(there)
    table = np.empty(size, np.int32)
    table[there] = np.arange(len(there), dtype=np.int32)
    return table.take(key), len(there)


def window_ranks(codes: np.ndarray, n: int, seen: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rank of every window of ``n`` codes that counts (``inner``) among their distinct ones, and where one of each starts.

    Windows are ranked length by length: the rank of a window and the code behind it make the number of the next longer one.
    """
    digits = np.zeros(int(seen[-1]) + 1, np.int32)
    digits[seen] = np.arange(len(seen))
    digits = digits[codes]
    rank, distinct = digits[:len(codes) - n + 1], len(seen)
    for k in range(1, n):
        distinct *= len(seen)
        rank = rank.astype(np.int64)
        rank *= len(seen)
        rank += digits[k:len(codes) - n + 1 + k]
        if k == n - 1:
            rank, distinct = ranks(rank if inner.all() else rank[inner], distinct)
        elif distinct * len(seen) > TABLE >> 4:  # short windows are numbers that are small enough
            rank, distinct = ranks(rank, distinct)
    starts = np.empty(distinct, np.int64)
    starts[rank] = np.flatnonzero(inner)
    return rank, starts


def counted_pairs(doc: np.ndarray, number: np.ndarray, distinct: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (document, number) pairs in order, and how often each comes."""
    pair = doc * distinct + number
    pair.sort()
    first = runs(pair)
    counts = np.diff(np.r_[first, len(pair)])
    pair = pair[first]
    return (pair // distinct).astype(np.int32), pair % distinct, counts.astype(np.int32)


class GramKeys:
    """Numbers for the n-grams of some texts, in the order of their characters; made slice by slice."""

    def __init__(self, texts: list[str], order: int) -> None:
        self.texts, self.order = texts, order
        there = np.zeros(0x110000, bool)
        for _, part in slices(texts, SLICE):
            there[text_codes(part, order)] = True
        self.seen = np.flatnonzero(there).astype(np.uint32)
        # digits that fit one number; with many different characters both halves of a window get names
        self.half = next(h for h in range(order, 0, -1) if len(self.seen) ** h < 1 << 62)
        if self.half < order:
            names = ([], [])
            for _, part in slices(texts, SLICE):
                for of, n in zip(names, (self.half, order - self.half), strict=True):
                    of.append(np.unique(gram_numbers(text_codes(part, order), n, self.seen)))
            self.heads, self.tails = (np.unique(np.concatenate(of)) for of in names)

    def numbers(self, codes: np.ndarray) -> np.ndarray:
        """The number of every window."""
        if self.half == self.order:
            return gram_numbers(codes, self.order, self.seen)
        tail = np.searchsorted(self.tails, gram_numbers(codes[self.half:], self.order - self.half, self.seen))
        return np.searchsorted(self.heads, gram_numbers(codes, self.half, self.seen)[:len(tail)]) * len(self.tails) + tail

    def of_slices(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Per slice: texts before it, the number of windows of each of its texts, their distinct numbers in order, and the rank of each window."""
        order = self.order
        for before, part in slices(self.texts, SLICE):
            codes = text_codes(part, order)
            lengths = np.fromiter(map(len, part), np.int64, len(part)) + 1
            inner = np.ones(len(codes) - order + 1, bool)  # windows that cross from one text into the next do not count
            stops = np.cumsum(lengths + order - 1)
            for k in range(1, order):
                inner[stops[:-1] - k] = False
            rank, starts = window_ranks(codes, order, self.seen, inner)
            one_each = codes[starts[:, None] + np.arange(order)].ravel()
            yield before, lengths, self.numbers(one_each)[::order], rank

    def spelled(self, distinct: np.ndarray) -> list[str]:
        digits = np.empty((len(distinct), self.order), np.int64)
        sides = [(distinct, 0, self.order)] if self.half == self.order else [
            (self.heads[distinct // len(self.tails)], 0, self.half), (self.tails[distinct % len(self.tails)], self.half, self.order)]
        for rest, start, stop in sides:
            for k in range(stop - 1, start - 1, -1):
                digits[:, k] = rest % len(self.seen)
                rest = rest // len(self.seen)
        return np.ascontiguousarray(self.seen[digits]).view(f"<U{self.order}").ravel().tolist()


def bag_counts(texts: list[str], order: int = ORDER) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """The distinct n-grams of some texts; of each (document, n-gram) pair the two indexes and the count, sorted.

    Texts are counted slice by slice: only their pairs are held for a whole bag, in twelve bytes each.
    """
    keys, found = GramKeys(texts, order), []
    for before, lengths, mine, rank in keys.of_slices():
        doc, number, counts = counted_pairs(np.repeat(np.arange(len(lengths)), lengths), rank, len(mine))
        found.append([doc + np.int32(before), mine[number], counts])
    distinct = np.unique(np.concatenate([np.unique(mine) for _, mine, _ in found]))
    for row in found:
        row[1] = np.searchsorted(distinct, row[1]).astype(np.int32)
    return keys.spelled(distinct), *(np.concatenate(c) for c in zip(*found, strict=True))


def bag_grams(texts: list[str], learned: np.ndarray, order: int = ORDER) -> tuple[list[str], np.ndarray]:
    """The distinct n-grams of some texts, and how often each comes in the ``learned`` ones."""
    keys, found = GramKeys(texts, order), []
    for before, lengths, mine, rank in keys.of_slices():
        found.append((mine, np.bincount(rank[np.repeat(learned[before:before + len(lengths)], lengths)], minlength=len(mine))))
    distinct, at = np.unique(np.concatenate([mine for mine, _ in found]), return_inverse=True)
    counts = np.concatenate([n for _, n in found])
    return keys.spelled(distinct), np.bincount(at, counts, len(distinct)).astype(np.int64)


def bag_sums(texts: list[str], costs_of: Callable[[list[str]], np.ndarray], order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text the sum of its n-grams' costs, that of its joints alone, and the number of these; ``costs_of`` gives the distinct ones'."""
    keys = GramKeys(texts, order)
    slices_ = [(lengths, mine, rank.astype(np.int32)) for _, lengths, mine, rank in keys.of_slices()]
    distinct = np.unique(np.concatenate([mine for _, mine, _ in slices_]))
    grams = keys.spelled(distinct)
    costs, joint = costs_of(grams), np.array([g[-2] == " " for g in grams])
    out = []
    for lengths, mine, rank in slices_:
        at, starts = np.searchsorted(distinct, mine), np.cumsum(lengths) - lengths
        out.append([np.add.reduceat(x[at][rank], starts) for x in (costs, np.where(joint, costs, 0), joint.astype(np.int64))])
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def planes(values: np.ndarray) -> bytes:
    """Whole numbers byte plane by byte plane: small ones compress well."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unplanes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8").ravel().astype(np.int64)


def fill_bag(bag: int, lang: str | None, fold: int, rows: list[tuple]) -> pa.RecordBatch:
    ids, texts, numbers, failed = zip(*rows, strict=True)
    filled = [i for i, t in enumerate(texts) if t]
    grams, trained = [], np.zeros(0, np.int64)
    if filled:
        grams, trained = bag_grams([texts[i] for i in filled], ~np.array(failed, bool)[filled])
    return record_batch(BAG_ARROW, [bag], [model_name(lang, fold)], [grams], [trained], [ids],
                        *([list(c)] for c in zip(*numbers, strict=True)), [failed],
                        [zstandard.ZstdCompressor(level=6).compress("\n".join(texts).encode())])  # joined words hold no \n


def by_use(trained: np.ndarray) -> np.ndarray:
    """The n-grams of a bag, those that are used most first."""
    return np.argsort(-trained, kind="stable")


def pack_pairs(doc: np.ndarray, gram: np.ndarray, counts: np.ndarray, trained: np.ndarray, n: int) -> list[bytes]:
    """Pairs and counts, compressed part by part: n-gram by n-gram, as frequent ones leave small gaps and lie together."""
    place = np.empty(len(trained), np.int64)
    place[by_use(trained)] = np.arange(len(trained))
    pair = place[gram]
    pair *= n
    pair += doc
    bits = int(counts.max()).bit_length()
    if len(trained) * n < 1 << (63 - bits):  # the count rides along
        pair <<= bits
        pair |= counts
        pair.sort()
        counts = pair & ((1 << bits) - 1)
        pair >>= bits
    else:
        order = np.argsort(pair, kind="stable")
        pair, counts = pair[order], counts[order]
    out, press = [], zstandard.ZstdCompressor(level=1)
    for k in range(0, len(pair), PART):
        mine = pair[k:k + PART]
        out.append(press.compress(planes(np.diff(mine, prepend=pair[k - 1] if k else 0)) + planes(counts[k:k + PART])))
    return out


def unpack_pairs(packed: list[bytes], trained: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The documents, n-grams and counts of ``pack_pairs``, part by part."""
    order, before, open_ = by_use(trained), 0, zstandard.ZstdDecompressor()
    for part in packed:
        data = open_.decompress(part)
        pair = np.cumsum(unplanes(data[:len(data) // 2])) + before
        before = pair[-1]
        yield pair % n, order[pair // n], unplanes(data[len(data) // 2:])


def bag_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per few megabytes of documents of one language and fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[tuple]] = {}
        size: dict[tuple, int] = {}
        bag = count(TaskContext.get().partitionId() << 32)
        ids = Numbers(count())
        for rows in chunks(batches):
            for k, language, t in zip(*rows, strict=True):
                words, group = words_of(t), (language, fold_of(t))
                if len(ids) > 1 << 20:
                    ids = Numbers(count())
                numbers = base_counts(t, words, ids)
                failed = len(words) < MIN_WORDS or 100 * numbers[-1] > 50 * len(words)
                held.setdefault(group, []).append((k, b" ".join(words).decode(), (len(words), *numbers), failed))
                size[group] = size.get(group, 0) + len(t or b"") + 64
                full = [group] if size[group] >= BAG_BYTES else list(held) if sum(size.values()) >= HELD_BYTES else []
                for g in full:
                    del size[g]
                    yield fill_bag(next(bag), *g, held.pop(g))
        for g in list(held):
            yield fill_bag(next(bag), *g, held.pop(g))

    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(lang).alias("lang"),
                       F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(run, BAG)


# The model

def hashed(model: Column, kind: Column, part: Column) -> Column:
    return F.xxhash64(model, kind, part)


def discounts(level: DataFrame) -> DataFrame:
    """(model, d1, d2, d3): what an n-gram of count 1, 2, 3 and more gives to the shorter ones."""
    n = [F.greatest(F.lit(1), F.count_if(F.col("n") == k)) for k in (1, 2, 3, 4)]
    seen = level.groupBy("model").agg(*(x.alias(f"n{k}") for k, x in enumerate(n, 1)))
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    return seen.select("model", *(
        F.least(F.greatest(k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}"), F.lit(0.1)), F.lit(float(k))).alias(f"d{k}")
        for k in (1, 2, 3)))


def count_grams(bags: DataFrame) -> DataFrame:
    """(model, teaches, part, n): the distinct n-grams that each model is asked for, and how often they teach the other one."""
    # a task sums several files' bags, which share most n-grams, before it deals them out
    tasks = max(bags.sparkSession.sparkContext.defaultParallelism, len(bags.inputFiles()) // FILES)
    pairs = bags.select("model", "grams", "trained").coalesce(tasks).select("model", F.explode(F.arrays_zip("grams", "trained")).alias("x"))
    other = F.concat(F.translate(F.substring("model", 1, 1), "01", "10"), F.expr("substring(model, 2)"))
    counted = pairs.groupBy("model", F.col("x.grams").alias("part")).agg(F.sum("x.trained").alias("n"))
    return written(counted.withColumn("teaches", other), "grams")


def train(counted: DataFrame, order: int = ORDER) -> tuple[DataFrame, list[DataFrame]]:
    """(model, kind, part, value): of kind k the probability of an n-gram of k characters, of kind -k the
    weight that its context of k - 1 characters leaves to the shorter ones. Also the written tables behind it."""
    level = counted.where("n > 0").select(F.col("teaches").alias("model"), "part", "n")
    levels = [level]
    for _ in range(order - 1):  # how many different characters stand before an n-gram
        level = written(level.groupBy("model", F.expr("substring(part, 2)").alias("part")).agg(F.count("*").alias("n")), "grams")
        levels.append(level)
    out, below, behind = None, None, levels[1:]
    for k, level in enumerate(reversed(levels), 1):
        less = level.join(discounts(level), "model").select(
            "model", "part", "n", F.substring("part", 1, k - 1).alias("context"), F.expr("substring(part, 2)").alias("suffix"),
            F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3")).alias("d"))
        contexts = written(less.groupBy("model", "context").agg(
            F.sum("n").alias("total"), (F.sum("d") / F.sum("n")).alias("back")), "contexts")
        less = less.join(contexts, ["model", "context"])
        if below is None:
            less = less.withColumn("lower", F.lit(1.0 / VOCABULARY))
        else:
            less = less.join(below.select("model", F.col("part").alias("suffix"), F.col("value").alias("lower")),
                             ["model", "suffix"])
        below = written(less.select("model", "part", (
            (F.col("n") - F.col("d")) / F.col("total") + F.col("back") * F.col("lower")).alias("value")), "shares")
        behind += [contexts, below]
        part = below.select("model", F.lit(k).alias("kind"), "part", "value").unionByName(
            contexts.select("model", F.lit(-k).alias("kind"), F.col("context").alias("part"), F.col("back").alias("value")))
        out = part if out is None else out.unionByName(part)
    return out, behind


def shard_of(h: Column, bits: int) -> Column:
    return F.shiftrightunsigned(h, 64 - bits) if bits else F.lit(0).cast("long")


def hash_arrays(entries: DataFrame, bits: int) -> DataFrame:
    """(shard, entries): the hashes of one range in order, with their values."""
    h = hashed(F.col("model"), F.col("kind"), F.col("part"))
    return entries.select(h.alias("h"), "value").groupBy(shard_of(F.col("h"), bits).alias("shard")).agg(
        F.sort_array(F.collect_list(F.struct("h", "value"))).alias("entries"))


def find(asked: DataFrame, arrays: DataFrame, bits: int) -> DataFrame:
    """The distinct (model, kind, part) rows of ``asked`` with their value, null if the model has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                wanted, entries = row["wanted"].flatten(), row["entries"].flatten()
                h, model, kind, part = wanted.flatten()
                if not len(entries):
                    yield record_batch(FOUND_ARROW, model, kind, part, pa.nulls(len(part), pa.float64()))
                    continue
                known, values = (x.to_numpy(zero_copy_only=False) for x in entries.flatten())
                h = h.to_numpy(zero_copy_only=False)
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                yield record_batch(FOUND_ARROW, model, kind, part, pa.array(values[at], mask=known[at] != h))

    h = hashed(F.col("model"), F.col("kind"), F.col("part"))
    rows = asked.select(h.alias("h"), "model", "kind", "part").groupBy(shard_of(F.col("h"), bits).alias("shard")).agg(
        F.collect_list(F.struct("h", "model", "kind", "part")).alias("wanted"))
    return rows.join(arrays, "shard", "left").select("wanted", "entries").mapInArrow(
        run, "model string, kind int, part string, value double")


def back_off(new: DataFrame, k: int, look_up) -> DataFrame:
    """(model, part, value): probabilities of n-grams of ``k`` characters that the model does not hold."""
    context, suffix = F.substring("part", 1, k - 1), F.expr("substring(part, 2)")
    asked = new.select("model", F.lit(-k).alias("kind"), context.alias("part"))
    if k > 1:
        asked = asked.unionByName(new.select("model", F.lit(k - 1).alias("kind"), suffix.alias("part")))
    found = look_up(asked.distinct())
    back = found.where(F.col("kind") == -k).select("model", F.col("part").alias("context"), F.col("value").alias("back"))
    out = new.select("model", "part", context.alias("context"), suffix.alias("suffix")).join(back, ["model", "context"])
    if k == 1:
        out = out.withColumn("lower", F.lit(1.0 / VOCABULARY))
    else:
        shorter = found.where(F.col("kind") == k - 1)
        known = shorter.where("value IS NOT NULL").select("model", "part", "value").unionByName(
            back_off(shorter.where("value IS NULL").select("model", "part"), k - 1, look_up))
        out = out.join(known.select("model", F.col("part").alias("suffix"), F.col("value").alias("lower")), ["model", "suffix"])
    return out.select("model", "part", (F.coalesce("back", F.lit(1.0)) * F.col("lower")).alias("value"))


def gram_values(counted: DataFrame, order: int = ORDER) -> DataFrame:
    """(h, cost): hash of each distinct n-gram asked for, and its log-probability by the model's hash arrays in ``-1 / STEP``."""
    drop_finished_shuffles(counted.sparkSession, at_once=True)
    entries, behind = train(counted, order)
    size = max(counted.count(), entries.count())
    bits = max(0, (size // SHARD).bit_length())
    arrays = written(hash_arrays(entries, bits), "arrays")
    for table in behind:
        drop_written(table)
    used = [arrays]

    def look_up(asked: DataFrame) -> DataFrame:
        drop_finished_shuffles(asked.sparkSession, at_once=True)  # those of the step before are as large as this one's
        used.append(written(find(asked, arrays, bits), "found"))
        return used[-1]

    got = look_up(counted.select("model", F.lit(order).alias("kind"), "part"))
    values = got.where("value IS NOT NULL").select("model", "part", "value").unionByName(
        back_off(got.where("value IS NULL").select("model", "part"), order, look_up))
    out = written(values.select(F.xxhash64("model", "part").alias("h"), F.round(-F.log("value") * STEP).cast("long").alias("cost")), "values")
    for table in used:
        drop_written(table)
    return out


# Judging

def gram_hashes(model: str, grams: list[str]) -> np.ndarray:
    """What ``F.xxhash64("model", "part")`` gives, unsigned."""
    seed = xxhash.xxh64_intdigest(model.encode(), 42)
    return np.fromiter((xxhash.xxh64_intdigest(g.encode(), seed) for g in grams), np.uint64, len(grams))


def ask_ranges(bags: DataFrame, bits: int) -> DataFrame:
    """(shard, bag, n, hashes): what a bag asks of a hash range, its n-grams' hashes in order; packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for bag, hashes in zip(batch["bag"].to_pylist(), batch["hashes"], strict=True):
                h = np.sort(hashes.values.to_numpy().view(np.uint64))
                shard = (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)
                edges = np.r_[runs(shard), len(h)].tolist()
                steps = np.diff(h, prepend=np.uint64(0))  # the first of a range is reached from zero
                steps[edges[:-1]] = h[edges[:-1]]
                pairs = list(zip(edges[:-1], edges[1:], strict=True))
                yield record_batch(WANTED_ARROW, shard[edges[:-1]], [bag] * len(pairs), [b - a for a, b in pairs],
                                   [press.compress(planes(steps[a:b])) for a, b in pairs])

    hashes = F.transform("grams", lambda part: F.xxhash64("model", part)).alias("hashes")
    return bags.where("size(grams) > 0").select("bag", hashes).mapInArrow(run, "shard long, bag long, n long, hashes binary")


def answer_ranges(wanted: DataFrame, values: DataFrame, bits: int) -> DataFrame:
    """(bag, shard, costs): the values of the n-grams in the order they were asked for, four bytes each; packed."""

    def run(asked: pa.Table, known: pa.Table) -> pa.Table:
        press, open_ = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
        h = known["h"].to_numpy().view(np.uint64)
        order = np.argsort(h)
        h, costs = h[order], known["cost"].to_numpy()[order].astype("<u4")
        out = []
        for shard, bag, data in zip(*(asked[c].to_pylist() for c in ("shard", "bag", "hashes")), strict=True):
            mine = np.cumsum(unplanes(open_.decompress(data)).view(np.uint64), dtype=np.uint64)
            at = np.searchsorted(h, mine)
            if not len(h) or at[-1] == len(h) or (h[at] != mine).any():
                raise ValueError("an n-gram has no value")
            out.append((bag, shard, press.compress(np.ascontiguousarray(costs[at].view(np.uint8).reshape(-1, 4).T).tobytes())))
        return pa.Table.from_batches([record_batch(ANSWERED_ARROW, *map(list, zip(*out, strict=True)))] if out else [], ANSWERED_ARROW)

    known = values.select(shard_of(F.col("h"), bits).alias("shard"), "h", "cost")
    return wanted.groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(run, "bag long, shard long, costs binary")


def finish_bag(row: dict) -> pa.RecordBatch:
    """The documents of a bag whose n-grams have their values."""
    n, open_ = len(row["ids"]), zstandard.ZstdDecompressor()
    texts = open_.decompress(row["texts"]).decode().split("\n")
    sums, joint_sums, joints = np.zeros(n), np.zeros(n), np.zeros(n)
    filled = np.array([i for i, t in enumerate(texts) if t], np.int64)
    if len(filled):
        packed = [open_.decompress(x["costs"]) for x in sorted(row["answers"], key=lambda x: x["shard"])]

        def costs_of(grams: list[str]) -> np.ndarray:
            costs = np.empty(len(grams), np.int64)
            costs[np.argsort(gram_hashes(row["model"], grams))] = np.concatenate([
                np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(4, -1).T).view("<u4").ravel() for x in packed])
            return costs

        sums[filled], joint_sums[filled], joints[filled] = bag_sums([texts[i] for i in filled], costs_of)
    symbols = [len(t) + 1 if t else 0 for t in texts]
    means = ([float(x) / STEP / k if k else None for x, k in zip(*pairs, strict=True)]
             for pairs in ((sums, symbols), (joint_sums, joints)))
    return record_batch(BASE_ARROW, row["ids"], *(row[c] for c in COUNTS), row["base_failed"], [row["model"]] * n, *means)


def measure(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Base counts of every document and its log-perplexity per symbol by the model of the other fold."""

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield finish_bag(batch.slice(k, 1).to_pylist()[0])

    bags = written(bag_documents(docs, key, text, lang), "bags", compression="zstd")
    counted = count_grams(bags)
    values = gram_values(counted)
    drop_written(counted)
    drop_finished_shuffles(docs.sparkSession, at_once=True)
    asked = bags.agg(F.sum(F.size("grams")).alias("n")).head().n or 0
    bits = max(0, (values.count() // SHARD).bit_length(), (asked // ASKED).bit_length())
    answers = written(answer_ranges(ask_ranges(bags, bits), values, bits), "answers")
    drop_written(values)
    drop_finished_shuffles(docs.sparkSession, at_once=True)
    out = None
    for k in range(ROUNDS):
        rest, lists = (t.where(F.pmod(F.xxhash64("bag"), F.lit(ROUNDS)) == k) for t in (bags, answers))
        lists = lists.groupBy("bag").agg(F.collect_list(F.struct("shard", "costs")).alias("answers"))
        rest = rest.select("bag", "model", "ids", *COUNTS, "base_failed", "texts").join(lists, "bag", "left")
        part = written(rest.mapInArrow(finish, BASE), "finished")
        drop_finished_shuffles(docs.sparkSession, at_once=True)
        out = part if out is None else out.unionByName(part)
    drop_written(bags)
    drop_written(answers)
    return out


def bands(measured: DataFrame, width: float = WIDTH, joint_width: float = JOINT_WIDTH) -> DataFrame:
    """(model, low, high, joint_low, joint_high): the values that the documents judged by a model may have."""
    points = measured.where(~F.col("base_failed")).groupBy("model").agg(*(
        F.percentile_approx(c, [0.25, 0.5, 0.75], 10_000).alias(c) for c in ("log_perplexity", "joint_perplexity")),
        (1 + 4 / F.sqrt(F.count("*"))).alias("unsure"))

    def limits(c: str, by: float) -> tuple[Column, Column]:
        low, middle, high = (F.col(c)[k] for k in range(3))
        spread, by = F.lit(0.01), by * F.col("unsure")
        return middle - by * F.greatest(middle - low, spread), middle + by * F.greatest(high - middle, spread)

    low, high = limits("log_perplexity", width)
    joint_low, joint_high = limits("joint_perplexity", joint_width)
    return points.select("model", low.alias("low"), high.alias("high"), joint_low.alias("joint_low"),
                         joint_high.alias("joint_high"))


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
          width: float = WIDTH, joint_width: float = JOINT_WIDTH) -> DataFrame:
    """Base counts, perplexities and the verdict ``kept`` of every document."""
    measured = written(measure(docs, key, text, lang), "measured")
    judged = measured.join(bands(measured, width, joint_width), "model", "left")
    inside = (F.col("log_perplexity").between(F.col("low"), F.col("high"))
              & F.col("joint_perplexity").between(F.col("joint_low"), F.col("joint_high")))
    return judged.select(
        "doc_id", *COUNTS, "base_failed",
        (~F.col("base_failed") & F.coalesce(inside, F.lit(False))).alias("kept"),
        F.exp("log_perplexity").alias("perplexity"), F.exp("joint_perplexity").alias("joint_perplexity"))

"""Operator 4, SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprints: 64 bits, a bit is set if it is set in over half of the XXH64 hashes (seed 42) of a text's
three-word shingles. Two fingerprints that differ in at most ``MAX_BITS`` = 3 bits agree in one of
four 16-bit blocks, so each distinct fingerprint is rotated four times, and only those of equal upper
block can match. These are sorted by Gray rank (neighbours in that order share most bits) over all
tasks, and each task cuts its range into groups of equal upper block and chunks of ``CHUNK``.

A chunk is a small tree: leaves of up to ``FAN`` neighbours, nodes of up to ``FAN`` children; a node keeps
the bits that all below share (mask and pattern). Pairs of nodes are followed downward; the
shared bits in which they differ can only grow, so a pair is pruned once they exceed ``MAX_BITS``. A group that goes on in another
chunk is matched chunk by chunk afterwards, pruned the same way by the masks of whole chunks.
A chunk yields no pairs but a link from each fingerprint to the least of its local component, so
links are linear in the rows. Components are joined by contraction over these links.

Defined results: null and empty texts have no shingles, fingerprint zero, linked like any other.
Texts of one or two words hash the whole sequence. Equal fingerprints are one node, so groups of
copies cost one node; rows with a null id are members, but ``component_id`` is the least id that is
not null (null if there is none). Repeated rows are members each. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import chunks, id_and_bytes, record_batch, runs, written
from tallyspark.llm.components import connected_components

SHINGLE = 3
SEED = 42
MAX_BITS = 3
BLOCKS = 4
CHUNK = 2048
FAN = 16
SLICE = 1 << 18
PRINTS = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])


def lower_ascii(text: bytes) -> bytes:
    return text.lower()  # of bytes: A-Z only


def fingerprint(text: bytes | None) -> int:
    """Unsigned fingerprint of one whole text."""
    words = lower_ascii(text).split() if text else []
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    stops = ends[SHINGLE - 1:].tolist() if len(words) >= SHINGLE else [len(joined)]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 16):
        part = [digest(joined[a:b], SEED) for a, b in zip(starts[k:k + (1 << 16)], stops[k:k + (1 << 16)], strict=True)]
        bits = np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp) of every row, ``fp`` as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in chunks(batches):
            prints = np.fromiter(map(fingerprint, texts), np.uint64, len(texts))
            yield record_batch(PRINTS, ids, prints.view(np.int64))

    return id_and_bytes(docs, key, text).withColumn("id", F.col("id").cast("long")).mapInArrow(
        run, "doc_id long, fp long")


def gray_rank(code: Column) -> Column:
    """Place of a 64-bit code in Gray order: each bit is the parity of the bits above and itself."""
    for step in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, step))
    return code


def rotated(fp: Column, block: int) -> Column:
    """The code with its 16-bit block ``block`` on top."""
    by = 16 * block
    return fp if not by else F.shiftleft(fp, by).bitwiseOR(F.shiftrightunsigned(fp, 64 - by))


def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= MAX_BITS


class Tree:
    """Levels of (first child, past the last child, mask, pattern) over rows sorted by group and Gray rank."""

    def __init__(self, codes: np.ndarray, group_starts: np.ndarray) -> None:
        self.codes = codes
        bounds = np.r_[group_starts, len(codes)]
        self.levels = []
        ones, zeros = codes, codes
        while True:
            starts = np.concatenate([np.arange(a, b, FAN) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]) \
                if np.any(np.diff(bounds) > FAN) else bounds[:-1]
            stops = np.r_[starts[1:], len(ones)]
            ones, zeros = np.bitwise_and.reduceat(ones, starts), np.bitwise_or.reduceat(zeros, starts)
            self.levels.append((starts, stops, ~(ones ^ zeros), ones))
            bounds = np.searchsorted(starts, bounds)
            if len(starts) == len(group_starts):
                break

    def pairs(self, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows at most ``MAX_BITS`` apart below the pairs of top nodes; equal nodes stand for themselves."""
        yield from self._down(len(self.levels) - 1, left, right)

    def _down(self, level: int, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        starts, stops, mask, pattern = self.levels[level]
        differing = np.bitwise_count((pattern[left] ^ pattern[right]) & mask[left] & mask[right])
        fine = differing <= MAX_BITS
        left, right = left[fine], right[fine]
        per = max(1, SLICE // (FAN * FAN))
        for k in range(0, len(left), per):
            a, b = left[k:k + per], right[k:k + per]
            na, nb = stops[a] - starts[a], stops[b] - starts[b]
            each = na * nb
            which = np.repeat(np.arange(len(a)), each)
            at = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            x = starts[a][which] + at // nb[which]
            y = starts[b][which] + at % nb[which]
            keep = (a != b)[which] | (x < y if level == 0 else x <= y)
            x, y = x[keep], y[keep]
            if level:
                yield from self._down(level - 1, x, y)
            else:
                hit = near(self.codes[x], self.codes[y])
                yield x[hit], y[hit]


def local_links(n: int, found: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(row, least row of its component) of the rows that are linked to a smaller one."""
    root = np.arange(n)
    for a, b in found:
        while True:
            ra, rb = root[a], root[b]
            if np.array_equal(ra, rb):
                break
            low = np.minimum(ra, rb)
            np.minimum.at(root, ra, low)
            np.minimum.at(root, rb, low)
            while True:
                up = root[root]
                if np.array_equal(up, root):
                    break
                root = up
    rows = np.flatnonzero(root != np.arange(n))
    return rows, root[rows]


FOUND = "kind int, a long, b long, chunk long, top int"
FOUND_ARROW = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("chunk", pa.int64()),
                         ("top", pa.int32())])
LINK, OPEN = 0, 1


def index_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links inside the chunks of one task's Gray-ordered range, and the rows of groups that go on elsewhere."""
    shard, made = TaskContext.get().partitionId(), 0
    tops, fps, codes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    size, first = 0, True

    def emit(top: np.ndarray, fp: np.ndarray, code: np.ndarray, opens: bool, goes_on: bool) -> Iterator[pa.RecordBatch]:
        """Whole stretch of rows; its first group may go on before it, its last one behind it."""
        nonlocal made
        if not len(top):
            return
        group = runs(top)
        sizes = np.diff(np.r_[group, len(top)])
        cuts = np.concatenate([np.arange(a, a + s, CHUNK) for a, s in zip(group, sizes, strict=True)]) \
            if sizes.max() > CHUNK else group
        tree = Tree(code, cuts)
        each = np.arange(len(cuts))
        alone = np.diff(np.r_[cuts, len(top)]) == 1
        rows, roots = local_links(len(top), tree.pairs(each[~alone], each[~alone]))
        if len(rows):
            zero = np.zeros(len(rows), np.int64)
            yield record_batch(FOUND_ARROW, zero.astype(np.int32), fp[rows], fp[roots], zero, zero.astype(np.int32))
        open_group = sizes > CHUNK
        open_group[0] |= opens
        open_group[-1] |= goes_on
        shared = np.repeat(open_group, sizes)
        if shared.any():
            number = np.repeat(each, np.diff(np.r_[cuts, len(top)])) + (shard << 32) + made
            at = np.flatnonzero(shared)
            yield record_batch(FOUND_ARROW, np.full(len(at), OPEN, np.int32), fp[at], code[at].view(np.int64),
                               number[at], top[at].astype(np.int32))
        made += len(cuts)

    for batch in batches:
        tops.append(batch.column(0).to_numpy())
        fps.append(batch.column(1).to_numpy())
        codes.append(batch.column(2).to_numpy().view(np.uint64))
        size += len(tops[-1])
        if size >= 1 << 16:  # keep the last group open, unless it fills the whole stretch
            top, fp, code = np.concatenate(tops), np.concatenate(fps), np.concatenate(codes)
            last = int(runs(top)[-1])
            whole = last == 0
            cut = len(top) // CHUNK * CHUNK if whole else last
            yield from emit(top[:cut], fp[:cut], code[:cut], first or whole, whole)
            first = whole
            tops, fps, codes, size = [top[cut:]], [fp[cut:]], [code[cut:]], len(top) - cut
    yield from emit(np.concatenate(tops), np.concatenate(fps), np.concatenate(codes), first, True)


def link_unit(rows: pd.DataFrame) -> pd.DataFrame:
    """Links between two chunks of one group."""
    rows = rows.sort_values(["chunk", "code"])
    codes = rows["code"].to_numpy().view(np.uint64)
    tree = Tree(codes, runs(rows["chunk"].to_numpy()))
    if len(tree.levels[-1][0]) < 2:
        return pd.DataFrame({"a": [], "b": []}, dtype="int64")
    at, root = local_links(len(codes), tree.pairs(np.array([0]), np.array([1])))
    fp = rows["fp"].to_numpy()
    return pd.DataFrame({"a": fp[at], "b": fp[root]})


def link_fingerprints(prints: DataFrame) -> DataFrame:
    """Links (a, b) that connect exactly the fingerprints reachable over steps of ``MAX_BITS``.

    ``prints``: distinct ``fp``, from a written table.
    """
    spark = prints.sparkSession
    turned = F.explode(F.array(*[F.struct(F.lit(k).alias("block"), rotated(F.col("fp"), k).alias("code"))
                                 for k in range(BLOCKS)])).alias("x")
    rows = prints.select("fp", turned).select(
        (F.col("x.block") * 65536 + F.shiftrightunsigned("x.code", 48)).cast("long").alias("top"), "fp",
        F.col("x.code").alias("code"), gray_rank(F.col("x.code")).alias("gray"))
    ways = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(ways, "top", "gray").sortWithinPartitions("top", "gray")
    found = written(ordered.select("top", "fp", "code").mapInArrow(index_range, FOUND), "gray")
    links = found.where(F.col("kind") == LINK).select("a", "b")
    open_rows = found.where(F.col("kind") == OPEN).select(
        F.col("a").alias("fp"), F.col("b").alias("code"), "chunk", "top")
    nodes = written(open_rows.groupBy("chunk").agg(
        F.first("top").alias("top"), F.expr("bit_and(code)").alias("ones"),
        F.expr("bit_or(code)").alias("zeros")), "nodes")
    mask = (lambda s: F.bitwise_not(F.col(f"{s}.ones").bitwiseXOR(F.col(f"{s}.zeros"))))
    differing = F.bit_count(F.col("l.ones").bitwiseXOR(F.col("r.ones")).bitwiseAND(mask("l")).bitwiseAND(mask("r")))
    units = nodes.alias("l").join(nodes.alias("r"), F.col("l.top") == F.col("r.top")).where(
        (F.col("l.chunk") < F.col("r.chunk")) & (differing <= MAX_BITS)).select(
        F.col("l.chunk").alias("first"), F.col("r.chunk").alias("second"))
    sides = units.select(F.explode(F.array("first", "second")).alias("chunk"), "first", "second")
    crossing = open_rows.join(sides, "chunk").select("first", "second", "chunk", "fp", "code").groupBy(
        "first", "second").applyInPandas(link_unit, "a long, b long")
    return links.union(crossing)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row."""
    prints = written(fingerprints(docs, key, text), "fingerprints")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = connected_components(link_fingerprints(distinct))
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = written(named.join(least, "root").select("fp", "component_id"), "components")
    return prints.join(labels, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

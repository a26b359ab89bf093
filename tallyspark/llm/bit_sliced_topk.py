"""Operator 6, exact top-k search with a bit-sliced index.

Vectors are turned into integers ``floor(SCALE * x)``. Blocks of rows are indexed by bit slices: bit
``b`` of the quantised component ``d`` of all rows is one bitmap over the block. A query's coarse score
is the sum of its quantised weights times the components, added up by carry-save bitmap adders: a
weight is a few signed powers of two, so a product is the component's slices moved up, or their
complement for a negative one. The sum's slices are then walked from the most significant downward:
the rows that are surely among the best are kept, the boundary narrowed. What quantisation may have
moved is bounded by the norms of the parts cut off; every row within that bound of the boundary
is resolved exactly by its integer inner product.

Rows or queries with a component too large for 64-bit products (``narrow_limit``) go another way: floating-point products with their
error bounds select the rows that may be among the best, whose products are then summed in whole numbers.

Queries come in blocks of ``QUERIES_PER_BLOCK``, one pass over the index each; a block of them is what is broadcast. Of several blocks
each is collected, searched and written before the next one. Every row is indexed, so recall is 1; nothing is approximated in the result.

Defined results: null vectors and vectors with a null or non-finite component take no part. Vectors
score only against vectors of the same length. A score beyond the range of a long is the end of that range, and ranks as it;
a component beyond +-1e300 counts as that. Ties go to the smaller id; rows that repeat an id stand for themselves
(a query's own id is never its candidate; ties of the same id keep one row each). Rows with a null id take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import record_batch, written

SCALE = 1024
LARGEST = 1e300
LONG = (1 << 63) - 1
ROWS_PER_BLOCK = 1 << 15
QUERIES_PER_BLOCK = 2048
#: Bits kept of a component (with its sign) and of a weight, from the top.
COMPONENT_BITS = 5
WEIGHT_BITS = 5

HITS = "query_id long, vec_id long, score long"
HITS_ARROW = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v) with ``v`` an array of whole numbers, of the rows that take part."""
    x = F.col(vector)
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    rows = vectors.where(F.col(key).isNotNull() & x.isNotNull() & fine & (F.size(x) > 0))
    def floor(e):  # a double of 2**53 or more is whole; floor() itself ends at the range of a long
        scaled = F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), e.cast("double"))) * SCALE
        return F.when(F.abs(scaled) < float(1 << 53), F.floor(scaled).cast("double")).otherwise(scaled)

    whole = F.transform(x, floor)
    return rows.select(F.col(key).cast("long").alias("id"), whole.alias("v"))


def matrix(column: pa.ListArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) for each length of vector in the column."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat, first = column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lengths)])[:-1]
    out = []
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        out.append((rows, flat[first[rows][:, None] + np.arange(n)]))
    return out


def narrow_limit(dims: int) -> int:
    """Products of components up to this, summed over ``dims``, fit a long."""
    return 1 << ((62 - max(1, dims - 1).bit_length()) // 2)


class WideRows:
    """Rows of one block of which some component is too large for the index."""

    def __init__(self, ids: np.ndarray, values: np.ndarray) -> None:
        self.ids, self.values, self.dims = ids, values, values.shape[1]

    def search(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        return exact_search(self.ids, self.values, query_id, query, k)


def exact_search(ids: np.ndarray, values: np.ndarray, query_id: int, query: np.ndarray, k: int
                 ) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of the best ``k`` rows by whole-number products, held within a long."""
    at = np.flatnonzero(ids != query_id)
    if len(at) > k:
        with np.errstate(over="ignore", invalid="ignore"):
            about = values[at] @ query
            error = (np.abs(values[at]) @ np.abs(query)) * (len(query) + 2) * 2.0 ** -52
        if np.isfinite(about).all() and np.isfinite(error).all():
            held = np.clip(about, -float(LONG), float(LONG))  # what is cut off ranks alike
            low = held - error
            at = at[held + error >= np.partition(low, len(low) - k)[len(low) - k]]
    asked = [int(x) for x in query]
    scores = np.array([max(-LONG - 1, min(LONG, sum(int(a) * b for a, b in zip(row, asked, strict=True))))
                       for row in values[at].tolist()], np.int64)
    best = np.lexsort((ids[at], ~scores))[:k]
    return ids[at][best], scores[best]


def signed_powers(value: int) -> list[tuple[int, int]]:
    """(sign, exponent) with the fewest terms that sum to ``value``."""
    out, k = [], 0
    while value:
        if value & 1:
            sign = 2 - (value & 3)
            out.append((sign, k))
            value -= sign
        value >>= 1
        k += 1
    return out


class BitSlices:
    """The index of one block of rows with vectors of one length."""

    def __init__(self, ids: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.values = ids[order], values[order]
        n, self.dims = self.values.shape
        self.words = (n + 63) // 64
        top = int(np.abs(self.values).max(initial=0)).bit_length() + 1
        self.shift = max(0, top - COMPONENT_BITS)
        coarse = self.values >> self.shift
        self.bits = top - self.shift
        unsigned = (coarse & ((1 << self.bits) - 1)).astype(np.uint64)
        padded = np.zeros((self.words * 64, self.dims), np.uint64)
        padded[:n] = unsigned
        # slices[d][b]: bitmap of bit b of component d, two's complement
        self.slices = [[self._pack((padded[:, d] >> np.uint64(b)) & np.uint64(1)) for b in range(self.bits)]
                       for d in range(self.dims)]
        self.full = ~np.zeros(self.words, np.uint64)
        half = (1 << self.shift) - 1  # the rest of a component lies in 0..half; its middle is added to all
        self.middle = half / 2.0
        rest = self.values - (coarse << self.shift) - self.middle
        self.rest_norm = float(np.sqrt((rest * rest).sum(1).max(initial=0.0)))
        moved = (coarse << self.shift) + self.middle
        self.coarse_norm = float(np.sqrt((moved * moved).sum(1).max(initial=0.0)))

    @staticmethod
    def _pack(column: np.ndarray) -> np.ndarray:
        return np.packbits(column.astype(np.uint8), bitorder="little").view(np.uint64)

    def coarse_sum(self, weights: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Slices (two's complement, least first) of the sum of weights times coarse components."""
        width = self.bits + int(np.abs(weights).sum()).bit_length() + 1
        columns: list[list[np.ndarray]] = [[] for _ in range(width)]
        constant = 0
        for d, weight in enumerate(weights.tolist()):
            for sign, exponent in signed_powers(weight):
                # v = low bits - top * 2**(bits-1): the top slice goes in complemented, with a constant
                for b, part in enumerate(self.slices[d]):
                    negative = (sign < 0) != (b == self.bits - 1)
                    if negative:
                        columns[b + exponent].append(~part)
                        constant -= 1 << (b + exponent)
                    else:
                        columns[b + exponent].append(part)
        for k in range(width):
            if constant >> k & 1:
                columns[k].append(self.full)
        out = []
        for k, waiting in enumerate(columns):
            while len(waiting) > 2:  # three bitmaps of a column become a sum and a carry
                a, b, c = waiting.pop(), waiting.pop(), waiting.pop()
                ab = a ^ b
                waiting.append(ab ^ c)
                if k + 1 < width:
                    columns[k + 1].append((a & b) | (ab & c))
            if len(waiting) == 2:
                a, b = waiting
                waiting[:] = [a ^ b]
                if k + 1 < width:
                    columns[k + 1].append(a & b)
            out.append(waiting[0] if waiting else np.zeros(self.words, np.uint64))
        return out, width

    def at_least(self, slices: list[np.ndarray], least: int) -> np.ndarray:
        """Bitmap of the rows whose sum is ``least`` or more."""
        width = len(slices)
        sure, same = np.zeros(self.words, np.uint64), self.live
        for k in reversed(range(width)):
            part = ~slices[k] if k == width - 1 else slices[k]  # the sign slice sorts the other way round
            bit = (least >> k & 1) ^ (k == width - 1)
            if bit:
                same = same & part
            else:
                sure = sure | (same & part)
                same = same & ~part
        return sure | same

    def kth_sum(self, slices: list[np.ndarray], k: int, among: np.ndarray) -> int:
        """The k-th largest sum: slices from the most significant downward decide a bit each."""
        width, value, need, same = len(slices), 0, k, among
        for b in reversed(range(width)):
            part = ~slices[b] if b == width - 1 else slices[b]
            upper = same & part
            have = int(np.bitwise_count(upper).sum())
            if have >= need:
                same = upper
                value |= 0 if b == width - 1 else 1 << b
            else:
                need -= have
                same = same & ~part
                value -= 1 << b if b == width - 1 else 0
        return value

    @property
    def live(self) -> np.ndarray:
        out = np.zeros(self.words * 64, np.uint8)
        out[:len(self.ids)] = 1
        return np.packbits(out, bitorder="little").view(np.uint64)

    def search(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the best ``k`` rows other than the query's own."""
        if np.abs(query).max(initial=0) > narrow_limit(self.dims):
            return exact_search(self.ids, self.values.astype(np.float64), query_id, query, k)
        query = query.astype(np.int64)
        others = int(np.count_nonzero(self.ids != query_id))
        if others > k:
            top = int(np.abs(query).max(initial=0)).bit_length() + 1
            shift = max(0, top - WEIGHT_BITS)
            weights = (query + ((1 << shift) >> 1)) >> shift
            slices, _ = self.coarse_sum(weights)
            own = len(self.ids) - others
            kth = self.kth_sum(slices, k + own, self.live)
            # score = 2**(shift + self.shift) * coarse sum + parts whose sizes are bounded by norms
            lost = query - (weights << shift)
            bound = float(np.linalg.norm(lost)) * self.coarse_norm + float(np.linalg.norm(query)) * self.rest_norm
            unit = float(1 << (shift + self.shift))
            least = int(np.floor(kth - 2 * bound / unit)) - 1
            lowest = -(1 << (len(slices) - 1))
            chosen = self.at_least(slices, max(least, lowest))
            at = np.flatnonzero(np.unpackbits(chosen.view(np.uint8), bitorder="little")[:len(self.ids)])
        else:
            at = np.arange(len(self.ids))
        at = at[self.ids[at] != query_id]
        scores = self.values[at] @ query
        best = np.lexsort((self.ids[at], -scores))[:k]
        return self.ids[at][best], scores[best]


def block_of(ids: np.ndarray, values: np.ndarray) -> Iterator[BitSlices | WideRows]:
    narrow = np.abs(values).max(axis=1, initial=0.0) <= narrow_limit(values.shape[1])
    if narrow.any():
        yield BitSlices(ids[narrow], values[narrow].astype(np.int64))
    if not narrow.all():
        yield WideRows(ids[~narrow], values[~narrow])


def index_blocks(batches: Iterator[pa.RecordBatch], rows: int = ROWS_PER_BLOCK) -> Iterator[BitSlices | WideRows]:
    """Bit-sliced blocks of at most ``rows`` rows; rows with too large components apart."""
    held: dict[int, list] = {}
    for batch in batches:
        ids = batch.column(0).to_numpy()
        for at, values in matrix(batch.column(1)):
            waiting = held.setdefault(values.shape[1], [])
            for start in range(0, len(at), rows):
                waiting.append((ids[at[start:start + rows]], values[start:start + rows]))
                if sum(len(i) for i, _ in waiting) >= rows:
                    yield from block_of(np.concatenate([i for i, _ in waiting]), np.concatenate([v for _, v in waiting]))
                    waiting.clear()
    for waiting in held.values():
        if waiting:
            yield from block_of(np.concatenate([i for i, _ in waiting]), np.concatenate([v for _, v in waiting]))


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, key: str = "vec_id", vector: str = "embedding",
          queries_per_block: int = QUERIES_PER_BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: the best ``k`` of all rows for each row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    rows = usable(vectors, key, vector)
    queries = rows.where(F.col("id") % every == 0)
    n = queries.count()
    blocks = max(1, -(-n // queries_per_block))
    if blocks > 1:
        rows, queries = written(rows, "vectors"), written(queries, "queries")
    parts = []
    for block in range(blocks):
        # a hash deals queries out to blocks of about the same, bounded size; equal ids are equal queries
        own = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).dropDuplicates(["id", "v"])
        held = spark.sparkContext.broadcast([(r.id, r.v) for r in own.collect()])

        def search(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            asked = [(i, np.array(v, np.float64)) for i, v in held.value]
            for index in index_blocks(batches):
                found = [(i, *index.search(i, q, k)) for i, q in asked if len(q) == index.dims]
                if found:
                    yield record_batch(
                        HITS_ARROW, np.repeat([f[0] for f in found], [len(f[1]) for f in found]),
                        np.concatenate([f[1] for f in found]), np.concatenate([f[2] for f in found]))

        part = rows.mapInArrow(search, HITS)
        if blocks > 1:
            part = written(part, "hits")
            held.unpersist()
        parts.append(part)
    hits = parts[0]
    for part in parts[1:]:
        hits = hits.union(part)
    # a salted first round keeps any task's share of one query small, however many blocks there are
    salted = hits.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(16)))
    order = (F.desc("score"), F.asc("vec_id"))
    for by in (["query_id", "salt"], ["query_id"]):
        w = Window.partitionBy(*by).orderBy(*order)
        salted = salted.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return salted.select("query_id", "rank", "vec_id", "score")

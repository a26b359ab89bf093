"""Operator 13, conversation prefix trie: z-fast tries per batch, merged by Spark into one node table.

A conversation is a sequence of turns; every distinct prefix is a node. A batch of sequences is inserted
into a z-fast trie: only nodes where sequences branch or end are kept, each hashed at its two-fattest
depth between its parent and itself. Fat binary search over these handles finds a sequence's exit node with
a number of look-ups logarithmic in its length; there an edge is split or a leaf is hung on. When
a batch is full its edges are expanded to one row per depth with the batch's counts, and Spark adds
up the rows of all batches by the digest of the prefix. So what many conversations share (a common first turn, a
group of copies) leaves a task once per batch, not once per conversation.

Figures of subtrees need no walk over levels. A node is *owned* by its smallest member; the nodes a
conversation owns are a tail of its path, from depth ``d0`` on. A node's ``n_convs - 1`` are its members
that do not own it, so the summed savings of a subtree are, over its members, the text lengths between the
subtree's top and ``d0``: a second run of the tries, with each path cut before ``d0``, sums them. A childless
node is owned by one conversation, whose path carries it upward in the same run.

A path is cut into segments of ``SEGMENT`` turns, each a sequence of its own below the digest of all turns before it,
so that no array, batch or group grows with the longest conversation; positions are counted in cells of ``CELL`` turn numbers.
Texts leave their task as digests and lengths only. The list of ids behind ``ends_sha256`` is one stream of bytes by its
definition: it is sorted by Spark in blocks and hashed while it streams, never held.

Defined results: rows of a null conversation id are not read. Null turns come first; turns of equal number
are ordered by the MD5 of role and text, repeated rows are turns each. Null roles and texts are empty ones. The remainder of a
negative id is SQL's, with the sign of the id. A conversation rebuilt without turns is a member of the root.
An empty table has no root. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import record_batch, written

#: Most turns of one segment; turn numbers of one cell (a power of two); turns in a batch's tries; ids in a block.
SEGMENT, CELL_BITS, BATCH_TURNS, BLOCK_BITS = 1024, 10, 200_000, 8
ROOT = bytes(16)

PARTIAL = pa.schema([("node", pa.binary()), ("up", pa.binary()), ("depth", pa.int64()), ("n", pa.int64()),
                     ("n_convs", pa.int64()), ("conv_id", pa.int64()), ("rest", pa.int64()), ("more", pa.bool_()),
                     ("ends", pa.list_(pa.int64()))])
PARTIAL_DDL = ("node binary, up binary, depth long, n long, n_convs long, conv_id long, rest long, more boolean, "
               "ends array<long>")
SUMS = pa.schema([("node", pa.binary()), ("saved", pa.int64()), ("leaves", pa.int64())])


def two_fattest(low: int, high: int) -> int:
    """The number in (low, high] that the highest power of two divides."""
    return high & (-1 << ((low ^ high).bit_length() - 1))


class ZFastTrie:
    """Compacted tries over paths, each a list of prefix digests whose first one names the trie it belongs to."""

    def __init__(self, paths: list[list[bytes]]) -> None:
        self.paths = paths
        self.low: list[int] = []  # depth of the parent
        self.high: list[int] = []  # depth of the node
        self.of: list[int] = []  # a path that runs through the node
        self.up: list[int] = []
        self.handle: dict[bytes, int] = {}
        self.step: dict[bytes, int] = {}  # the first prefix on an edge to the node at its end
        self.roots: dict[bytes, int] = {}

    def _hash(self, node: int) -> None:
        path = self.paths[self.of[node]]
        self.handle[path[two_fattest(self.low[node], self.high[node])]] = node
        self.step[path[self.low[node] + 1]] = node

    def _new(self, up: int, low: int, high: int, k: int) -> int:
        self.low.append(low)
        self.high.append(high)
        self.of.append(k)
        self.up.append(up)
        node = len(self.up) - 1
        if high > low:
            self._hash(node)
        return node

    def exit_node(self, path: list[bytes], last: int, root: int) -> tuple[int, int | None]:
        """The deepest node that is a prefix of ``path[:last + 1]``; the node at whose edge the path leaves, if any."""
        low, high, best = 0, last, root
        while low < high:
            f = two_fattest(low, high)
            node = self.handle.get(path[f])
            if node is None:
                high = f - 1
                continue
            end = self.high[node]
            if end > last or path[end] != self.paths[self.of[node]][end]:
                return self.up[node], node
            low, best = end, node
        return best, self.step.get(path[low + 1]) if low < last else None

    def add(self, k: int, last: int) -> int:
        """Insert the first ``last`` turns of path ``k``; the node at which they end."""
        path = self.paths[k]
        root = self.roots.get(path[0])
        if root is None:
            root = self.roots[path[0]] = self._new(-1, 0, 0, k)
        best, child = self.exit_node(path, last, root)
        if self.high[best] == last:
            return best
        if child is None:
            return self._new(best, self.high[best], last, k)
        other, low, high = self.paths[self.of[child]], self.high[best] + 1, min(self.high[child], last)
        while low < high:  # how far they go together on this edge
            middle = (low + high + 1) // 2
            if other[middle] == path[middle]:
                low = middle
            else:
                high = middle - 1
        del self.handle[other[two_fattest(self.low[child], self.high[child])]]
        fork = self._new(best, self.low[child], low, self.of[child])
        self.low[child], self.up[child] = low, fork
        self._hash(child)
        return fork if low == last else self._new(fork, low, last, k)

    def upward(self) -> list[int]:
        """Nodes, children before parents."""
        return sorted(range(len(self.up)), key=self.high.__getitem__, reverse=True)


def prefix_digests(top: bytes, digests: list[bytes]) -> list[bytes]:
    """Digest of each prefix of a segment: of what names its top and of the turns so far."""
    out, state = [top], hashlib.md5()
    for digest in digests:
        state.update(digest)
        out.append(hashlib.md5(top + state.digest()).digest())
    return out


def batches_of_segments(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[list[tuple]]:
    """Rows as tuples, together about ``limit`` turns."""
    held, size = [], 0
    for batch in batches:
        for start in range(0, batch.num_rows, 500):
            for row in zip(*(c.to_pylist() for c in batch.slice(start, 500).columns), strict=True):
                held.append(row)
                size += len(row[-1]) + 1
                if size >= limit:
                    yield held
                    held, size = [], 0
    if held:
        yield held


def count_nodes(rows: list[tuple], segment: int) -> pa.RecordBatch:
    """The nodes of a batch of (conv_id, seg, top, after, last, digests, lens): members, smallest member, ends."""
    trie = ZFastTrie([prefix_digests(row[2], row[5]) for row in rows])
    ends: dict[int, list[int]] = {}
    for k, path in enumerate(trie.paths):
        ends.setdefault(trie.add(k, len(path) - 1), []).append(k)
    size = len(trie.up)
    members, least, more = [0] * size, [-1] * size, [False] * size
    out: list[tuple] = []
    for node in trie.upward():
        here = ends.get(node, ())
        members[node] += len(here)
        for k in here:
            more[node] |= not rows[k][4]
            if least[node] < 0 or rows[k][0] < rows[least[node]][0]:
                least[node] = k
        k, up = least[node], trie.up[node]
        conv_id, seg, _, after, _, _, lens = rows[k]
        listed = [rows[e][0] for e in here if rows[e][4]]
        path, high, rest = trie.paths[k], trie.high[node], after + sum(lens[trie.high[node]:])
        if up < 0:
            if seg == 0:
                out.append((path[0], None, 0, 0, members[node], conv_id, rest, more[node], listed))
            continue
        for d in range(high, trie.low[node], -1):
            rest += lens[d - 1]
            out.append((path[d], path[d - 1], seg * segment + d, lens[d - 1], members[node], conv_id, rest,
                        d < high or more[node], listed if d == high else []))
        members[up] += members[node]
        more[up] = True
        if least[up] < 0 or conv_id < rows[least[up]][0]:
            least[up] = k
    return record_batch(PARTIAL, *map(list, zip(*out, strict=True)))


def sum_nodes(rows: list[tuple], segment: int) -> pa.RecordBatch:
    """Savings and leaves at the nodes of (conv_id, seg, top, after, last, d0, rest0, leaf, digests, lens)."""
    trie = ZFastTrie([prefix_digests(row[2], row[-2]) for row in rows])
    ends: list[tuple[int, int, int, int]] = []  # node, members that do not own it, savings below it, leaves
    for k, (_, seg, _, after, _, first, rest, leaf, _, lens) in enumerate(rows):
        whole, start = len(lens), seg * segment
        shared = whole if first is None else min(whole, first - 1 - start)
        if shared > 0:
            below = 0 if first is not None and first <= start + whole else after - (rest or 0)
            ends.append((trie.add(k, shared), 1, below, 0))
        if leaf:
            ends.append((trie.add(k, whole), 0, 0, 1))
    size = len(trie.up)
    others, saved, leaves = [0] * size, [0] * size, [0] * size
    for node, other, below, leaf in ends:
        others[node] += other
        saved[node] += below
        leaves[node] += leaf
    out: list[tuple] = []
    for node in trie.upward():
        path, lens, up = trie.paths[trie.of[node]], rows[trie.of[node]][-1], trie.up[node]
        if up < 0:
            if rows[trie.of[node]][1] == 0:
                out.append((path[0], saved[node], leaves[node]))
            continue
        total = saved[node]
        for d in range(trie.high[node], trie.low[node], -1):
            total += lens[d - 1] * others[node]
            out.append((path[d], total, leaves[node]))
        saved[up] += total
        others[up] += others[node]
        leaves[up] += leaves[node]
    return record_batch(SUMS, *(map(list, zip(*out, strict=True)) if out else ([], [], [])))


def turn_rows(conversations: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    """Per turn: conversation, order, digest of role and text, code points; no texts."""
    role, text = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    return conversations.where(F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("c"), F.col(turn).isNotNull().alias("has"),
        F.coalesce(F.col(turn).cast("long"), F.lit(0)).alias("turn"),
        F.unhex(F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))).alias("digest"),
        F.char_length(text).cast("long").alias("n"))


def rebuilt(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role",
            text: str = "text", every: int = 100, heads: int = 6) -> DataFrame:
    """Rows (c, d, digest, n) of the rebuilt conversations; ``d = 0`` once for each conversation.

    The first turns of conversation ``c - c % every``, their number a checksum of ``c`` below ``heads``, then the own rest.
    """
    rows = written(turn_rows(conversations, key, turn, role, text).withColumn("cell", F.shiftright("turn", CELL_BITS)),
                   "turns")
    cells = rows.groupBy("c", "has", "cell").agg(F.count("*").alias("size"))
    in_order = Window.partitionBy("c").orderBy("has", "cell")
    cells = cells.select("c", "has", "cell", F.coalesce(F.sum("size").over(
        in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = rows.withColumn("inner", F.row_number().over(Window.partitionBy("c", "has", "cell").orderBy("turn", "digest")))
    placed = written(own.join(cells, ["c", "has", "cell"]).select(
        "c", (F.col("before") + F.col("inner")).alias("pos"), "digest", "n"), "placed")
    sizes = rows.groupBy("c").agg(F.count("*").alias("size"))
    starts = sizes.where(F.col("c") % every == 0).select(F.col("c").alias("host"), F.col("size").alias("of_host"))
    heads_of = written(sizes.select("c", (F.col("c") - F.col("c") % every).alias("host"),
                                    (F.crc32(F.col("c").cast("string")) % heads).alias("h"))
                       .join(starts, "host", "left")
                       .withColumn("taken", F.least("h", F.coalesce("of_host", F.lit(0)))), "heads")
    first = placed.where((F.col("c") % every == 0) & (F.col("pos") < heads)).withColumnRenamed("c", "host")
    return (placed.join(heads_of.select("c", "h", "taken"), "c").where("pos > h")
            .select("c", (F.col("pos") - F.col("h") + F.col("taken")).alias("d"), "digest", "n")
            .unionByName(first.join(heads_of.select("c", "host", "h"), "host").where("pos <= h")
                         .select("c", F.col("pos").alias("d"), "digest", "n"))
            .unionByName(heads_of.select("c", F.lit(0).cast("long").alias("d"), F.lit(None).cast("binary").alias("digest"),
                                         F.lit(0).cast("long").alias("n"))))


def segments(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(c, seg, top, after, last, digests, lens) of sequences given as rows (c, d, digest, n).

    ``top`` names all turns before the segment, ``after`` is the text length behind it.
    """
    parts = rows.withColumn("seg", F.floor((F.greatest("d", F.lit(1)) - 1) / segment).cast("long")).groupBy("c", "seg").agg(
        F.sort_array(F.collect_list(F.struct("d", "digest", "n"))).alias("turns"))
    parts = written(parts.select("c", "seg", F.filter("turns", lambda x: x.d > 0).alias("turns")).select(
        "c", "seg", F.col("turns.digest").alias("digests"), F.col("turns.n").alias("lens")), "segments")
    long = parts.where("seg > 0").select("c").distinct()
    cut = parts.join(long, "c", "left_semi").select(
        "c", "seg", F.md5(F.unhex(F.array_join(F.transform("digests", F.hex), ""))).alias("md5"),
        F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))

    def chain(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("seg")
        tops, top = [], ROOT
        for digest in group["md5"]:
            tops.append(top)
            top = hashlib.md5(top + bytes.fromhex(digest)).digest()
        after = group["n"].sum() - group["n"].cumsum()
        return pd.DataFrame({"c": group["c"], "seg": group["seg"], "top": tops, "after": after,
                             "last": group["seg"] == group["seg"].max()})

    chained = cut.groupBy("c").applyInPandas(chain, "c long, seg long, top binary, after long, last boolean")
    return parts.join(chained, ["c", "seg"], "left").select(
        "c", "seg", F.coalesce("top", F.lit(ROOT)).alias("top"), F.coalesce("after", F.lit(0)).alias("after"),
        F.coalesce("last", F.lit(True)).alias("last"), "digests", "lens")


def end_digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of each node's ids in order, joined by commas: sorted blocks, hashed as they stream by."""
    blocks = ends.groupBy("node", F.shiftright("c", BLOCK_BITS).alias("block")).agg(
        F.array_join(F.sort_array(F.collect_list("c")), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("node", pa.binary()), ("ends_sha256", pa.string())])
        node, state = None, None
        for batch in batches:
            nodes, digests = [], []
            for now, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if now != node:
                    if state is not None:
                        nodes.append(node)
                        digests.append(state.hexdigest())
                    node, state = now, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield record_batch(schema, nodes, digests)
        if state is not None:
            yield record_batch(schema, [node], [state.hexdigest()])

    return blocks.repartition("node").sortWithinPartitions("node", "block").select("node", "ids").mapInArrow(
        run, "node binary, ends_sha256 string")


def prefix_nodes(sequences: DataFrame, segment: int = SEGMENT, batch_turns: int = BATCH_TURNS) -> DataFrame:
    """One row per distinct prefix of sequences given as rows (c, d, digest, n), ``d = 0`` once for each."""
    parts = written(segments(sequences, segment), "paths")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches_of_segments(batches, batch_turns):
            yield count_nodes(rows, segment)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches_of_segments(batches, batch_turns):
            yield sum_nodes(rows, segment)

    partial = written(parts.mapInArrow(count, PARTIAL_DDL), "batches")
    nodes = written(partial.groupBy("node", "up", "depth", "n").agg(
        F.sum("n_convs").alias("n_convs"), F.min(F.struct("conv_id", "rest")).alias("least"),
        F.max("more").alias("more")).select("node", "up", "depth", "n", "n_convs", "least.*", "more"), "nodes")
    owned = nodes.groupBy(F.col("conv_id").alias("c")).agg(
        F.min(F.struct("depth", "rest")).alias("first"), F.max(F.struct("depth", "more")).alias("end"))
    owned = owned.select("c", F.col("first.depth").alias("d0"), F.col("first.rest").alias("rest0"),
                         (~F.col("end.more")).alias("leaf"))
    sums = parts.join(owned, "c", "left").select("c", "seg", "top", "after", "last", "d0", "rest0", "leaf", "digests", "lens") \
        .mapInArrow(add_up, "node binary, saved long, leaves long")
    ends = end_digests(partial.select("node", F.explode("ends").alias("c")))
    none = F.lit(0).cast("long")
    facts = sums.select("node", "saved", "leaves", none.alias("children"), F.lit(None).cast("string").alias("ends_sha256")) \
        .unionByName(nodes.where("up IS NOT NULL").select(F.col("up").alias("node"), none.alias("saved"), none.alias("leaves"),
                                                          F.lit(1).cast("long").alias("children"),
                                                          F.lit(None).cast("string").alias("ends_sha256"))) \
        .unionByName(ends.select("node", none.alias("saved"), none.alias("leaves"), none.alias("children"), "ends_sha256")) \
        .groupBy("node").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"),
                             F.sum("children").alias("children"), F.max("ends_sha256").alias("ends_sha256"))
    above = nodes.select(F.col("node").alias("up"), F.col("conv_id").alias("parent_conv_id"))
    return nodes.join(facts, "node", "left").join(above, "up", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("children", F.lit(0)).alias("n_children"),
        F.coalesce("leaves", F.lit(0)).alias("n_leaves"), F.coalesce("saved", F.lit(0)).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame, **columns: str) -> DataFrame:
    """The prefix nodes of all rebuilt conversations; ``columns``: names for ``key``, ``turn``, ``role``, ``text``."""
    return prefix_nodes(rebuilt(conversations, **columns))

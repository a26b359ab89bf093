"""Operator 12, cross-tokenizer alignment by pointer jumping.

Two tokenizations of one text are two rows of byte ranges. Every token points to the farthest-right
token that overlaps it: the token of the other row that holds its last byte, if that ends later; where both
end together, to the first row's token, which is terminal. Doubling the pointers of all tokens of a chunk at
once, ``next = next[next]``, ends after a logarithm of the longest chain; the terminal token a token has reached is the
label of its group. Documents of a chunk lie side by side: they end in both rows, so none reaches into the next.

Each stretch between neighbouring token ends lies in one token of either row: these stretches are the links. In how many
documents a pair of ids is linked is counted per chunk first and then by Spark. A chunk asks for the counts of its own
distinct pairs only, by a join on the pair; AQE splits that of a pair which all chunks ask for. The highest count of an id
of the first vocabulary is a table of at most that vocabulary's size, which is why it may be broadcast.

Defined results: null and empty texts, and texts that one of the tokenizers does not give back byte by byte (a text
with U+2581, for instance), have no tokens: zeros and an empty string. Strings of special tokens are plain text. Repeated rows count as documents each.
Null ids stay null. A text of any length is aligned whole. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm import packing
from tallyspark.llm.common import chunks, record_batch, written

#: Bytes of text aligned at once.
CHUNK = 512 << 10
WIDTH = 1 << 20  # ids of the second vocabulary lie below

NUMBERS = ("n_a", "n_b", "n_groups", "n_links")
OUT_COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
CHUNK_SCHEMA = pa.schema([("chunk", pa.int64()), ("pairs", pa.list_(pa.int64())), ("docs", pa.list_(pa.int64())),
                          ("ids", pa.list_(pa.int64())), *((n, pa.list_(pa.int64())) for n in NUMBERS),
                          ("digests", pa.list_(pa.string())), ("links", pa.binary())])
CHUNK_DDL = ("chunk long, pairs array<long>, docs array<long>, ids array<long>, n_a array<long>, n_b array<long>, "
             "n_groups array<long>, n_links array<long>, digests array<string>, links binary")
OUT = pa.schema([(n, pa.string() if n == "groups_sha256" else pa.int64()) for n in OUT_COLUMNS])
OUT_DDL = ", ".join(f"{n} {'string' if n == 'groups_sha256' else 'long'}" for n in OUT_COLUMNS)


class Tokens:
    """Ids and token bytes of both tokenizers: a byte-level BPE file and a SentencePiece model."""

    def __init__(self, bpe_path: str, piece_path: str) -> None:
        self.bpe = packing.load(bpe_path).coder
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        ranks = self.bpe._mergeable_ranks
        self.bytes_a = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.bytes_a[i] = token
        self.bytes_b = [self._piece(i) for i in range(self.pieces.get_piece_size())]
        self.size_a, self.size_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        # decimal ids with what stands behind them in a group's text: first row within and at the end of a group, second row
        self.written = [f"{i}{mark}".encode() for t, marks in ((self.bytes_a, ",|"), (self.bytes_b, ",;"))
                        for mark in marks for i in range(len(t))]

    def _piece(self, i: int) -> bytes:
        piece = self.pieces.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.pieces.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        none = np.zeros(0, np.int64)
        if not text:
            return none, none
        whole, a, b = (" " + text).encode(), self.bpe.encode_ordinary(" " + text), self.pieces.encode(text)
        same = b"".join(map(self.bytes_a.__getitem__, a)) == whole == b"".join(map(self.bytes_b.__getitem__, b))
        return (np.array(a, np.int64), np.array(b, np.int64)) if same else (none, none)


def group_labels(ends_a: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
    """The terminal token (an index into the first row) of each token of the first row, then of the second."""
    n = len(ends_a)
    over, under = np.searchsorted(ends_b, ends_a), np.searchsorted(ends_a, ends_b)
    following = np.concatenate([np.where(ends_b[over] > ends_a, n + over, np.arange(n)), under])
    while True:
        further = following[following]
        if np.array_equal(further, following):
            return following
        following = further


def counts_by(index: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(index, minlength=n).astype(np.int64)


def link_type(n_pairs: int) -> str:
    return "<u2" if n_pairs <= 1 << 16 else "<u4"


def align_chunk(tokens: Tokens, ids: list, texts: list[str | None], chunk: int) -> pa.RecordBatch:
    """One row: the chunk's distinct linked pairs with their number of documents, and what its documents need later."""
    encoded = [tokens.encode(t) for t in texts]
    n_docs = len(encoded)
    n_a, n_b = (np.array([len(e[k]) for e in encoded], np.int64) for k in (0, 1))
    a, b = (np.concatenate([e[k] for e in encoded]) for k in (0, 1))
    del encoded
    doc_a, doc_b = np.repeat(np.arange(n_docs), n_a), np.repeat(np.arange(n_docs), n_b)
    n_groups = np.zeros(n_docs, np.int64)
    digests = [""] * n_docs
    links = pairs = docs = np.zeros(0, np.int64)
    n_links = np.zeros(n_docs, np.int64)
    if len(a):
        ends_a, ends_b = np.cumsum(tokens.size_a[a]), np.cumsum(tokens.size_b[b])
        label = group_labels(ends_a, ends_b)
        terminal = label[:len(a)] == np.arange(len(a))
        rank = np.cumsum(terminal) - 1
        group_a, group_b = rank[label[:len(a)]], rank[label[len(a):]]
        n_groups = counts_by(doc_a[terminal], n_docs)
        # the groups' text: ids of the first row, then of the second, group by group
        of_a, of_b = np.cumsum(counts_by(group_a, rank[-1] + 1)), np.cumsum(counts_by(group_b, rank[-1] + 1))
        last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        last_a[of_a - 1] = last_b[of_b - 1] = True
        codes = np.empty(len(a) + len(b), np.int64)
        codes[np.arange(len(a)) + np.r_[0, of_b][group_a]] = a + len(tokens.bytes_a) * last_a
        codes[np.arange(len(b)) + of_a[group_b]] = 2 * len(tokens.bytes_a) + b + len(tokens.bytes_b) * last_b
        stops = np.cumsum(n_a + n_b).tolist()
        for k, (start, stop) in enumerate(zip([0, *stops], stops)):
            if stop > start:
                digests[k] = hashlib.sha256(b"".join(map(tokens.written.__getitem__, codes[start:stop].tolist()))[:-1]).hexdigest()
        del codes, label, group_a, group_b
        ends = np.union1d(ends_a, ends_b)
        at_a, at_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
        pairs, links = np.unique(a[at_a] * WIDTH + b[at_b], return_inverse=True)
        doc = doc_a[at_a]
        n_links = counts_by(doc, n_docs)
        once = np.unique(doc * len(pairs) + links)  # a document counts a pair once
        docs = counts_by(once % len(pairs), len(pairs))
    packed = zstandard.ZstdCompressor(level=1).compress(links.astype(link_type(len(pairs))).tobytes())
    return record_batch(CHUNK_SCHEMA, [chunk], [pairs], [docs], [ids], [n_a], [n_b], [n_groups], [n_links], [digests], [packed])


def finish_chunk(row: dict) -> pa.RecordBatch:
    """The documents of a chunk whose pairs have their corpus-wide counts."""
    n_links = np.array(row["n_links"], np.int64)
    links = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["links"]), link_type(len(row["pairs"])))
    count, best = np.zeros(len(row["pairs"]), np.int64), np.zeros(len(row["pairs"]), np.int64)
    at = np.array(row["at"] or [], np.int64)
    count[at], best[at] = row["count"] or [], row["best"] or []
    doc = np.repeat(np.arange(len(n_links)), n_links)
    sums = [np.zeros(len(n_links), np.int64) for _ in range(2)]
    for total, value in zip(sums, (best, count), strict=True):
        np.add.at(total, doc, value[links])
    return record_batch(OUT, row["ids"], *(row[n] for n in NUMBERS), *sums, row["digests"])


_LOADED: dict[tuple[str, str], Tokens] = {}


def load(bpe_path: str, piece_path: str) -> Tokens:
    if (bpe_path, piece_path) not in _LOADED:
        _LOADED[bpe_path, piece_path] = Tokens(bpe_path, piece_path)
    return _LOADED[bpe_path, piece_path]


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, a, count, best) of all linked id pairs; ``best``: no pair of ``a`` is in more documents."""
    counts = written(aligned.select(F.explode(F.arrays_zip("pairs", "docs")).alias("x"))
                     .groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.docs").alias("count"))
                     .withColumn("a", F.floor(F.col("pair") / WIDTH).cast("long")), "pairs")
    highest = counts.groupBy("a").agg(F.max("count").alias("highest"))  # a row per id of the first vocabulary at most
    return counts.join(F.broadcast(highest), "a").select("pair", "a", "count", (F.col("count") == F.col("highest")).alias("best"))


def align_documents(docs: DataFrame, bpe_path: str, piece_path: str, key: str = "doc_id", text: str = "text",
                    chunk_bytes: int = CHUNK) -> DataFrame:
    """Per document: tokens, groups and links, and how the links rank in the whole corpus."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, base = load(bpe_path, piece_path), TaskContext.get().partitionId() << 32
        for k, (ids, texts) in enumerate(chunks(batches, chunk_bytes)):
            yield align_chunk(tokens, ids, texts, base + k)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield finish_chunk(batch.slice(k, 1).to_pylist()[0])

    aligned = written(docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
                      .mapInArrow(align, CHUNK_DDL), "aligned")
    counts = pair_counts(aligned).select("pair", "count", F.col("best").cast("long").alias("best"))
    asked = aligned.select("chunk", F.posexplode("pairs").alias("at", "pair")).join(counts, "pair")
    answers = asked.groupBy("chunk").agg(F.collect_list(F.struct("at", "count", "best")).alias("x")).select(
        "chunk", *(F.col(f"x.{n}").cast("array<long>").alias(n) for n in ("at", "count", "best")))
    return aligned.drop("docs").join(answers, "chunk", "left").mapInArrow(finish, OUT_DDL)

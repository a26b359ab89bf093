"""Operator 3, packing: order-preserving dynamic programming over window cuts.

Documents are tokenized, ended with ``END_ID`` and laid side by side in the order in which a task reads
them. Cuts may fall behind a document or behind a sentence (a token that ends in ``.``, ``!``, ``?``
or a line break); where no such place lies within a window's reach, at multiples of the window. A cut
inside a document costs ``CUT_PENALTY`` tokens, inside a sentence ``SPLIT_PENALTY``. The programme
minimises padding plus penalties: the best cut before a place is the least value of a window that slides along,
kept in a monotone queue; sequences whose length is a power of two need no padding and are looked up
one by one.

A task's rows are one shard; nothing is shuffled and memory is bounded, because the programme works
on stretches of ``STRETCH`` tokens and carries the last, unfinished windows on. Sequence ids hold
the shard's number in their upper bits. A shard's rest is cut into powers of two when that is cheaper
than padding.

Defined results: an added token of the vocabulary file (``<|endoftext|>``) is its one id. Null and empty texts are the end id alone. Repeated rows are packed each. A text
of any length is packed whole. Null ids stay null. Other columns are not read.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import chunks, record_batch

WINDOW = 2048
END_ID = 1
CUT_PENALTY = 6
SPLIT_PENALTY = 40
STRETCH = 200_000

OUT_DDL = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
OUT = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
                                           "offset")])
#: Fixed value: how the byte-level tokenizer splits a text before it merges bytes.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary file, by its rule."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoder:
    """Ids of whole texts.

    The vocabulary is that of a ``tokenizers`` file; ``tiktoken`` merges it, which gives the same ids in
    about a sixth of the time. ``whole_ids`` gives the file's added tokens their one id wherever a text holds
    them, as the library does; for ``ids`` they are ordinary text.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        letters = byte_letters()
        if odd := [t["content"] for t in model["added_tokens"]
                   if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]]:
            raise ValueError(f"added tokens that are not matched as plain strings: {odd}")
        special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.added = special
        self.at_added = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") \
            if special else None
        ranks = {bytes(letters[c] for c in piece): i for piece, i in model["model"]["vocab"].items()
                 if piece not in special}
        self.coder = tiktoken.Encoding("byte-level", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.ends = np.zeros(max([*ranks.values(), *special.values()]) + 1, bool)
        for piece, i in ranks.items():
            self.ends[i] = piece.endswith((b".", b"!", b"?", b"\n"))

    def ids(self, text: str | None) -> np.ndarray:
        """The ids of the whole text, then the end id."""
        found = self.coder.encode_ordinary(text) if text else []
        found.append(END_ID)
        return np.array(found, "<u4")

    def whole_ids(self, text: str | None) -> np.ndarray:
        """The ids of the whole text with added tokens as one id each, then the end id."""
        if not text or not self.at_added or not self.at_added.search(text):
            return self.ids(text)
        found: list[int] = []
        for part in self.at_added.split(text):
            if part in self.added:
                found.append(self.added[part])
            elif part:
                found += self.coder.encode_ordinary(part)
        found.append(END_ID)
        return np.array(found, "<u4")


def cut(places: np.ndarray, costs: np.ndarray, window: int = WINDOW) -> list[int]:
    """Indexes of ``places`` (rising token positions, the first one 0, no gap over ``window``) to cut at.

    Cuts from the first to the last place so that padding plus the costs of the cuts is least.
    """
    at, cost, n = places.tolist(), costs.tolist(), len(places)
    exact: list[list[int]] = [[] for _ in range(n)]
    size = 1
    index = np.full(at[-1] + 1, -1, np.int32)
    index[places] = np.arange(n)
    while size <= window:  # earlier places a power of two away
        here = np.flatnonzero(places >= size)
        before = index[places[here] - size]
        for j, i in zip(here[before >= 0].tolist(), before[before >= 0].tolist(), strict=True):
            exact[j].append(i)
        size *= 2
    best, back = [0.0] * n, [0] * n
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])  # rising values of best + place, oldest first
    for j in range(1, n):
        p = at[j]
        low = p - window
        while at[queue[0][1]] < low:
            queue.popleft()
        value, i = queue[0][0] + window - p, queue[0][1]
        for k in exact[j]:
            if best[k] < value:
                value, i = best[k], k
        value += cost[j]
        best[j], back[j] = value, i
        key = value + p
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    out, j = [], n - 1
    while j:
        out.append(j)
        j = back[j]
    return out[::-1]


def cut_places(ends: list[np.ndarray], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Cut places and costs of documents laid side by side; ``ends``: per document, which ids end a sentence."""
    lengths = np.fromiter(map(len, ends), np.int64, len(ends))
    total = int(lengths.sum())
    cost = np.zeros(total + 1, np.float32)
    sentence = np.flatnonzero(np.concatenate(ends)) + 1
    allowed = np.zeros(total + 1, bool)
    allowed[sentence] = True
    cost[sentence] = CUT_PENALTY
    whole = np.cumsum(lengths)
    allowed[0] = allowed[whole] = True
    cost[whole] = 0
    places = np.flatnonzero(allowed)
    wide = np.flatnonzero(np.diff(places) > window // 2)
    if len(wide):  # long stretches without a sentence end: finer places inside them, dearer
        extra = np.concatenate([np.arange(places[k] + window // 2, places[k + 1], window // 2) for k in wide])
        allowed[extra] = True
        cost[extra] = SPLIT_PENALTY
        places = np.flatnonzero(allowed)
    return places, cost[places]


def shard_pieces(docs: Iterator[tuple[int | None, np.ndarray]], ends: np.ndarray, shard: int,
                 window: int = WINDOW, stretch: int = STRETCH) -> Iterator[tuple]:
    """Pieces of one shard's documents, in order."""
    held: list[list] = []  # doc id, ids not yet packed, start of them, all ids of the document
    waiting, sequence = 0, shard << 40

    def pack(last: bool) -> Iterator[tuple]:
        nonlocal held, waiting, sequence
        places, costs = cut_places([ends[np.minimum(ids, len(ends) - 1)] for _, ids, _, _ in held], window)
        stops = places[cut(places, costs, window)].tolist()
        if not last:  # the last windows may still change
            stops = [s for s in stops if s <= waiting - 4 * window]
        k, begun = 0, 0
        for stop in stops:
            offset = 0
            while begun < stop:
                doc, ids, start, total = held[k]
                take = min(len(ids), stop - begun)
                yield doc, start, take, zlib.crc32(ids[:take].tobytes()), total, sequence, offset
                offset += take
                begun += take
                if take == len(ids):
                    k += 1
                else:
                    held[k] = [doc, ids[take:], start + take, total]
            sequence += 1
        held, waiting = held[k:], waiting - begun

    for doc, ids in docs:
        for at in range(0, len(ids), stretch):
            held.append([doc, ids[at:at + stretch], at, len(ids)])
            waiting += len(held[-1][1])
            if waiting >= stretch:
                yield from pack(False)
    if held:
        yield from pack(True)


_LOADED: dict[str, Encoder] = {}


def load(path: str) -> Encoder:
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


def pack_documents(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: where it lies in its document and in which sequence, at which offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load(tokenizer_path)
        shard = TaskContext.get().partitionId()
        stream = ((i, encoder.whole_ids(t)) for ids, texts in chunks(batches) for i, t in zip(ids, texts, strict=True))
        rows: list[tuple] = []
        for piece in shard_pieces(stream, encoder.ends, shard):
            rows.append(piece)
            if len(rows) >= 20_000:
                yield record_batch(OUT, *map(list, zip(*rows, strict=True)))
                rows = []
        if rows:
            yield record_batch(OUT, *map(list, zip(*rows, strict=True)))

    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, OUT_DDL)

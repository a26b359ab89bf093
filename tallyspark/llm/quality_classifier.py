"""Operator 11, quality classifier: supervised subword embeddings.

Features of a text are its words ``[^\\x20\\x09-\\x0D]+``, the byte n-grams of ``<word>`` and its pairs of neighbouring words (all
pairs of a word with itself are one feature), each hashed to one of
``2 ** BUCKET_BITS`` vectors. A document is the mean of its features' vectors, a softmax layer on it
gives the labels' probabilities; vectors and layer are learned together by stochastic gradient descent in numpy.
The layer is linear, so the mean of the vectors' products with it is the product with the mean: scoring needs one
number per label and feature, summed per word once and kept in a bounded cache of words.

Training takes at most ``TRAIN_PER_LABEL`` labelled documents per label, those whose hashed ids are least; a training
document is its counts by bucket, made by the executors from the whole text and never longer than the number of buckets, and at most
``TRAIN_FEATURES`` of such counts in all, shared out to the labels, are taken (documented bounds; one document of each label always fits).
Labels are equally frequent in training; their real shares, counted over all labelled rows, are put back when scoring. The model has a fixed size and is broadcast.

Defined results: null, empty and blank texts have no features and get the shares of the labels. Without any
label every score is 0.5. Rows labelled null are not used; a repeated label row counts once, a document with two labels is an
example of each, of texts that share an id the least one is taken for training. Null ids are never held out. Repeated rows are scored each. Whole texts are read,
columns of other names are not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import CACHE_ENTRIES, chunks, id_and_bytes, record_batch, words_of, written

BUCKET_BITS = 16
GRAMS = (3, 4, 5)
DIMENSIONS = 8
TRAIN_PER_LABEL = 1_000
TRAIN_FEATURES = 6_000_000
MAX_LABELS = 100
EPOCHS, RATE, SEED = 5, 1.0, 7
#: Features of a zero vector that every document has besides its own, so that a few words decide little.
SMOOTH = 20
#: Bytes of words hashed at once; a longer word is hashed alone.
HASH_BYTES = 256 << 10

BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse
MIX = np.uint64(0xFF51AFD7ED558CCD)
OUT = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


class Hasher:
    """Buckets of words, of the n-grams in them and of word pairs; hashes of byte ranges are differences of one running sum."""

    def __init__(self) -> None:
        self._powers(1 << 12)

    def _powers(self, n: int) -> None:
        self.up, self.down = (np.cumprod(np.r_[np.uint64(1), np.full(n, x, np.uint64)]) for x in (BASE, pow(BASE, -1, 1 << 64)))

    def words(self, words: list[bytes]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """The words' hashes; (index of the word, bucket) of the features in them, in one part per kind."""
        raw = np.frombuffer(b"<" + b"><".join(words) + b">", np.uint8)
        if len(raw) >= len(self.up):
            self._powers(2 * len(raw))
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
        ends = np.cumsum(lengths)
        total = np.r_[np.uint64(0), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.up[:len(raw)])]
        word = np.repeat(np.arange(len(words)), lengths)
        starts = ends - lengths
        hashes = mixed((total[ends] - total[starts]) * self.down[starts], 1)
        parts = [(np.arange(len(words)), bucket(hashes))]
        for n in GRAMS:
            at = np.arange(len(raw) - n + 1)
            at = at[at + n <= ends[word[at]]]
            parts.append((word[at], bucket(mixed((total[at + n] - total[at]) * self.down[at], 2))))
        return hashes, parts


def mixed(h: np.ndarray, kind: int) -> np.ndarray:
    h = h + np.uint64(kind)
    h ^= h >> np.uint64(32)
    h *= MIX
    return h ^ (h >> np.uint64(29))


def bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def pair_buckets(hashes: np.ndarray) -> np.ndarray:
    """Bucket of each pair of neighbours in a row of word hashes; a word and itself are the same feature for all words."""
    first, second = hashes[:-1], hashes[1:]
    return bucket(mixed(np.where(first == second, np.uint64(0), first * np.uint64(BASE) + second), 3))


def word_lots(words: list[bytes]) -> Iterator[list[bytes]]:
    """Consecutive words that hold about ``HASH_BYTES`` together."""
    lot, size = [], 0
    for word in words:
        lot.append(word)
        size += len(word) + 2
        if size >= HASH_BYTES:
            yield lot
            lot, size = [], 0
    if lot:
        yield lot


def bucket_counts(hasher: Hasher, text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a whole text and how many of its features fall into each."""
    counts = np.zeros(1 << BUCKET_BITS, np.int64)
    last = np.zeros(0, np.uint64)
    for lot in word_lots(words_of(text)):
        hashes, parts = hasher.words(lot)
        hashes = np.r_[last, hashes]
        for buckets in [pair_buckets(hashes), *(b for _, b in parts)]:
            counts += np.bincount(buckets, minlength=len(counts))
        last = hashes[-1:]
    found = np.flatnonzero(counts)
    return found.astype(np.int32), counts[found]


class Model:
    """Labels in order, feature values per label but the first (whose values are zero), logarithms of the labels' shares."""

    def __init__(self, labels: list[int], values: np.ndarray, prior: np.ndarray) -> None:
        self.labels, self.values, self.prior = labels, values, prior

    def probabilities(self, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Rows of label probabilities from summed feature values and numbers of features."""
        logits = np.zeros((len(counts), len(self.labels)))
        logits[:, 1:] = sums / (counts + SMOOTH)[:, None]
        logits += self.prior
        logits = np.exp(logits - logits.max(axis=1, keepdims=True))
        return logits / logits.sum(axis=1, keepdims=True)


def train(examples: list[tuple[int, np.ndarray, np.ndarray]], shares: dict[int, int], epochs: int = EPOCHS,
          rate: float = RATE, seed: int = SEED) -> Model:
    """Model of (label, buckets, counts) examples; ``shares``: how many rows have each label."""
    labels = sorted(shares)
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (1 << BUCKET_BITS, DIMENSIONS)).astype(np.float32)
    layer = np.zeros((DIMENSIONS, len(labels)), np.float32)
    per_label = {label: [k for k, e in enumerate(examples) if e[0] == label and len(e[1])] for label in labels}
    each = max(map(len, per_label.values()), default=0)
    data = [(labels.index(label), buckets, (counts / (counts.sum() + SMOOTH)).astype(np.float32))
            for label, buckets, counts in examples]
    for epoch in range(epochs):  # rarer labels are taken repeatedly
        order = rng.permutation([k for ks in per_label.values() if ks for k in rng.permutation(np.resize(ks, each))])
        step = rate * (1 - epoch / epochs)
        for k in order:
            label, buckets, weights = data[k]
            x = vectors[buckets]
            mean = weights @ x
            p = mean @ layer
            p = np.exp(p - p.max())
            p /= p.sum()
            p[label] -= 1
            back = layer @ p
            layer -= step * np.outer(mean, p)
            # a feature has only its share of the mean: without the root, long texts would hardly move theirs
            vectors[buckets] = x - step * len(weights) ** 0.5 * np.outer(weights, back)
    values = (vectors @ layer).astype(np.float64)
    return Model(labels, values[:, 1:] - values[:, :1], np.log([shares[label] for label in labels]))


class Scorer:
    """A model at work in one task; remembers what a word adds, in bounded memory."""

    def __init__(self, model: Model) -> None:
        self.model, self.hasher = model, Hasher()
        self._forget()

    def _forget(self) -> None:
        self.at: dict[bytes, int] = {}
        self.hashes = np.zeros(0, np.uint64)
        self.counts = np.zeros(0, np.int64)
        self.values = np.zeros((0, self.model.values.shape[1]))

    def _learn(self, words: list[bytes]) -> None:
        hashes, counts, values = [self.hashes], [self.counts], [self.values]
        for lot in word_lots(words):
            found, parts = self.hasher.words(lot)
            hashes.append(found)
            counts.append(sum(np.bincount(w, minlength=len(lot)) for w, _ in parts))
            values.append(np.stack([sum(np.bincount(w, weights=column[b], minlength=len(lot)) for w, b in parts)
                                    for column in self.model.values.T], axis=1))
        self.at.update(zip(words, range(len(self.at), len(self.at) + len(words)), strict=True))
        self.hashes, self.counts, self.values = np.concatenate(hashes), np.concatenate(counts), np.concatenate(values)

    def probabilities(self, texts: list[bytes | None]) -> np.ndarray:
        """Rows of label probabilities of whole texts."""
        n, words = len(texts), [words_of(t) for t in texts]
        if self.model.values.shape[1] == 0:
            return self.model.probabilities(np.zeros((n, 0)), np.zeros(n))
        if len(self.at) > CACHE_ENTRIES:
            self._forget()
        flat = [w for ws in words for w in ws]
        if new := list(dict.fromkeys(w for w in flat if w not in self.at)):
            self._learn(new)
        at = np.fromiter(map(self.at.__getitem__, flat), np.int64, len(flat))
        doc = np.repeat(np.arange(n), np.fromiter(map(len, words), np.int64, n))
        pairs = pair_buckets(self.hashes[at])
        inside = doc[1:] == doc[:-1]
        pairs, doc_of_pair = pairs[inside], doc[1:][inside]
        counts = np.bincount(doc, weights=self.counts[at], minlength=n) + np.bincount(doc_of_pair, minlength=n)
        sums = np.stack([np.bincount(doc, weights=self.values[at, k], minlength=n)
                         + np.bincount(doc_of_pair, weights=column[pairs], minlength=n)
                         for k, column in enumerate(self.model.values.T)], axis=1)
        return self.model.probabilities(sums, counts)


def training_ids(labels: DataFrame, key: str, label: str) -> tuple[dict[int, int], DataFrame]:
    """How many documents have each label; a table of at most ``TRAIN_PER_LABEL`` ids per label, least hashes first."""
    rows = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).select(
        F.col(key).cast("long").alias("id"), F.col(label).cast("int").alias("label")).distinct()
    rows = written(rows.withColumn("order", F.pmod(F.xxhash64(F.lit(SEED), "id"), F.lit(1 << 30))), "labelled")
    shares = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).limit(MAX_LABELS + 1).collect()}
    if len(shares) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} labels")
    # about a third more than wanted, so that no group grows with the table
    bound = F.create_map(*[F.lit(x) for k, n in (shares or {0: 1}).items()
                           for x in (k, int(min(1.0, (1.35 * TRAIN_PER_LABEL + 50) / n) * (1 << 30)))])
    top = rows.where(F.col("order") < bound[F.col("label")]).groupBy("label").agg(
        F.slice(F.array_sort(F.collect_list(F.struct("order", "id"))), 1, TRAIN_PER_LABEL).alias("x"))
    return shares, top.select("label", F.explode("x").alias("x")).select("label", "x.order", "x.id")


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """A model of the labelled documents' texts, from a bounded sample of them."""
    shares, ids = training_ids(labels, key, label)
    if not shares:
        return Model([], np.zeros((1 << BUCKET_BITS, 0)), np.zeros(0))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        schema = pa.schema([("id", pa.int64()), ("label", pa.int32()), ("order", pa.int64()), ("buckets", pa.list_(pa.int32())),
                            ("counts", pa.list_(pa.int64()))])
        for batch in batches:
            for k in range(batch.num_rows):
                *row, content = (c[0].as_py() for c in batch.slice(k, 1).columns)
                buckets, counts = bucket_counts(hasher, content)
                yield record_batch(schema, *([x] for x in row), [buckets], [counts])

    chosen = id_and_bytes(docs, key, text).join(F.broadcast(ids), "id").groupBy("id", "label", "order").agg(
        F.min("text").alias("text"))
    rows = written(chosen.mapInArrow(count, "id long, label int, order long, buckets array<int>, counts array<long>"), "features")
    taken: dict[int, list[int]] = {}
    room = dict.fromkeys(shares, TRAIN_FEATURES // len(shares))
    for r in sorted(rows.select("label", "order", "id", F.size("buckets").alias("n")).collect()):
        if room[r.label] > 0:
            room[r.label] -= r.n
            taken.setdefault(r.label, []).append(r.id)
    pick = [F.col("label").eqNullSafe(k) & F.col("id").isin(v) for k, v in taken.items()]
    examples = []
    for k, part in enumerate(pick):
        table = rows.where(part).toArrow().sort_by([("order", "ascending"), ("id", "ascending")])
        for batch in table.to_batches():
            for at in range(batch.num_rows):
                examples.append((list(taken)[k], *(batch.column(c)[at].values.to_numpy() for c in (3, 4))))
    return train(examples, shares)


def score_documents(docs: DataFrame, model: Model, positive: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, probability of the label ``positive``, and whether it is 0.5 or more."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shipped.value)
        labels = scorer.model.labels
        for ids, texts in chunks(batches):
            if not labels:
                scores = np.full(len(ids), 0.5)
            elif positive in labels:
                scores = scorer.probabilities(texts)[:, labels.index(positive)]
            else:
                scores = np.zeros(len(ids))
            yield record_batch(OUT, ids, scores)

    return id_and_bytes(docs, key, text).withColumn("id", F.col("id").cast("long")).mapInArrow(
        run, "doc_id long, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))

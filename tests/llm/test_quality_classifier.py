"""Quality classifier: features against slow loops, whole scores against a plain rebuild, held-out accuracy."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tallyspark.llm import quality_classifier as qc
from tallyspark.llm.queries import op11_quality_classifier

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, quality int, score string, label string, id long"
LABELS = "doc_id long, quality int, text string, order long"


def slow_mix(h, kind):
    m = (1 << 64) - 1
    h = (h + kind) & m
    h ^= h >> 32
    h = h * 0xFF51AFD7ED558CCD & m
    return h ^ (h >> 29)


def slow_hash(gram, kind):
    return slow_mix(sum((b + 1) * pow(qc.BASE, k, 1 << 64) for k, b in enumerate(gram)) % (1 << 64), kind)


def slow_features(text):
    words = (text or "").encode().split()
    out = Counter()
    for w in words:
        w = b"<" + w + b">"
        out[slow_hash(w, 1) >> 48] += 1
        for n in qc.GRAMS:
            for k in range(len(w) - n + 1):
                out[slow_hash(w[k:k + n], 2) >> 48] += 1
    for a, b in zip(words, words[1:]):
        a, b = (slow_hash(b"<" + w + b">", 1) for w in (a, b))
        out[slow_mix(0 if a == b else (a * qc.BASE + b) % (1 << 64), 3) >> 48] += 1
    return out


TEXTS = [None, "", " \t\n", "a", "a a a b b", "Hello, world! Hello", "é 日本 \x1c x", "word " * 50 + "x" * 3000]


@pytest.mark.parametrize("lot", [1, 40, 1 << 18])
def test_features(monkeypatch, lot):
    monkeypatch.setattr(qc, "HASH_BYTES", lot)
    hasher = qc.Hasher()
    for text in TEXTS:
        buckets, counts = qc.bucket_counts(hasher, text.encode() if text is not None else None)
        assert dict(zip(buckets.tolist(), counts.tolist())) == slow_features(text)


def test_scores_are_those_of_the_mean_vector(monkeypatch):
    rng = np.random.default_rng(2)
    model = qc.Model([0, 1, 5], rng.normal(size=(1 << qc.BUCKET_BITS, 2)) * 9, np.log([3, 4, 5]))
    for entries in (3, 100_000):
        monkeypatch.setattr(qc, "CACHE_ENTRIES", entries)
        scorer = qc.Scorer(model)
        for texts in (TEXTS, TEXTS[::-1], [], [None]):
            got = scorer.probabilities([t.encode() if t is not None else None for t in texts])
            assert got.shape == (len(texts), 3)
            for row, text in zip(got, texts, strict=True):
                features = slow_features(text)
                n = sum(features.values()) + qc.SMOOTH
                logits = [math.log(3), *(math.log(p) + sum(model.values[b, k] * c for b, c in features.items()) / n
                                         for k, p in enumerate((4, 5)))]
                want = np.exp(logits) / np.exp(logits).sum()
                assert np.allclose(row, want, rtol=1e-9)


def good_and_bad(rng, n):
    out = []
    for k in range(n):
        words = [rng.choice(["the", "and", "thing", "reason", "ofter", "lying"]) + rng.choice(["", "ing", ".", "er"])
                 for _ in range(rng.randrange(5, 60))]
        bad = k % 4 == 0
        out.append((k, " ".join(w + rng.choice(["$$$", "%%%"]) if bad else w for w in words), int(not bad)))
    return out


def test_learns_from_labels_only(spark):
    rows = good_and_bad(random.Random(1), 400)
    docs = spark.createDataFrame([(i, t, 1 - q, "x", "y", 3) for i, t, q in rows]
                                 + [(i, t, 0, None, None, None) for i, t in enumerate(TEXTS, 1000)] + [(None, "the thing", 0, "", "", 1)], DOCS)
    labels = spark.createDataFrame([(i, q, "t", 1) for i, t, q in rows if i < 200] + [(3, rows[3][2], "t", 1), (None, 0, "t", 1),
                                   (5, None, "t", 1), (99_999, 0, "t", 1), (1001, 1, "t", 1)], LABELS)
    model = qc.fit(docs, labels)
    got = qc.score_documents(docs, model).collect()
    assert [f.name for f in qc.score_documents(docs, model).schema] == ["doc_id", "score", "predicted"]
    assert len(got) == len(rows) + len(TEXTS) + 1
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    by_id = {r.doc_id: r.score for r in got}
    assert sum((by_id[i] >= 0.5) == q for i, _, q in rows if i >= 200) >= 195
    share = sum(r[2] for r in rows[:200]) + 1
    assert by_id[1000] == by_id[1001] == by_id[1002] == pytest.approx(share / 202)
    again = {r.doc_id: r.score for r in qc.score_documents(docs.repartition(7), model).collect()}
    assert all(abs(again[i] - s) < 1e-9 for i, s in by_id.items())


def test_no_or_one_label_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b", 1, "", "", 1), (2, None, 1, "", "", 1)], DOCS)
    none = spark.createDataFrame([(1, None, "", 1)], LABELS)
    assert {(r.score, r.predicted) for r in qc.score_documents(docs, qc.fit(docs, none)).collect()} == {(0.5, 1)}
    for quality, want in ((1, 1.0), (0, 0.0)):
        one = spark.createDataFrame([(1, quality, "", 1)], LABELS)
        assert {r.score for r in qc.score_documents(docs, qc.fit(docs, one)).collect()} == {want}
        assert {r.score for r in qc.score_documents(docs, qc.fit(docs.limit(0), one)).collect()} == {want}
        assert qc.score_documents(docs.limit(0), qc.fit(docs, one)).count() == 0


def test_training_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(qc, "TRAIN_PER_LABEL", 20)
    monkeypatch.setattr(qc, "TRAIN_FEATURES", 600)
    seen = []
    monkeypatch.setattr(qc, "train", lambda examples, shares: seen.append((examples, shares)))
    rows = good_and_bad(random.Random(1), 3000)
    docs = spark.createDataFrame([(i, t, 0, "", "", 1) for i, t, _ in rows] * 2, DOCS)
    qc.fit(docs, spark.createDataFrame([(i, q, "", 1) for i, _, q in rows], LABELS))
    (examples, shares), = seen
    assert shares == {0: 750, 1: 2250}
    for label in (0, 1):
        sizes = [len(b) for k, b, _ in examples if k == label]
        assert 1 <= len(sizes) <= 20 and sum(sizes[:-1]) < 300 <= sum(sizes)
    known = [slow_features(t) for _, t, q in rows if q == 0]
    assert all(Counter(dict(zip(b.tolist(), c.tolist()))) in known for k, b, c in examples if k == 0)


def test_held_out_accuracy(spark):
    rows = op11_quality_classifier(spark, SF).collect()
    docs = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for value in (0, 1):
        judged = [r.predicted == value for r in rows if r.held_out and quality.get(r.doc_id) == value]
        assert len(judged) > 5 and sum(judged) >= 0.9 * len(judged)

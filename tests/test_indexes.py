"""The positional index and the dictionary table against the operators that read everything."""

import random

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import constants as K
from tallyspark.operators import categorize, dictionary, word_index, words

WORD = "array<struct<index:int,text:string,x:double,y:double,width:double,height:double>>"


def make_pages(spark, docs):
    rows = [(d, p, [(k, w, 0.0, 0.0, 0.1, 0.1) for k, w in enumerate(page)]) for d, pages in docs.items() for p, page in enumerate(pages, 1)]
    return spark.createDataFrame(rows, f"doc_id string, page_number int, words {WORD}")


def make_values(spark, rows):
    return spark.createDataFrame(rows, "doc_id string, target_id string, value string, confidence double")


def same(a, b):
    assert a.columns == b.columns
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


@pytest.mark.parametrize("seed", [1, 2])
def test_index_finds_what_a_search_finds(spark, seed):
    rng = random.Random(seed)
    vocabulary = ["Total", "total:", "a", "b", "B.", "--", "", "due", "12.50", "€", "x-y"]
    docs = {f"d{k}": [[rng.choice(vocabulary) for _ in range(rng.randrange(25))] for _ in range(rng.randrange(1, 6))] for k in range(25)}
    values = []
    for d, pages in [*docs.items(), ("missing", [["a"]])]:
        for k in range(12):
            page = rng.choice(pages) or ["a"]
            at = rng.randrange(len(page))
            text = rng.choice([" ".join(page[at:at + rng.randrange(1, 5)]), " ".join(rng.choice(vocabulary) for _ in range(3)), "nowhere a", "a a a"])
            values.append((d, f"t{k}", rng.choice([text, text.upper(), text, None, " "]), 0.5))
    pages, values = make_pages(spark, docs), make_values(spark, values)
    same(word_index.locate_indexed(values, pages), words.locate(values, pages))
    same(word_index.locate_indexed(values, pages.limit(0)), words.locate(values, pages.limit(0)))
    assert word_index.locate_indexed(values.limit(0), pages).count() == 0


def test_candidates_on_a_long_document(spark):
    """2,000 pages of common words: a value with a rare word proposes as many runs as that word has places."""
    page = ["the", "sum", "of", "all"] * 25
    docs = {"long": [[*page, f"mark{p}", "the", "rare" if p == 1500 else "usual"] for p in range(2000)]}
    pages = make_pages(spark, docs).repartition(8)
    values = make_values(spark, [("long", "a", "all mark77 the", 1.0), ("long", "b", "the rare", 1.0), ("long", "c", "sum of all the", 1.0)])
    squashed = word_index.squashed_pages(pages)
    places = word_index.postings(squashed)
    runs = values.select("doc_id", F.split("value", " ").alias("run"))
    proposed = word_index.candidates(runs, places, word_index.token_counts(places))
    assert {r.run[-1]: r.n for r in proposed.groupBy("run").agg(F.count("*").alias("n")).collect() if r.run[0] != "sum"} == {"the": 1, "rare": 1}
    found = {r.target_id: (r.page_number, r.word_indices) for r in word_index.locate_indexed(values, pages).collect()}
    assert found == {"a": (78, [99, 100, 101]), "b": (1501, [101, 102]), "c": (1, [1, 2, 3, 4])}


def test_dictionary_scores_like_the_expression(spark):
    rng = random.Random(4)
    vocabulary = [w for ws in K.CATEGORY_KEYWORDS.values() for w in ws] + ["nothing", "of", "note"]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(8))) for _ in range(150)] + [None, "", "UPPER " + vocabulary[0].upper()]
    df = spark.createDataFrame(list(enumerate(texts)), "invoice_id long, doc_text string")
    table = spark.createDataFrame([(w, k, c) for k, (c, ws) in enumerate(K.CATEGORY_KEYWORDS.items()) for w in ws] + [(None, 0, "x"), ("", 0, "x")],
                                  "word string, ordinal int, category string")
    same(dictionary.score_with_dictionary(df, table).select("invoice_id", "candidates"),
         categorize.score_categories(df).select("invoice_id", "candidates"))


def test_fifty_thousand_keywords(spark, monkeypatch):
    monkeypatch.setattr(dictionary, "PHRASES", 9_000)
    rng = random.Random(8)
    words_ = [f"k{k}" if k % 2 else f"p{k % 300} q{k}" for k in range(50_000)]
    owners = {w: sorted({k % 7, k % 11}) for k, w in enumerate(words_)}
    table = spark.createDataFrame([(w, o, f"c{o}") for w, os in owners.items() for o in os], "word string, ordinal int, category string")
    texts = [" ".join(rng.choice(words_) for _ in range(rng.randrange(6))) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "invoice_id long, doc_text string")
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        got = {r.invoice_id: [(c.ordinal, -c.neg_score) for c in r.candidates] for r in dictionary.score_with_dictionary(df, table).collect()}
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")
    for k, text in enumerate(texts):
        hits = [w for w in set(text.split()) if w in owners] + [w for w in owners if " " in w and w in text]
        n = {}
        for w in hits:
            for o in owners[w]:
                n[o] = n.get(o, 0) + 1
        scored = [(o, float(K.HIT_SCORES[min(c, 3)])) for o, c in n.items()]
        assert got[k] == sorted([s for s in scored if s[1] >= K.CATEGORY_FLOOR], key=lambda s: (-s[1], s[0]))

"""Category scores with a dictionary of any size: a table instead of generated code.

Single words are matched by a join of the documents' distinct words with the dictionary, phrases by an Aho-Corasick
automaton over the lower-cased text, built once per task from a block of at most ``PHRASES`` phrases; more phrases
make more passes. Hits per document and category are an aggregate. Scores, floor and order are those of
``categorize.score_categories``, which suits small vocabularies better: it needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.rows import written

PHRASES = 50_000
PHRASE_BYTES = 16 << 20


def phrase_blocks(phrases: DataFrame) -> Iterator[list[str]]:
    """Distinct phrases in order, in lists of bounded number and size."""
    block, size = [], 0
    for (phrase,) in phrases.select("word").distinct().orderBy("word").toLocalIterator():
        block.append(phrase)
        size += len(phrase.encode())
        if len(block) >= PHRASES or size >= PHRASE_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def phrase_hits(texts: DataFrame, block: list[str]) -> DataFrame:
    """(key, word): the block's phrases that a text holds, each once."""
    shipped = texts.sparkSession.sparkContext.broadcast(block)

    def find(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = ahocorasick.Automaton()
        for phrase in shipped.value:
            automaton.add_word(phrase, phrase)
        automaton.make_automaton()
        for part in parts:
            rows = [(key, phrase) for key, text in zip(part["key"], part["text"], strict=True)
                    for phrase in {p for _, p in automaton.iter(text)}]
            yield pd.DataFrame(rows, columns=["key", "word"])

    return texts.mapInPandas(find, "key string, word string")


def score_with_dictionary(df: DataFrame, keywords: DataFrame, key: str = "invoice_id", text: str = "doc_text") -> DataFrame:
    """df with unique ``key`` → (key, candidates array<struct<neg_score,ordinal,category>>), best first.

    keywords(word, ordinal, category): words in lower case; a word may belong to several categories.
    """
    # rows without a word are nobody's; equal rows count once
    owners = written(keywords.select("word", F.col("ordinal").cast("int").alias("ordinal"), "category")
                     .where("coalesce(word, '') <> ''").distinct(), "keywords")
    texts = written(df.select(F.col(key).cast("string").alias("key"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("text")),
                    "texts")
    words = texts.select("key", F.explode(F.array_distinct(F.split(
        F.regexp_replace("text", "[^a-z0-9 ]+", " "), " "))).alias("word"))
    hits = words.join(owners.where(~F.col("word").contains(" ")), "word").select("key", "ordinal", "category")
    phrases = owners.where(F.col("word").contains(" "))
    for block in phrase_blocks(phrases):
        hits = hits.unionByName(phrase_hits(texts, block).join(phrases, "word").select("key", "ordinal", "category"))
    _, one, two, many = K.HIT_SCORES
    n = F.col("n")
    score = F.when(n == 1, F.lit(-float(one))).when(n == 2, F.lit(-float(two))).otherwise(F.lit(-float(many)))
    ranked = hits.groupBy("key", "ordinal", "category").agg(F.count("*").alias("n")).select(
        "key", F.struct(score.alias("neg_score"), "ordinal", "category").alias("c")).where(
        -F.col("c.neg_score") >= K.CATEGORY_FLOOR).groupBy("key").agg(F.array_sort(F.collect_list("c")).alias("candidates"))
    none = F.array().cast("array<struct<neg_score:double,ordinal:int,category:string>>")
    return texts.select("key").join(ranked, "key", "left").select(
        F.col("key").cast(dict(df.dtypes)[key]).alias(key), F.coalesce("candidates", none).alias("candidates"))

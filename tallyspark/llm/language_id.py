"""Operator 5, language ID by compression.

Each language gets a zstandard raw-content dictionary made of sampled labelled texts. A text is
lower-cased, reduced to its letters, cut into blocks, and every block is compressed with every
dictionary; the language with the smallest total wins. Byte counts of short texts are coarse, so the share of a
text's words that a dictionary holds counts as a fraction of one byte less. ``score`` is the share of
bytes saved against the runner-up scaled to 0..1; a score under ``min_score`` is rejected.

Training takes rows with a text and a language, whatever its length: at most ``SAMPLE_PER_LANGUAGE`` texts per
language (a documented bound: chosen by a hash of id and text, rows that repeat count once) until a dictionary
holds ``DICTIONARY_BYTES``. Of a text of more than ``SAMPLE_CHARS`` characters a slice of that length, at a place given
by its hash, goes into the dictionary. Prediction reads all of every text.

Defined results: null text or no letter gives ``und``, score 0, rejected. Equal sizes go to the
language that sorts first. Nothing labelled: everything is ``und``. Repeated rows count each. Null
ids are never held out. Columns of other names are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import chunks, record_batch

UNKNOWN = "und"
SAMPLE_PER_LANGUAGE = 250
SAMPLE_CHARS = 4_000
DICTIONARY_BYTES = 96 << 10
MAX_LANGUAGES = 400
BLOCK_CHARS = 1800
#: Saved share at which a decision counts as certain, and the least score that is not rejected.
CERTAIN = 0.05
MIN_SCORE = 0.05
LEVEL = 7

NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")
LETTER = regex.compile(r"\p{L}")

OUT = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("accepted", pa.bool_())])


def held_out(key: Column) -> Column:
    """One third of the ids: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def letters_only(text: str) -> str:
    return NOT_LETTERS.sub(" ", text.lower()).strip()


def sampled(labelled: DataFrame, key: str, text: str, lang: str) -> dict[str, list[str]]:
    """Language to at most ``SAMPLE_PER_LANGUAGE`` texts, or slices of long ones, in the order of their hashes."""
    size = F.char_length(text)
    at = F.when(size <= SAMPLE_CHARS, 1).otherwise(
        F.lit(1) + F.pmod(F.xxhash64(F.lit(1), F.col(key), F.col(text)), size - SAMPLE_CHARS + 1).cast("int"))
    rows = labelled.where(F.col(lang).isNotNull() & (size > 0)).select(
        F.col(lang).alias("lang"), F.substring(F.col(text), at, F.lit(SAMPLE_CHARS)).alias("text"),
        F.pmod(F.xxhash64(F.col(key), F.col(text)), F.lit(1 << 30)).alias("order"))
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(
        F.approx_count_distinct("order", 0.02).alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages: raise MAX_LANGUAGES and watch the broadcast")
    if not counts:
        return {}
    # about a third more than wanted, so that the top of the order is there; rows that repeat count once
    share = F.create_map(*[F.lit(x) for k, n in counts.items()
                           for x in (k, int(min(1.0, 1.35 * SAMPLE_PER_LANGUAGE / max(1, n)) * (1 << 30)))])
    few = rows.where(F.col("order") < share[F.col("lang")]).groupBy("lang", "order").agg(F.min("text").alias("text"))
    top = few.groupBy("lang").agg(F.slice(F.array_sort(F.collect_list(F.struct("order", "text"))), 1, SAMPLE_PER_LANGUAGE)
                                  .getField("text").alias("texts"))
    return {r.lang: r.texts for r in top.collect()}


def dictionaries(labelled: DataFrame, key: str, text: str, lang: str) -> dict[str, bytes]:
    """Language to dictionary content, from a bounded sample of ``labelled``."""
    sample = sampled(labelled, key, text, lang)
    limit = min(DICTIONARY_BYTES, (32 << 20) // max(1, len(sample)))
    out: dict[str, bytes] = {}
    for name, texts in sample.items():
        for t in texts:
            have = out.get(name, b"")
            if len(have) < limit:
                out[name] = have + letters_only(t).encode() + b" "
    return dict(sorted(out.items()))


def compressors(contents: dict[str, bytes]) -> list[tuple[str, zstandard.ZstdCompressor, frozenset]]:
    parameters = zstandard.ZstdCompressionParameters.from_level(
        LEVEL, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0)
    out = []
    for lang, content in contents.items():
        held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(level=LEVEL)
        coder = zstandard.ZstdCompressor(dict_data=held, compression_params=parameters)
        out.append((lang, coder, frozenset(content.decode().split())))
    return out


def classify(text: str | None, encoders: list[tuple[str, zstandard.ZstdCompressor, frozenset]]) -> tuple[str, float]:
    """Language and score of one whole text."""
    if not text or not encoders or not LETTER.search(text):
        return UNKNOWN, 0.0
    plain = letters_only(text)
    blocks = [plain[i:i + BLOCK_CHARS].encode() for i in range(0, len(plain), BLOCK_CHARS)]
    words = plain.split()
    sizes = sorted((sum(len(coder.compress(b)) for b in blocks) - 0.9 * sum(w in known for w in words) / len(words), lang)
                   for lang, coder, known in encoders)
    if len(sizes) == 1:
        return sizes[0][1], 1.0
    saved = (sizes[1][0] - sizes[0][0]) / sizes[1][0]
    return sizes[0][1], min(1.0, saved / CERTAIN)


def identify(docs: DataFrame, labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
             min_score: float = MIN_SCORE) -> DataFrame:
    """``doc_id, lang_pred, score, accepted`` of every row of ``docs``."""
    held = docs.sparkSession.sparkContext.broadcast(dictionaries(labelled, key, text, lang))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = compressors(held.value)
        for ids, texts in chunks(batches):
            found = [classify(t, encoders) for t in texts]
            yield record_batch(OUT, ids, [f[0] for f in found], [f[1] for f in found],
                               [f[0] != UNKNOWN and f[1] >= min_score for f in found])

    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(
        predict, "doc_id long, lang_pred string, score double, accepted boolean")


def keep_certain(docs: DataFrame, labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
                 min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of ``docs``, all columns, whose language is not rejected."""
    held = docs.sparkSession.sparkContext.broadcast(dictionaries(labelled, key, text, lang))

    @F.pandas_udf("boolean")
    def certain(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoders = compressors(held.value)
        for texts in parts:
            found = [classify(t, encoders) for t in texts]
            yield pd.Series([f[0] != UNKNOWN and f[1] >= min_score for f in found], dtype=bool)

    return docs.where(certain(text))

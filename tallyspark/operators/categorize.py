"""Income or expense, and which category: keyword dictionaries evaluated inside the row.

The dictionary is a small fixed dimension, so scoring is column arithmetic with no join and no
shuffle: the document's tokens are first cut down to dictionary words, then counted per category.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.rows import once
from ..functions.text import (contains_any, non_empty, quote, sql_list, strip, strip_fences,
                              token_type, variant_text)
from .receipts import advisory_number


def doc_text(vendor: Column, sponsor: Column, study: Column, descriptions: Column,
             subject: Column, sender: Column, body: Column) -> Column:
    filled = F.filter(descriptions, lambda d: d.isNotNull() & (d != ""))
    return F.concat_ws(" ", non_empty(vendor), non_empty(sponsor), non_empty(study),
                       non_empty(F.array_join(filled, " ")), non_empty(subject),
                       non_empty(sender), non_empty(body))


def adversarial(text: Column, patterns: Sequence[str] = K.ADVERSARIAL_PATTERNS) -> Column:
    return F.coalesce(text.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns)), F.lit(False))


def score_categories(df: DataFrame, text: str = "doc_text",
                     categories: Mapping[str, Sequence[str]] = K.CATEGORY_KEYWORDS) -> DataFrame:
    """Adds ``candidates array<struct<neg_score,ordinal,category>>``, best first."""
    names = list(categories)
    owners: dict[str, list[int]] = {}
    for ordinal, words in enumerate(categories.values()):
        for word in words:
            owners.setdefault(word, []).append(ordinal)
    single = [w for w in owners if " " not in w]
    owner_map = ", ".join(
        f"{quote(w)}, array({', '.join(map(str, owners[w]))})" for w in single)
    phrases = ", ".join(
        f"case when contains(_lower, {quote(w)}) then {o} end"
        for w in owners if " " in w for o in owners[w])
    df = df.withColumn("_lower", F.lower(F.coalesce(text, F.lit(""))))
    # dictionary words present, then one category number per hit
    hits = f"""concat(
        flatten(transform(
            array_distinct(filter(split(regexp_replace(_lower, '[^a-z0-9 ]+', ' '), ' '),
                                  t -> t in ({sql_list(single)}))),
            t -> try_element_at(map({owner_map}), t))),
        array_compact(cast(array({phrases}) as array<int>)))"""
    _, one, two, many = K.HIT_SCORES
    # the floor lies above no hit, so only categories that are hit are counted
    ranked = f"""array_sort(filter(transform(array_distinct(_hits), o -> struct(
            case size(filter(_hits, h -> h = o)) when 1 then -{one}D when 2 then -{two}D else -{many}D end
                as neg_score, o as ordinal, array({sql_list(names)})[o] as category)),
        c -> -c.neg_score >= {K.CATEGORY_FLOOR}D))"""
    df = once(df.withColumn("_hits", F.expr(hits)).drop("_lower"), "_hits")
    df = df.withColumn("candidates", F.expr(ranked)).drop("_hits")
    return once(df, "candidates")


def candidate_rows(scored: DataFrame, key: str) -> DataFrame:
    rows = scored.select(key, F.posexplode_outer("candidates").alias("p", "c")).filter(
        "p is not null")
    return rows.select(key, (F.col("p") + 1).cast("bigint").alias("rank"),
                       F.col("c.category").alias("category"),
                       (-F.col("c.neg_score")).alias("score"))


def classify(df: DataFrame, text: str = "doc_text", vendor: str = "vendor_name",
             total: str = "total_amount", n_lines: str = "n_lines",
             categories: Mapping[str, Sequence[str]] = K.CATEGORY_KEYWORDS,
             income_words: Sequence[str] = K.INCOME_KEYWORDS,
             patterns: Sequence[str] = K.ADVERSARIAL_PATTERNS) -> DataFrame:
    """Adds type, category, confidences, evidence, ``alternates``, ``ambiguous``, ``adversarial``."""
    df = score_categories(df, text, categories)
    df = df.withColumn("ambiguous", F.expr(
        "coalesce(-try_element_at(candidates, 2).neg_score"
        f" >= -try_element_at(candidates, 1).neg_score - {K.AMBIGUITY_GAP}D, false)"))
    df = (df.withColumn("category", F.expr("try_element_at(candidates, 1).category"))
          .withColumn("_best", F.expr("coalesce(-try_element_at(candidates, 1).neg_score, 0.0D)")))
    confidence = F.when(F.col("ambiguous"), F.least("_best", F.lit(K.AMBIGUOUS_CAP))).otherwise(
        F.col("_best"))
    rationale = (F.when(F.col("category").isNull(), K.NO_CATEGORY_RATIONALE)
                 .when(F.col("ambiguous"), F.format_string(
                     "ambiguous between '%s' and '%s'", F.expr("try_element_at(candidates, 1).category"),
                     F.expr("try_element_at(candidates, 2).category")))
                 .otherwise(F.format_string("keyword match to '%s' (%.2f)", "category", "_best")))
    income = contains_any(F.lower(F.coalesce(text, F.lit(""))), income_words) | F.coalesce(
        F.col("category") == K.INCOME_CATEGORY, F.lit(False))
    has_vendor = F.coalesce(F.col(vendor), F.lit("")) != ""
    has_total = F.col(total).isNotNull()

    def kind(name, conf, evidence):
        return F.struct(F.lit(name).alias("t"), F.lit(conf).alias("c"), F.lit(evidence).alias("e"))

    doc_type = (F.when(income, kind("income", K.TYPE_CONFIDENCE, K.EVIDENCE_INCOME))
                .when(has_vendor & has_total,
                      kind("expense", K.TYPE_CONFIDENCE, K.EVIDENCE_PURCHASE))
                .when(has_total | (F.col(n_lines) > 0),
                      kind("expense", K.WEAK_TYPE_CONFIDENCE, K.EVIDENCE_WEAK))
                .otherwise(kind("unknown", 0.0, K.EVIDENCE_NO_TYPE)))
    df = (df.withColumn("_type", doc_type)
          .withColumn("document_type", F.col("_type.t"))
          .withColumn("document_type_confidence", F.round("_type.c", 3))
          .withColumn("document_type_evidence", F.col("_type.e"))
          .withColumn("category_confidence", F.round(confidence, 3))
          .withColumn("category_evidence", rationale)
          .withColumn("adversarial", adversarial(F.col(text), patterns))
          .drop("_type", "_best"))
    return with_alternates(df)


def with_alternates(df: DataFrame) -> DataFrame:
    return df.withColumn("alternates", F.expr(
        "filter(candidates.category, n -> not (n <=> category))"))


def needs_advice() -> Column:
    return F.col("ambiguous") | (F.col("document_type") == "unknown")


def advisory_requests(classified: DataFrame, key: str = "invoice_id",
                      categories: Mapping[str, Sequence[str]] = K.CATEGORY_KEYWORDS) -> DataFrame:
    """Request table of the undecided documents only; the filter comes before any model call."""
    names = F.array(*[F.lit(n) for n in categories])
    return classified.filter(needs_advice()).select(key, F.to_json(F.struct(
        F.col("vendor_name").alias("vendor"), F.col("total_amount_raw").alias("total"), "subject",
        F.col("descriptions").alias("line_items"),
        F.when(F.size("candidates") > 0, F.col("candidates.category")).otherwise(names)
        .alias("candidate_categories"))).alias("request"))


def merge_advice(classified: DataFrame, answers: DataFrame, key: str = "invoice_id",
                 categories: Mapping[str, Sequence[str]] = K.CATEGORY_KEYWORDS) -> DataFrame:
    """answers(key, json, error_class) replace type, category, confidences and rationale.

    Unusable answers and connection errors keep the heuristic; another error becomes
    ``advice_error`` (stage failure). A category outside the candidates is nulled.
    """
    v = F.col("_v")
    cell = F.try_variant_get(v, "$.document_type", "variant")
    raw_type = F.lower(F.coalesce(variant_text(cell), F.lit("")))
    cat = F.try_variant_get(v, "$.category", "variant")
    rationale = F.try_variant_get(v, "$.rationale", "variant")
    asked = needs_advice()
    df = classified.join(answers.select(key, F.col("error_class").alias("_err"), F.col("json").alias("_json")), key, "left")
    # only answers that may be used are parsed; pinned, as each column below reads the parsed one
    parsed = F.when(asked & F.col("_err").isNull(), F.try_parse_json(strip_fences(F.col("_json"))))
    df = once(df.withColumn("_v", parsed).drop("_json"), "_v").select(
        "*", raw_type.alias("_t"),
        advisory_number(v, "$.document_type_confidence").alias("_tc"),
        advisory_number(v, "$.category_confidence").alias("_cc"),
        F.when(token_type(cat) != "VOID", variant_text(cat)).alias("_cat"),
        F.coalesce(non_empty(strip(variant_text(rationale))),
                   F.lit(K.ADJUDICATION_RATIONALE)).alias("_r")).drop("_v")
    usable = F.coalesce(asked & F.col("_err").isNull() & F.col("_t").isin(*K.DOCUMENT_TYPES)
                        & F.col("_tc").isNotNull() & F.col("_cc").isNotNull(), F.lit(False))
    names = F.array(*[F.lit(n) for n in categories])
    allowed = F.when(F.size("candidates") > 0, F.col("candidates.category")).otherwise(names)
    df = df.withColumn("_use", usable).withColumn("_allowed", F.array_contains(allowed, F.col("_cat")))
    df = (df.withColumn("advice_error", F.when(
            asked & F.col("_err").isNotNull() & ~F.col("_err").isin(*K.CONNECTION_ERRORS),
            F.col("_err")))
          .withColumn("document_type", F.when(F.col("_use"), F.col("_t"))
                      .otherwise(F.col("document_type")))
          .withColumn("document_type_confidence", F.when(F.col("_use"), F.round("_tc", 3))
                      .otherwise(F.col("document_type_confidence")))
          .withColumn("category", F.when(F.col("_use"), F.when(F.col("_allowed"), F.col("_cat")))
                      .otherwise(F.col("category")))
          .withColumn("category_confidence", F.when(F.col("_use"), F.round("_cc", 3))
                      .otherwise(F.col("category_confidence")))
          .withColumn("category_evidence", F.when(F.col("_use"), F.col("_r"))
                      .otherwise(F.col("category_evidence")))
          .drop("_err", "_t", "_tc", "_cc", "_cat", "_r", "_use", "_allowed"))
    return with_alternates(df)


def pin_category(classified: DataFrame, overlay: DataFrame, key: str = "invoice_id") -> DataFrame:
    """overlay(key, corrected_category): the reviewer's category is a verified input."""
    df = classified.join(overlay, key, "left")
    pinned = F.coalesce("corrected_category", F.lit("")) != ""
    return (df.withColumn("category", F.when(pinned, F.col("corrected_category"))
                          .otherwise(F.col("category")))
            .withColumn("category_confidence", F.when(pinned, 1.0)
                        .otherwise(F.col("category_confidence")))
            .withColumn("category_evidence", F.when(pinned, K.REVIEWER_EVIDENCE)
                        .otherwise(F.col("category_evidence")))
            .drop("corrected_category"))

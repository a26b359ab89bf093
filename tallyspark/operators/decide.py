"""File or hold: weakest-link confidence and severity-graded flags, as row expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.rows import once
from ..functions.text import MONEY, case_map, humanise, number_text

_SEVERITY = {code: severity for code, _, severity, _ in K.HOLD_REASONS}
_TITLE = {code: title for code, title, _, _ in K.HOLD_REASONS}
_RETRYABLE = tuple(code for code, _, _, retry in K.HOLD_REASONS if retry)


def severity_of(code: Column) -> Column:
    return case_map(code, _SEVERITY, F.lit("high"))


def title_of(code: Column) -> Column:
    return case_map(code, _TITLE, humanise(code))


def is_retryable(code: Column) -> Column:
    return F.coalesce(code.isin(*_RETRYABLE), F.lit(False))


def reconcile(items: DataFrame, lines: DataFrame, key: str = "invoice_id") -> DataFrame:
    """Adds ``n_lines``, ``line_total`` and ``total_mismatch`` to items(key, total_amount).

    Line totals are summed before the join, so one small row per item is exchanged.
    """
    sums = lines.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.coalesce(F.sum("total"), F.lit(0).cast(MONEY)).alias("line_total"))
    return with_mismatch(items.join(sums, key, "left").fillna(0, ["n_lines"]))


def with_mismatch(df: DataFrame) -> DataFrame:
    gap = F.abs(F.col("line_total") - F.col("total_amount")) > F.lit(K.TOTAL_TOLERANCE).cast(MONEY)
    return df.withColumn("total_mismatch", F.coalesce(
        F.col("total_amount").isNotNull() & (F.col("n_lines") > 0) & gap, F.lit(False)))


def line_signals(extracted: DataFrame) -> DataFrame:
    """The same figures from line items carried inside the document row (no join)."""
    df = (extracted
          .withColumn("n_lines", F.size("lines").cast("bigint"))
          .withColumn("line_total", F.expr(
              "aggregate(filter(lines.total, t -> t is not null), cast(0 as decimal(28,4)),"
              " (a, t) -> cast(a + t as decimal(28,4)))"))
          .withColumn("min_line_confidence", F.array_min("lines.extraction_confidence")))
    return with_mismatch(df)


def decide(df: DataFrame) -> DataFrame:
    """Adds ``extraction_confidence``, ``risk_flags``, ``decision``, ``confidence``,
    ``decision_rationale`` and ``required_actions``.

    Needs: field_confidence map (or the ``least_confidence`` of its populated fields, which goes here), missing_fields, min_line_confidence, total_mismatch, document_type,
    document_type_confidence, category, category_confidence, adversarial.
    """
    if "least_confidence" in df.columns:
        least = F.col("least_confidence")
    else:
        least = F.array_min(F.map_values(F.map_filter(
            "field_confidence", lambda k, _: F.array_position("missing_fields", k) == 0)))
    df = df.withColumn("extraction_confidence", F.coalesce(F.round(
        F.least(least, F.col("min_line_confidence")), 3), F.lit(0.0))).drop("least_confidence")
    df = df.withColumn("confidence", F.round(F.least(
        "extraction_confidence", "document_type_confidence", "category_confidence"), 3))

    def flag(when: Column, code: str, message) -> Column:
        message = F.lit(message) if isinstance(message, str) else message
        return F.when(when, F.struct(F.lit(code).alias("type"),
                                     F.lit(_SEVERITY.get(code, "high")).alias("severity"),
                                     message.alias("message")))

    ext = F.col("extraction_confidence")
    tconf, cconf = F.col("document_type_confidence"), F.col("category_confidence")
    optional = F.array_remove("missing_fields", "total_amount")
    # pinned before and after: what stands below a lambda is not compiled
    df = once(df, "extraction_confidence", "confidence")
    flags = F.array(
        flag(F.col("adversarial"), "suspected_adversarial",
             "document content contains instruction-like text; treated as untrusted"),
        flag((F.col("document_type") == "unknown") | (tconf < K.TYPE_HOLD),
             "ambiguous_income_expense",
             F.concat(F.lit("could not confidently classify income vs expense ("),
                      number_text(F.round(tconf, 3)), F.lit(")"))),
        flag((F.coalesce("category", F.lit("")) == "") | (cconf < K.CATEGORY_HOLD),
             "low_category_confidence",
             F.concat(F.lit("category could not be assigned with confidence ("),
                      number_text(F.round(cconf, 3)), F.lit(")"))),
        flag(F.array_contains("missing_fields", "total_amount"), "missing_total",
             "required field 'total_amount' is missing"),
        flag(F.size(optional) > 0, "missing_optional_fields",
             F.concat(F.lit("optional fields not present: "), F.array_join(optional, ", "))),
        flag(ext < K.EXTRACTION_HOLD, "low_extraction_confidence",
             F.concat(F.lit("extraction confidence "), number_text(ext),
                      F.lit(" below the file threshold"))),
        flag((ext >= K.EXTRACTION_HOLD) & (ext < K.EXTRACTION_WATCH),
             "moderate_extraction_confidence",
             F.concat(F.lit("some extracted fields are only moderately confident ("),
                      number_text(ext), F.lit(")"))),
        flag(F.col("total_mismatch"), "total_mismatch", "line items do not sum to the total"))
    df = once(df.withColumn("_flags", flags), "_flags").withColumn("_flags", F.array_compact("_flags"))
    overall = F.concat(F.lit("overall decision confidence "), number_text(F.col("confidence")),
                       F.lit(" below the file threshold"))
    calm = ~F.exists("_flags", lambda f: f["severity"] == "high")
    df = df.withColumn("risk_flags", F.when(
        calm & (F.col("confidence") < K.DECISION_FLOOR), F.concat("_flags", F.array(
            F.struct(F.lit("low_confidence").alias("type"), F.lit("high").alias("severity"),
                     overall.alias("message"))))).otherwise(F.col("_flags"))).drop("_flags")
    df = df.withColumn("_high", F.filter("risk_flags", lambda f: f["severity"] == "high"))
    hold = F.size("_high") > 0
    actions = F.array_compact(F.transform(
        "_high", lambda f: case_map(f["type"], K.REQUIRED_ACTIONS)))
    df = once(df, "risk_flags", "_high")
    return (df.withColumn("decision", F.when(hold, "hold").otherwise("submit"))
            .withColumn("decision_rationale", F.when(hold, F.array_join("_high.message", "; "))
                        .otherwise(K.SUBMIT_RATIONALE))
            .withColumn("required_actions", F.when(hold, actions)
                        .otherwise(F.array().cast("array<string>")))
            .drop("_high"))


def hold_exceptions(decided: DataFrame, key: str = "invoice_id", *keep: str) -> DataFrame:
    """One exception row per medium or high flag of a held item; ``ordinal`` keeps flag order."""
    flags = F.filter("risk_flags", lambda f: f["severity"].isin("medium", "high"))
    rows = decided.filter("decision = 'hold'").select(
        key, *keep, F.posexplode(flags).alias("ordinal", "f"))
    return build_exceptions(rows.select(key, *keep, "ordinal", "f.*"), key, *keep, "ordinal")


def build_exceptions(rows: DataFrame, key: str = "invoice_id", *keep: str) -> DataFrame:
    """rows(key, type, severity?, message?) with registry defaults filled in."""
    return rows.select(
        key, *keep, "type", F.coalesce("severity", severity_of(F.col("type"))).alias("severity"),
        F.coalesce(F.nullif("message", F.lit("")), title_of(F.col("type"))).alias("message"))

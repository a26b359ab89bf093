"""Is this message a receipt? Heuristics first, advisory answers only for the undecided band."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.text import (contains_any, non_empty, strip, strip_fences, token_type,
                              variant_text)


def sender_local(sender: Column) -> Column:
    """Text before the first ``@``, trimmed and lower-cased; empty when there is no sender."""
    return F.lower(strip(F.split_part(F.coalesce(sender, F.lit("")), F.lit("@"), F.lit(1))))


def receipt_signal(sender, subject, attachment, senders=K.RECEIPT_SENDERS,
                   tells=K.RECEIPT_SUBJECT_TELLS) -> Column:
    by_subject = contains_any(F.lower(F.coalesce(subject, F.lit(""))), tells)
    by_file = F.lower(F.coalesce(attachment, F.lit(""))).endswith(".pdf")
    return sender_local(sender).isin(*senders) | by_subject | by_file


def non_receipt_signal(subject, body, tells=K.NON_RECEIPT_TELLS) -> Column:
    text = F.concat(F.coalesce(subject, F.lit("")), F.lit(" "), F.coalesce(body, F.lit("")))
    return contains_any(F.lower(text), tells)


def advisory_number(variant: Column, path: str) -> Column:
    """Numeric reading of an answer field: absent is 0, null or text that is no number is null."""
    cell = F.try_variant_get(variant, path, "variant")
    kind = token_type(cell)
    return (F.when(cell.isNull(), F.lit(0.0))
            .when(kind == "BOOLEAN", cell.cast("boolean").cast("double"))
            .when(kind.isin("VOID", "OBJECT", "ARRAY"), F.lit(None).cast("double"))
            .otherwise(strip(cell.cast("string")).try_cast("double")))


def advisory_text(variant: Column, path: str, default: str) -> Column:
    cell = F.try_variant_get(variant, path, "variant")
    return F.coalesce(non_empty(strip(variant_text(cell))), F.lit(default))


def read_receipt_answers(answers: DataFrame) -> DataFrame:
    """answers(message_id, json, error_class) → one usable verdict per message, or an error.

    Connection failures degrade to "no answer"; any other failure is reported as
    ``advisory_error`` so the message stays unprocessed.
    """
    v = F.try_parse_json(strip_fences(F.col("json")))
    parsed = answers.select("message_id", "error_class", v.alias("v"))
    is_bool = token_type(F.try_variant_get("v", "$.is_receipt", "variant")) == "BOOLEAN"
    conf = advisory_number(F.col("v"), "$.confidence")
    usable = (F.col("error_class").isNull() & (token_type(F.col("v")) == "OBJECT")
              & is_bool & conf.isNotNull())
    return parsed.select(
        "message_id",
        F.when(F.coalesce(usable, F.lit(False)), F.struct(
            F.try_variant_get("v", "$.is_receipt", "boolean").alias("is_receipt"),
            conf.alias("confidence"),
            advisory_text(F.col("v"), "$.reason", K.REASON_ADVISORY).alias("reason"),
        )).alias("answer"),
        F.when(F.col("error_class").isNotNull()
               & ~F.col("error_class").isin(*K.CONNECTION_ERRORS),
               F.col("error_class")).alias("advisory_error"))


def undecided(messages: DataFrame, body: str | None = "body", **vocabulary) -> DataFrame:
    """Messages neither heuristic decides, as the (small) advisory request table."""
    receipt, non_receipt = _signals(body, vocabulary)
    body_col = F.col(body) if body else F.lit(None).cast("string")
    return messages.filter(~receipt & ~non_receipt).select(
        "message_id",
        F.to_json(F.struct(
            "sender", "subject",
            F.coalesce(F.length("attachment") > 0, F.lit(False)).alias("has_attachment"),
            F.coalesce(body_col, F.lit("")).alias("body"))).alias("request"))


def _signals(body, vocabulary):
    receipt = receipt_signal(
        F.col("sender"), F.col("subject"), F.col("attachment"),
        vocabulary.get("senders", K.RECEIPT_SENDERS),
        vocabulary.get("subject_tells", K.RECEIPT_SUBJECT_TELLS))
    non_receipt = non_receipt_signal(
        F.col("subject"), F.col(body) if body else F.lit(None).cast("string"),
        vocabulary.get("non_receipt_tells", K.NON_RECEIPT_TELLS))
    return receipt, non_receipt


def verdicts(messages: DataFrame, answers: DataFrame | None = None, body: str | None = "body",
             **vocabulary) -> DataFrame:
    """Adds ``is_receipt``, ``confidence``, ``reason`` (and ``advisory_error``).

    ``body=None`` is the mailbox path, where the verdict is reached before bodies are fetched:
    Catalyst then never reads the body column.
    """
    receipt, non_receipt = _signals(body, vocabulary)
    df = messages
    if answers is not None:
        df = df.join(read_receipt_answers(answers), "message_id", "left")
    else:
        df = df.withColumn("answer", F.lit(None).cast(
            "struct<is_receipt:boolean,confidence:double,reason:string>"))
        df = df.withColumn("advisory_error", F.lit(None).cast("string"))

    def verdict(flag, conf, reason):
        return F.struct(F.lit(flag).alias("is_receipt"), F.lit(conf).alias("confidence"),
                        F.lit(reason).alias("reason"))

    chosen = (F.when(receipt, verdict(True, K.RECEIPT_CONFIDENCE, K.REASON_RECEIPT))
              .when(non_receipt, verdict(False, K.RECEIPT_CONFIDENCE, K.REASON_NON_RECEIPT))
              .when(F.col("answer").isNotNull(), F.col("answer"))
              .otherwise(verdict(True, K.UNCERTAIN_RECEIPT_CONFIDENCE, K.REASON_UNCERTAIN)))
    error = F.when(~receipt & ~non_receipt, F.col("advisory_error"))
    return (df.withColumn("_v", chosen).withColumn("advisory_error", error)
            .withColumn("is_receipt", F.col("_v.is_receipt"))
            .withColumn("confidence", F.col("_v.confidence"))
            .withColumn("reason", F.col("_v.reason"))
            .drop("_v", "answer"))


def is_dropped() -> Column:
    return ~F.col("is_receipt") & (F.col("confidence") >= K.DROP_THRESHOLD)


def dropped(judged: DataFrame) -> DataFrame:
    """Drop log with minimal retention: never a body or document column."""
    return judged.filter(is_dropped() & F.col("advisory_error").isNull()).select(
        "message_id", "sender", "subject", "is_receipt", "confidence", "reason")


def survivors(judged: DataFrame) -> DataFrame:
    return judged.filter(~is_dropped() & F.col("advisory_error").isNull())


def chosen_body(html: Column, text: Column) -> Column:
    return F.coalesce(non_empty(html), text)


def first_pdf(attachments: Column) -> Column:
    """First PDF among ``array<struct<filename,attachment_id,mime_type>>``."""
    pdfs = F.filter(attachments, lambda a: (a["mime_type"] == "application/pdf")
                    | F.lower(a["filename"]).endswith(".pdf"))
    return F.try_element_at(pdfs, F.lit(1))

"""Locate the payload of a message, name its format and read layout text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.rows import once
from ..functions.text import non_empty, quote


def register(messages: DataFrame) -> DataFrame:
    """New items: deterministic id, status ``received``, channel default ``email``."""
    return (messages
            .withColumn("invoice_id", item_id(F.col("channel"), F.col("message_id")))
            .withColumn("source", F.coalesce("channel", F.lit("email")))
            .withColumn("status", F.lit("received")))


def item_id(channel: Column, message_id: Column) -> Column:
    """The whole digest: it is the idempotency key, so no two documents may share it."""
    digest = F.sha2(F.concat_ws("|", F.coalesce(channel, F.lit("email")), message_id), 256)
    return F.concat(F.lit("inv_"), digest)


def real_pdf(path: Column, b64: Column, attachment: Column) -> Column:
    by_path = F.lower(F.coalesce(path, F.lit(""))).endswith(".pdf")
    inline = (F.coalesce(F.length(b64), F.lit(0)) > 0) & F.lower(
        F.coalesce(attachment, F.lit(""))).endswith(".pdf")
    return by_path | inline


def has_source_pdf(path: Column, attachment: Column) -> Column:
    return (F.lower(F.coalesce(path, F.lit(""))).endswith(".pdf")
            | F.lower(F.coalesce(attachment, F.lit(""))).endswith(".pdf"))


def rasterisable(path: Column) -> Column:
    return F.coalesce(F.lower(path).rlike(K.RASTER_SUFFIX_PATTERN), F.lit(False))


def parse(messages: DataFrame) -> DataFrame:
    """Adds ``location``, ``format``, ``text``, ``sections`` and ``is_real_pdf``.

    Needs: attachment, attachment_path, attachment_b64, document, body, source_body, pdf_text
    (text layer of real PDFs, delivered as a column).
    """
    document = F.when(~F.col("document").rlike(r"^\s*(\{\s*\}|null)?\s*$"), F.col("document"))
    body = F.coalesce(F.col("body"), F.col("source_body"))
    df = (messages
          .withColumn("is_real_pdf", real_pdf(F.col("attachment_path"), F.col("attachment_b64"),
                                              F.col("attachment")))
          .withColumn("_doc", document)
          .withColumn("_body", non_empty(body)))
    name = F.lower(F.coalesce("attachment", F.lit("")))
    location = (F.when(F.col("_doc").isNotNull(), "attachment")
                .when(F.col("_body").isNotNull(), "body").otherwise("none"))
    fmt = (F.when(F.col("is_real_pdf"), "pdf")
           .when(F.col("_doc").isNotNull(),
                 F.when(name.endswith(".pdf"), "pdf")
                 .when(name.rlike(K.IMAGE_SUFFIX_PATTERN), "image").otherwise("attachment"))
           .when(F.col("_body").isNotNull(), "email_body").otherwise("unknown"))
    text = F.when(F.col("is_real_pdf"), F.coalesce("pdf_text", F.lit(""))).otherwise(
        F.coalesce("_doc", "_body", F.lit("")))
    # A structured payload is a document block, or a body that is a JSON object.
    structured = ~F.col("is_real_pdf") & (
        F.col("_doc").isNotNull() | F.coalesce(F.col("_body").rlike(r"^\s*\{"), F.lit(False)))
    return (df.withColumn("location", location).withColumn("format", fmt)
            .withColumn("text", text).withColumn("structured", structured)
            .drop("_doc", "_body")
            .withColumn("sections", sections(F.col("text"), F.col("structured"))))


def sections(text: Column, structured: Column) -> Column:
    """Names of the non-empty top-level blocks of a structured payload."""
    def filled(name: str) -> Column:
        raw = F.get_json_object(text, "$." + name)
        return F.when(structured & ~raw.isin("", "{}", "[]", "false", "0", "0.0"), F.lit(name))
    return F.array_compact(F.array(filled("metadata"), filled("line_items")))


# the six characters a regex calls white space; btrim avoids a regex per line
_BLANK = r"' \t\n\u000B\u000C\r'"


def layout_lines(text: str) -> Column:
    """Trimmed, non-blank lines."""
    return F.expr(f"filter(transform(split({text}, '\\\\R'), l -> btrim(l, {_BLANK})), l -> l <> '')")


def read_layout(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``layout_header map<string,string>`` and ``layout_items array<struct>``.

    Header lines are ``Label: value`` until the marker line; the last non-empty value of a label
    wins. After the marker, pipe rows with four or more cells are line items.
    """
    labels = ", ".join(f"{quote(v)}, {quote(k)}" for k, v in K.HEADER_LABELS.items())
    marker = quote(K.LINE_ITEMS_MARKER)
    df = df.withColumn("_lines", layout_lines(text))
    df = df.withColumn("_mark", F.expr(f"cast(array_position(_lines, {marker}) as int)"))
    df = (df.withColumn("_head", F.expr("if(_mark > 0, slice(_lines, 1, _mark - 1), _lines)"))
          .withColumn("_tail", F.expr(
              "if(_mark > 0, slice(_lines, _mark + 1, size(_lines)), slice(_lines, 1, 0))")))
    pairs = f"""
        filter(
          transform(
            filter(reverse(_head), l -> contains(l, ':')),
            l -> struct(
              try_element_at(map({labels}),
                btrim(substring_index(l, ':', 1), {_BLANK})) as field,
              btrim(substr(l, instr(l, ':') + 1), {_BLANK}) as value)),
          p -> p.field is not null and p.value <> '')"""
    # reversed order + first occurrence per field = the last line wins
    first_only = "filter(_pairs, (p, i) -> array_position(_pairs.field, p.field) = i + 1)"
    items = f"""
        transform(
          filter(
            transform(filter(_tail, l -> contains(l, '|')),
              l -> transform(split(l, '[|]'), c -> btrim(c, {_BLANK}))),
            c -> size(c) >= 4 and c[0] <> '' and lower(c[0]) <> {quote(K.LINE_ITEMS_FIRST_COLUMN)}),
          c -> struct(c[0] as raw_description, nullif(c[1], '') as quantity,
                      nullif(c[2], '') as unit_price, nullif(c[3], '') as total))"""
    df = (df.withColumn("_pairs", F.expr(pairs))
          .withColumn("layout_header", F.expr(f"map_from_entries({first_only})"))
          .withColumn("layout_items", F.expr(items))
          .drop("_lines", "_mark", "_head", "_tail", "_pairs"))
    return once(df, "layout_header", "layout_items")

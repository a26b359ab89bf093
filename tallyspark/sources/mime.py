"""Mailbox payload trees, flattened to parts, and the bodies and attachments they carry."""

from __future__ import annotations

import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rows import once, written
from ..functions.text import base64url_bytes, utf8_text

NODES = "array<struct<path:string,node:variant>>"
PARTS = ("array<struct<path:string,mime_type:string,filename:string,attachment_id:string,data_b64url:string,"
         "error:string>>")
#: Levels of a tree that one pass opens; only deeper payloads are taken up again.
LEVELS = 4
#: Payloads from this length on may hold more than Spark's JSON parser takes.
LARGE = 16_000_000
ROW = ("message_id string, part_order int, mime_type string, filename string,"
       " attachment_id string, data_b64url string, error string")


def _given(node: Column, name: str) -> Column:
    """A member of an object; SQL null if it is missing or JSON null."""
    value = F.try_variant_get(node, f"$.{name}", "variant")
    return F.when(~F.is_variant_null(value), value)


def _text(node: Column, name: str) -> tuple[Column, Column]:
    """A text member, null unless it has one that is not empty; the complaint about any other type."""
    value = _given(node, name)
    fits = F.schema_of_variant(value) == "STRING"
    return (F.nullif(F.when(fits, F.try_variant_get(value, "$", "string")), F.lit("")),
            F.when(value.isNotNull() & ~fits, f"{name} is no str"))


def _inner(node: Column, name: str, kind: str, called: str) -> Column:
    """The complaint about a member that is neither missing nor of a nested type."""
    value = _given(node, name)
    return F.when(value.isNotNull() & F.try_variant_get(value, "$", kind).isNull(), f"{name} is no {called}")


def _part(path: Column, mime: Column, name: Column, attachment: Column, data: Column, error: Column) -> Column:
    return F.struct(path.alias("path"), F.coalesce(mime, F.lit("")).alias("mime_type"),
                    F.coalesce(name, F.lit("")).alias("filename"), attachment.alias("attachment_id"),
                    data.alias("data_b64url"), error.alias("error"))


def _part_of(entry: Column) -> Column:
    node, none = entry["node"], F.lit(None).cast("string")
    body = F.try_variant_get(node, "$.body", "variant")
    (mime, e1), (name, e2) = _text(node, "mimeType"), _text(node, "filename")
    (attachment, e3), (data, e4) = _text(body, "attachmentId"), _text(body, "data")
    errors = F.concat_ws("; ", _inner(node, "body", "map<string,variant>", "dict"), e1, e2, e3, e4,
                         _inner(node, "parts", "array<variant>", "list"))
    return F.when(F.try_variant_get(node, "$", "map<string,variant>").isNull(),
                  _part(entry["path"], none, none, none, none, F.lit("part is no dict"))).otherwise(
        _part(entry["path"], mime, name, attachment, data, F.nullif(errors, F.lit(""))))


def _children(entry: Column) -> Column:
    """The nodes below one; paths sort a parent before its children and these in their order."""
    parts = F.coalesce(F.try_variant_get(entry["node"], "$.parts", "array<variant>"), F.array().cast("array<variant>"))
    return F.transform(parts, lambda node, i: F.struct(
        F.concat(entry["path"], F.lpad(i.cast("string"), 9, "0")).alias("path"), node.alias("node")))


def _opened(rows: DataFrame) -> DataFrame:
    """Up to ``LEVELS`` more levels of every tree moved from ``open`` to ``parts``."""
    for _ in range(LEVELS):
        rows = once(rows.select(
            "message_id", "large", F.concat("parts", F.transform("open", _part_of)).cast(PARTS).alias("parts"),
            F.flatten(F.transform("open", _children)).cast(NODES).alias("open")), "parts", "open")
    return rows


def _walk_large(messages: DataFrame) -> DataFrame:
    """The same for payloads beyond what Spark's JSON parser takes: one payload at a time in an Arrow-batched helper."""
    names = [c.split()[0] for c in ROW.split(", ")]

    # nested on purpose: the helper travels with the task, executors need no package install
    def pre_order(payload):
        try:
            stack = [json.loads(payload or "")]
        except (ValueError, RecursionError):
            yield 0, "", "", None, None, "payload is no JSON"
            return
        order = 0
        while stack:
            node = stack.pop()
            errors = []

            def take(owner, name, kind, default=None, errors=errors):
                value = owner.get(name)
                if value is None or isinstance(value, kind):
                    return value or default
                errors.append(f"{name} is no {kind.__name__}")
                return default

            if not isinstance(node, dict):
                yield order, "", "", None, None, "part is no dict"
                order += 1
                continue
            body = take(node, "body", dict, {})
            row = (order, take(node, "mimeType", str, ""), take(node, "filename", str, ""),
                   take(body, "attachmentId", str), take(body, "data", str))
            stack.extend(reversed(take(node, "parts", list, [])))
            yield *row, "; ".join(errors) or None
            order += 1

    def run(batches):
        for batch in batches:
            rows = [(m, *part) for m, p in zip(batch["message_id"], batch["payload"])
                    for part in pre_order(p)]
            yield pd.DataFrame(rows, columns=names)
    return messages.select("message_id", "payload").mapInPandas(run, ROW)


def walk_payloads(messages: DataFrame) -> DataFrame:
    """messages(message_id, payload JSON) → part rows in pre-order, any nesting depth.

    Trees are opened level by level inside their row, as arrays of VARIANT nodes: no shuffle and no Python. A pass opens a
    few levels of all trees; payloads that go deeper are taken up by another pass over them alone. Values of the wrong type are
    left out and named in ``error``; a bad payload never fails the job. JSON is taken strictly: a payload with a name twice in
    an object, NaN, or nested deeper than Spark's parser goes is no JSON. Payloads that are too large for it are walked by a
    helper instead, if there are any. Repeated rows give their parts each.
    """
    none, tree = F.lit(None).cast("string"), F.try_parse_json(F.coalesce("payload", F.lit("")))
    rows = once(messages.select(F.col("message_id").cast("string").alias("message_id"), "payload", tree.alias("tree")), "tree")
    bad = F.col("tree").isNull()
    error = F.array(_part(F.lit(""), none, none, none, none, F.lit("payload is no JSON")))
    root = F.array(F.struct(F.lit("").alias("path"), F.col("tree").alias("node")))
    large = F.when(bad & (F.length("payload") >= LARGE), F.col("payload"))
    left = rows.select("message_id", large.alias("large"), F.when(bad, error).otherwise(F.array()).cast(PARTS).alias("parts"),
                       F.when(~bad, root).otherwise(F.array()).cast(NODES).alias("open"))
    passes, too_large, more = [], None, True
    while more:
        table = written(_opened(left), "mime")
        passes.append(table.where((F.size("open") == 0) & F.col("large").isNull()).select("message_id", "parts"))
        left = table.where(F.size("open") > 0)
        more, n_large = table.agg(F.max(F.size("open") > 0), F.count("large")).head()
        if n_large:  # rows of the first pass, they have no tree to open
            too_large = table.where("large is not null").select("message_id", F.col("large").alias("payload"))
    out = reduce(DataFrame.unionByName, passes).select(
        "message_id", F.posexplode(F.array_sort("parts")).alias("part_order", "x")).select(
        "message_id", "part_order", "x.mime_type", "x.filename", "x.attachment_id", "x.data_b64url", "x.error")
    return out if too_large is None else out.unionByName(_walk_large(too_large))


def bodies(parts: DataFrame, order: str = "part_order") -> DataFrame:
    """First text/plain and first text/html body per message.

    A part with file name and attachment id is never a body. Only the winning part is decoded.
    """
    attached = "coalesce(filename, '') <> '' and coalesce(attachment_id, '') <> ''"
    is_body = F.expr(f"not ({attached}) and coalesce(data_b64url, '') <> ''")

    def first(mime):
        hit = is_body & (F.col("mime_type") == mime)
        return F.min_by(F.when(hit, F.col("data_b64url")), F.when(hit, F.col(order)))

    picked = parts.groupBy("message_id").agg(
        first("text/plain").alias("_t"), first("text/html").alias("_h"))
    return picked.select(
        "message_id", utf8_text(base64url_bytes(F.col("_t"))).alias("body_text"),
        utf8_text(base64url_bytes(F.col("_h"))).alias("body_html"))


def attachments(parts: DataFrame, order: str = "part_order") -> DataFrame:
    """Attachment rows in part order; the bytes stay where they are."""
    return parts.filter(
        "coalesce(filename, '') <> '' and coalesce(attachment_id, '') <> ''").select(
        "message_id", order, "filename", "attachment_id", "mime_type")


def first_pdf_attachment(parts: DataFrame, order: str = "part_order") -> DataFrame:
    """First PDF per message by part order."""
    pdf = attachments(parts, order).filter(
        "mime_type = 'application/pdf' or lower(filename) like '%.pdf'")
    return pdf.groupBy("message_id").agg(F.min_by(
        F.struct("filename", "attachment_id", "mime_type"), order).alias("_a")).select(
        "message_id", "_a.*")

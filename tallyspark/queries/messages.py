"""Sources, receipt filter, parsing, extraction and the whole document run."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.text import base64url_text, base64_text
from ..operators import audit, parse, receipts
from ..plans import intake
from ..sources import inbox, mime
from .core import bind, binding, query, table

# ---- sources --------------------------------------------------------------------------------


@query("backfill_messages", """
  select cast(o_orderkey as string) as message_id from {orders}
  where o_orderdate >= timestamp '1998-01-01 00:00:00'""")
def backfill_messages(spark, sf):
    messages = table(spark, sf, "orders").withColumnRenamed("o_orderdate", "received_at")
    return inbox.backfill(messages, 1998).select(
        F.col("o_orderkey").cast("string").alias("message_id"))


binding("changes", """
  select event_id as history_id, cast(user_id as string) as message_id, ts from {events}""")


def _cursor(spark, sf, until):
    return bind(spark, sf, "changes").filter(f"ts < timestamp_ntz'{until} 00:00:00'").agg(
        F.max("history_id").alias("history_id"))


@query("incremental_delta", """
  select message_id, min(history_id) as first_history_id from {changes}
  where history_id > (select max(history_id) from {changes} where ts < timestamp '2024-01-26')
  group by message_id""")
def incremental_delta(spark, sf):
    return inbox.changed_since(bind(spark, sf, "changes"), _cursor(spark, sf, "2024-01-26"))


@query("sync_cursor", "select max(history_id) as history_id from {changes}")
def sync_cursor(spark, sf):
    return inbox.next_cursor(bind(spark, sf, "changes"))


def _sync(spark, sf, until):
    changes = bind(spark, sf, "changes")
    retained = changes.filter("ts >= timestamp_ntz'2024-01-10 00:00:00'")
    seen = table(spark, sf, "events").filter("value > 250").select(
        F.col("user_id").cast("string").alias("message_id")).distinct()
    messages = changes.withColumnRenamed("ts", "received_at")
    return inbox.sync(messages, retained, _cursor(spark, sf, until), seen, 2024)


_SEEN = "(select cast(user_id as string) from {events} where value > 250)"


@query("expired_cursor_sync", f"""
  select distinct message_id from {{changes}} where message_id not in {_SEEN}""")
def expired_cursor_sync(spark, sf):
    """The cursor is older than the retained change log: full backfill minus seen."""
    return _sync(spark, sf, "2024-01-05")


@query("valid_cursor_sync", f"""
  select distinct message_id from {{changes}} where history_id >
    (select max(history_id) from {{changes}} where ts < timestamp '2024-01-28')
    and message_id not in {_SEEN}""")
def valid_cursor_sync(spark, sf):
    return _sync(spark, sf, "2024-01-28")


def _labelled(spark, sf):
    docs = table(spark, sf, "documents").withColumnRenamed("doc_id", "message_id")
    seen = table(spark, sf, "labels").select(F.col("doc_id").alias("message_id"))
    return docs, seen


@query("unseen_messages", """
  select doc_id as message_id, source from {documents}
  where doc_id not in (select doc_id from {labels})""")
def unseen_messages(spark, sf):
    docs, seen = _labelled(spark, sf)
    return inbox.unseen(docs, seen).select("message_id", "source")


@query("fetch_counts", """
  select cast(count_if(l.doc_id is null) as bigint) as received,
         cast(count_if(l.doc_id is not null) as bigint) as skipped
  from {documents} d left join (select distinct doc_id from {labels}) l on l.doc_id = d.doc_id""")
def fetch_counts(spark, sf):
    docs, seen = _labelled(spark, sf)
    return inbox.fetch_counts(docs.select("message_id"), seen)


@query("first_messages", """
  select conv_id as message_id, role, text from (select *, row_number() over (
    partition by conv_id order by turn) as r from {conversations}) where r = 1""")
def first_messages(spark, sf):
    rows = table(spark, sf, "conversations").withColumnRenamed("conv_id", "message_id")
    return inbox.first_per_message(rows, ["turn"]).select("message_id", "role", "text")


@query("intake_samples", """
  select message_id, 'email' as channel, subject, sender, attachment, body from {mail}""")
def intake_samples(spark, sf):
    mail = bind(spark, sf, "mail")
    sample = inbox.to_sample(intake.complete(mail))
    get = F.get_json_object
    return sample.select(
        "message_id", get("source", "$.channel").alias("channel"),
        get("source", "$.subject").alias("subject"), get("source", "$.sender").alias("sender"),
        get("source", "$.attachment").alias("attachment"), "body")


@query("stored_blobs", """
  select message_id, case when pdf and damaged then null when pdf then octet_length(encode(text)) end
           as stored_bytes from (
    select cast(conv_id as string) || '-' || cast(turn as string) as message_id, text,
           role <> 'user' as pdf, turn = 5 as damaged from {conversations})""")
def stored_blobs(spark, sf):
    conv = table(spark, sf, "conversations")
    b64 = base64_text(F.col("text").cast("binary"))
    df = conv.select(
        F.concat_ws("-", "conv_id", "turn").alias("message_id"),
        F.when(F.col("turn") == 5, F.concat(F.lit("**"), b64)).otherwise(b64).alias("b64"),
        F.when(F.col("role") == "user", "note.txt").otherwise("bill.PDF").alias("attachment"))
    blob = inbox.stored_blob(F.col("b64"), F.col("attachment"), F.lit(None).cast("string"),
                             F.lit(None).cast("binary"))
    return df.select("message_id", F.length(blob).cast("bigint").alias("stored_bytes"))


# ---- receipt filter -------------------------------------------------------------------------
# two words of the texts' invented languages join the defaults, so bodies can decide too
NON_RECEIPT = K.NON_RECEIPT_TELLS + ("oution", "einver")
_LOCAL = r"regexp_replace(split_part(lower(sender), '@', 1), '^\s+|\s+$', '', 'g')"
_TELLS = "'receipt|invoice|order confirmation|your order|payment|paid|purchase|subscription|renewal'"
binding("mail_signals", f"""
  select *, {_LOCAL} in ('billing','invoices','invoice','receipts','receipt','orders','order',
      'no-reply','noreply','payments','sales')
    or regexp_matches(lower(coalesce(subject, '')), {_TELLS})
    or coalesce(lower(attachment) like '%.pdf', false) as yes,
    regexp_matches(lower(coalesce(subject, '') || ' ' || coalesce(body, '')),
      '{"|".join(NON_RECEIPT)}') as no
  from {{mail}}""")
binding("mail_verdicts", f"""
  select *, yes or not no as is_receipt,
    cast(case when yes or no then 0.9 else 0.4 end as double) as confidence,
    case when yes then '{K.REASON_RECEIPT}' when no then '{K.REASON_NON_RECEIPT}'
         else '{K.REASON_UNCERTAIN}' end as reason from {{mail_signals}}""")


def _verdicts(spark, sf, answers=None):
    return receipts.verdicts(bind(spark, sf, "mail"), answers, non_receipt_tells=NON_RECEIPT)


@query("receipt_verdicts", "select message_id, is_receipt, confidence, reason from {mail_verdicts}")
def receipt_verdicts(spark, sf):
    return _verdicts(spark, sf).select("message_id", "is_receipt", "confidence", "reason")


@query("dropped_messages", """
  select message_id, sender, subject, is_receipt, confidence, reason from {mail_verdicts}
  where not is_receipt and confidence >= 0.7""")
def dropped_messages(spark, sf):
    return receipts.dropped(_verdicts(spark, sf))


@query("mailbox_drops", """
  select message_id, sender, subject, false as is_receipt, cast(0.9 as double) as confidence,
         'subject/body matched a newsletter/marketing tell' as reason
  from {mail_signals} where not yes and lower(coalesce(subject, '')) like '%digest%'""")
def mailbox_drops(spark, sf):
    """Mailbox path: the verdict is reached from the subject, bodies stay unread."""
    return receipts.dropped(receipts.verdicts(bind(spark, sf, "mail"), body=None))


@query("survivor_messages", """
  select message_id, case when role = 'assistant' then text else 'plain' end as body,
    case when lower(attachment) like '%.pdf' then attachment end as pdf
  from (select v.*, c.text from {mail_verdicts} v join {conversations} c
        on c.conv_id = v.conv_id and c.turn = v.turn)
  where not (not is_receipt and confidence >= 0.7)""")
def survivor_messages(spark, sf):
    kept = receipts.survivors(_verdicts(spark, sf))
    html = F.when(F.col("role") == "assistant", F.col("body")).otherwise("")
    files = F.array(
        F.struct(F.lit("readme.txt").alias("filename"), F.lit("text/plain").alias("mime_type")),
        F.struct(F.coalesce("attachment", F.lit("")).alias("filename"),
                 F.lit("application/octet-stream").alias("mime_type")))
    return kept.select("message_id", receipts.chosen_body(html, F.lit("plain")).alias("body"),
                       receipts.first_pdf(files)["filename"].alias("pdf"))


binding("mail_answers", """
  select message_id, case turn when 0 then '{"is_receipt":false,"confidence":0.8}'
      when 4 then '{"is_receipt":"true","confidence":0.8,"reason":"text, not a flag"}'
      when 6 then '{"is_receipt":false,"confidence":"0.55","reason":" maybe "}'
      when 7 then '{"is_receipt":false,"confidence":null}' else 'oops' end as json,
    case when conv_id < 20 then 'ConnectTimeout' when conv_id < 30 then 'RateLimitError' end
      as error_class
  from {mail}""")


@query("receipt_advisory_merge", f"""
  select message_id,
    case when used then false else is_receipt end as is_receipt,
    case when used then cast(case turn when 0 then 0.8 else 0.55 end as double)
         else confidence end as confidence,
    case when used then case turn when 0 then '{K.REASON_ADVISORY}' else 'maybe' end
         else reason end as reason,
    case when not yes and not no and error_class = 'RateLimitError' then error_class end
      as advisory_error
  from (select v.*, a.error_class, not yes and not no and error_class is null and turn in (0, 6)
          as used from {{mail_verdicts}} v join {{mail_answers}} a using (message_id))""")
def receipt_advisory_merge(spark, sf):
    return _verdicts(spark, sf, bind(spark, sf, "mail_answers")).select(
        "message_id", "is_receipt", "confidence", "reason", "advisory_error")


@query("receipt_requests", """
  select message_id, sender, subject, coalesce(attachment, '') <> '' as has_attachment,
         coalesce(body, '') as body from {mail_signals} where not yes and not no""")
def receipt_requests(spark, sf):
    req = receipts.undecided(bind(spark, sf, "mail"), non_receipt_tells=NON_RECEIPT)
    read = F.from_json("request", "sender string, subject string, has_attachment boolean,"
                                  " body string")
    return req.select("message_id", read.alias("r")).select("message_id", "r.*")


# ---- parsing --------------------------------------------------------------------------------
@query("payload_formats", """
  with p as (
    select *, coalesce(lower(attachment_path) like '%.pdf', false) as is_real_pdf,
      nullif(document, '{}') as d, nullif(case when body is not null then body else source_body end,
        '') as b from {web_documents})
  select message_id, is_real_pdf,
    case when d is not null then 'attachment' when b is not null then 'body' else 'none' end
      as location,
    case when is_real_pdf then 'pdf'
         when d is not null then case when lower(attachment) like '%.pdf' then 'pdf'
           when lower(attachment) like '%.jpg' then 'image' else 'attachment' end
         when b is not null then 'email_body' else 'unknown' end as format,
    case when d is not null and not is_real_pdf then 'metadata' else '' end as sections,
    case when is_real_pdf then '' else coalesce(d, b, '') end as text
  from p""")
def payload_formats(spark, sf):
    return parse.parse(intake.complete(bind(spark, sf, "web_documents"))).select(
        "message_id", "is_real_pdf", "location", "format",
        F.array_join("sections", ",").alias("sections"), "text")


@query("source_flags", r"""
  select message_id, coalesce(lower(attachment) like '%.pdf', false) as real_pdf,
    lower(attachment_path) like '%.pdf' or coalesce(lower(attachment) like '%.pdf', false)
      as has_pdf,
    coalesce(regexp_matches(lower(attachment), '\.(pdf|png|jpe?g|tiff?|gif|bmp)$'), false)
      as rasterisable
  from {web_documents}""")
def source_flags(spark, sf):
    path, name = F.col("attachment_path"), F.col("attachment")
    return bind(spark, sf, "web_documents").select(
        "message_id", parse.real_pdf(F.lit(None).cast("string"), F.lit("eA=="), name)
        .alias("real_pdf"), parse.has_source_pdf(path, name).alias("has_pdf"),
        parse.rasterisable(name).alias("rasterisable"))


@query("layout_header", """
  select doc_id, 'INV-' || split_part(doc_id, '-', 1) as invoice_number,
    case l_returnflag when 'A' then 'Final Vendor: ' || cast(l_suppkey as string)
         else 'Supplier ' || cast(l_suppkey as string) end as vendor_name,
    cast(cast(l_extendedprice as decimal(18,2)) as string) as total_amount,
    case when l_linestatus <> 'O' then 'USD' end as currency,
    cast(case when l_linestatus = 'O' then 3 else 5 end as bigint) as n_fields
  from (select *, cast(l_orderkey as string) || '-' || cast(l_linenumber as string) || '-'
          || cast(l_partkey as string) || '-' || cast(l_suppkey as string) || '-'
          || cast(cast(l_extendedprice as decimal(18,2)) as string) as doc_id from {lineitem})""")
def layout_header(spark, sf):
    h = F.col("layout_header")
    return parse.read_layout(bind(spark, sf, "layout_docs")).select(
        "doc_id", *[F.try_element_at(h, F.lit(k)).alias(k) for k in (
            "invoice_number", "vendor_name", "total_amount", "currency")],
        F.size(h).cast("bigint").alias("n_fields"))


@query("layout_line_items", """
  select doc_id, cast(pos as bigint) as pos,
    case pos when 0 then 'Part ' || cast(l_partkey as string) else 'Tax:' end as raw_description,
    case pos when 0 then cast(cast(l_quantity as int) as string)
         else case l_returnflag when 'R' then '1' end end as quantity,
    case pos when 1 then '2' end as unit_price,
    case pos when 0 then cast(cast(l_extendedprice as decimal(18,2)) as string)
         else cast(cast(l_tax as decimal(18,2)) as string) end as total
  from (select *, cast(l_orderkey as string) || '-' || cast(l_linenumber as string) || '-'
          || cast(l_partkey as string) || '-' || cast(l_suppkey as string) || '-'
          || cast(cast(l_extendedprice as decimal(18,2)) as string) as doc_id,
          unnest([0, 1]) as pos from {lineitem} where l_linestatus = 'O')""")
def layout_line_items(spark, sf):
    return parse.read_layout(bind(spark, sf, "layout_docs")).select(
        "doc_id", F.posexplode("layout_items").alias("pos", "i")).select(
        "doc_id", F.col("pos").cast("bigint").alias("pos"), "i.*")


@query("layout_prose", r"""
  with l as (select doc_id, regexp_replace(line, '^\s+|\s+$', '', 'g') as line, pos from (
      select doc_id, unnest(string_split(text, chr(10))) as line,
             generate_subscripts(string_split(text, chr(10)), 1) as pos from {documents})),
  c as (select doc_id, pos, list_transform(string_split(line, '|'),
          lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')) as cells from l where line like '%|%')
  select doc_id, cast(row_number() over (partition by doc_id order by pos) - 1 as bigint) as pos,
    cells[1] as raw_description, nullif(cells[2], '') as quantity,
    nullif(cells[3], '') as unit_price, nullif(cells[4], '') as total
  from c where len(cells) >= 4 and cells[1] <> '' and lower(cells[1]) <> 'description'""")
def layout_prose(spark, sf):
    """Pipe tables that occur in ordinary documents, read as line items."""
    docs = table(spark, sf, "documents").select(
        "doc_id", F.concat(F.lit("Line Items\n"), "text").alias("text"))
    return parse.read_layout(docs).select(
        "doc_id", F.posexplode("layout_items").alias("pos", "i")).select(
        "doc_id", F.col("pos").cast("bigint").alias("pos"), "i.*")


# ---- extraction -----------------------------------------------------------------------------
def extracted(spark, sf):
    return intake.read_documents(bind(spark, sf, "json_docs"))


_KEYED_LINES = """(select *, cast(l_orderkey as string) || '-' || cast(l_linenumber as string)
    || '-' || cast(l_partkey as string) || '-' || cast(l_suppkey as string) || '-'
    || cast(cast(l_extendedprice as decimal(18,2)) as string) as message_id,
    case when l_suppkey < 20 then 'PDF attachment' when l_suppkey < 40 then 'scanned image'
         else 'attachment' end as label,
    cast(cast(l_extendedprice as decimal(18,2)) as string) as price,
    l_suppkey < 90 as has_doc from {lineitem})"""


@query("header_fields", f"""
  select message_id,
    case when has_doc and l_returnflag in ('A', 'R')
      then 'Supplier ' || cast(l_suppkey as string) end as vendor_name,
    cast(case when not has_doc then 0.0 when l_returnflag = 'A' then 0.95 when l_returnflag = 'R'
      then 0.7 else 0.0 end as double) as vendor_conf,
    case when has_doc then case l_returnflag when 'A' then label || ': "Supplier '
        || cast(l_suppkey as string) || '"' when 'R' then 'read' end end as vendor_evidence,
    case when has_doc and l_linestatus = 'F' then 'café' end as currency,
    cast(case when has_doc and l_linestatus = 'F' then 0.9 else 0.0 end as double) as currency_conf,
    case when has_doc then label || ': "30 days"' end as terms_evidence,
    cast(case when has_doc and l_discount <= 0.095 then l_extendedprice end as double)
      as total_amount,
    case when not has_doc then 'invoice_number,invoice_date,due_date,vendor_name,sponsor_name,'
      || 'study_name,protocol_number,site_identifier,billing_period,currency,total_amount,tax,'
      || 'payment_terms' else 'due_date,'
      || case when l_returnflag = 'N' then 'vendor_name,' else '' end
      || 'sponsor_name,study_name,protocol_number,site_identifier,billing_period,'
      || case when l_linestatus = 'O' then 'currency,' else '' end || 'tax' end as missing_fields
  from {_KEYED_LINES}""")
def header_fields(spark, sf):
    return extracted(spark, sf).select(
        "message_id", "vendor_name", F.expr("field_confidence['vendor_name']").alias("vendor_conf"),
        F.expr("field_evidence['vendor_name']").alias("vendor_evidence"),
        F.expr("fields['currency']").alias("currency"),
        F.expr("field_confidence['currency']").alias("currency_conf"),
        F.expr("field_evidence['payment_terms']").alias("terms_evidence"),
        F.col("total_amount").cast("double").alias("total_amount"),
        F.array_join("missing_fields", ",").alias("missing_fields"))


@query("extracted_counts", f"""
  select message_id, cast(case when not has_doc then 0 else 6
      - case when l_returnflag = 'N' then 1 else 0 end
      - case when l_linestatus = 'O' then 1 else 0 end end as bigint) as fields_extracted,
    cast(case when has_doc then 2 else 0 end as bigint) as line_items
  from {_KEYED_LINES}""")
def extracted_counts(spark, sf):
    df = extracted(spark, sf)
    return df.select("message_id", (F.size("field_confidence") - F.size("missing_fields"))
                     .cast("bigint").alias("fields_extracted"),
                     F.size("lines").cast("bigint").alias("line_items"))


@query("line_items_normalised", f"""
  select message_id, cast(pos as bigint) as pos,
    case pos when 0 then 'Part P' || cast(l_partkey as string)
      || case l_linestatus when 'O' then ' flight' else ' office supplies' end
      else 'ticket' end as raw_description,
    cast(case pos when 0 then cast(l_quantity as int) end as double) as quantity,
    cast(case pos when 0 then case when l_tax > 0.07 then null else l_extendedprice end
         else case when l_tax < 0.005 then null else 0 end end as double) as total,
    cast(case pos when 0 then case when l_tax > 0.07 then 0.6 else 0.9 end else 0.85 end as double)
      as extraction_confidence
  from (select *, unnest([0, 1]) as pos from {_KEYED_LINES} where has_doc)""")
def line_items_normalised(spark, sf):
    df = extracted(spark, sf)
    return df.select("message_id", F.inline("lines")).select(
        "message_id", F.col("pos").cast("bigint").alias("pos"), "raw_description",
        F.col("quantity").cast("double").alias("quantity"),
        F.col("total").cast("double").alias("total"), "extraction_confidence")


_FAILS = "(has_doc and (l_quantity > 48 or l_discount > 0.095 or l_tax < 0.005))"


@query("schema_gate", f"select message_id, {_FAILS} as failed from {_KEYED_LINES}")
def schema_gate(spark, sf):
    return extracted(spark, sf).select("message_id", F.col("extract_error").alias("failed"))


# ---- mailbox payloads -----------------------------------------------------------------------
def _parts(spark, sf):
    return bind(spark, sf, "mime_turns").withColumn(
        "data_b64url", base64url_text(F.col("text").cast("binary")))


@query("mime_bodies", """
  select message_id, arg_min(text, part_order) filter (mime_type = 'text/plain' and filename = '')
           as body_text,
         arg_min(text, part_order) filter (mime_type = 'text/html' and filename = '') as body_html
  from {mime_turns} group by message_id""")
def mime_bodies(spark, sf):
    return mime.bodies(_parts(spark, sf))


@query("mime_attachments", """
  select message_id, cast(part_order as int) as part_order, filename, attachment_id, mime_type
  from {mime_turns} where filename <> ''""")
def mime_attachments(spark, sf):
    return mime.attachments(_parts(spark, sf))


@query("mime_first_pdf", """
  select message_id, arg_min(filename, part_order) as filename from {mime_turns}
  where mime_type = 'application/pdf' or lower(filename) like '%.pdf' group by message_id""")
def mime_first_pdf(spark, sf):
    return mime.first_pdf_attachment(_parts(spark, sf)).select("message_id", "filename")


binding("mime_trees", """
  select cast(conv_id as string) || '-' || cast(turn as string) as message_id, role, turn, text
  from {conversations}""")


@query("mime_tree_bodies", """
  select message_id, case when role = 'user' then 'first' else text end as body_text,
         text as body_html from {mime_trees}""")
def mime_tree_bodies(spark, sf):
    """Nested payload JSON per message, walked to parts and reduced to bodies."""
    df = bind(spark, sf, "mime_trees")
    data = base64url_text(F.col("text").cast("binary"))
    lead = F.when(F.col("role") == "user", F.concat(
        F.lit('{"mimeType":"text/plain","body":{"data":"'),
        base64url_text(F.lit("first").cast("binary")), F.lit('"}},'))).otherwise("")
    payload = F.concat(
        F.lit('{"mimeType":"multipart/mixed","body":{},"parts":['), lead,
        F.lit('{"mimeType":"multipart/alternative","parts":['
              '{"mimeType":"text/plain","body":{"data":"'), data,
        F.lit('"}},{"mimeType":"text/html","body":{"data":"'), data,
        F.lit('"}}]},{"mimeType":"text/plain","filename":"a.txt",'
              '"body":{"attachmentId":"x","data":"eA"}}]}'))
    parts = mime.walk_payloads(df.select("message_id", payload.alias("payload")))
    return mime.bodies(parts)


_BROKEN = ('{"mimeType":"text/plain","body":"loose text"}', '{"mimeType":"text/plain","parts":"none","body":{"data":"eA"}}',
           '{"mimeType":7,"filename":"a.txt","body":{"attachmentId":1,"data":"eA"}}', "[1]", "no json", '{"parts":[3,{"mimeType":"text/plain"}]}')
_BROKEN_PARTS = (  # payload number, part, type, error
    (0, 0, "text/plain", "body is no dict"), (1, 0, "text/plain", "parts is no list"),
    (2, 0, "", "mimeType is no str; attachmentId is no str"), (3, 0, "", "part is no dict"),
    (4, 0, "", "payload is no JSON"), (5, 0, "", None), (5, 1, "", "part is no dict"), (5, 2, "text/plain", None))


@query("mime_malformed", """
  select message_id, cast(p as int) as part_order, mime, error from (
    select message_id, (turn + length(text)) % 6 as kind from {mime_trees}) t
  join (values """ + ", ".join("({}, {}, '{}', {})".format(a, b, c, f"'{d}'" if d else "null") for a, b, c, d in _BROKEN_PARTS) + """)
    as e(kind2, p, mime, error) on kind = kind2""")
def mime_malformed(spark, sf):
    """Payloads with values of the wrong type: named in the parts, never fatal."""
    kind = F.pmod(F.col("turn") + F.char_length("text"), F.lit(6)).cast("int")
    payload = F.get(F.array(*[F.lit(b) for b in _BROKEN]), kind)
    parts = mime.walk_payloads(bind(spark, sf, "mime_trees").select("message_id", payload.alias("payload")))
    return parts.select("message_id", "part_order", F.col("mime_type").alias("mime"), "error")


# ---- the whole run --------------------------------------------------------------------------
def _run(spark, sf, *columns):
    docs = bind(spark, sf, "json_docs").withColumn(
        "created_at", F.col("received_at").cast("timestamp"))
    return intake.process(docs, columns=columns)


binding("json_results", f"""
  select message_id, l_shipdate, case when {_FAILS} then 'failed'
    when has_doc and l_returnflag = 'A' and l_linestatus = 'O' and l_tax <= 0.07 then 'posted'
    else 'held' end as status, has_doc, l_linestatus, l_returnflag from {_KEYED_LINES}""")


@query("document_outcomes", """
  select message_id, status, case when status = 'failed' then 'extraction_failed' end as error_kind,
    case when status <> 'failed' then case when has_doc then case l_linestatus when 'O'
      then 'Travel' else 'Office expense' end end end as category
  from {json_results}""")
def document_outcomes(spark, sf):
    done = _run(spark, sf, "message_id", "category")
    return done.select("message_id", "status", "error_kind", F.when(
        F.col("status") != "failed", F.col("category")).alias("category"))


_ITEM_SQL = "'inv_' || sha256('email|' || message_id)"


@query("stage_events", f"""
  with numbered as (
    select *, row_number() over (partition by status order by l_shipdate, substr(md5({_ITEM_SQL}), 1, 2), {_ITEM_SQL}) as n,
      cast(split_part(message_id, '-', 4) as int) as supplier from {{json_results}})
  select message_id, cast(seq as bigint) as seq, case when seq < 3 or status <> 'failed' then
      case seq when 1 then 'received' when 2 then 'parsed' when 3 then 'extracted'
        when 4 then 'classified' when 5 then 'categorized' else status end
      else 'failed' end as action,
    case when seq = 1 or seq = 2 or status = 'failed' then 'system' else 'ai' end as actor,
    case when seq = 1 then 'email' when seq = 2 then case when has_doc then case when supplier < 20 then 'pdf'
          when supplier < 40 then 'image' else 'attachment' end when supplier >= 95 then 'email_body' else 'unknown' end
      when status = 'failed' then 'extraction_failed' when seq = 3 then case when has_doc then '2' else '0' end
      when seq = 6 and status = 'posted' then 'Ledger!A' || cast(n as varchar) || ':F' || cast(n as varchar) end as detail
  from (select *, unnest([1, 2, 3, 4, 5, 6]) as seq from numbered)
  where status <> 'failed' or seq <= 3""")
def stage_events(spark, sf):
    """The run's events with one telling detail each: channel, format, lines, ledger reference, kind of failure."""
    done = _run(spark, sf, *audit.EVENT_COLUMNS, "category", "invoice_date", "error_message")
    at = F.lit("2026-01-01 00:00:00").cast("timestamp")
    nothing = spark.createDataFrame([], "idempotency_key string, sheet_row_ref string")
    filed = intake.file_rows(done, nothing, nothing.agg(F.count("*").alias("n")))
    rows = audit.stage_events(intake.with_refs(done, filed).withColumn("run_ts", at), "run-1", "message_id")
    read = F.from_json("details", "channel string, format string, line_items string, sheet_row_ref string, kind string")
    return rows.withColumn("d", read).select(
        "message_id", "seq", "action", "actor", F.coalesce(
            "d.channel", "d.format", "d.line_items", "d.sheet_row_ref", "d.kind").alias("detail"))


@query("document_duplicates", """
  select message_id || '#' || cast(k as varchar) as message_id,
    case when k = 2 and status = 'posted' then 'held' else status end as status,
    case when k = 2 and status = 'posted' then message_id || '#1' end as duplicate_of
  from {json_results}, (values (1), (2)) as copies(k)""")
def document_duplicates(spark, sf):
    """Every document comes twice, a day apart: the copies of posted ones are held."""
    docs = bind(spark, sf, "json_docs").withColumn("k", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn(
        "message_id", F.concat_ws("#", "message_id", "k")).withColumn(
        "created_at", F.timestamp_seconds(F.unix_seconds(F.col("received_at").cast("timestamp")) + F.col("k") * 86400))
    done = intake.process(docs.drop("k"), columns=["message_id"])
    names = done.filter("status = 'posted'").select(F.col("invoice_id").alias("duplicate_of"), F.col("message_id").alias("first"))
    return done.select("message_id", "status", "duplicate_of").join(names, "duplicate_of", "left").select(
        "message_id", "status", F.col("first").alias("duplicate_of"))


@query("run_exceptions", """
  select status, count(*) as items from {json_results} where status = 'failed' group by status""")
def run_exceptions(spark, sf):
    """Failed documents seen through their exception rows."""
    rows = intake.exceptions_of(_run(spark, sf, "error_message", "risk_flags")).filter("type = 'extraction_failed'")
    return rows.groupBy(F.lit("failed").alias("status")).agg(F.count(F.lit(1)).alias("items"))


# Up to four appends per item; which one succeeds follows from the length of its message id.
binding("append_tries", """
  select message_id, cast(k as int) as attempt, (length(message_id) + k) % 4 = 0 as ok,
         (length(message_id) / 4 + k) % 2 < 1 as ok_later
  from {json_docs}, (values (1), (2), (3), (4)) as tries(k)""")


def _filed(spark, sf, ok):
    return bind(spark, sf, "append_tries").select(
        parse.item_id(F.lit(None), F.col("message_id")).alias("item_id"), "attempt", F.col(ok).alias("ok"))


@query("filing_outcomes", """
  select message_id, case when lost then 'failed' else status end as status,
    case when lost then 'sheet_write_failed' when status = 'failed' then 'extraction_failed' end as error_kind
  from (select *, status = 'posted' and length(message_id) % 4 = 0 as lost from {json_results})""")
def filing_outcomes(spark, sf):
    done = intake.file_attempts(_run(spark, sf, "message_id", "error_message"), _filed(spark, sf, "ok"))
    return done.select("message_id", "status", "error_kind")


@query("recover_filings", """
  select message_id, status, case when status = 'failed' then 'extraction_failed' end as error_kind
  from {json_results}""")
def recover_filings(spark, sf):
    """What the first appends lost is filed by later ones."""
    done = intake.file_attempts(_run(spark, sf, "message_id", "error_message"), _filed(spark, sf, "ok"))
    later = intake.recover_filings(done, _filed(spark, sf, "ok_later"))
    return later.select("message_id", "status", "error_kind")


@query("run_citations", """
  select message_id, '0,1' as word_indices, 'extracted' as status from {json_results}
  where status <> 'failed' and has_doc and l_returnflag in ('A', 'R')""")
def run_citations(spark, sf):
    """Citations on the ``extracted`` events of a run whose documents have a page of words."""
    docs = bind(spark, sf, "json_docs").withColumn("created_at", F.col("received_at").cast("timestamp"))
    number = F.get(F.split("message_id", "-"), F.lit(3))
    word = (lambda i, text: F.struct(
        F.lit(i).alias("index"), text.alias("text"), F.lit(0.1 * i).alias("x"), F.lit(0.1).alias("y"),
        F.lit(0.1).alias("width"), F.lit(0.02).alias("height")))
    pages = docs.select(parse.item_id(F.lit(None), F.col("message_id")).alias("doc_id"), F.lit(1).alias("page_number"),
                        F.array(word(0, F.lit("Supplier")), word(1, number), word(2, F.lit("thanks"))).alias("words"))
    done = intake.process(docs, pages=pages, columns=[*audit.EVENT_COLUMNS, "error_message"]).withColumn("run_ts", F.col("created_at")).withColumn(
        "sheet_row_ref", F.lit(None).cast("string")).withColumn("deduped", F.lit(False))
    events = audit.stage_events(done, "run-1", "message_id").filter("action = 'extracted'")
    cited = F.from_json(F.get_json_object("details", "$.citations"),
                        "array<struct<target_id:string,word_indices:array<int>,status:string>>")
    return events.select("message_id", F.explode(cited).alias("c")).filter(
        "c.target_id = 'metadata.vendor_name'").select(
        "message_id", F.array_join("c.word_indices", ",").alias("word_indices"), "c.status")

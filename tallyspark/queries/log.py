"""Queries over the event log: overlays, statuses, reviewer read models, metrics, reruns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators import audit, decide, metrics, overlays, review
from ..plans import intake
from .core import bind, binding, query

FIELDS = ("vendor_name", "total_amount", "invoice_date", "currency")

# ---- overlays -------------------------------------------------------------------------------
binding("latest_fields", """
  select invoice_id, field, after_value from (
    select *, row_number() over (partition by invoice_id, field order by ts desc, seq desc) as r
    from {corrections} where target = 'metadata') where r = 1""")


@query("metadata_overlay", """
  select invoice_id, field, after_value as value from {latest_fields}""")
def metadata_overlay(spark, sf):
    return overlays.metadata_overlay(bind(spark, sf, "correction_log"))


binding("latest_category", """
  select invoice_id, after_value as corrected_category from (
    select *, row_number() over (partition by invoice_id order by ts desc, seq desc) as r
    from {corrections} where target = 'category' and coalesce(after_value, '') <> '') where r = 1""")


@query("category_overlay", "select * from {latest_category}")
def category_overlay(spark, sf):
    return overlays.category_overlay(bind(spark, sf, "correction_log"))


@query("line_overlay", """
  select invoice_id, 'L' || cast(n as string) as line_item_id, 'C' || cast(n as string)
           as catalog_item_id, after_value as catalog_description
  from (select *, row_number() over (partition by invoice_id, n order by ts desc, seq desc) as r
        from {corrections} where target = 'line_item' and n <> 0) where r = 1""")
def line_overlay(spark, sf):
    return overlays.line_overlay(bind(spark, sf, "correction_log"))


def _base(spark, sf):
    base = bind(spark, sf, "base_fields")
    return base.select("invoice_id", F.create_map(
        *[x for f in FIELDS for x in (F.lit(f), F.col(f))]).alias("fields"))


_WIDE = "select b.invoice_id, " + ", ".join(
    f"coalesce(nullif(max(case when l.field = '{f}' then l.after_value end), ''), b.{f}) as {f}"
    for f in FIELDS) + """ from {base_fields} b left join {latest_fields} l
    on l.invoice_id = b.invoice_id group by b.invoice_id, """ + ", ".join(
    f"b.{f}" for f in FIELDS)
binding("effective", _WIDE)


@query("effective_metadata", """
  select invoice_id, vendor_name, invoice_date, currency,
         cast(try_cast(total_amount as decimal(18,4)) as double) as total_amount,
         try_cast(total_amount as decimal(18,4)) is null as invalid_override from {effective}""")
def effective_metadata(spark, sf):
    df = overlays.effective_metadata(
        _base(spark, sf), overlays.metadata_overlay(bind(spark, sf, "correction_log")))
    return df.select("invoice_id", *[F.expr(f"fields['{f}']").alias(f) for f in (
        "vendor_name", "invoice_date", "currency")],
        F.col("total_amount").cast("double").alias("total_amount"), "invalid_override")


binding("matches", """
  select cast(user_id as string) as invoice_id, 'L' || cast(n as string) as line_item_id,
         min('C0') as catalog_item_id, min('engine ' || event_type) as catalog_description,
         cast(0.5 as double) as confidence, true as requires_exception_review,
         min('keyword') as rationale
  from {event_numbers} where event_type <> 'view' group by user_id, n""")


@query("corrected_matches", """
  with o as (select invoice_id, 'L' || cast(n as string) as line_item_id, n, after_value
    from (select *, row_number() over (partition by invoice_id, n order by ts desc, seq desc) as r
          from {corrections} where target = 'line_item' and n <> 0) where r = 1)
  select m.invoice_id, m.line_item_id,
    case when o.n is not null then 'C' || cast(o.n as string) else catalog_item_id end
      as catalog_item_id,
    case when o.n is not null then after_value else catalog_description end as catalog_description,
    cast(case when o.n is not null then 1.0 else confidence end as double) as confidence,
    o.n is null as requires_exception_review,
    case when o.n is not null then '' else 'weak_match' end as exceptions,
    case when o.n is not null then 'corrected by reviewer' else rationale end as rationale
  from {matches} m left join o using (invoice_id, line_item_id)""")
def corrected_matches(spark, sf):
    matches = bind(spark, sf, "matches").withColumn("exceptions", F.array(F.lit("weak_match")))
    df = overlays.apply_line_overlay(
        matches, overlays.line_overlay(bind(spark, sf, "correction_log")))
    return df.withColumn("exceptions", F.array_join("exceptions", ","))


@query("latest_details", """
  select invoice_id, action, details, epoch_us(ts) as at_us from (
    select *, row_number() over (partition by invoice_id, action order by ts desc, seq desc) as r
    from {audit}) where r = 1""")
def latest_details(spark, sf):
    return overlays.latest_details(bind(spark, sf, "audit")).select(
        "invoice_id", "action", "details", F.unix_micros("ts").alias("at_us"))


binding("extraction_log", """
  select 'ext-' || invoice_id as event_id, invoice_id, cast(-1 as bigint) as seq,
         timestamp '2024-01-01 00:00:00' as ts, 'ai' as actor, 'extracted' as action,
         '{"field_confidence":{"vendor_name":0.9,"total_amount":0.75,"invoice_date":'
           || case when invoice_date is null then '0.0' else '0.95' end
           || ',"currency":0.9},"field_evidence":{"vendor_name":"read"},"missing_fields":['
           || case when invoice_date is null then '"invoice_date",' else '' end || '"tax"]}'
           as details
  from {base_fields}
  union all
  select 'rec-' || invoice_id, invoice_id, cast(-2 as bigint), timestamp '2024-01-01 00:00:00',
         'system', 'received', '{"channel":"email","message_id":"m' || invoice_id
           || '","subject":"' || case when invoice_date is null then 'office chairs' else 'hello'
           end || '","sender":"a@b.example"}'
  from {base_fields}""")


def _rerun_log(spark, sf):
    return bind(spark, sf, "correction_log").unionByName(bind(spark, sf, "extraction_log"))


_CONF = {"vendor_name": "0.9", "total_amount": "0.75",
         "invoice_date": "case when b.invoice_date is null then 0.0 else 0.95 end",
         "currency": "0.9"}
binding("rerun_base", "select b.invoice_id, b.vendor_name as base_vendor, " + ", ".join(
    f"cast(case when max(case when l.field = '{f}' and coalesce(l.after_value, '') <> '' "
    f"then 1 end) = 1 then 1.0 else {c} end as double) as conf_{f}" for f, c in _CONF.items())
    + """, max(case when l.field = 'invoice_date' and coalesce(l.after_value, '') <> '' then 1 end)
      is null and b.invoice_date is null as date_missing
  from {base_fields} b left join {latest_fields} l on l.invoice_id = b.invoice_id
  group by b.invoice_id, b.vendor_name, b.invoice_date""")


@query("rerun_inputs", """
  select invoice_id, conf_vendor_name as vendor_conf, conf_total_amount as total_conf,
         conf_invoice_date as date_conf, case when conf_vendor_name = 1.0 then
           'corrected by reviewer' else 'read' end as vendor_evidence,
         case when date_missing then 'invoice_date,tax' else 'tax' end as missing_fields
  from {rerun_base}""")
def rerun_inputs(spark, sf):
    return overlays.rerun_inputs(_rerun_log(spark, sf)).select(
        "invoice_id", F.expr("field_confidence['vendor_name']").alias("vendor_conf"),
        F.expr("field_confidence['total_amount']").alias("total_conf"),
        F.expr("field_confidence['invoice_date']").alias("date_conf"),
        F.expr("field_evidence['vendor_name']").alias("vendor_evidence"),
        F.array_join("missing_fields", ",").alias("missing_fields"))


@query("correction_before_after", """
  select c.invoice_id, c.field, event_id,
    coalesce(nullif(lag(after_value) over (partition by c.invoice_id, c.field order by ts, seq), ''),
      case c.field when 'vendor_name' then b.vendor_name when 'total_amount' then b.total_amount
        when 'invoice_date' then b.invoice_date else b.currency end) as before_value,
    after_value
  from {corrections} c left join {base_fields} b on b.invoice_id = c.invoice_id
  where target = 'metadata'""")
def correction_before_after(spark, sf):
    base = _base(spark, sf).select("invoice_id", F.explode("fields").alias("field", "ai_value"))
    return overlays.before_after(bind(spark, sf, "correction_log"), base)


@query("current_status", """
  select invoice_id, case action when 'rerun' then 'rerun_requested' else action end as status from (
    select *, row_number() over (partition by invoice_id order by ts desc, seq desc) as r from {audit}
    where action not in ('note', 'reviewed')) where r = 1""")
def current_status(spark, sf):
    return overlays.current_status(bind(spark, sf, "audit"))


binding("terminals", """
  select invoice_id, action, json_extract_string(details, '$.reason') as reason,
         json_extract_string(details, '$.rationale') as why, details from (
    select *, row_number() over (partition by invoice_id order by ts desc, seq desc) as r
    from {audit} where action in ('posted', 'held', 'failed', 'rejected')) where r = 1""")


@query("terminal_events", """
  select invoice_id, action, coalesce(reason, why) as rationale,
         case action when 'held' then '[{"type":"total_mismatch"}]' else '[]' end as risk_flags
  from {terminals}""")
def terminal_events(spark, sf):
    return overlays.terminal_events(bind(spark, sf, "audit")).drop("ts")


@query("ledger_statuses", """
  select invoice_id, case action
    when 'posted' then 'Posted to ledger (ref ' || json_extract_string(details, '$.sheet_row_ref')
      || ')' when 'failed' then 'Failed: ' || coalesce(reason, 'unknown error')
    when 'held' then 'Held — not posted' else 'Rejected — not a receipt' end as ledger_status
  from {terminals}""")
def ledger_statuses(spark, sf):
    last = overlays.latest_details(bind(spark, sf, "audit"), K.TERMINAL_ACTIONS, per_action=False)
    return last.select("invoice_id", overlays.ledger_status(
        F.col("action"), overlays.detail("sheet_row_ref"), overlays.detail("reason"))
        .alias("ledger_status"))


@query("confidence_bands", """
  select invoice_id, case when round(category_confidence, 2) = 0 then 'muted'
      when category_confidence < 0.6 then 'conf-low' when category_confidence < 0.85
      then 'conf-mid' else 'conf-high' end as band,
    case when category_confidence = 0 then '—'
      else cast(cast(round(category_confidence * 100) as int) as string) || '%' end as shown
  from {judged}""")
def confidence_bands(spark, sf):
    conf = F.nullif(F.col("category_confidence"), F.lit(0.0))
    return bind(spark, sf, "judged").select(
        "invoice_id", overlays.confidence_band(conf).alias("band"),
        metrics.percent_text(conf).alias("shown"))


_AI = " union all ".join(
    f"select invoice_id, '{f}' as field, {f} as ai_value from {{base_fields}}" if f in FIELDS
    else f"select invoice_id, '{f}', cast(null as string) from {{base_fields}}"
    for f in K.HEADER_FIELDS)


@query("ai_vs_human", f"""
  select a.invoice_id, a.field, a.ai_value, l.after_value as human_value,
         case when l.field is not null then l.after_value else a.ai_value end as shown_value,
         l.field is not null as corrected
  from ({_AI}) a(invoice_id, field, ai_value) left join {{latest_fields}} l
    on l.invoice_id = a.invoice_id and l.field = a.field""")
def ai_vs_human(spark, sf):
    return overlays.ai_versus_human(
        _base(spark, sf), overlays.metadata_overlay(bind(spark, sf, "correction_log")))


@query("correction_diff", """
  select c.event_id, concat_ws(',', case when after_value <> '' and after_value <>
      coalesce(case field when 'vendor_name' then e.vendor_name when 'total_amount'
        then e.total_amount when 'invoice_date' then e.invoice_date else e.currency end, '')
      then field || '=' || after_value end,
      case when coalesce(e.vendor_name, '') <> 'Vendor 7' and field <> 'vendor_name'
      then 'vendor_name=Vendor 7' end) as updates
  from {corrections} c join {effective} e using (invoice_id) where target = 'metadata'
    and after_value is not null""")
def correction_diff(spark, sf):
    log = bind(spark, sf, "corrections").filter(
        "target = 'metadata' and after_value is not null")
    effective = overlays.effective_metadata(
        _base(spark, sf), overlays.metadata_overlay(bind(spark, sf, "correction_log")))
    edits = log.select("invoice_id", "event_id", F.when(
        F.col("field") == "vendor_name", F.create_map("field", "after_value")).otherwise(
        F.create_map("field", "after_value", F.lit("vendor_name"), F.lit("Vendor 7")))
        .alias("edits"))
    diff = overlays.correction_diff(edits, effective)
    return diff.select("event_id", F.array_join(F.transform(
        F.map_entries("updates"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
        .alias("updates"))


@query("category_options", """
  select invoice_id, concat_ws('; ', category, case when coalesce(category, '') <> 'Travel'
    then 'Travel' end, case when coalesce(category, '') <> 'Meals' then 'Meals' end) as options
  from {judged}""")
def category_options(spark, sf):
    alternates = F.array(F.lit("Travel"), F.lit("Meals"), F.lit("Travel"))
    return bind(spark, sf, "judged").select("invoice_id", F.array_join(
        overlays.category_options(F.col("category"), alternates), "; ").alias("options"))


@query("corrections_validated", """
  select event_id as request_id, case target
    when 'metadata' then case when n >= 75 then 'unknown field(s): colour, shape' end
    when 'line_item' then case when not exists (select 1 from {matches} m
      where m.invoice_id = c.invoice_id and m.line_item_id = 'L' || cast(c.n + 1 as string))
      then 'line item not found' end end as error
  from {corrections} c""")
def corrections_validated(spark, sf):
    lines = bind(spark, sf, "matches").select("invoice_id", F.col("line_item_id").alias("id"))
    batch = bind(spark, sf, "corrections").select(
        F.col("event_id").alias("request_id"), "invoice_id", "target",
        F.concat(F.lit("L"), (F.col("n") + 1).cast("string")).alias("line_item_id"),
        F.when(F.col("n") >= 75, F.create_map(
            F.lit("shape"), F.lit("1"), F.lit("currency"), F.lit("2"), F.lit("colour"), F.lit("3")))
        .otherwise(F.create_map("field", "after_value")).alias("updates"))
    return overlays.validate_corrections(batch, lines).select("request_id", "error")


# ---- reviewer actions, attempts -------------------------------------------------------------
binding("review_actions", """
  select event_id as request_id, cast(user_id as string) as invoice_id, ts as acted_at, n,
         case event_type when 'signup' then 'correct' when 'view' then 'reject'
              when 'click' then 'escalate' when 'error' then case when n < 50 then 'confirm'
              else 'note' end else case when n < 50 then 'review' else 'unknown' end end as action,
         case when n < 30 then 'metadata' when n < 60 then 'line_item' else 'category' end
           as target,
         'T' || cast(n as string) as target_id, case when n > 90 then 'because' end as reason
  from {event_numbers}""")


@query("reviewer_actions", """
  select invoice_id, case action when 'correct' then 'corrected' when 'reject' then 'rejected'
      when 'escalate' then 'escalated' when 'confirm' then 'confirmed' when 'review'
      then 'reviewed' when 'note' then 'note' end as action,
    case action when 'correct' then 'corrected' when 'reject' then 'rejected' when 'escalate'
      then 'escalated' end as new_status,
    case when action = 'correct' then target end as target,
    case when action = 'correct' and target = 'line_item' then target_id end as line_item_id,
    case when action = 'confirm' then target_id end as target_id,
    case when action = 'correct' then cast(n as string) end as after_value,
    case when action <> 'unknown' then reason end as reason,
    epoch_us(acted_at) as at_us, case when action = 'unknown' then 'unknown action' end as error
  from {review_actions}""")
def reviewer_actions(spark, sf):
    acts = bind(spark, sf, "review_actions")
    acts = acts.withColumn("before", F.create_map(F.lit("k"), F.lit("old"))).withColumn(
        "updates", F.create_map(F.lit("k"), F.col("n").cast("string")))
    d = overlays.detail
    return audit.reviewer_actions(acts).select(
        "invoice_id", "action", "new_status", d("target").alias("target"),
        d("line_item_id").alias("line_item_id"), d("target_id").alias("target_id"),
        d("after.k").alias("after_value"), d("reason").alias("reason"),
        F.unix_micros("ts").alias("at_us"), "error")


@query("checked_actions", """
  select request_id, case when cast(invoice_id as int) % 11 = 0 then 'item not found'
      when action = 'unknown' then 'unknown action'
      when action = 'correct' and target = 'metadata' and n % 2 = 0 then 'unknown field(s): k'
      when action = 'correct' and target = 'line_item' and n % 3 > 0 then 'line item not found'
      when action = 'review' and cast(invoice_id as int) % 2 = 0 then 'uncertain citations are open' end as error
  from {review_actions}""")
def checked_actions(spark, sf):
    """Every request comes back once, with the reason if it is rejected."""
    acts = bind(spark, sf, "review_actions").withColumn("before", F.create_map(F.lit("k"), F.lit("old"))).withColumn(
        "updates", F.when(F.col("n") % 2 == 0, F.create_map(F.lit("k"), F.lit("1"))).otherwise(
            F.create_map(F.lit("currency"), F.lit("EUR"))))
    number = F.col("invoice_id").cast("int")
    lines = acts.filter("n % 3 = 0").select("invoice_id", F.col("target_id").alias("id"))
    return audit.reviewer_actions(audit.check_actions(
        acts, acts.filter(number % 11 != 0), lines, acts.filter(number % 2 == 0)).withColumn(
        "invoice_id", F.col("request_id"))).select(F.col("invoice_id").alias("request_id"), "error")


binding("attempts", """
  select cast(l_orderkey as string) as item_id, cast(l_linenumber as int) as attempt,
         l_returnflag = 'A' as ok from {lineitem}""")


@query("attempt_outcomes", """
  select item_id, case when min(case when ok and attempt <= 3 then attempt end) is null then 'failed'
           else 'posted' end as status,
         cast(coalesce(min(case when ok and attempt <= 3 then attempt end),
                       max(case when attempt <= 3 then attempt end), 0) as bigint) as attempts_used
  from {attempts} group by item_id""")
def attempt_outcomes(spark, sf):
    return audit.attempt_outcomes(bind(spark, sf, "attempts"))


@query("retry_eligible", """
  select t.invoice_id, json_extract_string(details, '$.kind') as kind,
         json_extract_string(details, '$.kind') in ('extraction_failed', 'sheet_write_failed')
           as retryable from {terminals} t where action = 'failed'""")
def retry_eligible(spark, sf):
    last = overlays.latest_details(bind(spark, sf, "audit"), K.TERMINAL_ACTIONS, per_action=False)
    items = last.withColumnRenamed("action", "status")
    kind = overlays.detail("kind")
    return intake.recoverable(items).select(
        "invoice_id", kind.alias("kind"), decide.is_retryable(kind).alias("retryable"))


# ---- metrics --------------------------------------------------------------------------------
@query("first_decisions", """
  select invoice_id, arg_min(action, seq) filter (action in ('posted', 'held')) as first_decision,
         bool_or(actor = 'human') as human_touched,
         bool_or(actor = 'human' and action in ('corrected', 'escalated')) as human_confirmed,
         coalesce(string_agg(distinct action, ',' order by action) filter (actor = 'human'), '')
           as human_actions
  from {audit} group by invoice_id""")
def first_decisions(spark, sf):
    return metrics.first_decisions(bind(spark, sf, "audit")).withColumn(
        "human_actions", F.array_join("human_actions", ","))


@query("workflow_metrics", """
  with s as (select invoice_id, arg_max(action, seq) filter (action not in ('note', 'reviewed'))
      as status, arg_min(action, seq) filter (action in ('posted', 'held')) as first,
      bool_or(actor = 'human') as touched,
      bool_or(actor = 'human' and action in ('corrected', 'escalated')) as confirmed
    from {audit} group by invoice_id),
  items as (select * from s where status is not null)
  select count(*) as total, count(*) filter (status = 'posted') as submitted,
    count(*) filter (status = 'held') as held, count(*) filter (status = 'failed') as failed,
    round(count(*) filter (first = 'posted') / nullif(count(first), 0), 3) as auto_submit_rate,
    round(count(*) filter (first = 'posted' and confirmed)
      / nullif(count(*) filter (first = 'posted'), 0), 3) as false_submit_rate,
    round(count(*) filter (first = 'held' and confirmed)
      / nullif(count(*) filter (first = 'held' and touched), 0), 3) as hold_precision
  from items""")
def workflow_metrics(spark, sf):
    log = bind(spark, sf, "audit")
    return metrics.workflow_metrics(overlays.current_status(log), log)


# ---- reviewer read models -------------------------------------------------------------------
_LOW = "'low_extraction_confidence','moderate_extraction_confidence','low_confidence'," \
       "'ambiguous_income_expense','low_category_confidence'"
binding("tagged_items", f"""
  select i.*, coalesce(e.n, 0) as exception_count, e.reason, e.reason_title,
    coalesce(e.low, false) or (i.decision = 'submit' and i.decision_confidence < 0.75) as low
  from {{listed}} i left join (
    select invoice_id, count(*) as n, bool_or(type in ({_LOW})) as low,
      arg_min(type, (created_at, id)) as reason, arg_min(message, (created_at, id)) as reason_title
    from {{exceptions}} group by invoice_id) e using (invoice_id)""")


def _tagged(spark, sf):
    return review.tagged(bind(spark, sf, "listed"), bind(spark, sf, "exceptions"))


_TAGS = """array_to_string(list_sort(list_filter([status, case when status in ('held', 'failed')
    then 'needs_review' end, case when low then 'low_confidence' end],
    lambda t: t is not null)), ',')"""


@query("triage_list", f"""
  select invoice_id, status, decision, decision_confidence, vendor_name, total_amount,
         exception_count, {_TAGS} as filter_tags, epoch_us(updated_at) as updated_us
  from {{tagged_items}}""")
def triage_list(spark, sf):
    return _tagged(spark, sf).select(
        "invoice_id", "status", "decision", "decision_confidence", "vendor_name", "total_amount",
        "exception_count", F.array_join("filter_tags", ",").alias("filter_tags"),
        F.unix_micros("updated_at").alias("updated_us"))


binding("order_corrections", """
  select 'c-' || cast(l_orderkey as string) || '-' || cast(l_linenumber as string) || '-'
           || cast(l_partkey as string) || '-' || cast(l_suppkey as string) as event_id,
         cast(l_orderkey as string) as invoice_id, cast(l_linenumber as bigint) as seq,
         cast(l_shipdate as timestamp) as ts, 'human' as actor, 'corrected' as action,
         case when l_quantity < 25 then 'vendor_name' else 'total_amount' end as field,
         case when l_discount < 0.02 then '' else cast(cast(l_quantity as int) as string) end
           as after_value
  from {lineitem} where l_returnflag = 'A'""")


@query("item_summaries", f"""
  with last as (select invoice_id, field, nullif(after_value, '') as v from (
    select *, row_number() over (partition by invoice_id, field
      order by ts desc, seq desc, event_id desc) as r from {{order_corrections}}) where r = 1)
  select t.invoice_id, coalesce(v.v, t.vendor_name) as vendor_name,
    coalesce(a.v, t.total_amount) as total_amount, exception_count, {_TAGS} as filter_tags
  from {{tagged_items}} t
  left join last v on v.invoice_id = t.invoice_id and v.field = 'vendor_name'
  left join last a on a.invoice_id = t.invoice_id and a.field = 'total_amount'""")
def item_summaries(spark, sf):
    items = bind(spark, sf, "listed").withColumn("fields", F.create_map(
        F.lit("vendor_name"), F.col("vendor_name"), F.lit("total_amount"), F.col("total_amount"))
    ).drop("vendor_name", "total_amount")
    events = bind(spark, sf, "order_corrections").withColumn("details", F.to_json(F.struct(
        F.lit("metadata").alias("target"), F.create_map("field", "after_value").alias("after"))))
    return review.summaries(items, bind(spark, sf, "exceptions"),
                            overlays.metadata_overlay(events)).select(
        "invoice_id", "vendor_name", "total_amount", "exception_count",
        F.array_join("filter_tags", ",").alias("filter_tags"))


@query("triage_low_confidence", """
  select invoice_id, status, exception_count from {tagged_items} where low""")
def triage_low_confidence(spark, sf):
    return review.filtered(_tagged(spark, sf), "low_confidence").select(
        "invoice_id", "status", "exception_count")


@query("chip_counts", """
  select k.tag, count(t.invoice_id) as items
  from (values ('posted'), ('held'), ('failed'), ('needs_review'), ('low_confidence')) k(tag)
  left join {tagged_items} t on t.status = k.tag or (k.tag = 'needs_review'
    and t.status in ('held', 'failed')) or (k.tag = 'low_confidence' and t.low)
  group by k.tag""")
def chip_counts(spark, sf):
    return review.chip_counts(_tagged(spark, sf))


@query("held_digest", """
  select type as reason, count(*) as n from {exceptions} join {listed} using (invoice_id)
  where status = 'held' group by type
  union all select 'held_count', count(*) from {listed} where status = 'held'""")
def held_digest(spark, sf):
    return review.held_digest(bind(spark, sf, "listed"), bind(spark, sf, "exceptions"))


@query("exceptions_per_item", """
  select invoice_id, count(*) as exception_count from {exceptions} group by invoice_id""")
def exceptions_per_item(spark, sf):
    return review.exception_summary(bind(spark, sf, "exceptions")).select(
        "invoice_id", "exception_count")


@query("review_queue", """
  select invoice_id, reason, reason_title, exception_count, epoch_us(updated_at) as updated_us
  from {tagged_items} where status = 'held'
  order by coalesce(reason, ''), updated_at, invoice_id""")
def review_queue(spark, sf):
    return review.review_queue(_tagged(spark, sf)).select(
        "invoice_id", "reason", "reason_title", "exception_count",
        F.unix_micros("updated_at").alias("updated_us"))


@query("trace", """
  select invoice_id, row_number() over (partition by invoice_id order by ts, seq, event_id) as step,
    action as stage, actor, epoch_us(ts) as at_us, action <> 'failed' as ok,
    case when action = 'failed' then json_extract_string(details, '$.kind') end as kind,
    case when action = 'failed' then json_extract_string(details, '$.reason') end as error,
    case when action = 'failed' then json_extract_string(details, '$.kind')
      in ('extraction_failed', 'sheet_write_failed') end as retryable
  from {audit}""")
def trace(spark, sf):
    rows = review.trace(bind(spark, sf, "audit"))
    return rows.withColumn("at_us", F.unix_micros("ts")).drop("ts")


@query("item_detail", """
  select invoice_id, '1_item' as section, '' as sort_key, status as gist from {listed}
  union all select invoice_id, '2_line', lpad(cast(pos as varchar), 10, '0'), id from {lines}
  union all select invoice_id, '3_exception', lpad(cast(epoch_us(created_at) as varchar), 20, '0')
    || '|' || id, type from {exceptions}
  union all select invoice_id, '4_event', lpad(cast(epoch_us(ts) as varchar), 20, '0') || '|'
    || lpad(cast(seq as varchar), 20, '0') || '|' || event_id, action from {audit}""")
def item_detail(spark, sf):
    rows = review.item_detail(bind(spark, sf, "listed"), bind(spark, sf, "lines"),
                              bind(spark, sf, "exceptions"), bind(spark, sf, "audit"))
    gist = F.coalesce(*[F.get_json_object("payload", f"$.{k}")
                        for k in ("status", "id", "type", "action")])
    return rows.select("invoice_id", "section", "sort_key", gist.alias("gist"))


@query("spot_check_sample", """
  select invoice_id, vendor_name from {listed} where status = 'posted'
  order by md5('0|' || invoice_id), invoice_id limit 5""")
def spot_check_sample(spark, sf):
    posted = bind(spark, sf, "listed").filter("status = 'posted'")
    return review.spot_check(posted).select("invoice_id", "vendor_name")


@query("spot_check_events", """
  select invoice_id, 'system' as actor, 'note' as action,
         '{"spot_check":true,"reason":"spot-check sample"}' as details
  from {listed} where status = 'posted' order by md5('7|' || invoice_id), invoice_id limit 50""")
def spot_check_events(spark, sf):
    posted = bind(spark, sf, "listed").filter("status = 'posted'")
    return review.spot_check_events(review.spot_check(posted, k=50, seed=7))


# ---- rerun and recover ----------------------------------------------------------------------
def _stored(spark, sf):
    lines = "array<struct<id:string,raw_description:string,total:decimal(18,4)," \
            "extraction_confidence:double>>"
    base = _base(spark, sf)
    return intake.complete(base).withColumn("lines", F.array().cast(lines)).withColumn(
        "created_at", F.lit("2024-01-01 00:00:00").cast("timestamp"))


@query("rerun_outcomes", """
  with j as (
    select r.invoice_id, e.total_amount as raw, c.corrected_category,
      try_cast(e.total_amount as decimal(18,4)) is null as broken,
      least(conf_vendor_name, conf_total_amount, conf_currency,
        case when date_missing then 1.0 else conf_invoice_date end) as ext,
      r.date_missing, b.invoice_date is null as office
    from {rerun_base} r join {effective} e using (invoice_id) join {base_fields} b using (invoice_id)
    left join {latest_category} c using (invoice_id))
  select invoice_id,
    case when broken then 'failed' when least(ext, 0.9, case when corrected_category is not null
      then 1.0 when office then 0.8 else 0.0 end) >= 0.8 then 'posted' else 'held' end as status,
    case when broken then 'stage_failure' end as error_kind,
    cast(case when not broken then round(least(ext, 0.9, case when corrected_category is not null
      then 1.0 when office then 0.8 else 0.0 end), 3) end as double) as confidence,
    coalesce(corrected_category, case when office then 'Office expense' end) as category
  from j""")
def rerun_outcomes(spark, sf):
    done = intake.rerun(_stored(spark, sf), _rerun_log(spark, sf))
    return done.select("invoice_id", "status", "error_kind", "confidence", "category")


@query("rerun_events", """
  select b.invoice_id, 'human' as actor, 'rerun' as action,
    coalesce(string_agg(l.field, ',' order by l.field), '') as corrected_fields
  from {base_fields} b left join {latest_fields} l on l.invoice_id = b.invoice_id
  group by b.invoice_id""")
def rerun_events(spark, sf):
    at = F.lit("2026-01-01 00:00:00").cast("timestamp")
    rows = intake.rerun_events(_base(spark, sf), bind(spark, sf, "correction_log"), at, "run-2")
    fields = F.from_json(overlays.detail("corrected_fields"), "array<string>")
    return rows.select("invoice_id", "actor", "action",
                       F.array_join(fields, ",").alias("corrected_fields"))


@query("recover_events", """
  select invoice_id, 'system' as actor, 'recovered' as action, 'failed' as from_status
  from {terminals} where action = 'failed'""")
def recover_events(spark, sf):
    last = overlays.latest_details(bind(spark, sf, "audit"), K.TERMINAL_ACTIONS, per_action=False)
    failed = intake.recoverable(last.withColumnRenamed("action", "status"))
    at = F.lit("2026-01-01 00:00:00").cast("timestamp")
    return intake.recover_events(failed, at, "run-3").select(
        "invoice_id", "actor", "action", overlays.detail("from_status").alias("from_status"))


@query("recover_outcomes", """
  select invoice_id, case when invoice_date is null then 'posted' else 'held' end as status,
         cast(case when invoice_date is null then 0.8 else 0.0 end as double) as confidence,
         case when invoice_date is null then 'Office expense' end as category
  from {base_fields}""")
def recover_outcomes(spark, sf):
    """Items with a stored extraction reuse it; the others are read again from their text."""
    log = bind(spark, sf, "extraction_log")
    kept = bind(spark, sf, "base_fields").filter("invoice_date is not null").select("invoice_id")
    log = log.filter("action = 'received'").unionByName(
        log.filter("action = 'extracted'").join(kept, "invoice_id", "left_semi")
        .select(*log.columns))
    failed = _stored(spark, sf).withColumn("text", F.to_json(F.struct(
        F.map_filter("fields", lambda _, v: v.isNotNull()).alias("metadata"))))
    failed = (failed.withColumn("format", F.lit("attachment"))
              .withColumn("structured", F.lit(True)).withColumn("is_real_pdf", F.lit(False)))
    done = intake.recover(failed, log)
    return done.select("invoice_id", "status", "confidence", "category")


"""How the given tables stand in for messages, items, lines, events and words.

All of it is portable SQL over whole tables; every row of a table takes part.
"""

from .core import binding

# -- items and their lines ------------------------------------------------------------------
binding("lines", """
  select cast(l_orderkey as string) as invoice_id,
         cast(l_linenumber as int) as pos,
         cast(l_orderkey as string) || '#' || cast(l_linenumber as string) || '#'
           || cast(l_partkey as string) || '#' || cast(l_suppkey as string) as id,
         case when l_returnflag = 'N' and l_linestatus = 'F' then null
              else cast(l_extendedprice as decimal(18,4)) end as total,
         case when l_returnflag = 'N' and l_linestatus = 'F' then cast(0.6 as double)
              else cast(0.9 as double) end as extraction_confidence
  from {lineitem}""")

# Finished orders carry the true line sum, the others the stated price (which never matches).
binding("items", """
  select cast(o.o_orderkey as string) as invoice_id, o.o_orderstatus, o.o_orderpriority,
         cast(o.o_orderdate as timestamp) as created_at,
         'Customer ' || cast(o.o_custkey as string) as vendor_name,
         cast(cast(o.o_orderdate as date) as string) as invoice_date,
         o.o_totalprice,
         case when o.o_orderstatus = 'F' then coalesce(s.t, cast(0 as decimal(18,4)))
              when o.o_orderstatus = 'P' and o.o_orderpriority = '5-LOW' then null
              else cast(o.o_totalprice as decimal(18,4)) end as total_amount
  from {orders} o
  left join (select invoice_id, cast(sum(total) as decimal(18,4)) as t from {lines}
             group by invoice_id) s
    on s.invoice_id = cast(o.o_orderkey as string)""")

# Confidences, type and category as an upstream run would have left them.
binding("judged", """
  select i.*,
         cast(case o_orderpriority when '1-URGENT' then 0.95 when '2-HIGH' then 0.9
              when '3-MEDIUM' then 0.75 when '4-NOT SPECIFIED' then 0.45 else 0.85 end as double)
           as vendor_conf,
         cast(case when total_amount is null then 0.0 else 0.95 end as double) as total_conf,
         case when o_orderstatus = 'P' then 1 else 0 end as due_date_missing,
         case when o_totalprice > 400000 then 'income' when o_totalprice < 3000 then 'unknown'
              else 'expense' end as document_type,
         cast(case when o_totalprice > 400000 then 0.9 when o_totalprice < 3000 then 0.0
              when o_totalprice < 20000 then 0.6 else 0.9 end as double)
           as document_type_confidence,
         case o_orderpriority when '1-URGENT' then 'Travel' when '2-HIGH' then 'Office expense'
              when '3-MEDIUM' then 'Meals' when '4-NOT SPECIFIED' then null
              else 'Supplies' end as category,
         cast(case o_orderpriority when '1-URGENT' then 0.95 when '2-HIGH' then 0.8
              when '3-MEDIUM' then 0.7 when '4-NOT SPECIFIED' then 0.0 else 0.9 end as double)
           as category_confidence,
         case when o_totalprice between 100000 and 101000 then true else false end as adversarial
  from {items} i""")

# Items as the reviewer's list sees them; lines double as exceptions.
binding("listed", """
  select cast(o_orderkey as string) as invoice_id,
         case o_orderstatus when 'O' then 'held' when 'F' then 'failed' else 'posted' end
           as status,
         case o_orderstatus when 'P' then 'submit' else 'hold' end as decision,
         cast(case o_orderpriority when '1-URGENT' then 0.72 when '2-HIGH' then 0.8
              else 0.95 end as double) as decision_confidence,
         'Customer ' || cast(o_custkey as string) as vendor_name,
         cast(cast(o_totalprice as decimal(18,2)) as string) as total_amount,
         cast(o_orderdate as timestamp) as created_at,
         cast(o_orderdate as timestamp) + interval 1 day as updated_at
  from {orders}""")

binding("exceptions", """
  select cast(l_orderkey as string) as invoice_id,
         cast(l_orderkey as string) || '#' || cast(l_linenumber as string) || '#'
           || cast(l_partkey as string) || '#' || cast(l_suppkey as string) as id,
         case l_returnflag when 'A' then 'total_mismatch' when 'R' then 'low_category_confidence'
              else case l_linestatus when 'O' then 'missing_total'
                   else 'moderate_extraction_confidence' end end as type,
         'line ' || cast(l_linenumber as string) as message,
         case l_returnflag when 'N' then 'medium' else 'high' end as severity,
         cast(l_shipdate as timestamp) as created_at
  from {lineitem}""")

# -- the event log --------------------------------------------------------------------------
binding("event_numbers", """
  select event_id, cast(ts as timestamp) as ts, user_id, event_type, value,
         cast(regexp_extract(props, '[0-9]+', 0) as int) as n
  from {events}""")

# One item per user and day.
binding("audit", """
  select 'evt-' || cast(event_id as string) as event_id,
         cast(user_id as string) || ':' || cast(cast(ts as date) as string) as invoice_id,
         event_id as seq, ts,
         case event_type when 'signup' then 'human' when 'view' then 'human'
              when 'click' then 'system' else 'ai' end as actor,
         case event_type when 'purchase' then 'posted' when 'error' then
                case when n < 20 then 'failed' else 'held' end
              when 'signup' then case when n < 15 then 'escalated' when n < 25 then 'rejected'
                else 'corrected' end
              when 'view' then case when n < 30 then 'note' when n < 40 then 'rerun'
                else 'reviewed' end
              else 'received' end as action,
         case event_type
              when 'purchase' then '{"sheet_row_ref":"Ledger!A' || cast(n as string)
                || '","reason":"filed","risk_flags":[]}'
              when 'error' then case when n < 20
                then '{"kind":"' || case when n < 10 then 'extraction_failed'
                     when n < 15 then 'sheet_write_failed' else 'stage_broken' end
                     || '","reason":"code ' || cast(n as string) || '"}'
                else '{"rationale":"held ' || cast(n as string)
                     || '","risk_flags":[{"type":"total_mismatch"}]}' end
              else '{"attachment":"file' || cast(n as string) || '.pdf"}' end as details
  from {event_numbers}""")

# One item per user, every event a reviewer correction.
binding("corrections", """
  select 'evt-' || cast(event_id as string) as event_id, cast(user_id as string) as invoice_id,
         event_id as seq, ts, 'human' as actor, 'corrected' as action, n,
         case event_type when 'purchase' then 'category' when 'error' then 'line_item'
              else 'metadata' end as target,
         case when n < 25 then 'vendor_name' when n < 50 then 'total_amount'
              when n < 75 then 'invoice_date' else 'currency' end as field,
         case when value < 5 then null when value < 10 then '' else cast(n as string)
              || case when value > 120 then 'x' else '' end end as after_value
  from {event_numbers}""")
binding("correction_log", """
  select event_id, invoice_id, seq, ts, actor, action,
         '{"target":"' || target || '",' ||
         case target
           when 'category' then '"after":{"category":'
             || coalesce('"' || after_value || '"', 'null') || '}}'
           when 'line_item' then '"line_item_id":"' || case when n = 0 then '' else 'L'
             || cast(n as string) end || '","after":{"catalog_item_id":"C' || cast(n as string)
             || '","catalog_description":' || coalesce('"' || after_value || '"', 'null') || '}}'
           else '"after":{"' || field || '":' || coalesce('"' || after_value || '"', 'null')
             || '}}' end as details
  from {corrections}""")

# What the engine had read for each corrected item.
binding("base_fields", """
  select distinct cast(user_id as string) as invoice_id,
         'Vendor ' || cast(user_id as string) as vendor_name,
         cast(user_id as string) || '.50' as total_amount,
         case when user_id < 20 then null else '2024-01-01' end as invoice_date,
         'USD' as currency
  from {events}""")

# -- transactions for the duplicate guard ---------------------------------------------------
binding("transactions", """
  select cast(event_id as string) as invoice_id, ts as created_at,
         case when event_type in ('view', 'click') then ' USER ' || cast(user_id as string)
              else 'user ' || cast(user_id as string) || ' ' end as vendor_name,
         cast(floor(value / 10) as decimal(18,4)) as total_amount,
         cast(cast(floor(value / 10) as bigint) as string) as total_amount_raw,
         case when n < 3 then null when n = 3 then '2024-1-5'
              else cast(cast(ts as date) as string) || 'T00:00' end as invoice_date,
         event_type
  from {event_numbers}""")

# -- messages -------------------------------------------------------------------------------
binding("mail", """
  select cast(conv_id as string) || '-' || cast(turn as string) as message_id,
         case role when 'system' then ' No-Reply @desk.example'
              when 'assistant' then 'Support <billing@desk.example>'
              else 'user' || cast(conv_id as string) || '@home.example' end as sender,
         case when turn = 0 then 'Hello' when turn = 1 then 'Weekly Digest'
              when turn = 2 then 'Your Order has shipped' when turn = 3 then null
              else 'Re: ' || role end as subject,
         case when turn = 4 then 'scan.PDF' when turn = 5 then 'photo.png' end as attachment,
         text as body, role, turn, conv_id
  from {conversations}""")

# A document per page of the crawl: URL as path, HTML as body.
binding("web_documents", """
  select cast(page_id as string) as message_id, url as attachment_path,
         case when url like '%utm%' then 'page.pdf' when url like '%example.org%' then 'shot.JPG'
              when url like '%m.%' then 'mobile.html' end as attachment,
         case when url like '%page=2%' then '{"metadata":{"vendor_name":"x"},"line_items":[]}'
              when url like '%ref=%' then '{}' end as document,
         case when url like '%blog%' then null when url like '%/es/%' then '' else html end as body,
         case when url like '%/en/%' then null else url end as source_body
  from {pages}""")

# One rendered invoice per line item, as layout text.
binding("layout_docs", """
  select cast(l_orderkey as string) || '-' || cast(l_linenumber as string) || '-'
           || cast(l_partkey as string) || '-' || cast(l_suppkey as string) || '-'
           || cast(cast(l_extendedprice as decimal(18,2)) as string) as doc_id,
         'Invoice Number: INV-' || cast(l_orderkey as string) || chr(10)
         || '  Vendor :  Supplier ' || cast(l_suppkey as string) || chr(9) || chr(10)
         || 'Vendor:' || case when l_returnflag = 'A' then ' Final Vendor: ' ||
              cast(l_suppkey as string) else ' ' end || chr(13) || chr(10)
         || 'Unknown Label: nothing' || chr(10) || chr(10)
         || 'Total Amount: ' || cast(cast(l_extendedprice as decimal(18,2)) as string) || chr(10)
         || case when l_linestatus = 'O' then 'Line Items' else 'Items' end || chr(10)
         || 'Description | Qty | Unit Price | Line Total' || chr(10)
         || 'Part ' || cast(l_partkey as string) || ' | ' || cast(cast(l_quantity as int) as string)
         || ' | | ' || cast(cast(l_extendedprice as decimal(18,2)) as string) || ' | extra' || chr(10)
         || ' | 1 | 2 | 3' || chr(10) || 'too | few' || chr(10)
         || 'Tax: | ' || case when l_returnflag = 'R' then '1' else '' end || '|2|'
         || cast(cast(l_tax as decimal(18,2)) as string) || chr(10)
         || 'Currency: USD' as text
  from {lineitem}""")

# One JSON document per line item, flat and annotated cells mixed, some of them malformed.
binding("json_docs", """
  select cast(l_orderkey as string) || '-' || cast(l_linenumber as string) || '-'
           || cast(l_partkey as string) || '-' || cast(l_suppkey as string) || '-'
           || cast(cast(l_extendedprice as decimal(18,2)) as string) as message_id,
         l_returnflag, l_linestatus, l_shipdate as received_at,
         case when l_suppkey < 20 then 'scan.pdf' when l_suppkey < 40 then 'photo.jpeg' end
           as attachment,
         case when l_suppkey < 90 then
         '{"metadata":{"invoice_number":' || case when l_quantity > 48 then
              cast(l_orderkey as string) else '"INV-' || cast(l_orderkey as string) || '"' end
         || ',"vendor_name":' || case l_returnflag when 'A' then '"Supplier '
              || cast(l_suppkey as string) || '"' when 'R' then '{"value":"Supplier '
              || cast(l_suppkey as string) || '","confidence":0.7,"evidence":"read"}'
              else '{"value":"","confidence":0.2}' end
         || ',"invoice_date":"' || cast(cast(l_shipdate as date) as string) || '"'
         || ',"currency":' || case l_linestatus when 'O' then 'null' else '"caf' || chr(92) || 'u00e9"' end
         || ',"total_amount":' || case when l_discount > 0.095 then '"n/a"'
              else '"' || cast(cast(l_extendedprice as decimal(18,2)) as string) || '"' end
         || ',"payment_terms":{"value":"30 days"}}'
         || ',"line_items":[{"raw_description":"Part P' || cast(l_partkey as string)
         || case l_linestatus when 'O' then ' flight' else ' office supplies' end
         || '","quantity":"' || cast(cast(l_quantity as int) as string)
         || '","total":' || case when l_tax > 0.07 then 'null' else '"'
              || cast(cast(l_extendedprice as decimal(18,2)) as string) || '"' end
         || '},{"raw_description":"ticket","total":' || case when l_tax < 0.005
              then '""' else '"0.00"' end || ',"extraction_confidence":0.85}]}' end as document,
         case when l_suppkey < 95 then null else 'plain words ' || cast(l_suppkey as string) end
           as body
  from {lineitem}""")

# A message part per conversation turn, base64url text as mailboxes deliver it.
binding("mime_turns", """
  select cast(conv_id as string) as message_id, cast(turn as int) as part_order,
         case role when 'user' then 'text/plain' when 'assistant' then 'text/html'
              else 'application/pdf' end as mime_type,
         case when role = 'system' then 'terms.pdf' when turn = 2 then 'note.txt'
              when turn = 3 then 'Copy.PDF' else '' end as filename,
         case when role = 'system' or turn in (2, 3) then 'att-' || cast(turn as string) end
           as attachment_id, text
  from {conversations}""")

# One OCR table per line item: a structural row, a blank, a bad confidence and three words.
binding("ocr_pages", """
  select cast(l_orderkey as string) || '-' || cast(l_linenumber as string) || '-'
           || cast(l_partkey as string) || '-' || cast(l_suppkey as string) || '-'
           || cast(cast(l_extendedprice as decimal(18,2)) as string) as doc_id,
         1 as page_number, cast(1000 as double) as page_width, cast(2000 as double) as page_height,
         case when l_suppkey = 7 then 'level' || chr(9) || 'text' || chr(10) || '5' || chr(9) || 'x'
         else
         'level' || chr(9) || 'left' || chr(9) || 'top' || chr(9) || 'width' || chr(9) || 'height'
           || chr(9) || 'conf' || chr(9) || 'text' || chr(10)
         || '1' || chr(9) || '0' || chr(9) || '0' || chr(9) || '1000' || chr(9) || '2000' || chr(9)
           || '-1' || chr(9) || chr(10)
         || '5' || chr(9) || cast(cast(l_quantity as int) as string) || chr(9) || '10' || chr(9)
           || '140' || chr(9) || '40' || chr(9) || '96.5' || chr(9) || 'Part' || chr(10)
         || '5' || chr(9) || '200' || chr(9) || '10' || chr(9) || '2000' || chr(9) || '40' || chr(9)
           || case when l_returnflag = 'N' then 'low' else '88' end || chr(9)
           || ' ' || cast(l_partkey as string) || ' ' || chr(10)
         || '5' || chr(9) || '1' || chr(9) || '1' || chr(9) || '1' || chr(9) || '1' || chr(9)
           || '50' || chr(9) || '  ' || chr(10)
         || 'short' || chr(9) || 'row' || chr(10)
         || '5' || chr(9) || '500' || chr(9) || '2500' || chr(9) || '30' || chr(9) || '40' || chr(9)
           || '0' || chr(9) || l_linestatus end as tsv
  from {lineitem}""")

"""Operators on small tables, hot keys against brute force, and plan shapes."""

import base64
import json
import random
import re
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tallyspark.functions import constants as K
from tallyspark.functions.spread import previous, ranked
from tallyspark.functions.text import amount_key, humanise, iso_date, strip_fences, utf8_text
from tallyspark.operators import (categorize, citations, decide, duplicates, metrics, overlays, parse,
                                  receipts, review, words)
from tallyspark.plans import advisory, intake
from tallyspark.sources import inbox, ledger, mime

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# ---- hot keys ---------------------------------------------------------------------------------
START = datetime(2026, 1, 1)
DDL = "invoice_id string, created_at timestamp, vendor_name string, total string, invoice_date string"


def _items(n=600, seed=5, undated=0.03):
    """(id, minute, key number or None, day number or None): one key owns most rows."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        key = 0 if rng.random() < 0.6 else rng.choice([None, 1, 2, 3, 4])
        out.append((f"i{i:04d}", rng.randrange(5000), key, None if rng.random() < undated else rng.randrange(40)))
    return out


def _frame(spark, items):
    names = {0: ("Adobe ", "10.00"), 1: ("v1", "0.50"), 2: ("v2", "1.50"), 3: (" V1", "2.50"), 4: ("v4", "2.50"), None: (None, "10.00")}
    rows = []
    for i, minute, key, day in items:
        vendor, total = names[key]
        text = "soon" if day is None else f"{date(2026, 1, 1) + timedelta(days=day)}T10:00"
        rows.append((i, START + timedelta(minutes=minute), vendor, total, text))
    return spark.createDataFrame(rows, DDL).select(
        "*", F.col("total").cast("decimal(18,4)").alias("total_amount"),
        F.col("total").alias("total_amount_raw"))


def _meets(a, b):
    return a[2] is not None and a[2] == b[2] and (None in (a[3], b[3]) or abs(a[3] - b[3]) < 4)


def _brute_guard(items, posted=()):
    kept, out = list(posted), {}
    for x in sorted(items, key=lambda r: (r[1], r[0])):
        out[x[0]] = next((k[0] for k in kept if _meets(x, k)), None)
        if out[x[0]] is None:
            kept.append(x)
    return out


@pytest.mark.parametrize("seed, undated", [(5, 0.03), (6, 0.0), (7, 0.5), (8, 0.002)])
def test_guard_equals_brute_force(spark, seed, undated):
    items = _items(seed=seed, undated=undated)
    got = {r.invoice_id: r.duplicate_of for r in duplicates.guard(_frame(spark, items)).collect()}
    assert got == _brute_guard(items)
    # later batch, seeded with what an earlier one posted
    first, second = items[:300], [(r[0], r[1] + 9000, *r[2:]) for r in items[300:]]
    done = _brute_guard(first)
    posted = sorted((r for r in first if done[r[0]] is None), key=lambda r: (r[1], r[0]))
    got = duplicates.guard(_frame(spark, second), _frame(spark, posted)).collect()
    assert {r.invoice_id: r.duplicate_of for r in got} == _brute_guard(second, posted)


def test_guard_of_a_key_with_many_days(spark):
    """20,000 days of one key, in day order: every fourth is posted."""
    days = spark.range(20_000).select(
        F.col("id").cast("string").alias("invoice_id"), F.timestamp_seconds("id").alias("created_at"),
        F.lit("v").alias("vendor_name"), F.lit(1).cast("decimal(18,4)").alias("total_amount"),
        F.lit("1").alias("total_amount_raw"), F.date_add(F.lit("1970-01-01").cast("date"), F.col("id").cast("int")).cast("string")
        .alias("invoice_date"))
    got = {int(r.invoice_id): r.duplicate_of for r in duplicates.guard(days).collect()}
    assert got == {d: None if d % 4 == 0 else str(d - d % 4) for d in range(20_000)}


@pytest.mark.parametrize("a, b, same", [
    ("123.45671", "123.45674", False), ("1", "1.0000", True), ("+012.50", "12.5", True), (" 7 ", "7.", True), ("-0", "0", True),
    ("1000000000000000.00", "1000000000000000.01", False), ("1" + "0" * 60, "1" + "0" * 60 + ".0", True), ("1e3", "1000", True),
    ("-5", "5", False), (".5", "0.5", True)])
def test_amounts_compare_exactly(spark, a, b, same):
    row = spark.createDataFrame([(a, b)], "a string, b string").select(amount_key(F.col("a")), amount_key(F.col("b"))).collect()[0]
    assert None not in row and (row[0] == row[1]) == same


def test_what_is_no_amount(spark):
    rows = spark.createDataFrame([(x,) for x in ("", "n/a", "1,000.00", "1 2", ".", "--1", None)], "a string")
    assert [r[0] for r in rows.select(amount_key(F.col("a"))).collect()] == [None] * 7


def test_first_duplicates_equals_brute_force(spark):
    items = _items(300, seed=9)
    posted = sorted(items[:120], key=lambda r: (r[1], r[0]))
    want = {r[0]: next((p[0] for p in posted if p[0] != r[0] and _meets(r, p)), None) for r in items}
    got = duplicates.first_duplicates(_frame(spark, items), _frame(spark, posted)).collect()
    assert {r.invoice_id: r.duplicate_of for r in got} == want


def test_ledger_numbers_need_no_single_task_window(spark):
    rows = spark.range(3000).select(
        F.col("id").cast("string").alias("idempotency_key"),
        F.timestamp_seconds(F.col("id") % 900 * 86400).alias("created_at"))
    recorded = spark.createDataFrame([("7", "Ledger!A1:F1")], "idempotency_key string, sheet_row_ref string")
    filed = ledger.append_refs(rows, recorded, spark.createDataFrame([(1,)], "n long"), bucket_width=1)
    got = {r.idempotency_key: (r.sheet_row_ref, r.deduped) for r in filed.collect()}
    assert got.pop("7") == ("Ledger!A1:F1", True)
    order = rows.filter("idempotency_key <> '7'").select("idempotency_key", F.to_date("created_at").alias("d"), F.expr(
        "substring(md5(idempotency_key), 1, 1)").alias("b")).collect()
    for n, r in enumerate(sorted(order, key=lambda r: (r.d, r.b, r.idempotency_key)), 2):
        assert got[r.idempotency_key] == (f"Ledger!A{n}:F{n}", False)
    assert not re.search(r"Window.*\n[^\n]*\n?[^\n]*SinglePartition", plan(filed))


def test_submitted_settings_win(spark):
    """Settings that the context was started with stay; only missing ones are filled in."""
    from tallyspark.session import DEFAULTS, build_session
    started = spark.sparkContext.getConf()
    before = {k: spark.conf.get(k) for k in DEFAULTS}
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    build_session()
    assert started.contains("spark.sql.shuffle.partitions") and spark.conf.get("spark.sql.shuffle.partitions") == "4"
    assert {k: spark.conf.get(k) for k in DEFAULTS} == before


def test_versions_and_copies_of_equal_times(spark):
    rows = [("a", START, "x"), ("a", START, "y"), ("a", START, "z")]
    for data in (rows, rows[::-1]):
        frame = spark.createDataFrame(data, "invoice_id string, updated_at timestamp, status string").coalesce(1)
        assert [r.status for r in ledger.latest_versions(frame).collect()] == ["z"]
        copies = frame.withColumnsRenamed({"invoice_id": "message_id", "updated_at": "received_at"})
        assert [r.status for r in inbox.first_per_message(copies, ["received_at"]).collect()] == ["x"]


def test_ranked_and_previous_equal_plain_windows(spark):
    df = spark.range(2000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 7).cast("string")).alias("k"),
        (F.col("id") * 7919 % 2000).alias("t"), F.when(F.col("id") % 5 > 0, F.col("id")).alias("v"))
    df = df.withColumn("b", F.floor(F.col("t") / 50))
    w = Window.partitionBy("k").orderBy("t")
    want = df.select("k", "t", F.row_number().over(w).cast("bigint").alias("r"),
                     F.lag("v").over(w).alias("p"))
    got = previous(ranked(df, ["k"], ["b"], ["t"], "r"), ["k"], ["b"], ["t"], "v", "p")
    got = got.select("k", "t", "r", F.col("p.value").alias("p"))
    assert want.exceptAll(got).count() == 0 and got.count() == 2000


# ---- receipts ---------------------------------------------------------------------------------
@pytest.mark.parametrize("sender,subject,attachment,body,want", [
    ("billing@x.example", None, None, None, (True, 0.9)),
    (" No-Reply @x", None, None, None, (True, 0.9)),
    ("Billing <billing@x>", "Hi", None, None, (True, 0.4)),
    (None, "Your ORDER shipped", None, None, (True, 0.9)),
    (None, "hello", "a.PDF", None, (True, 0.9)),
    ("friend@mail.example", "Weekly digest", None, None, (False, 0.9)),
    (None, None, None, "click to Unsubscribe", (False, 0.9)),
    (None, "payment newsletter", None, None, (True, 0.9)),
    (None, None, None, None, (True, 0.4))])
def test_receipt_verdict(spark, sender, subject, attachment, body, want):
    df = spark.createDataFrame([("m", sender, subject, attachment, body)],
                               "message_id string, sender string, subject string,"
                               " attachment string, body string")
    row = receipts.verdicts(df).collect()[0]
    assert (row.is_receipt, row.confidence) == want


def test_mailbox_path_never_reads_bodies(spark):
    mail = spark.read.parquet(f"{SF}/conversations.parquet").select(
        F.col("conv_id").alias("message_id"), F.col("role").alias("sender"),
        F.col("role").alias("subject"), F.lit(None).cast("string").alias("attachment"),
        F.col("text").alias("body"))
    shape = plan(receipts.dropped(receipts.verdicts(mail, body=None)))
    assert "text" not in shape.split("ReadSchema")[1]


# ---- parsing and words --------------------------------------------------------------------------
def test_layout_text(spark):
    text = ("Invoice Number: N-1\r\nVendor: Old\n Vendor : New \nVendor:\nnoise\n"
            "Line Items\nDescription | Qty | Unit Price | Line Total\n"
            "Widget | 2 | | 9.00 | extra\n| 1 | 2 | 3\nshort | row\nCurrency: USD")
    row = parse.read_layout(spark.createDataFrame([(text,), ("",)], "text string")).collect()
    assert row[0].layout_header == {"invoice_number": "N-1", "vendor_name": "New"}
    assert [tuple(i) for i in row[0].layout_items] == [("Widget", "2", None, "9.00")]
    assert row[1].layout_header == {} and row[1].layout_items == []


def test_real_pdf_uses_layout_text(spark):
    text = "Vendor: Adobe\nTotal Amount: 64.25\nLine Items\nsoftware | 1 | 64.25 | 64.25"
    df = spark.createDataFrame([("m", "bill.pdf", "eA==", text)],
                               "message_id string, attachment string, attachment_b64 string,"
                               " pdf_text string").withColumn(
        "created_at", F.current_timestamp())
    done = intake.process(df).collect()[0]
    assert (done.format, done.status, done.category) == ("pdf", "posted", "Office expense")
    assert done.field_evidence["vendor_name"] == 'PDF attachment: "Adobe"'


def test_header_cells(spark):
    raw = {"metadata": {"vendor_name": "Acme", "currency": "café", "total_amount": 10.0,
                        "tax": {"value": "1.00", "confidence": 0.4, "evidence": "seen"},
                        "study_name": {"value": None, "confidence": 1}, "due_date": ""}}
    df = spark.createDataFrame([("m", json.dumps(raw), "x.png")],
                               "message_id string, document string, attachment string")
    row = intake.read_documents(df).collect()[0]
    assert not row.extract_error
    assert row.field_confidence["vendor_name"] == 0.95
    assert row.field_confidence["currency"] == 0.9  # escaped text is not corroborated
    assert row.field_confidence["tax"] == 0.4 and row.field_evidence["tax"] == "seen"
    assert row.field_evidence["vendor_name"] == 'scanned image: "Acme"'
    assert row.total_amount_raw == "10.0" and row.fields.get("due_date") is None
    assert {"study_name", "due_date"} <= set(row.missing_fields) and len(row.missing_fields) == 9


@pytest.mark.parametrize("raw", [
    {"metadata": "text"}, {"metadata": {}, "line_items": "x"}, {"metadata": None},
    {"metadata": {"vendor_name": {"name": "Acme"}}}, {"metadata": {"tax": True}},
    {"metadata": {"tax": {"value": "1", "confidence": "high"}}},
    {"line_items": [{"quantity": "1"}]}, {"line_items": [{"raw_description": "a", "total": ""}]}])
def test_schema_gate(spark, raw):
    df = spark.createDataFrame([("m", json.dumps(raw))], "message_id string, document string")
    assert intake.read_documents(df).collect()[0].extract_error


def test_line_source_defaults_to_sorted_json(spark):
    raw = {"line_items": [{"total": "1", "raw_description": "b"},
                          {"raw_description": "a", "raw_source_text": "as printed"}]}
    df = spark.createDataFrame([("m", json.dumps(raw))], "message_id string, document string")
    from tallyspark.operators.extract import line_rows
    rows = line_rows(intake.read_documents(df)).orderBy("pos").collect()
    assert [r.raw_source_text for r in rows] == [
        '{"raw_description":"b","total":"1"}', "as printed"]
    assert [r.extraction_confidence for r in rows] == [0.9, 0.6]


def _page(spark, texts, page=1):
    return spark.createDataFrame(
        [("d", page, [(i, t, 0.1 + 0.12 * i, 0.2, 0.1, 0.05) for i, t in enumerate(texts)])],
        "doc_id string, page_number int, words array<struct<index:int,text:string,x:double,"
        "y:double,width:double,height:double>>")


def test_locate_and_boxes(spark):
    pages = _page(spark, ["Vendor:", "Harbour", "Tide", "Studio", "$1,234.00", "---"]) \
        .unionByName(_page(spark, ["Studio", "Total", "1234.00"], 2))
    values = spark.createDataFrame([
        ("d", "a", "Harbour Tide Studio", 0.9), ("d", "b", "1,234.00", 0.6),
        ("d", "c", "Studio Harbour", 0.9), ("d", "e", "absent", 0.9), ("d", "f", "--", 0.9)],
        "doc_id string, target_id string, value string, confidence double")
    cited = citations.resolve(citations.synthesize(values, pages), pages)
    got = {r.target_id: r for r in cited.collect()}
    assert (got["a"].page_number, got["a"].word_indices, got["a"].status) == (
        1, [1, 2, 3], "extracted")
    assert round(got["a"].bbox.x, 6) == 0.22 and round(got["a"].bbox.width, 6) == 0.34
    assert (got["b"].word_indices, got["b"].status) == ([4], "uncertain")
    assert (got["c"].page_number, got["c"].word_indices) == (1, [3, 1])
    assert got["e"].status == got["f"].status == "unreadable" and got["e"].bbox is None
    flat = words.pack_pages(words.word_rows(pages))
    again = citations.resolve(citations.synthesize(values, flat), flat)
    assert {r.target_id: r.word_indices for r in again.collect()} == {
        k: r.word_indices for k, r in got.items()}


def test_boxes_move_no_texts(spark, tmp_path):
    """Boxes are found on the edges of words alone, null, empty and repeated pages included; pages of prose are built without decimals (F12)."""
    from tallyspark.queries import anchors
    made = _page(spark, ["Harbour", "Tide", "Studio"])
    made = made.unionByName(made).unionByName(_page(spark, [], 2)).unionByName(_page(spark, ["x"], 3).withColumn("words", F.when(F.lit(False), F.col("words"))))
    made.write.parquet(str(tmp_path / "pages"))
    pages = spark.read.schema(made.schema).parquet(str(tmp_path / "pages"))
    cited = spark.createDataFrame([("d", 1, [1, 2, 9]), ("d", 1, [7]), ("d", 2, [0]), ("d", 3, [0]), ("d", 4, [0])],
                                  "doc_id string, page_number int, word_indices array<int>")
    boxed = citations.resolve(cited, pages)
    assert "text:string" not in boxed._jdf.queryExecution().executedPlan().toString()
    got = [(r.page_number, r.word_indices, r.bbox and tuple(round(v, 6) for v in r.bbox)) for r in boxed.collect()]
    assert sorted(got, key=str) == sorted(2 * [(1, [1, 2, 9], (0.22, 0.2, 0.22, 0.05)), (1, [7], None)] + [
        (2, [0], None), (3, [0], None), (4, [0], None)], key=str)
    spark.createDataFrame([(1, " ".join(map(str, range(120)))), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    prose = anchors.document_pages(spark, str(tmp_path))
    assert "decimal" not in prose._jdf.queryExecution().optimizedPlan().toString()
    rows = prose.filter("doc_id = 1").orderBy("page_number").collect()
    assert [[(w.x, w.y, w.width, w.height) for w in r.words] for r in rows] == [
        [(float(f"0.{i % 10}"), float(f"0.{i // 10 * 2}"), 0.08, 0.1) for i in range(n)] for n in (50, 50, 20)]


def test_only_asked_answers_are_parsed(spark):
    """Answers are parsed after the join, where they may be used; repeated answers repeat rows, used or not (F13)."""
    rows = spark.createDataFrame([("a", "hotel", "Inn", 1.0), ("b", "hotel flight software hosting", "Inn", 1.0), ("c", "", None, None),
                                  ("d", "", None, None), ("e", "", None, None), (None, "", None, None)],
                                 "invoice_id string, text string, vendor_name string, total_amount double").selectExpr("*", "0L as n_lines")
    good = '{"document_type":"income","document_type_confidence":0.9,"category":"Nowhere","category_confidence":0.8}'
    answers = spark.createDataFrame([("a", good, None), ("a", "no json", None), ("c", good, None), ("c", "no json", None), ("c", None, "AuthenticationError"),
                                     ("d", good, "ReadTimeout"), (None, good, None)], "invoice_id string, json string, error_class string")
    judged = categorize.classify(rows, "text")
    merged = categorize.merge_advice(judged, answers).select("invoice_id", "document_type", "category", "category_evidence", "advice_error")
    plan = merged._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.index("parsejson" if "parsejson" in plan else "parse_json") < plan.index("join leftouter")
    kept = {r.invoice_id: (r.document_type, r.category, r.category_evidence, None) for r in judged.collect()}
    used = ("income", None, K.ADJUDICATION_RATIONALE, None)
    want = [("a", *kept["a"])] * 2 + [("b", *kept["b"]), ("c", *used), ("c", *kept["c"]), ("c", *kept["c"][:3], "AuthenticationError"),
                                      ("d", *kept["d"]), ("e", *kept["e"]), (None, *kept[None])]
    assert kept["c"][0] == "unknown" and kept["a"][0] == "expense"
    assert sorted(map(tuple, merged.collect()), key=str) == sorted(want, key=str)


def test_ocr_table(spark):
    rows = ["level\tleft\ttop\twidth\theight\tconf\ttext", "1\t0\t0\t1000\t2000\t-1\t",
            "5\t100\t200\t140\t40\t96.5\tHello", "5\t1\t1\t1\t1\tx\tbad", "5\t1\t1\t1\t1\t9\t  ",
            "5\t900\t200\t1400\t40\t0\t world "]
    df = spark.createDataFrame([("d", 1, 1000.0, 2000.0, "\n".join(rows)),
                                ("e", 1, 10.0, 10.0, "text\nfoo"), ("f", 1, 10.0, 10.0, "")],
                               "doc_id string, page_number int, page_width double,"
                               " page_height double, tsv string")
    got = {r.doc_id: r for r in words.read_ocr(df).collect()}
    assert [(w["index"], w.text, w.x, w.y, w.width, w.height) for w in got["d"].words] == [
        (0, "Hello", 0.1, 0.1, 0.14, 0.02), (1, "world", 0.9, 0.1, 1.0, 0.02)]
    assert got["e"].bad_header and not got["f"].bad_header and got["f"].words == []


def test_mime_tree(spark):
    def b64(text):
        return base64.urlsafe_b64encode(text.encode()).decode().rstrip("=")
    tree = {"mimeType": "multipart/mixed", "parts": [
        {"mimeType": "text/plain", "filename": "n.txt", "body": {"attachmentId": "a", "data": "eA"}},
        {"mimeType": "multipart/alternative", "parts": [
            {"mimeType": "text/html", "body": {"data": b64("<p>hé?>~</p>")}},
            {"mimeType": "text/plain", "body": {"data": b64("plain")}}]},
        {"mimeType": "text/plain", "body": {"data": b64("later")}},
        {"mimeType": "x/y", "filename": "b.PDF", "body": {"attachmentId": "b"}}]}
    df = spark.createDataFrame([("m", json.dumps(tree)), ("n", "broken")],
                               "message_id string, payload string")
    parts = mime.walk_payloads(df)
    body = mime.bodies(parts).collect()
    assert {r.message_id: (r.body_text, r.body_html) for r in body} == {"m": ("plain", "<p>hé?>~</p>"), "n": (None, None)}
    assert [r.error for r in parts.filter("message_id = 'n'").collect()] == ["payload is no JSON"]
    assert [r.filename for r in mime.attachments(parts).orderBy("part_order").collect()] == [
        "n.txt", "b.PDF"]
    assert mime.first_pdf_attachment(parts).collect()[0].filename == "b.PDF"


def slow_parts(payload):
    """Pre-order walk of one payload by the json module; the complaints are not part of it."""
    try:
        stack = [json.loads(payload or "")]
    except ValueError:
        return [("", "", None, None)]
    out = []
    while stack:
        node = stack.pop()
        if not isinstance(node, dict):
            out.append(("", "", None, None))
            continue
        text = lambda owner, name: (owner.get(name) if isinstance(owner, dict) and isinstance(owner.get(name), str) else None) or None
        out.append((text(node, "mimeType") or "", text(node, "filename") or "", text(node.get("body"), "attachmentId"),
                    text(node.get("body"), "data")))
        stack.extend(reversed(node["parts"] if isinstance(node.get("parts"), list) else []))
    return out


def test_mime_trees_of_any_shape(spark):
    draw = random.Random(5)
    odd = [None, 3, "x", [], [1], {}, {"a": 1}, True, ""]

    def node(depth):
        out = {name: draw.choice(["text/plain", "é\n", *odd]) for name in ("mimeType", "filename") if draw.random() < 0.7}
        if draw.random() < 0.7:
            out["body"] = draw.choice([{"data": draw.choice(["eA", *odd]), "attachmentId": draw.choice(["a", *odd])}, *odd])
        if draw.random() < 0.8:
            out["parts"] = draw.choice([[node(depth - 1) if depth else draw.choice(odd) for _ in range(draw.randrange(14))], *odd[:1]])
        return out

    deep = {"mimeType": "text/plain"}
    for k in range(23):
        deep = {"mimeType": f"m/{k}", "parts": [deep, None, 3]}
    payloads = [json.dumps(x) for x in [deep, *(node(k % 4) for k in range(40)), *odd]] + [None, "", "no json", "[1"]
    payloads += payloads[:2]
    rows = spark.createDataFrame([(f"m{k}", p) for k, p in enumerate(payloads)], "message_id string, payload string")
    want = {(f"m{k}", i): part for k, p in enumerate(payloads) for i, part in enumerate(slow_parts(p))}
    out = mime.walk_payloads(rows)
    assert "InPandas" not in out._jdf.queryExecution().toString()
    got = out.collect()
    assert {(r.message_id, r.part_order): (r.mime_type, r.filename, r.attachment_id, r.data_b64url) for r in got} == want
    assert len(got) == len(want) and mime.walk_payloads(rows.limit(0)).count() == 0


def test_mime_payload_beyond_the_parser(spark):
    rows = spark.range(2).select(F.col("id").cast("string").alias("message_id"), F.concat(
        F.lit('{"mimeType":"text/plain","body":{"data":"'), F.repeat(F.lit("eA"), F.when(F.col("id") == 0, 10_500_000).otherwise(5)),
        F.lit('"}}')).alias("payload"))
    got = mime.walk_payloads(rows).selectExpr("message_id", "part_order", "length(data_b64url) n", "error").collect()
    assert sorted(map(tuple, got)) == [("0", 0, 21_000_000, None), ("1", 0, 10, None)]
    bad = spark.sql("select X'ff41' as b").select(utf8_text(F.col("b"))).collect()[0][0]
    assert bad == "�A"


def test_scalars(spark):
    df = spark.createDataFrame([("low_stock", "2026-3-1", "```json\n{\"a\":1}\n```"),
                                ("x", "2026-03-01T00:00", " {} ")], "c string, d string, f string")
    rows = df.select(humanise(F.col("c")), iso_date(F.col("d")), strip_fences(F.col("f"))).collect()
    assert [tuple(r) for r in rows] == [("Low stock", None, '{"a":1}'),
                                        ("X", date(2026, 3, 1), "{}")]


# ---- sources -------------------------------------------------------------------------------------
def test_folder_lists_root_pdfs_only(spark, tmp_path):
    (tmp_path / "posted").mkdir()
    for name in ("a.pdf", "b.PDF", "c.txt", "posted/d.pdf"):
        (tmp_path / name).write_bytes(b"%PDF")
    rows = inbox.read_folder(spark, str(tmp_path)).collect()
    assert sorted(r.subject for r in rows) == ["a.pdf", "b.PDF"]

    def one_word(path, content):
        import pandas as pd
        if path.endswith(".PDF"):
            raise ValueError("unreadable")
        return pd.DataFrame([{"page_number": 1, "index": 0, "text": content.decode(), "x": 0.0,
                              "y": 0.0, "width": 0.1, "height": 0.1}])
    words_of = advisory.provide_words(
        inbox.read_folder(spark, str(tmp_path)).select(
            F.col("subject").alias("doc_id"), F.col("message_id").alias("path"), "content"),
        one_word)
    assert sorted(r.doc_id for r in words_of.collect()) == ["a.pdf"]


def test_backfill_filter_reaches_the_scan(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet").withColumnRenamed(
        "o_orderdate", "received_at")
    shape = plan(inbox.backfill(orders, 1998).select("o_orderkey"))
    assert "GreaterThanOrEqual(o_orderdate" in shape


def test_appended_log_and_routed_items(spark, tmp_path):
    events = spark.createDataFrame([("e1", "i", 1, "ai", "posted", "{}")],
                                   "event_id string, invoice_id string, seq bigint, actor string,"
                                   " action string, details string").withColumn(
        "ts", F.lit("2026-01-02 00:00:00").cast("timestamp"))
    for _ in range(2):
        ledger.append_events(events, str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    assert log.count() == 2 and (tmp_path / "log" / "event_date=2026-01-02").is_dir()
    items = spark.createDataFrame([("a", "failed", "submit"), ("b", "posted", "submit"),
                                   ("c", "held", "hold")],
                                  "invoice_id string, status string, decision string")
    ledger.write_routed(items, str(tmp_path / "routed"))
    assert sorted(p.name for p in (tmp_path / "routed").glob("dest=*")) == [
        "dest=failed", "dest=needs-review", "dest=posted"]


def test_ledger_csv(spark, tmp_path):
    rows = spark.createDataFrame([("k", "Expense", "Travel", "Bob", "", "1.00", "m")],
                                 "idempotency_key string, Type string, Category string,"
                                 " Vendor string, Date string, Amount string, Source string")
    ledger.write_ledger_csv(rows.coalesce(1), str(tmp_path / "ledger"))
    text = next((tmp_path / "ledger").glob("*.csv")).read_text().splitlines()
    assert text[0] == "Type,Category,Vendor,Date,Amount,Source"
    assert text[1].startswith("Expense,Travel,Bob,")


# ---- review and metrics ----------------------------------------------------------------------------
def _events(spark, rows):
    return spark.createDataFrame(
        [(f"e{i}", inv, i, actor, action, json.dumps(details)) for i, (inv, actor, action, details)
         in enumerate(rows)],
        "event_id string, invoice_id string, seq bigint, actor string, action string,"
        " details string").withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000)))


def test_metrics(spark):
    log = _events(spark, [("a", "ai", "posted", {}), ("b", "ai", "held", {}),
                          ("c", "ai", "held", {}), ("c", "human", "escalated", {}),
                          ("d", "ai", "held", {}), ("d", "human", "reviewed", {})])
    items = spark.createDataFrame([("a", "posted"), ("b", "held"), ("c", "escalated"),
                                   ("d", "held"), ("e", "failed")], "invoice_id string, status string")
    row = metrics.workflow_metrics(items, log).collect()[0]
    assert tuple(row) == (5, 1, 2, 1, 0.25, 0.0, 0.5)
    none = metrics.workflow_metrics(items.filter("invoice_id = 'e'"), log).collect()[0]
    assert tuple(none) == (1, 0, 0, 1, None, None, None)


def test_overlay_keeps_explicit_null(spark):
    def fix(value):
        return {"target": "metadata", "after": {"vendor_name": value}}
    log = _events(spark, [("a", "human", "corrected", fix("New")),
                          ("a", "human", "corrected", fix(None)),
                          ("a", "ai", "corrected", fix("Robot"))])
    assert [r.value for r in overlays.metadata_overlay(log).collect()] == [None]
    base = spark.createDataFrame([("a", {"vendor_name": "Old"})],
                                 "invoice_id string, fields map<string,string>")
    row = overlays.effective_metadata(base, overlays.metadata_overlay(log)).collect()[0]
    assert row.fields["vendor_name"] == "Old" and not row.invalid_override


def test_unknown_filter_is_an_error():
    with pytest.raises(ValueError, match="unknown filter"):
        review.filtered(None, "colour")


def test_submit_watch_tag(spark):
    items = spark.createDataFrame([("a", "posted", "submit", 0.7), ("b", "posted", "submit", 0.8)],
                                  "invoice_id string, status string, decision string,"
                                  " decision_confidence double")
    empty = spark.createDataFrame([], "invoice_id string, id string, type string, message string,"
                                      " created_at timestamp")
    tags = {r.invoice_id: r.filter_tags for r in review.tagged(items, empty).collect()}
    assert tags == {"a": ["low_confidence", "posted"], "b": ["posted"]}


def test_spot_check_bounds(spark):
    posted = spark.range(20).select(F.col("id").cast("string").alias("invoice_id"))
    ids = [r.invoice_id for r in review.spot_check(posted, 5, seed=3).collect()]
    assert len(set(ids)) == 5
    assert ids == [r.invoice_id for r in review.spot_check(posted, 5, seed=3).collect()]
    assert review.spot_check(posted, 50).count() == 20 and review.spot_check(posted, 0).count() == 0


def test_unknown_code_defaults(spark):
    row = spark.createDataFrame([("odd_code",)], "c string").select(
        decide.severity_of(F.col("c")), decide.title_of(F.col("c")),
        decide.is_retryable(F.col("c"))).collect()[0]
    assert tuple(row) == ("high", "Odd code", False)


# ---- plans -----------------------------------------------------------------------------------------
@pytest.mark.parametrize("name", ["decide_items", "categorize_purchases", "header_fields",
                                  "duplicate_guard", "locate_values", "triage_list", "trace",
                                  "advisory_merge", "review_gate", "valid_cursor_sync"])
def test_no_pairwise_joins(spark, name):
    shape = plan(entry.queries()[name](spark, SF))
    assert "CartesianProduct" not in shape and "BroadcastNestedLoopJoin" not in shape


@pytest.mark.parametrize("name", ["categorize_documents", "layout_prose", "confidence_bands",
                                  "payload_formats", "receipt_verdicts"])
def test_row_local_queries_never_shuffle_by_key(spark, name):
    assert "hashpartitioning" not in plan(entry.queries()[name](spark, SF))

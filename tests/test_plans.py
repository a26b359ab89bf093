"""Plans and rows of steps whose cost grew with repeated work."""

from collections import Counter

from pyspark.sql import functions as F

from tallyspark.functions import rows
from tallyspark.operators import audit, citations, duplicates, word_index
from tallyspark.plans import intake
from tallyspark.sources import buckets

CELL = "doc_id string, target_id string, cell string, value_override string, confidence double"
DOCUMENT = '{"metadata":{"vendor_name":{"value":"A","word_indices":[%s]},"total_amount":"1.00"},"line_items":[{"raw_description":"Part","total":"1.00"}]}'


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString().lower()


def messages(spark, rows):
    return spark.createDataFrame(rows, "message_id string, document string").withColumn(
        "created_at", F.lit("2024-01-01").cast("timestamp"))


def test_cells_are_parsed_once(spark):
    cells = spark.createDataFrame([("d", "t", '{"value":"a","word_indices":[1]}', None, 0.9)], CELL).repartition(2)
    read = citations.read_annotated(cells)
    assert plan_of(read).count("parsejson(") == 1
    assert [(r.quote, r.word_indices, r.bad) for r in read.collect()] == [("a", [1], False)]


def test_annotations_do_not_parse_documents_again(spark):
    docs = messages(spark, [("a", DOCUMENT % "1"), ("b", DOCUMENT % '"x"')]).repartition(2)
    read = intake.read_documents(docs)
    assert plan_of(read.select(F.inline("annotations"))).count("parsejson(") == 1
    found = {r.message_id: (r.extract_error, len(r.citations)) for r in citations.annotated(read).collect()}
    assert found == {"a": (False, 1), "b": (True, 1)}


def test_a_run_carries_no_raw_cells(spark):
    done = intake.process(messages(spark, [("a", DOCUMENT % "1")]))
    assert "annotations" not in done.columns and done.count() == 1


def test_an_index_keeps_what_is_asked_for(spark, monkeypatch):
    kept = {}

    def keep(df, name):
        kept[name] = rows.written(df, name)
        return kept[name]
    monkeypatch.setattr(word_index, "written", keep)
    page = [(k, w, 0.0, 0.0, 0.1, 0.1) for k, w in enumerate(["some", "Total", "due", "due", "today"] * 20)]
    pages = spark.createDataFrame([("d", 1, page), ("e", 1, page)], "doc_id string, page_number int, words array<struct<"
                                  "index:int,text:string,x:double,y:double,width:double,height:double>>")
    values = spark.createDataFrame([("d", "t", "total due"), ("e", "u", "due today some")], "doc_id string, target_id string, value string")
    found = {r.target_id: r.word_indices for r in word_index.locate_indexed(values, pages).collect()}
    assert found == {"t": [1, 2], "u": [3, 4, 5]}
    assert "squashed" not in kept and kept["postings"].count() == 60 + 80


def test_pages_that_come_twice_do_not_mix(spark):
    def page(text):
        return [(k, w, 0.0, 0.0, 0.1, 0.1) for k, w in enumerate(text.split())]
    pages = spark.createDataFrame([("d", 1, page("a x")), ("d", 1, page("y b"))], "doc_id string, page_number int, words array<struct<"
                                  "index:int,text:string,x:double,y:double,width:double,height:double>>")
    runs = spark.createDataFrame([("d", ["a", "b"])], "doc_id string, run array<string>")
    places = rows.written(word_index.asked_postings(word_index.squashed_pages(pages), runs), "places")
    proposed = word_index.candidates(runs, places, word_index.token_counts(places))
    assert proposed.count() and not word_index.exact_hits(proposed, places).count()


def test_versions_travel_without_their_content(spark, tmp_path):
    versions = spark.createDataFrame([("a", 1, "x", 5, "s"), ("a", 2, "y", 6, "t"), ("b", 1, "z", 7, "u")],
                                     "invoice_id string, updated_at int, status string, created_at int, source_text string")
    packed = buckets.version_rows(versions)
    assert "content" not in packed.schema.simpleString()
    table = buckets.BucketTable(spark, str(tmp_path), "invoice_id", buckets.merge_versions, buckets=2)
    table.update(packed, 0)
    assert sorted(map(tuple, buckets.latest_of(table.rows()).collect())) == [("a", 5, "s", 2, "y"), ("b", 7, "u", 1, "z")]
    assert {r.invoice_id: r.first is None for r in table.rows().collect()} == {"a": False, "b": True}


def test_a_table_that_grows_is_dealt_to_more_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(buckets, "TASK_ROWS", 20)
    children = spark.createDataFrame([(f"i{k}", f"c{k}") for k in range(400)], "invoice_id string, id string")
    table = buckets.BucketTable(spark, str(tmp_path), "invoice_id", buckets.merge_children, buckets=2)
    table.update(buckets.child_rows(children, 0), 0)
    sizes = [r["count"] for r in table.rows().groupBy(F.input_file_name()).count().collect()]
    assert sum(sizes) == 400 and len(sizes) > 8 and max(sizes) < 100


def test_parts_of_buckets_do_not_meet_in_a_task(spark, tmp_path, monkeypatch):
    """A task writes one part of one bucket: with hashed parts some tasks got several and others none."""
    monkeypatch.setattr(buckets, "TASK_ROWS", 20)
    children = spark.createDataFrame([(f"i{k}", f"c{k}") for k in range(400)], "invoice_id string, id string")
    table = buckets.BucketTable(spark, str(tmp_path), "invoice_id", buckets.merge_children, buckets=4)
    for turn in range(2):
        table.update(buckets.child_rows(children, turn), turn)
        parts = 4 * -(-400 * (1 + turn) // (4 * 20))
        sizes = [r["count"] for r in table.rows().groupBy(F.input_file_name()).count().collect()]
        assert sum(sizes) == 400 and len(sizes) == parts
    table.update(buckets.child_rows(spark.createDataFrame([(None, "c"), ("i1", "n")], "invoice_id string, id string"), 2), 2)
    assert table.rows().count() == 401 and table.rows().where("id = 'n'").count() == 1


def test_a_run_writes_only_what_is_read(spark, monkeypatch):
    """The table between deciding and the guard, and the answers: none for an item that meets nothing."""
    kept = {}

    def keep(df, name):
        kept[name] = rows.written(df, name)
        return kept[name]
    monkeypatch.setattr(intake, "written", keep)
    monkeypatch.setattr(duplicates, "written", keep)
    document = ('{"metadata":{"vendor_name":"A","total_amount":"%s","invoice_date":"2024-01-05","invoice_number":"1","currency":"USD"},'
                '"line_items":[{"raw_description":"flight","total":"%s"},{"raw_description":"ticket","total":"0.00"}]}')
    docs = messages(spark, [("a", document % (1, 1)), ("b", document % (1, 1)), ("c", document % (2, 2)), ("d", "{}")]).withColumn(
        "document", F.when(F.col("message_id") != "d", F.col("document")))
    whole = intake.process(docs)
    assert {"decision_rationale", "field_evidence", "lines"} <= set(kept["judged"].columns)
    want = {r.message_id: (r.status, r.duplicate_of) for r in whole.collect()}
    for limit in ("10485760", "-1"):  # answers that travel to the rows, rows that travel to the answers
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        done = intake.process(docs, columns=["message_id", "category"])
        assert {r.message_id: (r.status, r.duplicate_of) for r in done.collect()} == want
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert set(kept["judged"].columns) == {*intake._OUTCOME, "message_id", "category"}
    assert kept["answers"].count() == 1
    assert sorted(s for s, _ in want.values()) == ["held", "held", "posted", "posted"]


def test_annotated_documents_are_read_once(spark):
    """Documents of one id share their citations, rows without an id have none."""
    docs = messages(spark, [("a", DOCUMENT % "1"), ("a", DOCUMENT % "2"), ("b", DOCUMENT % '"x"'), ("c", "{}"), ("n", DOCUMENT % "3")])
    read = intake.read_documents(docs).withColumn("invoice_id", F.when(F.col("message_id") != "n", F.col("invoice_id")))
    found = citations.annotated(read)
    assert "join" not in plan_of(found)
    assert sorted((r.message_id, r.extract_error, [(c.quote, c.word_indices, c.status) for c in r.citations]) for r in found.collect()) == [
        ("a", False, [("A", [1], "extracted"), ("A", [2], "extracted")])] * 2 + [
        ("b", True, [("A", [None], None)]), ("c", False, []), ("n", False, [])]


def test_own_citations_are_those_of_the_rows(spark):
    cells = ['{"value":"v","word_indices":[1,"2",2.7,true],"page":3}', ' {"value":"v","status":"missing"}', '{"value":"v"}', '"text"', None,
             '{"value":"","word_indices":[1]}', '{"value":"v","word_indices":"x"}', '{"value":"v","word_indices":[],"status":null}',
             '{"value":"v","word_indices":[9],"page":"p"}', '{"value":"v","status":"odd"}', '{"value":"v","word_indices":[9],"status":"unreadable"}',
             '[1]', '{broken', '{"value":7,"word_indices":null,"status":"extracted"}']
    flat = spark.createDataFrame([(f"d{k}", "t", c, o, p) for k, c in enumerate(cells) for o in (None, "o") for p in (0.5, 0.9)], CELL)
    want = citations.read_annotated(flat).select("doc_id", "target_id", "page_number", "quote", "word_indices", "status", "bad")
    rows_of = flat.select("doc_id", F.array(F.struct("target_id", "cell", "value_override", "confidence")).alias("annotations"))
    got = citations.own_citations(rows_of).select("doc_id", F.inline("_own"))
    assert Counter(map(str, got.select(*want.columns).collect())) == Counter(map(str, want.collect())) and want.count() > 20


def test_citations_join_judged_documents(spark, monkeypatch):
    kept = {}

    def keep(df, name):
        kept[name] = rows.written(df, name)
        return kept[name]
    monkeypatch.setattr(intake, "written", keep)
    docs = messages(spark, [("a", DOCUMENT % "1"), ("b", DOCUMENT % "1")])
    word = (0, "A", 0.0, 0.0, 0.1, 0.1)
    name = intake.read_documents(docs).where("message_id = 'a'").head().invoice_id
    pages = spark.createDataFrame([(name, 1, [word])], "doc_id string, page_number int, words array<struct<"
                                  "index:int,text:string,x:double,y:double,width:double,height:double>>")
    done = {r.message_id: r.citations for r in intake.process(docs, pages=pages, columns=["message_id"]).collect()}
    assert set(kept["judged"].columns) == {*intake._OUTCOME, "message_id", "citations"}
    assert done["b"] is None and [c.word_indices for c in done["a"] if c.target_id == "metadata.vendor_name"] == [[0]]


def test_events_are_numbered_where_they_are_made(spark):
    """Steps that did not happen are dropped after a compiled explode, not by a lambda before it."""
    docs = messages(spark, [("a", DOCUMENT % "1"), ("b", '{"metadata":{"total_amount":"n/a"}}')])
    done = intake.process(docs, columns=[*audit.EVENT_COLUMNS, "error_message"]).withColumn(
        "sheet_row_ref", F.lit("r")).withColumn("deduped", F.lit(False)).withColumn("run_ts", F.col("created_at"))
    events = audit.stage_events(done, "run", "message_id")
    assert "posexplode" not in plan_of(events)
    got = sorted((r.message_id, r.seq, r.action) for r in events.collect())
    assert got == [("a", k + 1, x) for k, x in enumerate(("received", "parsed", "extracted", "classified", "categorized", "held"))] + [
        ("b", k + 1, x) for k, x in enumerate(("received", "parsed", "failed"))]

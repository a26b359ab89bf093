"""The large queries compile: no stage falls back because its generated code grows beyond 64 KB."""

import os
import random
from decimal import Decimal

import pytest

import __spark_entry__ as entry
from tallyspark.functions.text import amount_key

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
LARGE = ["document_outcomes", "stage_events", "duplicate_pairs", "duplicate_guard", "recover_outcomes", "run_citations"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", LARGE)
def test_no_fallback(spark, name):
    spark.conf.set("spark.sql.codegen.fallback", "false")  # a failed compilation is an error then
    try:
        entry.queries()[name](spark, SF).write.format("noop").mode("overwrite").save()
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")


def test_amount_keys(spark):
    rng = random.Random(3)
    texts = ["0", "-0", "+0.0", ".", "-.5", "+.50", "00012.500", "1.", "-1.0", "1e3", "1E-3", "-2.50e2", "9" * 50, "0" * 30 + "1", "x", "",
             None, "1,000", " 7 ", "\t-07.70\n", "1e9999", "100", "-100.00", "--1", "1.2.3", "e5", "0.000"]
    texts += ["".join(rng.choice("0012.-+5 ") for _ in range(rng.randrange(1, 7))) for _ in range(400)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = {r.k: r.a for r in df.select("k", amount_key(df.t).alias("a")).collect()}
    import re
    number = re.compile(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]{1,4})?$")
    keys = {}
    for k, t in enumerate(texts):
        if t is None or not number.match(t.strip()):
            assert got[k] is None, t
        elif "9999" not in t:
            value = Decimal(t.strip())
            assert Decimal(got[k]) == value
            assert keys.setdefault(value, got[k]) == got[k]  # equal numbers, equal texts

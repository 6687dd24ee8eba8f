import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import names, text, vectors as vx


def one(spark, column, **values):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("path,language", [("a/b.py", "python"), ("a.PY", "unknown"), ("x/y.tsx", "typescript"), ("c.h", "cpp"), ("Makefile", "unknown"), ("a.b/c", "unknown"), ("m.mjs", "javascript")])
def test_path_language(spark, path, language):
    assert one(spark, text.path_language(F.lit(path))) == language


@pytest.mark.parametrize("path,lexical,semantic", [("src/test/a.py", True, True), ("tests/a.py", False, False), ("a/tests/x.py", True, True), ("test_a.py", True, False), ("a_test.go", True, True), ("A.SPEC.ts", True, False), ("src\\Tests\\a.py", True, False), ("src/latest.py", False, False), ("a/contest.rs", False, False), ("x/test_b.py", True, True)])
def test_test_files(spark, path, lexical, semantic):
    assert one(spark, text.is_test_file(F.lit(path))) is lexical
    assert one(spark, text.is_test_file_semantic(F.lit(path))) is semantic


def test_tokens(spark):
    value = "processPayment_v2 Größe x" + "y" * 40 + " 中文"
    assert one(spark, text.tokens(F.lit(value))) == text.tokenize(value) == ["processpayment", "v2", "größe", "中文"]
    assert one(spark, text.tokens(F.lit(None).cast("string"))) == []


def test_file_line():
    assert text.parse_file_line("a:b/c.py:12") == ("a:b/c.py", 12)
    for bad in ("a.py", "a.py:x", ":3", "a.py:"):
        with pytest.raises(ValueError):
            text.parse_file_line(bad)


@pytest.mark.parametrize("n,shown", [(0, "—"), (1023, "1023 B"), (1536, "1.5 KB"), (1 << 20, "1.0 MB"), (5 << 30, "5.00 GB")])
def test_sizes(spark, n, shown):
    assert one(spark, text.size_text(F.lit(n))) == shown


@pytest.mark.parametrize("n,age,duration", [(-1, "just now", "-1s"), (5, "5s ago", "5s"), (90, "1m ago", "1m30s"), (7260, "2h 1m ago", "2h1m"), (200_000, "2d ago", "55h33m")])
def test_times(spark, n, age, duration):
    assert one(spark, text.age_text(F.lit(n))) == age
    assert one(spark, text.duration_text(F.lit(n))) == duration


def test_small_helpers(spark):
    assert one(spark, text.thousands(F.lit(1234567))) == "1,234,567"
    assert one(spark, text.percent_bar(F.lit(250), 4)) == "[████]" and one(spark, text.percent_bar(F.lit(50), 4)) == "[██░░]"
    assert one(spark, text.integer_percent(F.lit(2), F.lit(3))) == 66 and one(spark, text.integer_percent(F.lit(2), F.lit(0))) == 0
    assert one(spark, text.csv_field(F.lit('a"b'))) == '"a""b"' and one(spark, text.csv_field(F.lit("ab"))) == "ab"
    assert one(spark, text.list_from_json(F.lit("not json"))) == [] and one(spark, text.list_from_json(F.lit('["a"]'))) == ["a"]
    assert one(spark, text.relative_path(F.lit("/r/a/b"), "/r")) == "a/b" and one(spark, text.relative_path(F.lit("/q/a"), "/r/")) == "/q/a"
    assert text.escape_query("a+b:c") == "a\\+b\\:c"
    assert text.version_is_newer("1.10.0", "1.9.9") and not text.version_is_newer("1.x", "1.0.0")
    assert text.parse_bool("ON") and not text.parse_bool("no")
    assert text.days_before(86400 * 3, 2) == 86400
    with pytest.raises(ValueError):
        text.parse_bool("maybe")


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcde_", min_size=1, max_size=12), st.text(alphabet="abcde_", min_size=1, max_size=12))
def test_jaro_winkler_equals_another_engine(a, b):
    other = duckdb.execute("SELECT jaro_winkler_similarity(?, ?)", [a, b]).fetchone()[0]
    assert names.jaro_winkler_text(a, b) == pytest.approx(other, abs=1e-9)


def test_name_scores(spark):
    rows = spark.createDataFrame([("Process_Payment",), ("process_payment_v2",), ("do_process_payment",), ("refund",), (None,)], "name string")
    got = {r["name"]: r["s"] for r in rows.select("name", names.name_match_score(F.lit("process_payment"), F.col("name")).alias("s")).collect()}
    assert got["Process_Payment"] == 1.0 and got["process_payment_v2"] == 0.9 and got["do_process_payment"] == 0.7 and 0 < got["refund"] <= 0.4
    two = rows.select("name", names.name_match_score(F.lit("zzz refund"), F.col("name")).alias("s")).collect()
    assert {r["name"]: r["s"] for r in two}["refund"] == 0.5
    assert rows.select(names.name_match_score(F.lit(""), F.col("name")).alias("s")).first()["s"] == 0.9


def test_quantized_vectors(spark):
    pick = np.random.default_rng(1)
    rows = [(i, [float(x) for x in pick.standard_normal(32)]) for i in range(20)] + [(99, [2.0] * 32)]
    df = spark.createDataFrame(rows, "id long, v array<double>").withColumn("q", vx.quantize(F.col("v")))
    back = df.select("id", "v", vx.dequantize(F.col("q.data"), F.col("q.v_min"), F.col("q.v_max")).alias("b"), "q")
    for r in back.collect():
        assert max(abs(x - y) for x, y in zip(r["v"], r["b"])) <= (max(r["v"]) - min(r["v"])) / 255 / 2 + 1e-9
        assert all(0 <= x <= 255 for x in r["q"]["data"])
    a, b = np.array(rows[0][1]), np.array(rows[1][1])
    got = one(spark, vx.cosine(F.array(*map(F.lit, rows[0][1])), F.array(*map(F.lit, rows[1][1]))))
    assert got == pytest.approx(a @ b / np.linalg.norm(a) / np.linalg.norm(b))
    assert one(spark, vx.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) is None
    assert [tuple(p) for p in one(spark, vx.sparse(F.array(F.lit(0.5), F.lit(-0.05), F.lit(-2.0)), 0.1))] == [(0, 0.5), (2, -2.0)]

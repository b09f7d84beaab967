"""Lexical features: goldens, dialects, both entropy forms (reference tests ported)."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sievekit.functions.dialect import BASE, EXTENDED, FEATURE_COLUMNS
from sievekit.functions.text import (
    confidence_pct, digit_ratio, preview, shannon_entropy, strip_py, upper_ratio,
)
from sievekit.operators.features import add_payload_features, entropy_table, extract_features


def py_entropy(s):
    if not s:
        return 0.0
    n = len(s)
    return -sum((c / n) * math.log2(c / n) for c in Counter(s).values())


TEXTS = ["<script>alert('XSS')</script>", "", "a", "aaaa", "SELECT * FROM users WHERE 1=1",
         "héllo wörld ñ", "tab\tnew\nline", "😀😀x", "1' OR '1'='1'--"]


def test_entropy_golden(spark):
    row = spark.createDataFrame([("<script>alert('XSS')</script>",)], "p string") \
        .select(shannon_entropy("p").alias("h")).collect()[0]
    assert round(row["h"], 6) == 3.978334


def test_entropy_empty_is_zero(spark):
    out = extract_features(spark.createDataFrame([("",), (None,)], "payload string"))
    assert [r["payload_entropy"] for r in out.collect()] == [0.0, 0.0]


def test_entropy_forms_agree_with_python(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "k int, p string")
    stateless = {r["k"]: r["h"] for r in df.select("k", shannon_entropy("p").alias("h")).collect()}
    keyed = {r["k"]: r["payload_entropy"] for r in entropy_table(df, "k", "p").collect()}
    for k, t in enumerate(TEXTS):
        assert stateless[k] == pytest.approx(py_entropy(t), abs=1e-12)
        assert keyed[k] == pytest.approx(py_entropy(t), abs=1e-12)


def test_entropy_epsilon_variant_close(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "p string")
    rows = df.select(shannon_entropy("p").alias("a"), shannon_entropy("p", 1e-12).alias("b")).collect()
    for r in rows:
        assert abs(r["a"] - r["b"]) < 1e-9


@pytest.fixture
def simple_df(spark):
    return spark.createDataFrame([("<script>alert(1)</script>",), ("SELECT * FROM users WHERE 1=1",),
                                  ("Hello world",)], "Payload string")


def test_seven_features(simple_df):
    out = add_payload_features(simple_df).collect()
    assert len(out[0]) == 1 + 7
    assert out[0]["payload_len"] == len("<script>alert(1)</script>")
    assert [r["kw_xss"] for r in out] == [1, 0, 0]
    assert [r["kw_sql"] for r in out] == [0, 1, 0]
    for r in out:
        assert r["payload_entropy"] >= 0
        assert 0 <= r["digit_ratio"] <= 1 and 0 <= r["upper_ratio"] <= 1


def test_special_char_sets(spark):
    df = spark.createDataFrame([("<a href='x'>(1);-%=</a>",)], "payload string")
    base = extract_features(df, dialect=BASE).collect()[0]["special_char_cnt"]
    ext = extract_features(df, dialect=EXTENDED).collect()[0]["special_char_cnt"]
    s = "<a href='x'>(1);-%=</a>"
    assert base == sum(s.count(c) for c in "<>\"'()")
    assert ext == sum(1 for ch in s if ch in "<>\"'()=;-%")


def test_extended_keywords(spark):
    df = spark.createDataFrame([("x' or 'a'='a",), ("<div onmouseover=x>",), ("plain",)], "payload string")
    out = extract_features(df, dialect=EXTENDED).collect()
    assert [r["kw_sql"] for r in out] == [1, 0, 0]
    assert [r["kw_xss"] for r in out] == [0, 1, 0]


def test_unicode_classes_match_python(spark):
    texts = ["Ⅻ ÀÉ ١٢٣ ²³ abc", "ÑAND 42", "ǅ ǈ ᾈ"]
    df = spark.createDataFrame([(t,) for t in texts], "p string")
    rows = df.select(digit_ratio("p", True).alias("d"), upper_ratio("p", True).alias("u")).collect()
    for t, r in zip(texts, rows):
        assert r["d"] == pytest.approx(sum(c.isdigit() for c in t) / max(len(t), 1))
        assert r["u"] == pytest.approx(sum(c.isupper() for c in t) / max(len(t), 1))


def test_strip_matches_python(spark):
    texts = ["  hello world  ", "　x ", "\x1c\x1dy\x85", "none"]
    df = spark.createDataFrame([(t,) for t in texts], "p string")
    assert [r[0] for r in df.select(strip_py("p")).collect()] == [t.strip() for t in texts]


def test_preview_and_confidence(spark):
    df = spark.createDataFrame([("x" * 60, [0.125, 0.875]), ("short", [0.00025, 0.99975])], "p string, pr array<double>")
    rows = df.select(preview("p", 50).alias("v"), confidence_pct("pr", 1).alias("c"),
                     confidence_pct("pr", 2).alias("c2")).collect()
    assert rows[0]["v"] == "x" * 50 + "…" and rows[1]["v"] == "short"
    assert rows[0]["c"] == 87.5 and rows[1]["c2"] == 99.98  # half-even: 99.975 -> 99.98 (binary repr above .5)


def test_feature_order():
    assert FEATURE_COLUMNS == ("payload_len", "payload_entropy", "special_char_cnt", "digit_ratio",
                               "upper_ratio", "kw_sql", "kw_xss")


def test_no_python_udf_in_feature_plan(spark, simple_df):
    plan = add_payload_features(simple_df)._jdf.queryExecution().executedPlan().toString()
    assert "PythonUDF" not in plan and "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan

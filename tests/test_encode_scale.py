"""Encoders and scalers (reference feature tests ported)."""

import pytest
from pyspark.sql import functions as F

from sievekit.operators.encode import code_table, encode_features, label_encode
from sievekit.operators.scale import METHODS, ScalerState, fit_scaler, scale_features, transform

COLS = ["a", "b", "c"]


@pytest.fixture
def numeric_df(spark):
    return spark.range(100).select(((F.col("id") * 37) % 101).cast("double").alias("a"),
                                   (F.col("id") % 7 * 0.5).alias("b"), F.lit(3.0).alias("c"))


def test_label_order_is_text_order(spark):
    df = spark.createDataFrame([(1,), (10,), (2,), (None,)], "x bigint")
    t = {r["value"]: r["x_code"] for r in code_table(df, "x").collect()}
    assert t == {"1": 0, "10": 1, "2": 2, "None": 3}


def test_label_encode_roundtrip(spark):
    df = spark.createDataFrame([("XSS",), ("SQLi",), ("normal",)], "text_label string")
    enc, table = label_encode(df, "text_label", out_col="code")
    assert sorted(r["code"] for r in enc.collect()) == [0, 1, 2]
    assert {r["value"] for r in table.collect()} == {"XSS", "SQLi", "normal"}


def test_onehot_and_bad_strategy(spark):
    df = spark.createDataFrame([("<script>", "XSS"), ("SELECT *", "SQLi"), ("Hello", "normal")], "Payload string, text_label string")
    out, cats = encode_features(df, ["text_label"], "onehot")
    assert "text_label" not in out.columns
    assert sorted(c for c in out.columns if c.startswith("text_label_")) == ["text_label_SQLi", "text_label_XSS", "text_label_normal"]
    assert all(sum(r[c] for c in out.columns if c.startswith("text_label_")) == 1.0 for r in out.collect())
    with pytest.raises(ValueError):
        encode_features(df, ["text_label"], "bad")


@pytest.mark.parametrize("method", METHODS)
def test_scalers_keep_shape(numeric_df, method):
    out, _ = scale_features(numeric_df, method, COLS)
    assert out.count() == 100 and out.columns == numeric_df.columns


def test_minmax_range_and_standard_mean(numeric_df):
    mm, _ = scale_features(numeric_df, "minmax", COLS)
    r = mm.agg(*[F.min(c).alias(f"mn_{c}") for c in COLS], *[F.max(c).alias(f"mx_{c}") for c in COLS]).collect()[0]
    assert r["mn_a"] == 0.0 and r["mx_a"] == 1.0 and r["mx_c"] == 0.0  # constant column -> 0
    st, _ = scale_features(numeric_df, "standard", COLS)
    r = st.agg(F.avg("a").alias("m"), F.stddev_pop("a").alias("s")).collect()[0]
    assert abs(r["m"]) < 1e-12 and r["s"] == pytest.approx(1.0)


def test_robust_and_state_reuse(spark, numeric_df):
    state = fit_scaler(numeric_df, "robust", COLS)
    again = ScalerState.from_df(state.to_df(spark))
    a = transform(numeric_df, state).collect()
    b = transform(numeric_df, again).collect()
    assert a == b


def test_unknown_method_raises(numeric_df):
    with pytest.raises(ValueError, match="Choose from"):
        fit_scaler(numeric_df, "bad")


def test_unseen_value_raises(spark):
    import pytest

    from sievekit.operators.encode import label_encode

    df = spark.createDataFrame([("a",), ("b",)], "x string")
    _, table = label_encode(df, "x")
    with pytest.raises(Exception, match="lacks"):
        label_encode(spark.createDataFrame([("c",)], "x string"), "x", table)[0].collect()

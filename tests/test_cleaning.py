"""Cleaning: the reference's clean_data assertions plus goldens."""

import pytest
from pyspark.sql import functions as F

from sievekit.operators.cleaning import (
    check_batch, clean, column_medians, column_modes, near_constant_columns, null_profile,
)
from sievekit.operators.quantiles import exact_quantiles


@pytest.fixture
def sample_df(spark):
    rows = [("<script>alert('XSS')</script>", 1, "XSS", 1), ("1' OR '1'='1'--", 2, "SQLi", 2),
            ("Select a paint color for the room.", 3, "normal", 3), ("1' OR '1'='1'--", 2, "SQLi", 2),
            (None, 3, "normal", 5), ("  hello world  ", 3, "normal", 6)]
    return spark.createDataFrame(rows, "Payload string, Label bigint, text_label string, ID bigint")


def test_removes_duplicates(sample_df):
    out, rep = clean(sample_df)
    assert rep.duplicates_removed == 1
    assert out.count() == 5


def test_fills_and_strips(sample_df):
    out, rep = clean(sample_df)
    vals = [r["Payload"] for r in out.collect()]
    assert None not in vals
    assert all(v == v.strip() for v in vals)
    # golden: the smallest of the tied modes is '  hello world  ', then stripped
    assert vals.count("hello world") == 2
    assert rep.missing_before == {"Payload": 1} and rep.missing_after == 0


def test_no_false_constant_drop(spark):
    df = spark.createDataFrame([("a", 1, "XSS", 10), ("b", 2, "SQLi", 11), ("c", 3, "normal", 12)],
                               "Payload string, Label bigint, text_label string, ID bigint")
    _, rep = clean(df)
    assert rep.constant_cols_dropped == []


def test_constant_rules(spark):
    df = spark.createDataFrame([(i, "k", i % 2) for i in range(3000)], "a int, c string, label int")
    assert near_constant_columns(df, mode="nunique", protect=("label",)) == ["c"]
    assert set(near_constant_columns(df, threshold=0.001, protect=("label",))) == {"c"}
    with pytest.raises(ValueError):
        near_constant_columns(df, mode="bad")


def test_mode_smallest_on_tie(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "x string")
    assert column_modes(df, ["x"]) == {"x": "a"}


def test_median_matches_pandas(spark):
    import pandas as pd

    vals = [3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0, 6.0, None]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    assert column_medians(df, ["x"])["x"] == pd.Series(vals).median()


def test_quantiles_equal_numpy(spark):
    """Radix selection on values that share many leading digits, with a hot
    value, null and NaN values, infinities, tiny numbers and a null group."""
    import numpy as np

    rng = np.random.default_rng(1)
    hard = [0.0, -0.0, 1.0, np.nextafter(1.0, 2.0), np.nextafter(1.0, 0.0), 2.0**52, 2.0**53 + 2, -1e308, 1e308, 5e-324, -5e-324, 2.0**-1022,
            float("nan"), None]
    rows = [("hard", None if v is None else float(v)) for v in hard] + [("inf", v) for v in (float("inf"), float("-inf"), 3.0)]
    rows += [("near", 1.0 + i * 2.0**-50) for i in range(200)] + [("hot", 7.0)] * 900 + [("hot", float(x)) for x in rng.normal(size=400)]
    rows += [(None, float(x)) for x in rng.integers(-50, 50, 301)] + [("none", None), ("one", 2.5)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {(r["g"], r["p"]): r["q"] for r in exact_quantiles(df, "v", probs, ["g"]).collect()}
    for g in ("hard", "near", "hot", None, "one"):
        x = np.array([v for h, v in rows if h == g and v is not None and v == v])
        for p in probs:
            assert got.pop((g, p)) == pytest.approx(float(np.quantile(x, p)), rel=1e-15, abs=0.0), (g, p)
    assert {got.pop(("inf", p)) for p in (0.0, 0.5, 1.0)} == {float("-inf"), 3.0, float("inf")}
    assert {k[0] for k in got} == {"inf"}  # a group without values is absent


def test_order_keys_keep_order_and_come_back(spark):
    import numpy as np

    from sievekit.operators.quantiles import key_value, order_key

    rng = np.random.default_rng(2)
    x = np.concatenate([rng.integers(-(1 << 63), 1 << 63, 20_000, dtype=np.int64).view(np.float64), 2.0 ** np.arange(-1074, 1024),
                        np.nextafter(2.0 ** np.arange(-1000, 1024), 0), [0.0, np.inf, -np.inf]])
    x = np.unique(x[~np.isnan(x)])
    df = spark.createDataFrame([(float(v),) for v in x], "x double").repartition(4)
    got = df.select("x", order_key(F.col("x")).alias("k"), key_value(order_key(F.col("x"))).alias("y")).toPandas().sort_values("x")
    assert (got["x"] == got["y"]).all() and (np.diff(got["k"].to_numpy()) > 0).all()


def test_null_profile(sample_df):
    prof = {r["column"]: r["n_null"] for r in null_profile(sample_df).collect()}
    assert prof == {"Payload": 1, "Label": 0, "text_label": 0, "ID": 0}


def test_batch_guards(spark):
    with pytest.raises(ValueError):
        check_batch(spark.createDataFrame([], "payload string"))
    with pytest.raises(ValueError):
        check_batch(spark.range(501), max_rows=500)
    assert check_batch(spark.range(500), max_rows=500).count() == 500

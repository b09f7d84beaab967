"""Training and scoring invariants (reference train/predict tests ported)."""

import math

import pytest
from pyspark.sql import functions as F

from sievekit.functions.dialect import FEATURE_COLUMNS
from sievekit.operators.models import fit_gaussian_nb, predict_gaussian_nb
from sievekit.operators.select import laid_out, rf_importances, select_from_model
from sievekit.plans.training import compare_models, score_batch

from conftest import SF001

FEATS = list(FEATURE_COLUMNS)


@pytest.fixture(scope="module")
def synthetic(spark):
    # three separated classes (means -2 / 0 / +2 on every feature), 360 rows
    df = spark.range(360).select("id", (F.col("id") % 3).cast("double").alias("label"))
    noise = lambda k: (F.abs(F.hash(F.col("id"), F.lit(k))) % 1000 / 1000.0 - 0.5)
    return df.select("id", "label", *[((F.col("label") - 1) * 2 + noise(i)).alias(c) for i, c in enumerate(FEATS)])


def test_gaussian_nb_separates(synthetic):
    st = fit_gaussian_nb(synthetic, FEATS, "label")
    out = predict_gaussian_nb(synthetic, st, FEATS)
    acc = out.agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).collect()[0][0]
    assert acc == 1.0
    probs = out.select("probability").collect()
    assert all(abs(sum(r[0]) - 1.0) < 1e-9 for r in probs)


def test_importances_sum_to_one(synthetic):
    imp = rf_importances(synthetic, FEATS, "label", trees=20)
    rows = imp.collect()
    assert sum(r["importance"] for r in rows) == pytest.approx(1.0)
    sel = select_from_model(imp, "mean").collect()
    assert 1 <= sum(r["selected"] for r in sel) <= len(FEATS)


def test_compare_models_ranges(spark):
    out = compare_models(spark, SF001, ["DecisionTree", "GaussianNB"]).collect()
    assert {r["model"] for r in out} == {"DecisionTree", "GaussianNB"}
    for r in out:
        for k in ("accuracy", "precision", "recall", "f1"):
            assert 0.0 <= r[k] <= 1.0


def test_score_batch_fields(spark):
    payloads = spark.createDataFrame([("<script>alert('XSS')</script>",), ("1' OR '1'='1'--",),
                                      ("What is the weather in Chennai today?",)], "payload string")
    out = score_batch(spark, SF001, payloads, "DecisionTree").collect()
    assert len(out) == 3
    for r in out:
        assert r["label"] in ("XSS", "SQLi", "Normal")
        assert 0.0 <= r["confidence"] <= 100.0
        assert sum(r["probabilities"].values()) == pytest.approx(100.0, abs=0.2)
        assert r["severity"] in ("CRITICAL", "HIGH", "SAFE")
        assert all(math.isfinite(r[c]) for c in FEATS)


def test_importances_do_not_depend_on_partitioning(spark):
    rows = [(i % 3, float(i % 3 + (i * 37 % 11) / 4), float(i * 53 % 29), float(i % 5)) for i in range(400)] + [(1, 1.0, 1.0, None)] * 300
    df = spark.createDataFrame(rows, "label int, a double, b double, c double").fillna(0.0)
    ask = lambda d: [tuple(r) for r in rf_importances(d, ["a", "b", "c"], "label", trees=8).collect()]
    one = ask(df.coalesce(1))
    assert one == ask(df.repartition(8)) and one[0][0] == "a"
    sizes = [r["n"] for r in laid_out(df, df.columns, 50).groupBy(F.spark_partition_id()).agg(F.count("label").alias("n")).collect()]
    assert sum(sizes) == 700 and max(sizes) < 120

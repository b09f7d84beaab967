"""Evaluation tables against direct computations."""

import random

import pytest
from pyspark.sql import functions as F

from sievekit.operators.evaluate import (
    classification_report, confusion_table, evaluate, overall_metrics, per_class_metrics, pr_curve, roc_auc,
    roc_curve, running_sum,
)

CLASSES = ["XSS", "SQLi", "Normal"]


@pytest.fixture
def preds(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(300):
        y = CLASSES[i % 3]
        p = y if rnd.random() < 0.7 else rnd.choice(CLASSES)
        s = round(rnd.random() * (1.5 if y == "XSS" else 1.0), 3)
        rows.append((i, y, p, s))
    return rows, spark.createDataFrame(rows, "id int, y string, p string, s_xss double")


def _manual(rows):
    out = {}
    for c in CLASSES:
        tp = sum(1 for _, y, p, _ in rows if y == c and p == c)
        pp = sum(1 for _, _, p, _ in rows if p == c)
        sup = sum(1 for _, y, _, _ in rows if y == c)
        pr = tp / pp if pp else 0.0
        rc = tp / sup if sup else 0.0
        f1 = 2 * pr * rc / (pr + rc) if pr + rc else 0.0
        out[c] = (pr, rc, f1, sup)
    return out


def test_weighted_metrics(preds):
    rows, df = preds
    m = evaluate(df, "y", "p", CLASSES).collect()[0]
    man = _manual(rows)
    n = len(rows)
    assert m["accuracy"] == pytest.approx(sum(1 for _, y, p, _ in rows if y == p) / n)
    for i, k in enumerate(("precision", "recall", "f1")):
        assert m[k] == pytest.approx(sum(v[i] * v[3] for v in man.values()) / n)


def test_confusion_zero_cells(spark):
    df = spark.createDataFrame([("XSS", "XSS"), ("SQLi", "XSS")], "y string, p string")
    conf = confusion_table(df, "y", "p", CLASSES).collect()
    assert len(conf) == 9 and sum(r["n"] for r in conf) == 2
    rep = classification_report(per_class_metrics(confusion_table(df, "y", "p", CLASSES))).collect()
    assert [r["row"] for r in sorted(rep, key=lambda r: r["position"])][-3:] == ["accuracy", "macro avg", "weighted avg"]
    norm = [r for r in rep if r["row"] == "Normal"][0]
    assert norm["precision"] == 0.0 and norm["f1"] == 0.0  # zero_division -> 0


def test_binary_average(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 1), (1, 1)], "y int, p int")
    m = evaluate(df, "y", "p", [0, 1]).collect()[0]
    assert m["precision"] == pytest.approx(2 / 3) and m["recall"] == pytest.approx(2 / 3)


def test_running_sum_many_partitions(spark):
    df = spark.range(2000).select((F.col("id") % 3).alias("g"), F.col("id").alias("o"), F.lit(1).alias("v"))
    out = running_sum(df, ["g"], [F.col("o")], ["v"], partitions=13).collect()
    for r in out:
        assert r["cum_v"] == r["o"] // 3 + 1


def test_roc_auc_matches_pair_count(preds):
    rows, df = preds
    auc = {r["class"]: r["auc"] for r in roc_auc(df, "y", {"XSS": "s_xss"}).collect()}["XSS"]
    pos = [s for _, y, _, s in rows if y == "XSS"]
    neg = [s for _, y, _, s in rows if y != "XSS"]
    pairs = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a in pos for b in neg)
    assert auc == pytest.approx(pairs / (len(pos) * len(neg)))
    curve = roc_curve(df, "y", {"XSS": "s_xss"}).collect()
    assert max(r["tpr"] for r in curve) == 1.0 and max(r["fpr"] for r in curve) == 1.0
    pr = pr_curve(df, "y", {"XSS": "s_xss"}).collect()
    assert any(r["threshold"] is None and r["precision"] == 1.0 and r["recall"] == 0.0 for r in pr)


def test_evaluation_of_counts_shuffles_nothing(spark):
    """five exchanges a call on a table of a few rows; tuning calls it per configuration and fold."""
    df = spark.createDataFrame([(1, 0.0), (1, 1.0), (7, 0.0), (None, 1.0), (0, None), (0, 0.0)], "y bigint, p double")
    m = evaluate(df, "y", "p", [0, 1, 2])
    assert "Exchange" not in m._jdf.queryExecution().executedPlan().toString()
    assert m.collect()[0]["accuracy"] == pytest.approx(2 / 6)
    conf = confusion_table(df, "y", "p", [0, 1, 2])
    assert [t for _, t in conf.dtypes] == ["int", "bigint", "int", "double", "bigint"]
    got = {(r["actual"], r["predicted"]): r["n"] for r in conf.collect() if r["n"]}
    assert got == {(1, 0.0): 1, (1, 1.0): 1, (None, 0.0): 1, (None, 1.0): 1, (0, None): 1, (0, 0.0): 1} and conf.count() == 9 + 3
    per = {r["class"]: (r["position"], r["tp"], r["fp"], r["fn"], r["support"]) for r in per_class_metrics(conf).collect()}
    assert per == {0: (0, 1, 2, 1, 2), 1: (1, 1, 1, 1, 2), 2: (2, 0, 0, 0, 0), None: (None, 0, 0, 2, 2)}

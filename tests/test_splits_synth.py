"""Exact splits, folds, seeded sampling and synthetic data."""

import pytest
from pyspark.sql import functions as F

from sievekit.operators.ordering import exact_sample
from sievekit.operators.splits import assign_folds, stratified_split
from sievekit.operators.synth import FILLER_WORDS, TEMPLATES, generate_payloads, inject_label_noise


def _classes(spark, sizes, parts=8):
    df = spark.range(sum(sizes)).repartition(parts)
    bounds = [sum(sizes[:i + 1]) for i in range(len(sizes))]
    lab = F.when(F.col("id") < bounds[0], 1)
    for i, b in enumerate(bounds[1:], start=2):
        lab = lab.when(F.col("id") < b, i)
    return df.withColumn("Label", lab)


def test_stratified_split_golden(spark):
    df = _classes(spark, [5932, 7567, 2902])
    out = stratified_split(df, "Label", "id", 0.2, seed=42)
    got = {r["Label"]: r["count"] for r in out.where("split = 'test'").groupBy("Label").count().collect()}
    assert got == {1: 1187, 2: 1514, 3: 580}
    assert out.count() == 16401


def test_split_partition_independent(spark):
    a = stratified_split(_classes(spark, [300, 200, 50], parts=1), "Label", "id", 0.2)
    b = stratified_split(_classes(spark, [300, 200, 50], parts=8), "Label", "id", 0.2)
    ta = {r["id"] for r in a.where("split='test'").collect()}
    tb = {r["id"] for r in b.where("split='test'").collect()}
    assert ta == tb and len(ta) == 110


def test_split_needs_two_classes(spark):
    with pytest.raises(ValueError):
        stratified_split(spark.range(10).withColumn("Label", F.lit(1)), "Label", "id")


def test_folds_balanced(spark):
    df = _classes(spark, [103, 57, 11])
    f = assign_folds(df, "id", 5, label="Label")
    per = f.groupBy("Label", "fold").count().collect()
    by = {}
    for r in per:
        by.setdefault(r["Label"], []).append(r["count"])
    for counts in by.values():
        assert max(counts) - min(counts) <= 1
    tot = [r["count"] for r in f.groupBy("fold").count().collect()]
    assert max(tot) - min(tot) <= 1


def test_exact_sample(spark):
    df = spark.range(1000)
    s1 = [r["id"] for r in exact_sample(df, 100, "id").collect()]
    s2 = [r["id"] for r in exact_sample(df.repartition(7), 100, "id").collect()]
    assert len(s1) == 100 and s1 == s2
    assert exact_sample(df, 5000, "id").count() == 1000


def test_generate_payloads(spark):
    out = generate_payloads(spark.range(200), "id").collect()
    assert len(out) == 600
    words = set(FILLER_WORDS)
    for r in out:
        assert r["label"] in TEMPLATES
        assert any(w in r["payload"] for w in words)
    doubled = sum(1 for r in out if "  " in r["payload"])
    assert 0 < doubled < 200  # about 15 %


def test_label_noise_exact(spark):
    df = spark.range(1000).withColumn("label", F.element_at(F.array(F.lit("Normal"), F.lit("XSS"), F.lit("SQLi")),
                                                             (F.col("id") % 3 + 1).cast("int")))
    out = inject_label_noise(df.withColumnRenamed("label", "orig").withColumn("label", F.col("orig")), "id", "label", 0.03)
    rows = out.collect()
    flipped = [r for r in rows if r["flipped"]]
    assert len(flipped) == 30
    assert all(r["label"] != r["orig"] for r in flipped)
    assert all(r["label"] == r["orig"] for r in rows if not r["flipped"])

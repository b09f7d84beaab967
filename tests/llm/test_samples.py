"""Samples that models learn from stay bounded, and whole, when rows share an
id, have none, or are equal."""

import pytest
from pyspark.sql import functions as F

from sievekit.llm import decision_list, gru_langid, ordinal_quality


@pytest.fixture
def drawn(monkeypatch):
    """Labels of the rows that reach the network's training."""
    got = []
    monkeypatch.setattr(gru_langid.Network, "fit", lambda self, data, target, mask, **k: got.append((self.langs, target)))
    return got


def _docs(spark, key, text):
    return spark.range(4000).select(key.alias("doc_id"), text.alias("text"), F.when(F.col("id") % 4 == 0, "de").otherwise("en").alias("lang"))


@pytest.mark.parametrize("key", ["7L", "CAST(NULL AS BIGINT)"])
@pytest.mark.parametrize("text", ["concat('word ', id)", "'one text for all'"])
def test_language_sample(spark, drawn, key, text):
    assert gru_langid.fit(_docs(spark, F.expr(key), F.expr(text)), sample_docs=60) is not None
    langs, target = drawn[0]
    assert langs == ["de", "en"] and sorted(target.tolist()) == [0] * 60 + [1] * 60


def test_language_sample_is_repeatable(spark, drawn):
    df = _docs(spark, F.col("id"), F.concat(F.lit("word "), F.col("id").cast("string")))
    gru_langid.fit(df, sample_docs=30)
    gru_langid.fit(df.repartition(13), sample_docs=30)
    assert drawn[0][1].tolist() == drawn[1][1].tolist()


def test_rules_learn_from_one_row_a_key(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(decision_list, "learn", lambda counts, bad, order: seen.update(n=len(bad)) or [])
    docs = spark.range(3000).select(F.when(F.col("id") < 2500, 1).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("some words "), F.col("id").cast("string")).alias("text"))
    labels = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("quality"))
    decision_list.fit(docs, labels)
    assert seen["n"] == 501
    decision_list.fit(docs, labels, sample_rows=100)
    assert seen["n"] <= 100
    decision_list.fit(docs.withColumn("doc_id", F.lit(None).cast("long")), labels)  # no document has a label
    assert seen["n"] == 0


def test_grades_learn_from_one_row_a_key(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(ordinal_quality.CumulativeLink, "fit", lambda self, rows, y, **k: seen.append(len(y)) or [])
    docs = spark.range(3000).select(F.when(F.col("id") < 2500, 1).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("some words "), F.col("id").cast("string")).alias("text"))
    labels = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("quality"), F.lit(0).alias("toxic"))
    ordinal_quality.fit(docs, labels, ordinal_quality.grade_column())
    assert seen == [501]

"""Versioned artifacts, and the live history against a batch."""

import os

import pytest
from pyspark.sql import functions as F

from sievekit.operators import training as tr
from sievekit.streaming.history import history, recent_entries
from sievekit.streaming.live import payload_stream, run_update_to_table


def _fitted(spark, shift):
    rows = spark.range(60).select((F.col("id") % 7 + shift).cast("double").alias("f"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("y"))
    return tr.fit(rows, ["f"], "y", "GaussianNB")


def _mean(fitted):
    return fitted.table.toPandas().sort_values("class").to_numpy().tolist()


def test_broken_save_leaves_the_former_version(spark, tmp_path, monkeypatch):
    path, one, two = str(tmp_path / "m"), _fitted(spark, 0), _fitted(spark, 100)
    point, calls = tr._point_to, []

    def broken(*a):
        calls.append(a)
        raise OSError("disk full")

    monkeypatch.setattr(tr, "_point_to", broken)
    with pytest.raises(OSError):
        one.save(path)
    assert tr.load_artifact(spark, path) is None  # all files but no pointer
    monkeypatch.setattr(tr, "_point_to", point)
    one.save(path)
    assert _mean(tr.load_artifact(spark, path)) == _mean(one)
    monkeypatch.setattr(two, "labels", [object()])  # breaks after the table, before the metadata
    with pytest.raises(TypeError):
        two.save(path)
    assert _mean(tr.load_artifact(spark, path)) == _mean(one)


def test_newest_version_is_current_and_old_ones_go(spark, tmp_path):
    path = str(tmp_path / "m")
    models = [_fitted(spark, i) for i in range(tr.KEPT_VERSIONS + 2)]
    for m in models:
        m.save(path)
        assert _mean(tr.load_artifact(spark, path)) == _mean(m)
    assert sum(n.startswith("version-") for n in os.listdir(path)) == tr.KEPT_VERSIONS


SCHEMA = "user string, id bigint, ts timestamp"


def _entries(spark, low, high):
    """Two thirds of the entries are one user's; some have no time."""
    return spark.range(low, high).select(
        F.when(F.col("id") % 3 > 0, "busy").otherwise(F.concat(F.lit("u"), (F.col("id") % 5).cast("string"))).alias("user"), "id",
        F.when(F.col("id") % 17 > 0, F.timestamp_seconds(F.lit(1_700_000_000) + F.pmod(F.col("id") * 7919, F.lit(1000)))).alias("ts"))


def _run(spark, folder, sink, ck, **more):
    stream = payload_stream(spark, folder, spark.createDataFrame([], SCHEMA).schema)
    run_update_to_table(recent_entries(stream, "user", "id", "ts", keep=5, salts=3, **more), sink, ck)


def _want(df):
    rows = {}
    for r in df.distinct().collect():
        rows.setdefault(r["user"], []).append((-(r["ts"].timestamp() if r["ts"] else float("-inf")), r["id"]))
    return {(u, i, n + 1) for u, xs in rows.items() for n, (_, i) in enumerate(sorted(xs)[:5])}


@pytest.mark.parametrize("more", [{}, {"idle": "1 day"}, {"idle": "1 second"}])
def test_history_after_restart_and_replay(spark, tmp_path, more):
    folder, sink, ck = (str(tmp_path / n) for n in ("in", "sink", "ck"))
    _entries(spark, 0, 300).repartition(3).write.parquet(folder)
    _run(spark, folder, sink, ck, **more)
    _entries(spark, 200, 500).repartition(2).write.mode("append").parquet(folder)  # a hundred entries come again
    _run(spark, folder, sink, ck, **more)  # restarted
    _run(spark, folder, sink, ck, **more)
    got = {(r["user"], r["entry"], r["rank"]) for r in history(spark.read.parquet(sink), 5).collect()}
    assert got == _want(_entries(spark, 0, 500))
    if not more:  # only what entered a list was put out
        assert spark.read.parquet(sink).count() < 400

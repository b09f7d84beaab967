"""Nearest-neighbour mutual information against a direct computation."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sievekit.operators.neighbours import digamma, kth_distances, mutual_information_knn


def _psi(n):
    return -0.5772156649015329 + sum(1 / j for j in range(1, n))


def _direct(rows, k=3):
    rows = [(x, y) for x, y in rows if x is not None and y is not None and x == x]
    size = {}
    for _, y in rows:
        size[y] = size.get(y, 0) + 1
    rows = [(x, y) for x, y in rows if size[y] > 1]
    total = 0.0
    for i, (x, y) in enumerate(rows):
        kk = min(k, size[y] - 1)
        r = sorted(abs(x - w) for j, (w, z) in enumerate(rows) if z == y and j != i)[kk - 1]
        if r > 0:
            m = sum(x - r < w < x + r for w, _ in rows)
        else:
            kk, m = sum(w == x and z == y for w, z in rows), sum(w == x for w, _ in rows)
        total += _psi(kk) - _psi(size[y]) - _psi(m)
    return max(0.0, _psi(len(rows)) + total / len(rows))


def test_equals_direct_estimate(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(400):
        y = rnd.choice(["a", "b", "b", "c"])
        rows.append((rnd.gauss({"a": 0, "b": 2, "c": 5}[y], 1), float(rnd.randint(0, 4)), rnd.choice([1.0, 1.0, rnd.random()]), rnd.random(), y))
    rows += [(None, 1.0, float("nan"), 0.5, "a"), (1.0, 2.0, 3.0, 0.1, None), (9.0, 9.0, 9.0, 9.0, "single")]
    df = spark.createDataFrame(rows, "f double, g double, h double, noise double, y string").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "11")  # neighbours lie in other batches and partitions
    try:
        got = {r["feature"]: r["mi"] for r in mutual_information_knn(df, ["f", "g", "h", "noise"], "y").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for j, name in enumerate(["f", "g", "h", "noise"]):
        assert got[name] == pytest.approx(_direct([(r[j], r[4]) for r in rows]), abs=1e-9), name
    assert got["f"] > 0.5 > got["noise"]


def test_kth_distance_over_many_partitions(spark):
    rnd = random.Random(6)
    values = {g: sorted({round(rnd.uniform(0, 50), 2) for _ in range(n)}) for g, n in ((1, 3), (2, 1), (3, 200), (4, 2))}
    rows = [(g, v, rnd.choice([1, 1, 2, 5]), 4) for g, xs in values.items() for v in xs]
    want = {}
    for g, v, c, k in rows:
        others = sorted([0.0] * (c - 1) + [abs(v - w) for h, w, n, _ in rows if h == g and w != v for _ in range(n)])
        want[g, v] = others[k - 1] if len(others) >= k else None
    df = spark.createDataFrame(rows, "g int, v double, c bigint, k bigint")
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    try:
        got = {(r["g"], r["v"]): r["radius"] for r in kth_distances(df, ["g"], "v", "c", "k", 4).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    for key, r in want.items():
        if r is not None:
            assert got[key] == pytest.approx(r, abs=1e-12), key


def test_digamma(spark):
    got = spark.range(1, 300).select("id", digamma(F.col("id")).alias("p")).collect()
    assert all(math.isclose(r["p"], _psi(r["id"]), abs_tol=1e-11) for r in got)

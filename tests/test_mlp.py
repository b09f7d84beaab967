"""Perceptron: gradients, a plain version, any partitioning, copies, persistence."""

import math

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from sievekit.operators import mlp


def table(spark, rows):
    df = spark.createDataFrame(rows, "a double, b double, label int")
    return VectorAssembler(inputCols=["a", "b"], outputCol="features", handleInvalid="keep").transform(df)


def rings(n=600, seed=3):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        a, b = rng.normal(size=2)
        r = math.hypot(a, b)
        out.append((float(a), float(b), int(r > 0.8) + int(r > 1.5)))
    return out


def plain_loss(flat, layers, x, y, alpha):
    """One row and one unit at a time."""
    total, at, shapes = 0.0, 0, []
    for a, b in zip(layers, layers[1:]):
        shapes.append((at, a, b))
        at += a * b + b
    for row, c in zip(x, y):
        h = list(row)
        for k, (o, a, b) in enumerate(shapes):
            z = [sum(h[i] * flat[o + i * b + j] for i in range(a)) + flat[o + a * b + j] for j in range(b)]
            h = z if k == len(shapes) - 1 else [max(v, 0.0) for v in z]
        total += math.log(sum(math.exp(v) for v in h)) - h[c]
    squares = sum(flat[o + i] ** 2 for o, a, b in shapes for i in range(a * b))
    return total / len(x) + alpha / 2 * squares / len(x)


def test_loss_and_gradient_equal_differences_of_a_plain_loss():
    rng = np.random.default_rng(1)
    layers = [3, 5, 4, 3]
    flat = mlp.start(layers, 7)
    x, y = rng.normal(size=(6, 3)), rng.integers(0, 3, 6)
    loss, grad = mlp.loss_and_gradient(flat, layers, x, y, 0.1)
    assert loss == pytest.approx(plain_loss(flat, layers, x, y, 0.1))
    for i in range(len(flat)):
        e = np.zeros_like(flat)
        e[i] = 1e-6
        slope = (plain_loss(flat + e, layers, x, y, 0.1) - plain_loss(flat - e, layers, x, y, 0.1)) / 2e-6
        assert grad[i] == pytest.approx(slope, abs=1e-6)


def test_one_shard_is_plain_minibatch_adam(spark):
    rows = rings(90)
    got = mlp.AdamPerceptron(layers=[2, 4, 3], maxIter=3, batchSize=40, roundEpochs=2, seed=5).fit(table(spark, rows))
    rows = sorted(rows)
    x, y = np.array([r[:2] for r in rows]), np.array([r[2] for r in rows])
    w = mlp.start([2, 4, 3], 5)
    m, v, t = 0 * w, 0 * w, 0
    for epoch in range(3):
        order = np.random.default_rng([5, epoch, 0]).permutation(90)
        for some in (order[:40], order[40:80], order[80:]):
            g = mlp.loss_and_gradient(w, [2, 4, 3], x[some], y[some], 1e-4)[1]
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w - 1e-3 * (math.sqrt(1 - 0.999**t) / (1 - 0.9**t)) * m / (np.sqrt(v) + 1e-8)
    assert np.allclose(got.getOrDefault("weights"), w, atol=1e-9)


def test_partitioning_does_not_change_the_result(spark):
    df = table(spark, rings(400))
    fit = lambda d: mlp.AdamPerceptron(layers=[2, 8, 3], maxIter=4, roundEpochs=2, shardRows=50).fit(d)
    a, b = fit(df.coalesce(1)), fit(df.repartition(8, F.rand(1)))
    assert a.getOrDefault("weights") == b.getOrDefault("weights")
    assert a.getOrDefault("lossCurve") == b.getOrDefault("lossCurve")


def test_learns_what_no_line_separates_and_survives_saving(spark, tmp_path):
    df = table(spark, rings())
    model = mlp.AdamPerceptron(layers=[2, 32, 16, 3], maxIter=150, batchSize=32, shardRows=300).fit(df)
    model.write().overwrite().save(str(tmp_path / "m"))
    out = mlp.AdamPerceptronModel.load(str(tmp_path / "m")).transform(df)
    assert out.where(F.col("prediction") == F.col("label")).count() / df.count() > 0.93
    p = out.select("probability").first()[0]
    assert sum(p) == pytest.approx(1)


def test_copies_spread_over_shards_and_gaps_are_zero(spark):
    rows = [(1.0, 1.0, 0)] * 300 + [(None, float("nan"), 1), (0.0, 0.0, 1), (2.0, 2.0, None)]
    shards, n, count = mlp.shards_of(table(spark, rows), "features", "label", 50, 1)
    sizes = [r["n"] for r in shards.collect()]
    assert (n, count, sum(sizes)) == (302, 7, 302) and max(sizes) < 100
    with pytest.raises(ValueError, match="no labelled row"):
        mlp.AdamPerceptron(layers=[2, 3, 2]).fit(table(spark, rows[-1:]))


def test_every_task_gets_as_many_shards(spark):
    rows = [(float(i), float(i % 7), i % 3) for i in range(4000)]
    shards, _, count = mlp.shards_of(table(spark, rows), "features", "label", 100, 1)
    assert count == 40
    sizes = mlp.dealt(shards, 8).groupBy(F.spark_partition_id()).count().select("count").collect()
    assert len(sizes) == 8 and max(r["count"] for r in sizes) <= 6

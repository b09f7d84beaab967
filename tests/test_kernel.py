"""Landmark kernel machine against an exact kernel solve; bounds; persistence."""

import numpy as np
import pytest
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from sievekit.operators.kernel import LandmarkKernel, LandmarkKernelModel, margin_gap, rbf

GAMMA, C = 0.5, 1.0


def circle(n, seed=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2))
    return x, ((x**2).sum(axis=1) > 1.2).astype(float)


def exact_svm(x, y, rounds=3000):
    """Dual of the kernel machine by coordinate ascent; the intercept is the
    kernel's constant 100, which leaves it nearly free."""
    s = 2 * y - 1
    k = rbf(x, x, GAMMA) + 100.0
    a = np.zeros(len(x))
    f = np.zeros(len(x))
    for _ in range(rounds):
        for i in range(len(x)):
            new = min(C, max(0.0, a[i] + (1 - s[i] * f[i]) / k[i, i]))
            f += (new - a[i]) * s[i] * k[i]
            a[i] = new
    return f, a.sum() - 0.5 * (a * s) @ f


def fit(df, landmarks):
    df = df.coalesce(1)
    kernel = LandmarkKernel(inputCols=["a", "b"], outputCol="features", gamma=GAMMA, landmarks=landmarks).fit(df)
    phi = kernel.transform(df).cache()
    machine = LinearSVC(regParam=1.0 / (C * df.count()), maxIter=100, tol=1e-7, standardization=False).fit(phi)
    return kernel, machine


def test_all_rows_as_landmarks_equal_the_exact_machine(spark):
    x, y = circle(50)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y)], "a double, b double, label double")
    kernel, machine = fit(df, 200)
    phi = np.array([r["p"] for r in kernel.transform(df).select(vector_to_array("features").alias("p")).collect()])
    assert np.allclose(phi @ phi.T, rbf(x, x, GAMMA), atol=1e-6)
    exact, least = exact_svm(x, y)
    w = machine.coefficients.toArray()
    ours = phi @ w + machine.intercept
    cost = 0.5 * w @ w + C * np.maximum(0, 1 - (2 * y - 1) * ours).sum()
    assert cost < 1.01 * least  # the dual's value is below every machine's cost
    clear = np.abs(exact) > 0.25
    assert ((ours > 0) == (exact > 0))[clear].all() and clear.mean() > 0.7


def test_gap_bounds_what_fewer_landmarks_change(spark):
    x, y = circle(300)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y)], "a double, b double, label double")
    kernel, machine = fit(df, 12)
    rows = margin_gap(df, kernel, machine.coefficients.toArray(), machine.intercept).collect()
    marks = np.array(kernel.getOrDefault("marks")).reshape(-1, 2)
    k = rbf(x, marks, GAMMA)
    lost = 1 - np.einsum("ij,jk,ik->i", k, np.linalg.pinv(rbf(marks, marks, GAMMA), hermitian=True), k)
    norm = np.linalg.norm(machine.coefficients.toArray())
    want = {(a, b): norm * np.sqrt(max(0, v)) for (a, b), v in zip(x, lost)}
    for r in rows:
        assert r["gap"] == pytest.approx(want[r["a"], r["b"]], abs=1e-3 * norm)
        assert r["certain"] == (abs(r["margin"]) > r["gap"])
    wide = LandmarkKernel(inputCols=["a", "b"], gamma=GAMMA, landmarks=400).fit(df)
    full = margin_gap(df, wide, [1.0] + [0.0] * (len(wide.getOrDefault("root")) // 300 - 1), 0.0)
    assert full.agg(F.max("gap")).first()[0] < 1e-2


def test_landmarks_do_not_depend_on_partitions_and_survive_saving(spark, tmp_path):
    rows = [(float(i % 50), float(i % 7)) for i in range(500)] + [(None, float("nan")), (-0.0, 0.0)]
    df = spark.createDataFrame(rows, "a double, b double")
    make = lambda d: LandmarkKernel(inputCols=["a", "b"], landmarks=20).fit(d)
    one, many = make(df.coalesce(1)), make(df.repartition(8, F.rand(2)))
    assert one.getOrDefault("marks") == many.getOrDefault("marks")
    one.write().overwrite().save(str(tmp_path / "k"))
    again = LandmarkKernelModel.load(str(tmp_path / "k"))
    assert again.transform(df).select("features").first() == one.transform(df).select("features").first()
    with pytest.raises(ValueError, match="no row"):
        make(df.where("a > 1000"))

"""Binned trees and forests against MLlib's, and whatever the partitions."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from sievekit.operators import forest
from sievekit.operators.forest import BinnedForest
from sievekit.operators.models import DEFAULT_MODELS, build_pipeline

COLS = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.normal(size=1500), rng.integers(0, 60, 1500) / 4.0, rng.integers(0, 2, 1500), np.where(rng.random(1500) < 0.6, 0.0, rng.random(1500))])
    y = (x[:, 0] + x[:, 2] > 0.4) + (x[:, 1] + 3 * rng.normal(size=1500) > 9).astype(int)
    df = spark.createDataFrame([(i, *map(float, v), float(c)) for i, (v, c) in enumerate(zip(x, y))], "id int, a double, b double, c double, d double, label double")
    return VectorAssembler(inputCols=COLS, outputCol="features").transform(df).repartition(4).cache()


def _answers(model, rows):
    return {r.id: (r.prediction, tuple(r.probability)) for r in model.transform(rows).select("id", "prediction", "probability").collect()}


@pytest.mark.parametrize("more", [{}, {"localCells": 40}])
def test_tree_is_mllibs(rows, more):
    for depth, least in ((4, 1), (30, 5)):
        theirs = DecisionTreeClassifier(maxDepth=depth, minInstancesPerNode=least, seed=42).fit(rows)
        own = BinnedForest(numTrees=1, bootstrap=False, maxDepth=depth, minInstancesPerNode=least, **more).fit(rows)
        a, b = _answers(theirs, rows), _answers(own, rows)
        assert all(a[i][0] == b[i][0] and a[i][1] == pytest.approx(b[i][1]) for i in a)
        assert own.featureImportances.toArray() == pytest.approx(theirs.featureImportances.toArray())


def test_forest_does_not_depend_on_partitions(rows):
    fit = lambda df, **more: BinnedForest(numTrees=12, **more).fit(df)
    one, many = fit(rows.coalesce(1)), fit(rows.repartition(9))
    assert one.trees == many.trees and one.cuts == many.cuts
    split = fit(rows, localCells=100)  # upper levels by histograms
    for m in (one, split):
        got = _answers(m, rows)
        truth = {r.id: r.label for r in rows.select("id", "label").collect()}
        assert np.mean([got[i][0] == truth[i] for i in got]) > 0.85
        assert all(sum(p) == pytest.approx(1.0) for _, p in got.values())


def test_borders_of_many_values(spark):
    values = np.concatenate([np.zeros(900), np.random.default_rng(1).exponential(size=2000), np.full(700, 2.5), [np.nan] * 5])
    df = spark.createDataFrame([([float(v)],) for v in values], "x array<double>")
    seen, counts = np.unique(values[~np.isnan(values)], return_counts=True)
    want = forest._walk(list(zip(seen, counts, counts.cumsum())), len(values), 32)
    assert forest.borders(df, 1, len(values)) == [want] and len(want) > 20


def test_saved_forest_scores_the_same(spark, rows, tmp_path):
    model = Pipeline(stages=[BinnedForest(numTrees=5)]).fit(rows)
    model.write().save(str(tmp_path / "m"))
    assert _answers(PipelineModel.load(str(tmp_path / "m")), rows) == _answers(model, rows)


def test_registry_forest_grows_in_tasks(rows, monkeypatch):
    """The forest of the registry ran in one task for a small table and kept MLlib's nodes."""
    for name in ("RandomForest", "DecisionTree"):
        assert isinstance(build_pipeline(DEFAULT_MODELS[name], COLS, 10, 3).getStages()[-1], BinnedForest)
    with pytest.raises(ValueError):
        BinnedForest(numTrees=2).fit(rows.where(F.lit(False)))


@pytest.mark.parametrize("more", [{}, {"localCells": 100}])
def test_configurations_grow_in_the_same_jobs(rows, monkeypatch, more):
    """every configuration of a fold ran its own jobs."""
    calls, grow = [], forest.grow_trees
    monkeypatch.setattr(forest, "grow_trees", lambda *a: calls.append(len(a[4])) or grow(*a))
    trees = [BinnedForest(numTrees=1, bootstrap=False, maxDepth=d, minInstancesPerNode=m, **more) for d, m in ((3, 1), (30, 1), (30, 9))]
    forests = [BinnedForest(numTrees=t, maxDepth=4, **more) for t in (4, 3)]
    prepared = trees[0].prepare(rows)
    alone = [e.grown(prepared).trees for e in trees + forests]
    calls.clear()
    assert [m.trees for m in forest.grown_together(trees + forests, prepared)] == alone and calls == [3, 7]
    calls.clear()
    monkeypatch.setattr(forest, "TREES_TOGETHER", 5)
    assert [m.trees for m in forest.grown_together(forests, prepared)] == alone[3:] and calls == [4, 3]

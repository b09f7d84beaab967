"""Exact kNN (k-d partition) against brute force."""

import random
from collections import Counter

import numpy as np
import pytest

from sievekit.operators.knn import CellTree, LeafTree, knn_classify


def test_knn_matches_brute_force(spark):
    rnd = random.Random(3)
    train = [(i, round(rnd.gauss(c, 1.0), 3), round(rnd.gauss(-c, 1.0), 3), round(rnd.random(), 2), c)
             for i, c in enumerate([0, 1, 2] * 60)]
    train += [(1000 + i, 0.0, 0.0, 0.5, 1) for i in range(40)]  # one hot duplicated vector
    test = [(i, round(rnd.uniform(-3, 5), 3), round(rnd.uniform(-5, 3), 3), round(rnd.random(), 2)) for i in range(80)]
    tdf = spark.createDataFrame(train, "id int, a double, b double, c double, label int")
    qdf = spark.createDataFrame(test, "qid int, a double, b double, c double")
    got = {r["qid"]: r["prediction"] for r in knn_classify(tdf, qdf, ["a", "b", "c"], "label", "qid", k=5,
                                                             leaf_rows=7).collect()}
    for qid, a, b, c in test:
        ds = sorted(((((a - x) ** 2 + (b - y) ** 2 + (c - z) ** 2) ** 0.5, lab, x, y, z)
                     for _, x, y, z, lab in train))
        votes = {}
        for d in ds[:5]:
            votes[d[1]] = votes.get(d[1], 0) + 1
        best = sorted(votes.items(), key=lambda kv: (-kv[1], kv[0]))[0][0]
        assert got[qid] == best, qid


def test_every_row_is_answered(spark):
    train = spark.createDataFrame([(0.0, 0), (1.0, 0), (2.0, 1), (1e9, 1)], "a double, label int")
    test = spark.createDataFrame([(1, 0.4), (2, -1e12), (3, 1e12), (4, 0.4), (5, None)], "qid int, a double")
    got = {r["qid"]: (r["prediction"], r["votes"]) for r in knn_classify(train, test, ["a"], "label", "qid", k=3, leaf_rows=1).collect()}
    assert got == {1: (0, 2), 2: (0, 2), 3: (1, 2), 4: (0, 2), 5: (0, 2)}


def test_more_neighbours_than_rows_raises(spark):
    train = spark.createDataFrame([(0.0, 0), (1.0, 0), (2.0, 1)], "a double, label int")
    with pytest.raises(ValueError, match="k = 5"):
        knn_classify(train, train.selectExpr("label qid", "a"), ["a"], "label", "qid", k=5)


def test_many_cells_and_rounds(spark):
    """Cells are cut again when full, and queries visit several of them."""
    rnd = random.Random(8)
    train = [(round(rnd.gauss(0, 1), 2), round(rnd.gauss(0, 1), 2), rnd.choice([0, 1, 2])) for _ in range(1500)] + [(0.5, 0.5, 1)] * 700
    test = [(i, rnd.uniform(-4, 4), rnd.uniform(-4, 4)) for i in range(150)] + [(900, 0.5, 0.5), (901, None, 50.0)]
    tdf = spark.createDataFrame(train, "a double, b double, label int")
    qdf = spark.createDataFrame(test, "qid int, a double, b double")
    for cells, leaf in ((40, 4), (3, 1), (10_000, 16)):  # cells smaller than k need more rounds
        got = {r["qid"]: (r["prediction"], r["votes"]) for r in knn_classify(tdf, qdf, ["a", "b"], "label", "qid", k=7, leaf_rows=leaf, cell_rows=cells).collect()}
        for qid, a, b in test:
            a, b = a or 0.0, b or 0.0
            near = sorted((((a - x) * (a - x) + (b - y) * (b - y)) ** 0.5, lab, x, y) for x, y, lab in train)[:7]
            votes = Counter(lab for _, lab, _, _ in near)
            assert got[qid] == min(votes.items(), key=lambda v: (-v[1], v[0])), (qid, cells)


def test_comparisons_stay_flat():
    """A query meets about as many vectors in 2 000 rows as in 200 000."""
    rng = np.random.default_rng(4)
    met = {}
    for n in (2_000, 200_000):
        x = rng.normal(size=(n, 3))
        tree = LeafTree(x, np.zeros(n, np.int64), np.ones(n, np.int64))
        count = [0]
        for q in rng.normal(size=(50, 3)):
            got = tree.search(q, 5, seen=count)
            want = np.sort(np.sqrt(((x - q) ** 2).sum(axis=1)))[:5]
            assert np.allclose([d for d, _, _ in got], want)
        met[n] = count[0] / 50
    assert met[200_000] < 2 * met[2_000] and met[200_000] < 500


def test_cells_are_found_nearest_first():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3_000, 4))
    tree = CellTree()
    assert tree.split(0, x, 16)
    assert tree.split(3, x[tree.cell_of(x) == 3], 8)  # a full cell is cut again
    cell = tree.cell_of(x)
    assert set(cell) == set(range(tree.cells)) and tree.cells == 23
    for q in rng.normal(size=(20, 4)) * 2:
        order = list(tree.near_cells(q))
        assert [d for d, _ in order] == sorted(d for d, _ in order) and sorted(c for _, c in order) == list(range(tree.cells))
        assert order[0][1] == tree.cell_of(q[None])[0]
        for low, c in order:  # a bound of every vector of the cell
            assert low <= np.sqrt(((x[cell == c] - q) ** 2).sum(axis=1)).min() + 1e-12

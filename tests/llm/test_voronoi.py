"""Voronoi kNN join against all inner products, computed plainly."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievekit.llm.voronoi_knn import bounds, choose_pivots, group_cells, top_k

SCHEMA = "vec_id bigint, embedding array<float>, label int, cell int, id string, rank int, score double"


def _frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, "x", 2, 0.5) for i, v in rows], SCHEMA)


def _brute(rows, k=5, every=50):
    clean = {}
    for i, v in rows:
        if i is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        clean[(i, tuple(math.floor(256 * float(np.float32(x))) for x in v))] = None
    out = set()
    for i, v in clean:
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in clean if (j, w) != (i, v))
        out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])}
    return out


def _got(df, **more):
    out = top_k(df, F.col("vec_id") % 50 == 0, **more)
    assert out.columns == ["query_id", "rank", "vec_id", "score"]
    rows = [tuple(r) for r in out.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("shape", ["clusters", "sphere"])
def test_equals_all_products(spark, shape):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16)) * (3 if shape == "clusters" else 0)
    x = centres[rng.integers(0, 12, 900)] + rng.normal(size=(900, 16)) * (0.05 if shape == "clusters" else 1)
    rows = [(int(i), [float(c) for c in v]) for i, v in enumerate(x)]
    want = _brute(rows)
    df = _frame(spark, rows)
    assert _got(df) == want
    # many cells, groups, chunks and slices
    assert _got(df, pivots=20, query_rows=3, data_rows=64) == want


def test_odd_rows_ties_and_copies(spark):
    rng = np.random.default_rng(6)
    same = [0.25, -0.5, 0.125]
    rows = [(i, same) for i in range(0, 400, 2)]  # half of all rows are one vector, queries among them
    rows += [(i, [float(c) for c in rng.integers(-2, 3, 3) / 4]) for i in range(1, 300, 2)]  # few values: ties
    rows += [(50, same)] * 5 + [(50, [1.0, 1.0, 1.0])]  # repeated rows; a second vector under one id
    rows += [(1000, None), (1050, []), (1100, [1.0, None, 0.0]), (1150, [float("nan"), 0.0, 0.0]), (1200, [float("inf"), 0.0, 0.0]), (None, same)]
    rows += [(1250, [0.5]), (1300, [0.0, 0.0, 0.0])]  # shorter; zero
    df, want = _frame(spark, rows), _brute(rows)
    assert _got(df) == want
    assert _got(df, pivots=7, query_rows=2, data_rows=10) == want


def test_few_rows_and_none(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (50, [0.0, 1.0])]
    assert _got(_frame(spark, rows)) == _brute(rows)  # fewer than k candidates
    assert _got(_frame(spark, rows[:1])) == set()
    assert _got(_frame(spark, [])) == set()
    assert _got(_frame(spark, [(3, [1.0])])) == set()  # no query
    with pytest.raises(Exception, match="31 bits"):
        _got(_frame(spark, [(0, [1e30]), (1, [1.0])]))


def test_bounds_are_sound_and_leave_out_far_cells():
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(8, 32)) * 400
    x = np.floor(centres[rng.integers(0, 8, 2000)] + rng.normal(size=(2000, 32)) * 4).astype(np.int64)
    p = choose_pivots(x, 8)
    d = np.sqrt(((x[:, None, :] - p) ** 2).sum(axis=2))
    cell = d.argmin(axis=1)
    d = d[np.arange(len(x)), cell]
    q = np.arange(len(x)) % 50 == 0
    reach = np.array([d[q & (cell == j)].max() if (q & (cell == j)).any() else np.nan for j in range(8)])
    norm = np.array([np.sqrt((x[q & (cell == j)] ** 2).sum(axis=1)).max() if (q & (cell == j)).any() else np.nan for j in range(8)])
    need = bounds(p, reach, norm, [np.sort(d[cell == j])[:6] for j in range(8)], 6)
    sent = 0
    for i in np.flatnonzero(~np.isnan(reach)):
        goes = d >= need[i][cell]
        sent += goes.sum()
        scores = x[q & (cell == i)] @ x.T
        for row in scores:  # none of a query's six best is left out
            assert goes[np.argsort(-row, kind="stable")[:6]].all()
    assert sent < 3 * len(x)  # eight query cells, and yet far fewer than eight copies
    group = group_cells(p, np.array([5, 0, 9, 1, 1, 30, 2, 2]), 10)
    assert group[1] == -1 and (np.delete(group, 1) >= 0).all()

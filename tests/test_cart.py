"""Exact decision tree against a plain recursive one."""

import random

import pytest
from pyspark.sql import functions as F

from sievekit.operators.cart import fit_tree, predict_tree, split_table


def _gini_score(rows, classes):
    return sum(sum(y == c for _, y in rows) ** 2 for c in classes) / len(rows)


def _plain(rows, classes, depth, least):
    """A leaf's (class, rows), or (feature, threshold, left, right)."""
    ys = [y for _, y in rows]
    top = max(classes, key=lambda c: (ys.count(c), -classes.index(c)))
    if len(rows) < max(2, least) or depth == 0 or len(set(ys)) == 1:
        return top, len(rows)
    best = None
    for f in range(len(rows[0][0])):
        values = sorted({x[f] for x, _ in rows})
        for a, b in zip(values, values[1:]):
            low, high = [r for r in rows if r[0][f] <= a], [r for r in rows if r[0][f] > a]
            score = _gini_score(low, classes) + _gini_score(high, classes)
            if best is None or score > best[0]:
                best = (score, f, a / 2 + b / 2, low, high)
    if best is None:
        return top, len(rows)
    _, f, t, low, high = best
    nxt = None if depth is None else depth - 1
    return f, t, _plain(low, classes, nxt, least), _plain(high, classes, nxt, least)


def _ask(tree, x):
    while len(tree) == 4:
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(9)
    out = []
    for i in range(260):
        y = rnd.choice(["a", "b", "b", "c"])
        out.append((i, float(rnd.randint(0, 6)), round(rnd.gauss({"a": 0, "b": 1, "c": 3}[y], 1), 2), 1.5, y))
    return out + [(900, None, float("nan"), 1.5, "a"), (901, 1.0, 1.0, 1.5, "a"), (902, 1.0, 1.0, 1.5, "c"), (903, 2.0, 2.0, None, None)]


@pytest.mark.parametrize("depth,least,local", [(None, 2, 40), (None, 2, 1), (None, 30, 50), (3, 2, 100), (2, 2, 1), (None, 2, 100_000), (0, 2, 5)])
def test_whole_tree(spark, rows, depth, least, local):
    df = spark.createDataFrame(rows, "id int, f double, g double, h double, y string").repartition(4)
    tree = fit_tree(df, ["f", "g", "h"], "y", depth, least, local)
    got = {r["id"]: (r["prediction"], r["n"]) for r in predict_tree(df, tree, "id").collect()}
    num = lambda v: 0.0 if v is None or v != v else v
    plain = [(tuple(num(v) for v in r[1:4]), r[4]) for r in rows]
    want = _plain([r for r in plain if r[1] is not None], ["a", "b", "c"], depth, least)
    assert got == {r[0]: _ask(want, x) for r, (x, _) in zip(rows, plain)}


def test_split_table(spark, rows):
    df = spark.createDataFrame(rows, "id int, f double, g double, h double, y string")
    got = {r["feature"]: r for r in split_table(df.where(F.col("h").isNotNull()), ["f", "g", "h"], "y").collect()}
    assert set(got) == {"f", "g"} and got["g"]["gini"] < got["f"]["gini"]
    assert got["g"]["n_left"] + got["g"]["n_right"] == 263


def test_no_label_raises(spark):
    with pytest.raises(ValueError, match="no labelled row"):
        fit_tree(spark.createDataFrame([(1.0, None)], "f double, y string"), ["f"], "y")

"""Exact decision tree (T2): Gini splits over all distinct values, with
``min_samples_split`` and, by default, no bound of depth.

Large nodes are split level by level, all of a level at once: rows are counted
per (node, feature, value) and class, the counts are summed along each sorted
axis (``running_sum``: one shuffle, no axis in one task), and every gap between
two neighbouring values is a candidate, so no value is binned. A node of at most
``local_rows`` rows is finished in one task, depth first over the same
candidates, and stored as a row of a table. So there are about
log2(rows / local_rows) passes, whatever the depth of the tree.

The driver holds the split nodes above (one per ``local_rows`` rows or so); the
subtrees stay in their table. Scoring descends the upper nodes in Arrow batches
and meets the subtrees by cogroup, a bounded chunk of rows each.

A split puts x <= threshold to the left; the threshold lies halfway between the
neighbours. Equal scores go to the earlier feature, then the smaller threshold.
Impure nodes with any valid split are split even if it gains nothing. Null
features and NaN count as 0; rows without a label aren't learned from.
"""

from __future__ import annotations

import pickle
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import reliable_checkpoint
from .prefix import running_sum, ship

LOCAL_ROWS = 20_000
CHUNK_ROWS = 20_000


def candidate_splits(counts: DataFrame, classes: int) -> DataFrame:
    """All splits of each node: ``counts`` has (node, f, x, c0, c1, ...), one
    row per distinct value. Adds l0, l1, ... (rows at or below x, by class),
    the sizes of both sides and ``score``: the sum over both sides of squared
    class counts by side size (largest where Gini impurity is least)."""
    cols = [f"c{k}" for k in range(classes)]
    cum = running_sum(counts, ["node", "f"], [F.col("x")], cols)
    total = counts.groupBy("node", "f").agg(*[F.sum(c).alias(f"t{k}") for k, c in enumerate(cols)])
    j = cum.join(total.withColumnsRenamed({"node": "node_", "f": "f_"}), (F.col("node") == F.col("node_")) & (F.col("f") == F.col("f_")))
    left = sum((F.col(f"cum_{c}") for c in cols), F.lit(0).cast("long"))
    right = sum((F.col(f"t{k}") for k in range(classes)), F.lit(0).cast("long")) - left
    j = j.withColumns({"n_left": left, "n_right": right}).where("n_right > 0")
    squares = lambda of: sum((of(k) * of(k) for k in range(classes)), F.lit(0).cast("long"))
    score = squares(lambda k: F.col(f"cum_c{k}")) / F.col("n_left") + squares(lambda k: F.col(f"t{k}") - F.col(f"cum_c{k}")) / F.col("n_right")
    return j.select("node", "f", "x", *[F.col(f"cum_{c}").alias(f"l{k}") for k, c in enumerate(cols)],
                    *[F.col(f"t{k}") for k in range(classes)], "n_left", "n_right", score.alias("score"))


def value_counts(rows: DataFrame, features: Sequence[str], classes: int) -> DataFrame:
    """(node, f, x, c0, ...) of rows (node, features..., y)."""
    long = rows.select("node", "y", F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(c).alias("x")) for i, c in enumerate(features)])).alias("v"))
    return long.groupBy("node", F.col("v.f").alias("f"), F.col("v.x").alias("x")).agg(
        *[F.sum((F.col("y") == k).cast("long")).alias(f"c{k}") for k in range(classes)])


def best_splits(rows: DataFrame, features: Sequence[str], classes: int, per: Sequence[str] = ("node",)) -> DataFrame:
    """The best split per node (or per node and feature): f, threshold, score
    and the class counts of the left side and of the node."""
    counts = reliable_checkpoint(value_counts(rows, features, classes))
    order = F.struct("score", (-F.col("f")).alias("nf"), (-F.col("x")).alias("nx"))
    lt = [*[f"l{k}" for k in range(classes)], *[f"t{k}" for k in range(classes)], "n_left", "n_right"]
    best = candidate_splits(counts, classes).groupBy(*per).agg(
        F.max(F.struct(order.alias("o"), F.col("node").alias("n"), F.col("f"), F.col("x"), F.col("score"), *[F.col(c) for c in lt])).alias("b"))
    best = reliable_checkpoint(best.select(F.col("b.n").alias("node"), *[F.col(f"b.{c}").alias(c) for c in ("f", "x", "score", *lt)]))
    above = counts.select(F.col("node").alias("node_"), F.col("f").alias("f_"), F.col("x").alias("x_"))
    nxt = best.join(above, (F.col("node") == F.col("node_")) & (F.col("f") == F.col("f_")) & (F.col("x_") > F.col("x")))
    nxt = nxt.groupBy("node", "f").agg(F.min("x_").alias("next"))
    half = F.col("x") / 2 + F.col("next") / 2
    return best.join(nxt, ["node", "f"]).withColumn("threshold", F.when((half >= F.col("next")) | (half < F.col("x")), F.col("x")).otherwise(half))


def _grow(x: np.ndarray, y: np.ndarray, classes: int, depth: int | None, least: int) -> list[tuple]:
    """Depth-first exact tree: nodes (feature, threshold, left, right, counts);
    leaves have feature -1."""
    nodes: list[tuple] = []
    todo = [(np.arange(len(x)), depth, -1, 0)]
    while todo:
        rows, left_depth, parent, side = todo.pop()
        here = len(nodes)
        if parent >= 0:
            p = list(nodes[parent])
            p[2 + side] = here
            nodes[parent] = tuple(p)
        counts = np.bincount(y[rows], minlength=classes)
        nodes.append((-1, 0.0, -1, -1, counts))
        if len(rows) < max(2, least) or left_depth == 0 or counts.max() == len(rows):
            continue
        best = None
        for f in range(x.shape[1]):
            o = np.argsort(x[rows, f], kind="stable")
            v = x[rows[o], f]
            at = np.flatnonzero(v[1:] > v[:-1])
            if not len(at):
                continue
            cum = np.cumsum(np.eye(classes, dtype=np.int64)[y[rows[o]]], axis=0)[at]
            n = at + 1.0
            score = (cum * cum).sum(axis=1) / n + ((counts - cum) ** 2).sum(axis=1) / (len(rows) - n)
            i = int(score.argmax())
            if best is None or score[i] > best[0]:
                half = v[at[i]] / 2 + v[at[i] + 1] / 2
                best = (score[i], f, half if v[at[i]] <= half < v[at[i] + 1] else v[at[i]])
        if best is None:
            continue
        _, f, t = best
        nodes[here] = (f, float(t), -1, -1, counts)
        low = x[rows, f] <= t
        nxt = None if left_depth is None else left_depth - 1
        todo.append((rows[~low], nxt, here, 1))
        todo.append((rows[low], nxt, here, 0))
    return nodes


def _descend(nodes: list[tuple], x: np.ndarray) -> np.ndarray:
    """The node in which each row ends."""
    feature, threshold, left, right = (np.array([n[i] for n in nodes]) for i in range(4))
    at = np.zeros(len(x), np.int64)
    todo = np.arange(len(x))
    while len(todo):
        todo = todo[feature[at[todo]] >= 0]
        n = at[todo]
        at[todo] = np.where(x[todo, feature[n]] <= threshold[n], left[n], right[n])
    return at


@dataclass
class Tree:
    """``upper``: split nodes on the driver, as in ``_grow``; ``open``: upper
    leaves that go on in ``stored`` (node, tree)."""

    features: list[str]
    labels: list
    upper: list[tuple] = field(default_factory=list)
    open: set[int] = field(default_factory=set)
    stored: DataFrame | None = None
    depths: dict[int, int] = field(default_factory=dict)

    def node_udf(self):
        upper = self.upper

        @F.pandas_udf("bigint")
        def node(*cols: pd.Series) -> pd.Series:
            return pd.Series(_descend(upper, np.column_stack([c.to_numpy(float) for c in cols])))

        return node


def _clean(df: DataFrame, features: Sequence[str]) -> list:
    zero = F.lit(0.0)
    return [F.coalesce(F.nanvl(F.col(c).cast("double"), zero), zero).alias(f"x{i}") for i, c in enumerate(features)]


def fit_tree(df: DataFrame, features: Sequence[str], label: str, max_depth: int | None = None, min_samples_split: int = 2,
             local_rows: int = LOCAL_ROWS) -> Tree:
    """Fit on all rows of ``df``."""
    ship(df.sparkSession)
    labels = [r[0] for r in df.select(label).where(F.col(label).isNotNull()).distinct().orderBy(label).collect()]  # the classes
    if not labels:
        raise ValueError("no labelled row to learn from")
    code = F.create_map(*[v for i, c in enumerate(labels) for v in (F.lit(c), F.lit(i))])
    xs = [f"x{i}" for i in range(len(features))]
    base = reliable_checkpoint(df.where(F.col(label).isNotNull()).select(*_clean(df, features), code[F.col(label)].alias("y")))
    tree = Tree(list(features), labels)
    k = len(labels)
    at = {r["y"]: r["n"] for r in base.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    tree.upper = [(-1, 0.0, -1, -1, np.array([at.get(i, 0) for i in range(k)]))]
    depth, level = 0, [0]
    while level:
        splittable = [n for n in level if tree.upper[n][4].sum() >= max(2, min_samples_split) and tree.upper[n][4].max() < tree.upper[n][4].sum()
                      and (max_depth is None or depth < max_depth)]
        tree.open |= {n for n in splittable if tree.upper[n][4].sum() <= local_rows}
        large = [n for n in splittable if n not in tree.open]
        level = []
        if large:
            rows = base.withColumn("node", tree.node_udf()(*xs)).where(F.col("node").isin(large))
            for r in best_splits(rows, xs, k).collect():  # one row a large node
                n, low = r["node"], np.array([r[f"l{i}"] for i in range(k)])
                children = len(tree.upper), len(tree.upper) + 1
                tree.upper += [(-1, 0.0, -1, -1, low), (-1, 0.0, -1, -1, tree.upper[n][4] - low)]
                tree.upper[n] = (r["f"], r["threshold"], *children, tree.upper[n][4])
                level += children
        tree.depths.update({n: depth for n in splittable if n in tree.open})
        depth += 1
    if tree.open:
        depths, features_n = tree.depths, len(xs)

        def build(rows: pa.Table) -> pa.Table:
            node = rows.column("node")[0].as_py()
            x = np.column_stack([rows.column(f"x{i}").to_numpy() for i in range(features_n)])
            left = None if max_depth is None else max_depth - depths[node]
            nodes = _grow(x, rows.column("y").to_numpy().astype(np.int64), k, left, min_samples_split)
            return pa.table({"node": pa.array([node], pa.int64()), "tree": pa.array([pickle.dumps(nodes)], pa.binary())})

        rows = base.withColumn("node", tree.node_udf()(*xs)).where(F.col("node").isin(list(tree.open)))
        tree.stored = reliable_checkpoint(rows.groupBy("node").applyInArrow(build, "node bigint, tree binary"))
    return tree


def predict_tree(df: DataFrame, tree: Tree, key: str) -> DataFrame:
    """(key, prediction, n): the majority class of each row's leaf (ties to the
    smaller class) and the leaf's number of training rows."""
    ship(df.sparkSession)
    xs = [f"x{i}" for i in range(len(tree.features))]
    rows = df.select(F.col(key).alias("key"), *_clean(df, tree.features)).withColumn("node", tree.node_udf()(*xs))
    done = {i: n for i, n in enumerate(tree.upper) if n[0] < 0 and i not in tree.open}
    names = F.array(*[F.lit(v) for v in tree.labels])
    ends = df.sparkSession.createDataFrame([(i, int(n[4].argmax()), int(n[4].sum())) for i, n in done.items()], "node_ bigint, best int, n bigint")
    out = rows.join(F.broadcast(ends), F.col("node") == F.col("node_")).select("key", "best", "n")
    if tree.stored is not None:
        width = len(xs)
        kind = df.schema[key].dataType

        def score(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows:
                return pa.table({"key": left.column("key"), "best": pa.array([], pa.int32()), "n": pa.array([], pa.int64())})
            nodes = pickle.loads(right.column("tree")[0].as_py())
            leaf = _descend(nodes, np.column_stack([left.column(f"x{i}").to_numpy() for i in range(width)]))
            counts = np.array([n[4] for n in nodes])[leaf]
            return pa.table({"key": left.column("key"), "best": pa.array(counts.argmax(axis=1), pa.int32()), "n": pa.array(counts.sum(axis=1), pa.int64())})

        inner = rows.where(F.col("node").isin(list(tree.open)))
        load = inner.groupBy(F.col("node").alias("node_")).agg(F.ceil(F.count(F.lit(1)) / CHUNK_ROWS).cast("int").alias("chunks"))
        a = inner.join(load, F.col("node") == F.col("node_")).withColumn("chunk", F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int"))
        b = tree.stored.join(load, F.col("node") == F.col("node_")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        more = (a.select("node", "chunk", "key", *xs).groupBy("node", "chunk").cogroup(b.select("node", "chunk", "tree").groupBy("node", "chunk"))
                .applyInArrow(score, f"key {kind.simpleString()}, best int, n bigint"))
        out = out.unionByName(more)
    return out.select(F.col("key").alias(key), names[F.col("best")].alias("prediction"), "n")


def split_table(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """The best split of the whole table on each feature: (feature, threshold,
    n_left, n_right, gini) with the weighted impurity after the split; features
    of a single value have none."""
    ship(df.sparkSession)
    labels = [r[0] for r in df.select(label).where(F.col(label).isNotNull()).distinct().orderBy(label).collect()]
    code = F.create_map(*[v for i, c in enumerate(labels) for v in (F.lit(c), F.lit(i))])
    xs = [f"x{i}" for i in range(len(features))]
    rows = df.where(F.col(label).isNotNull()).select(F.lit(0).cast("long").alias("node"), *_clean(df, features), code[F.col(label)].alias("y"))
    best = best_splits(rows, xs, len(labels), ("node", "f"))
    names = F.array(*[F.lit(c) for c in features])
    return best.select(names[F.col("f")].alias("feature"), "threshold", "n_left", "n_right",
                       (1 - F.col("score") / (F.col("n_left") + F.col("n_right"))).alias("gini"))

"""Binned decision trees and forests (T2, T3) on weighted cells.

* Values are cut at up to 31 borders per feature, at equal shares of all rows (where
  there are no more distinct values, halfway between each two). Rows of the same
  bins and label are one cell with a count; a histogram can't tell them apart.
* A tree of a forest weighs a cell by a Poisson draw with the cell's count as mean,
  which is the sum of its rows' draws. Draws are seeded by (seed, tree, shard), and
  cells are dealt to shards by hash: the result is the same for any partitioning.
* Nodes of more than ``local_cells`` cells are split level by level, all trees in one
  job: shards add up histograms per (tree, node), and their groups pick the split.
  A smaller node's cells then go to one task per (tree, node), which grows the rest
  of that branch a level at a time. No table is whole in a task or on the driver.
* Splits are by Gini gain, equal ones go to the earlier feature and border; two
  leaves of one prediction become one, as in MLlib. Importances are gains by weight.

The driver and every Python worker hold the fitted trees, at six bytes a node.
NaN is above all borders; rows without a label aren't learned from.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasSeed
from pyspark.ml.util import (
    DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter,
)
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import reliable_checkpoint
from .prefix import running_sum, ship

MAX_BINS = 32
SHARD_CELLS = 16_384
LOCAL_CELLS = 250_000
#: numbers of the histograms that a task makes at a time
HISTOGRAM = 4_000_000
#: trees of several estimators that are grown in the same jobs
TREES_TOGETHER = 200
LEAF = 255


# ------------------------------------------------------------------ borders, cells
def _walk(rows: list[tuple[float, int, int]], n: int, bins: int) -> list[float]:
    """Borders from (value, count, cumulated count) in order of value: halfway
    before the value that would take the count further from the next share."""
    out, target = [], n / bins
    for (a, _, before), (b, _, now) in zip(rows, rows[1:]):
        if abs(before - target) < abs(now - target):
            out.append((a + b) / 2.0)
            target += n / bins
    return out


def borders(rows: DataFrame, width: int, n: int) -> list[list[float]]:
    """Borders of every feature of ``rows`` (array ``x``). Of the distinct values
    only those next to a share can become a border: per feature and share the first
    ``bins`` and the last one come to the driver, whatever the number of rows."""
    bins = min(MAX_BINS, n)
    values = rows.select(F.posexplode("x").alias("f", "v")).where(~F.isnan("v"))
    counts = reliable_checkpoint(values.groupBy("f", (F.col("v") + 0.0).alias("v")).agg(F.count(F.lit(1)).alias("c")))
    distinct = {r["f"]: r["n"] for r in counts.groupBy("f").agg(F.count(F.lit(1)).alias("n")).collect()}
    cum = running_sum(counts, ["f"], [F.col("v")], ["c"])
    share = F.floor((2 * F.col("cum_c") - F.col("c")) * bins / F.lit(2.0 * n))
    few = [f for f, d in distinct.items() if d <= bins]
    cum = cum.withColumn("k", F.when(F.col("f").isin(few), F.lit(0)).otherwise(share))
    w = Window.partitionBy("f", "k")
    kept = cum.withColumn("nth", F.row_number().over(w.orderBy("v"))).where(F.col("nth") <= bins).drop("nth")
    last = cum.groupBy("f", "k").agg(F.max_by(F.struct("v", "c", "cum_c"), "v").alias("r")).select("f", "r.*")
    got = kept.select("f", "v", "c", "cum_c").unionByName(last).distinct().collect()  # at most 33 a share
    out: list[list[float]] = []
    for f in range(width):
        own = sorted((r["v"], r["c"], r["cum_c"]) for r in got if r["f"] == f)
        if len(own) <= bins and f in few:
            out.append([(a[0] + b[0]) / 2.0 for a, b in zip(own, own[1:])])
        else:
            # values left out lie between the last and the first row of two shares or behind the
            # first rows of one; there the count goes past no share, so nothing is cut
            out.append(_walk(own, n, bins)[: bins - 1])
    return out


def coded(x: np.ndarray, cuts: Sequence[Sequence[float]]) -> np.ndarray:
    return np.column_stack([np.searchsorted(np.asarray(c, float), x[:, i]) for i, c in enumerate(cuts)]).astype(np.uint8)


def _matrix(x: pd.Series) -> np.ndarray:
    return np.stack(x.to_numpy()).astype(float)


def shards_of(rows: DataFrame, cuts: list[list[float]], shard_cells: int) -> tuple[DataFrame, int]:
    """A row per shard (shard, codes, y, c as bytes), and the number of cells."""
    @F.pandas_udf("binary")
    def cell(x: pd.Series) -> pd.Series:
        return pd.Series([r.tobytes() for r in coded(_matrix(x), cuts)] if len(x) else [], dtype=object)

    cells = reliable_checkpoint(rows.select(cell("x").alias("codes"), "y").groupBy("codes", "y").agg(F.count(F.lit(1)).alias("c")))
    n = cells.count()
    width = len(cuts)

    def pack(t: pa.Table) -> pa.Table:
        codes = np.frombuffer(b"".join(t.column("codes").to_pylist()), np.uint8).reshape(-1, width)
        y, c = t.column("y").to_numpy().astype(np.uint8), t.column("c").to_numpy().astype(np.int64)
        o = np.lexsort((y, *codes.T[::-1]))
        return pa.table({"shard": t.column("shard")[:1], **{k: pa.array([v[o].tobytes()], pa.binary()) for k, v in (("codes", codes), ("y", y), ("c", c))}})

    dealt = cells.withColumn("shard", F.pmod(F.xxhash64("codes", "y"), F.lit(max(1, -(-n // shard_cells)))))
    return reliable_checkpoint(dealt.groupBy("shard").applyInArrow(pack, "shard bigint, codes binary, y binary, c binary")), n


# ------------------------------------------------------------------ growing
def _gains(hist: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Gini gain of (node, feature, border), -1 where a side has under ``least``,
    and the class weights on the left, of histograms (node, feature, bin, class)."""
    left = hist.cumsum(axis=2)
    total = left[:, :, -1:]
    left = left[:, :, :-1]
    right = total - left
    a, b, n = left.sum(axis=3), right.sum(axis=3), total.sum(axis=3)

    def impurity(c: np.ndarray, m: np.ndarray) -> np.ndarray:
        out = np.ones(m.shape)
        for i in range(c.shape[3]):  # class by class, as MLlib: splits of nearly equal gain then rank as there
            share = c[..., i] / np.maximum(m, 1)
            out -= share * share
        return out

    gain = impurity(total, n) - a / np.maximum(n, 1) * impurity(left, a) - b / np.maximum(n, 1) * impurity(right, b)
    return np.where((a >= least) & (b >= least), gain, -1.0), left


def _pick(rng: np.random.Generator, nodes: int, width: int, k: int) -> np.ndarray:
    """``k`` of the features for each node, in order."""
    return np.sort(rng.random((nodes, width)).argsort(axis=1)[:, :k], axis=1) if k < width else np.tile(np.arange(width), (nodes, 1))


def _best(gain: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature's place, border, gain) of the best split per node."""
    flat = gain.reshape(len(gain), -1)
    at = flat.argmax(axis=1)
    return at // gain.shape[2], at % gain.shape[2], flat[np.arange(len(flat)), at]


def grow(codes: np.ndarray, y: np.ndarray, w: np.ndarray, classes: int, depth: int, least: int, k: int, rng: np.random.Generator):
    """A branch over the cells, a level at a time: arrays (feature or LEAF,
    border, left child; the right one is next to it), class weights and gains."""
    width = codes.shape[1]
    feature, border, child, counts, gains = [], [], [], [], []
    level = np.bincount(y, w, classes)[None, :]
    node, size = np.zeros(len(y), np.int64), 0
    while len(level):
        n = level.sum(axis=1)
        f, b, c, g = np.full(len(level), LEAF, np.uint8), np.zeros(len(level), np.uint8), np.zeros(len(level), np.int32), np.zeros(len(level))
        todo = np.flatnonzero((level.max(axis=1) < n) & (n >= 2 * least)) if depth > 0 else np.zeros(0, int)
        place = np.full(len(level), -1)
        place[todo] = np.arange(len(todo))
        keep = place[node] >= 0
        codes, y, w, node = codes[keep], y[keep], w[keep], place[node[keep]]
        o = np.argsort(node, kind="stable")
        codes, y, w, node = codes[o], y[o], w[o], node[o]
        nxt, to = [], np.full(len(todo), -1)
        step = max(1, HISTOGRAM // (k * MAX_BINS * classes))
        for a in range(0, len(todo), step):
            m = min(step, len(todo) - a)
            lo, hi = np.searchsorted(node, [a, a + m])
            chosen = _pick(rng, m, width, k)
            own = node[lo:hi] - a
            seen = np.take_along_axis(codes[lo:hi], chosen[own], axis=1).astype(np.int64)
            cell = ((own[:, None] * k + np.arange(k)) * MAX_BINS + seen) * classes + y[lo:hi, None]
            hist = np.bincount(cell.ravel(), np.repeat(w[lo:hi], k), m * k * MAX_BINS * classes).reshape(m, k, MAX_BINS, classes)
            gain, left = _gains(hist, least)
            j, at, best = _best(gain)
            good = np.flatnonzero(best > 0)
            where = todo[a + good]
            f[where], b[where], g[where] = chosen[good, j[good]], at[good], best[good]
            to[a + good] = sum(len(x) for x in nxt) + 2 * np.arange(len(good))
            low = left[good, j[good], at[good]]
            nxt.append(np.stack([low, level[where] - low], axis=1).reshape(-1, classes))
        c[todo] = np.where(to >= 0, size + len(level) + to, 0)
        keep = to[node] >= 0
        codes, y, w, node = codes[keep], y[keep], w[keep], node[keep]
        over = codes[np.arange(len(node)), f[todo[node]]] > b[todo[node]]
        node = to[node] + over
        for into, v in ((feature, f), (border, b), (child, c), (counts, level), (gains, g)):
            into.append(v)
        size += len(level)
        level = np.concatenate(nxt) if nxt else np.zeros((0, classes))
        depth -= 1
    return [np.concatenate(v) for v in (feature, border, child, counts, gains)]


def pruned(feature, border, child, counts, gains):
    """Two leaves of one prediction become one, from below; children lie behind
    their parents. Dropped nodes are taken out."""
    feature, best = feature.copy(), counts.argmax(axis=1)
    changed = True
    while changed:
        inner = np.flatnonzero(feature != LEAF)
        l = child[inner]
        merge = inner[(feature[l] == LEAF) & (feature[l + 1] == LEAF) & (best[l] == best[l + 1])]
        feature[merge] = LEAF
        changed = len(merge) > 0
    alive = np.zeros(len(feature), bool)
    here = np.zeros(1, np.int64)
    while len(here):
        alive[here] = True
        l = child[here[feature[here] != LEAF]].astype(np.int64)
        here = np.concatenate([l, l + 1])
    at = np.cumsum(alive) - 1
    return [feature[alive], border[alive], np.where(feature[alive] != LEAF, at[child[alive]], 0).astype(np.int32), counts[alive], gains[alive]]


def descend(feature: np.ndarray, border: np.ndarray, child: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The node in which each row ends."""
    at, todo = np.zeros(len(codes), np.int64), np.arange(len(codes))
    while len(todo):
        todo = todo[feature[at[todo]] != LEAF]
        n = at[todo]
        at[todo] = child[n] + (codes[todo, feature[n]] > border[n])
    return at


def _weights(c: np.ndarray, bag: bool, seed: int, tree: int, shard: int) -> np.ndarray:
    return (np.random.default_rng([seed, tree, shard]).poisson(c) if bag else c).astype(float)


def _shards(batches: Iterator[pa.RecordBatch], width: int):
    for batch in batches:
        for shard, codes, y, c in zip(*(batch.column(n).to_pylist() for n in ("shard", "codes", "y", "c"))):
            yield shard, np.frombuffer(codes, np.uint8).reshape(-1, width), np.frombuffer(y, np.uint8), np.frombuffer(c, np.int64)


def grow_trees(shards: DataFrame, cells: int, width: int, classes: int, wanted: Sequence[tuple[int, int, int]], k: int, bag: bool, seed: int,
               local_cells: int) -> list[list[np.ndarray]]:
    """All ``wanted`` trees, (number for the draws, greatest depth, least rows of a node)
    each, as (feature, border, left child, class weights, gains)."""
    trees = len(wanted)
    number, depth, least = zip(*wanted)
    # upper nodes per tree: [feature, border, left child, class weights, gain], children behind their parents
    upper: list[list[list]] = [[[LEAF, 0, 0, None, 0.0]] for _ in range(trees)]
    open_: list[set[int]] = [{0} for _ in range(trees)]
    large = [(t, 0) for t in range(trees) if depth[t] > 0] if cells > local_cells else []
    spread = 2 * shards.sparkSession.sparkContext.defaultParallelism
    shards = shards.repartition(spread, "shard")
    arrays = lambda nodes: (np.array([n[0] for n in nodes], np.uint8), np.array([n[1] for n in nodes], np.uint8), np.array([n[2] for n in nodes], np.int32))
    levels = 0
    while large:
        of = {t: sorted(n for u, n in large if u == t) for t in {t for t, _ in large}}
        tops = {t: arrays(upper[t]) for t in of}
        chosen = {(t, n): _pick(np.random.default_rng([seed, number[t], n, 1]), 1, width, k)[0] for t, n in large}

        def histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[tuple[int, int], np.ndarray] = {}
            for shard, codes, y, c in _shards(batches, width):
                for t, nodes in of.items():
                    w = _weights(c, bag, seed, number[t], shard)
                    at = descend(*tops[t], codes)
                    for n in nodes:
                        i = np.flatnonzero((at == n) & (w > 0))
                        cell = ((np.arange(k) * MAX_BINS + codes[i][:, chosen[t, n]]) * (classes + 1))
                        h = np.bincount((cell + y[i, None]).ravel(), np.repeat(w[i], k), k * MAX_BINS * (classes + 1))
                        h += np.bincount((cell + classes).ravel(), minlength=len(h))
                        sums[t, n] = sums[t, n] + h if (t, n) in sums else h
            for (t, n), h in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([t]), pa.array([n]), pa.array([h.tobytes()], pa.binary())], names=["t", "n", "h"])

        def choose(table: pa.Table) -> pa.Table:
            h = sum(np.frombuffer(b) for b in table.column("h").to_pylist()).reshape(1, k, MAX_BINS, classes + 1)
            t, n = table.column("t")[0].as_py(), table.column("n")[0].as_py()
            gain, left = _gains(h[..., :classes], least[t])
            (j,), (b,), (g,) = _best(gain)
            here = h[0, j].sum(axis=0)
            low = np.append(left[0, j, b], h[0, j, : b + 1, classes].sum())
            return pa.table({"t": [t], "n": [n], "f": pa.array([int(chosen[t, n][j])], pa.int32()), "b": pa.array([int(b)], pa.int32()), "g": [float(g)],
                             "low": pa.array([low.tolist()]), "here": pa.array([here.tolist()])})

        found = shards.mapInArrow(histograms, "t bigint, n bigint, h binary").groupBy("t", "n").applyInArrow(
            choose, "t bigint, n bigint, f int, b int, g double, low array<double>, here array<double>").collect()  # a row a large node
        large, levels = [], levels + 1
        for r in sorted(found, key=lambda r: (r["t"], r["n"])):
            t, n, low, here = r["t"], r["n"], np.array(r["low"]), np.array(r["here"])
            open_[t].discard(n)
            nodes = upper[t]
            nodes[n][3] = here[:classes]
            if r["g"] > 0:
                nodes[n][:3], nodes[n][4] = [r["f"], r["b"], len(nodes)], r["g"]
                for side in (low, here - low):
                    m = len(nodes)
                    nodes.append([LEAF, 0, 0, side[:classes], 0.0])
                    if side[:classes].max() < side[:classes].sum() and levels < depth[t]:
                        open_[t].add(m)
                        if side[classes] > local_cells:
                            large.append((t, m))
    tops, roots = {t: arrays(upper[t]) for t in range(trees)}, open_
    deep: list[dict[int, int]] = []
    for nodes in upper:
        d = {0: 0}
        for i, n in enumerate(nodes):
            if n[0] != LEAF:
                d[n[2]] = d[n[2] + 1] = d[i] + 1
        deep.append(d)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, codes, y, c in _shards(batches, width):
            for t in range(trees):
                if not roots[t]:
                    continue
                w = _weights(c, bag, seed, number[t], shard)
                at = descend(*tops[t], codes)
                at[w == 0] = -1
                for n in roots[t]:
                    i = np.flatnonzero(at == n)
                    if len(i):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([t]), pa.array([n]), pa.array([shard]), pa.array([codes[i].tobytes()], pa.binary()), pa.array([y[i].tobytes()], pa.binary()),
                             pa.array([w[i].tobytes()], pa.binary())],
                            names=["t", "n", "shard", "codes", "y", "w"])

    def finish(table: pa.Table) -> pa.Table:
        t, n = table.column("t")[0].as_py(), table.column("n")[0].as_py()
        table = table.sort_by("shard")
        join = lambda c, kind: np.frombuffer(b"".join(table.column(c).to_pylist()), kind)
        got = grow(join("codes", np.uint8).reshape(-1, width), join("y", np.uint8).astype(np.int64), join("w", float), classes, depth[t] - deep[t][n], least[t], k,
                   np.random.default_rng([seed, number[t], n, 2]))
        return pa.table({"t": [t], "n": [n], "tree": pa.array([pickle.dumps(pruned(*got))], pa.binary())})

    dealt = shards.mapInArrow(deal, "t bigint, n bigint, shard bigint, codes binary, y binary, w binary")
    dealt = dealt.repartition(max(1, min(8 * spread, sum(map(len, roots)))), "t", "n")
    branches = {(r["t"], r["n"]): pickle.loads(r["tree"]) for r in dealt.groupBy("t", "n").applyInArrow(finish, "t bigint, n bigint, tree binary").collect()}
    return [_assembled(upper[t], {n: branches.pop((t, n)) for n in sorted(open_[t]) if (t, n) in branches}, classes) for t in range(trees)]


def _assembled(nodes: list[list], below: dict[int, list[np.ndarray]], classes: int) -> list[np.ndarray]:
    """Upper nodes and the branches at their open leaves as one tree."""
    zero = np.zeros(classes)
    head = [np.array([n[0] for n in nodes], np.uint8), np.array([n[1] for n in nodes], np.uint8), np.array([n[2] for n in nodes], np.int32),
            np.array([zero if n[3] is None else n[3] for n in nodes]), np.array([n[4] for n in nodes])]
    parts, size = [head], len(nodes)
    for n, branch in below.items():
        f, b, c, w, g = branch
        # the branch's root takes the place of the leaf; the others follow
        moved = np.where(f != LEAF, c + size - 1, 0).astype(np.int32)
        for into, v in zip(head, (f, b, moved, w, g)):
            into[n] = v[0]
        parts.append([f[1:], b[1:], moved[1:], w[1:], g[1:]])
        size += len(f) - 1
    return pruned(*[np.concatenate(v) for v in zip(*parts)])


# ------------------------------------------------------------------ estimator, model
class _Classes(HasFeaturesCol, HasLabelCol, HasSeed):
    numClasses = Param(Params._dummy(), "numClasses", "label codes", typeConverter=TypeConverters.toInt)
    importances = Param(Params._dummy(), "importances", "share of gain by feature", typeConverter=TypeConverters.toListFloat)

    def setFeaturesCol(self, name: str):  # noqa: N802 - the names MLlib uses
        return self._set(featuresCol=name)

    def setLabelCol(self, name: str):  # noqa: N802
        return self._set(labelCol=name)


class BinnedForest(Estimator, _Classes, DefaultParamsReadable, DefaultParamsWritable):
    """A forest, or with ``numTrees=1`` and ``bootstrap=False`` a decision tree,
    which looks at all features. Labels are the codes 0 .. classes - 1."""

    numTrees = Param(Params._dummy(), "numTrees", "trees", typeConverter=TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "greatest depth", typeConverter=TypeConverters.toInt)
    minInstancesPerNode = Param(Params._dummy(), "minInstancesPerNode", "least rows of a node", typeConverter=TypeConverters.toInt)
    bootstrap = Param(Params._dummy(), "bootstrap", "draw rows for each tree", typeConverter=TypeConverters.toBoolean)
    localCells = Param(Params._dummy(), "localCells", "cells of a node that one task finishes", typeConverter=TypeConverters.toInt)

    @keyword_only
    def __init__(self, numTrees=200, maxDepth=30, minInstancesPerNode=1, bootstrap=True, seed=42, localCells=LOCAL_CELLS, featuresCol="features", labelCol="label"):
        super().__init__()
        self._setDefault(numTrees=200, maxDepth=30, minInstancesPerNode=1, bootstrap=True, seed=42, localCells=LOCAL_CELLS)
        self._set(**self._input_kwargs)

    def prepare(self, dataset: DataFrame) -> tuple:
        """What trees of any parameters are grown from: borders and cells of the rows."""
        ship(dataset.sparkSession)
        of = self.getOrDefault
        rows = dataset.where(F.col(of("labelCol")).isNotNull()).select(vector_to_array(of("featuresCol")).alias("x"), F.col(of("labelCol")).cast("int").alias("y"))
        about = rows.agg(F.count(F.lit(1)).alias("n"), F.max("y").alias("y"), F.max(F.size("x")).alias("width")).first()
        if not about["n"]:
            raise ValueError("no labelled row to learn from")
        cuts = borders(rows, about["width"], about["n"])
        return (cuts, about["y"] + 1, *shards_of(rows, cuts, min(SHARD_CELLS, of("localCells"))))

    def _fit(self, dataset: DataFrame) -> BinnedForestModel:
        return self.grown(self.prepare(dataset))

    def grown(self, prepared: tuple) -> BinnedForestModel:
        """The model on what ``prepare`` gave."""
        return grown_together([self], prepared)[0]

    def _model(self, grown: list[list[np.ndarray]], cuts: list[list[float]], classes: int) -> BinnedForestModel:
        share = np.zeros(len(cuts))
        packed = []
        for f, b, c, w, g in grown:
            own = np.bincount(f[f != LEAF], (g * w.sum(axis=1))[f != LEAF], len(cuts))
            share += own / own.sum() if own.sum() > 0 else own
            leaf = f == LEAF
            kinds, which = np.unique(w[leaf] / np.maximum(w[leaf].sum(axis=1), 1)[:, None], axis=0, return_inverse=True)
            c = c.copy()
            c[leaf] = which.ravel()
            packed.append(pickle.dumps((f, b, c, kinds)))
        model = BinnedForestModel(numClasses=classes, importances=(share / share.sum() if share.sum() > 0 else share).tolist())
        model.cuts, model.trees = cuts, packed
        return self._copyValues(model)


def grown_together(estimators: Sequence[BinnedForest], prepared: tuple) -> list[BinnedForestModel]:
    """The model of each estimator on what ``prepare`` gave, the same as from ``grown``.
    Trees of estimators that differ in depth, leaves and number of trees only are grown
    in the same jobs, up to ``TREES_TOGETHER`` of them or those of one estimator."""
    cuts, classes, shards, cells = prepared
    width = len(cuts)
    parts: list[tuple[tuple, list[int]]] = []
    for i, e in enumerate(estimators):
        of, trees = e.getOrDefault, e.getOrDefault("numTrees")
        alike = (width if trees == 1 else int(np.ceil(np.sqrt(width))), of("bootstrap"), of("seed"), of("localCells"))
        if not parts or parts[-1][0] != alike or trees + sum(estimators[j].getOrDefault("numTrees") for j in parts[-1][1]) > TREES_TOGETHER:
            parts.append((alike, []))
        parts[-1][1].append(i)
    out = []
    for alike, own in parts:
        wanted = [(t, of("maxDepth"), of("minInstancesPerNode")) for of in (estimators[i].getOrDefault for i in own) for t in range(of("numTrees"))]
        grown = iter(grow_trees(shards, cells, width, classes, wanted, *alike))
        out += [estimators[i]._model([next(grown) for _ in range(estimators[i].getOrDefault("numTrees"))], cuts, classes) for i in own]
    return out


_TREES: dict[str, list] = {}


def _unpacked(name: str, sent) -> list:
    """The trees of the model last used in this worker."""
    if name not in _TREES:
        _TREES.clear()
        _TREES[name] = [pickle.loads(t) for t in sent.value]
    return _TREES[name]


class BinnedForestModel(Model, _Classes, MLWritable, MLReadable):
    """Adds ``rawPrediction`` and ``probability`` (the trees' mean shares of the
    classes, vectors) and ``prediction``."""

    @keyword_only
    def __init__(self, numClasses=None, importances=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})
        self.cuts: list[list[float]] = []
        self.trees: list[bytes] = []
        self._sent = None

    @property
    def featureImportances(self) -> DenseVector:  # noqa: N802 - the name MLlib uses
        return DenseVector(self.getOrDefault("importances"))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        ship(dataset.sparkSession)
        if self._sent is None:
            self._sent = dataset.sparkSession.sparkContext.broadcast(self.trees)
        sent, cuts, classes = self._sent, self.cuts, self.getOrDefault("numClasses")
        name = self.uid

        @F.pandas_udf("array<double>")
        def shares(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=object)
            codes, total = coded(_matrix(x), cuts), np.zeros((len(x), classes))
            trees = _unpacked(name, sent)
            for f, b, c, kinds in trees:
                total += kinds[c[descend(f, b, c, codes)]]
            return pd.Series(list(total / len(trees)))

        out = dataset.withColumn("__p", shares(vector_to_array(self.getOrDefault("featuresCol"))))
        best = (F.array_position("__p", F.array_max("__p")) - 1).cast("double")
        return out.withColumns({"rawPrediction": array_to_vector("__p"), "probability": array_to_vector("__p"), "prediction": best}).drop("__p")

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    """Parameters as metadata, the trees as a table."""

    def __init__(self, instance: BinnedForestModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:  # noqa: N802
        spark, m = SparkSession.active(), self.instance
        DefaultParamsWriter.saveMetadata(m, path, spark)
        rows = [(i, t) for i, t in enumerate(m.trees)] + [(-1, pickle.dumps(m.cuts))]
        spark.createDataFrame(rows, "tree int, blob binary").write.parquet(f"{path}/trees")


class _Reader(MLReader):
    def load(self, path: str) -> BinnedForestModel:
        spark = SparkSession.active()
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        model = BinnedForestModel()
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        rows = {r["tree"]: bytes(r["blob"]) for r in spark.read.parquet(f"{path}/trees").collect()}
        model.cuts = pickle.loads(rows.pop(-1))
        model.trees = [rows[i] for i in sorted(rows)]
        return model

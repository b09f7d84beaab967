"""Exact k-nearest-neighbour classification (T4): best-first descent through
a stored k-d tree.

**The tree** has two parts. Training vectors are collapsed to distinct (vector,
label, weight) rows. The upper part, plain split nodes from a bounded sample,
cuts space into cells; a cell with more than ``cell_rows`` rows is sampled and
cut again until none is full. Each cell's rows then become a subtree of their
own with leaves of at most ``leaf_rows`` vectors and tight boxes, built in one
task and stored as one row of a table.

**The search** descends to a query's own cell and goes through that cell's
subtree best first: the node whose box is nearest is opened next, until no box
comes nearer than the k-th neighbour found. That distance bounds the answer,
so the query then visits only those other cells whose region comes within it
(the upper part is descended the same way). A query whose cells hold fewer
than ``k`` neighbours goes on to the next nearest cells. So a query is compared
with a few leaves, however many rows there are.

The upper part (20 bytes a cell) travels with the tasks; the rows, the
subtrees and everything per query stay distributed. A cell's queries are dealt
in chunks of ``QUERY_ROWS``, each with a copy of the subtree, and only the ``k``
best leave a task.

Votes are uniform over the k nearest (duplicates count by multiplicity); ties
in distance go to the smaller label, then the smaller vector; tied votes go
to the smaller label. With fewer than ``k`` training rows it raises, as the
original does. Null features count as 0.
"""

from __future__ import annotations

import heapq
import itertools
import pickle
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import reliable_checkpoint
from .prefix import ship

#: a round of cutting looks at about so many distinct training vectors
SAMPLE_VECTORS = 50_000
CELL_ROWS = 20_000
LEAF_ROWS = 32
QUERY_ROWS = 500
#: box distances are taken a little smaller, for rounding
SAFE = 1 - 1e-12


class CellTree:
    """The upper part: split nodes over cells. Node arrays: dimension, cut,
    and the two children (a negative child c is cell -1 - c)."""

    def __init__(self) -> None:
        self.dim, self.cut, self.below, self.above = [], [], [], []
        self.root, self.cells = -1, 1  # one cell

    def split(self, cell: int, sample: np.ndarray, parts: int) -> bool:
        """Cut a cell at medians of the sample into about ``parts`` cells."""
        made = self._grow(sample, max(2, parts), cell)
        if made == -1 - cell:
            return False
        for side in (self.below, self.above):
            for i, child in enumerate(side):
                if child == -1 - cell and i < self._first:
                    side[i] = made
        if self.root == -1 - cell:
            self.root = made
        return True

    def _grow(self, sample: np.ndarray, parts: int, cell: int) -> int:
        self._first = len(self.dim)
        free = [cell]  # the first leaf keeps the number of the cell

        def leaf() -> int:
            if free:
                return -1 - free.pop()
            self.cells += 1
            return -self.cells  # cell number cells - 1

        def grow(x: np.ndarray, n: int) -> int:
            spread = np.ptp(x, axis=0) if len(x) else np.zeros(1)
            if n < 2 or not spread.max() > 0:
                return leaf()
            d = int(spread.argmax())
            at = float(np.median(x[:, d]))
            if at == x[:, d].min():  # half of the rows share the smallest value: cut above it
                at = float(x[:, d][x[:, d] > at].min())
            node = len(self.dim)
            self.dim.append(d)
            self.cut.append(at)
            self.below.append(0)
            self.above.append(0)
            self.below[node] = grow(x[x[:, d] < at], n // 2)
            self.above[node] = grow(x[x[:, d] >= at], n - n // 2)
            return node

        return grow(sample, parts)

    def cell_of(self, x: np.ndarray) -> np.ndarray:
        """The cell of each vector: all descend a level at a time."""
        at = np.full(len(x), self.root, np.int64)
        if self.root < 0:
            return -1 - at
        dim, cut, below, above = (np.asarray(a) for a in (self.dim, self.cut, self.below, self.above))
        todo = np.arange(len(x))
        while len(todo):
            node = at[todo]
            at[todo] = np.where(x[todo, dim[node]] < cut[node], below[node], above[node])
            todo = todo[at[todo] >= 0]
        return -1 - at

    def near_cells(self, x: np.ndarray) -> Iterator[tuple[float, int]]:
        """(lower bound of the distance, cell), nearest first."""
        count = itertools.count()
        heap = [(0.0, next(count), self.root, (0.0,) * len(x))]
        while heap:
            square, _, node, off = heapq.heappop(heap)
            while node >= 0:  # down on the query's side; the other side waits
                d, gap = self.dim[node], float(self.cut[node] - x[self.dim[node]])
                near, far = (self.below[node], self.above[node]) if gap > 0 else (self.above[node], self.below[node])
                more = max(off[d], abs(gap))
                beyond = (*off[:d], more, *off[d + 1 :])
                heapq.heappush(heap, (sum(o * o for o in beyond), next(count), far, beyond))
                node = near
            yield square**0.5 * SAFE, -1 - node


class LeafTree:
    """A cell's subtree: rows in leaf order, nodes with tight boxes. A node is
    (first row, end row, left child, right child); leaves have child -1."""

    def __init__(self, x: np.ndarray, code: np.ndarray, weight: np.ndarray, leaf_rows: int = LEAF_ROWS):
        # equal distances keep the order (label, vector)
        tie = np.empty(len(x), np.int64)
        tie[np.lexsort((*x.T[::-1], code))] = np.arange(len(x))
        order = np.arange(len(x))
        nodes, low, high = [], [], []

        def grow(a: int, b: int) -> int:
            part = x[order[a:b]]
            lo, hi = part.min(axis=0), part.max(axis=0)
            node = len(nodes)
            nodes.append((a, b, -1, -1))
            low.append(lo)
            high.append(hi)
            d = int((hi - lo).argmax())
            if b - a > leaf_rows and hi[d] > lo[d]:
                mid = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(part[:, d], mid)]
                nodes[node] = (a, b, grow(a, a + mid), grow(a + mid, b))
            return node

        if len(x):
            grow(0, len(x))
        self.nodes = nodes
        self.low, self.high = np.array(low), np.array(high)
        self.x, self.tie, self.code, self.weight = x[order], tie[order], code[order], weight[order]

    def search(self, q: np.ndarray, k: int, bound: float = np.inf, seen: list[int] | None = None) -> list[tuple[float, int, int]]:
        """The ``k`` weighted nearest rows up to ``bound``, as (distance, tie
        rank, row). ``seen`` counts the vectors compared."""
        best: list[tuple[float, int, int]] = []
        heap = [(0.0, 0)] if self.nodes else []
        while heap:
            gap, node = heapq.heappop(heap)
            if gap > bound:
                break
            a, b, left, right = self.nodes[node]
            if left < 0:
                if seen is not None:
                    seen[0] += b - a
                d = np.zeros(b - a)
                for c in range(self.x.shape[1]):  # summed in column order
                    step = q[c] - self.x[a:b, c]
                    d += step * step
                d = np.sqrt(d)
                best += [(float(d[i]), int(self.tie[a + i]), a + int(i)) for i in np.flatnonzero(d <= bound)]
                best.sort()
                held = 0
                for n, (far, _, row) in enumerate(best):
                    held += int(self.weight[row])
                    if held >= k:
                        del best[n + 1 :]
                        bound = far
                        break
                continue
            for child in (left, right):
                box = np.maximum(np.maximum(self.low[child] - q, q - self.high[child]), 0.0)
                near = float(np.sqrt((box * box).sum())) * SAFE
                if near <= bound:
                    heapq.heappush(heap, (near, child))
        return best


def _build_cells(tv: DataFrame, vec: list[str], rows: int, cell_rows: int) -> tuple[CellTree, DataFrame]:
    """Cut space until no cell is full; returns the tree and the rows with
    their cell. Per round, only full cells and a bounded sample are looked at."""
    tree = CellTree()
    full = {0: rows} if rows > cell_rows else {}
    placed = tv.withColumn("__cell", F.lit(0))
    while full:
        share = min(1.0, 1.2 * SAMPLE_VECTORS / sum(full.values()))
        pick = F.pmod(F.xxhash64(F.lit(tree.cells), *vec), F.lit(1 << 30)) < int(share * (1 << 30)) + 1
        some = placed.where(F.col("__cell").isin(list(full)) & pick).select("__cell", *vec).limit(2 * SAMPLE_VECTORS).toPandas()
        grown = False
        for cell, part in some.groupby("__cell"):
            grown |= tree.split(int(cell), part[vec].to_numpy(float), -(-2 * full[cell] // cell_rows))
        if not grown:
            break  # equal vectors only (as many as there are labels)
        cell_of = _cell_udf(tree)
        placed = reliable_checkpoint(tv.withColumn("__cell", cell_of(*vec)))
        over = placed.groupBy("__cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cell_rows)
        full = {r["__cell"]: r["n"] for r in over.collect()}  # full cells: a few
    return tree, placed


def _cell_udf(tree: CellTree):
    @F.pandas_udf("int")
    def cell_of(*cols: pd.Series) -> pd.Series:
        return pd.Series(tree.cell_of(np.column_stack([c.to_numpy(float) for c in cols])).astype(np.int32))

    return cell_of


def _store(placed: DataFrame, vec: list[str], leaf_rows: int) -> DataFrame:
    """One row a cell: its subtree."""
    def build(rows: pa.Table) -> pa.Table:
        x = np.column_stack([rows.column(c).to_numpy() for c in vec])
        labels = rows.column("__label").to_pylist()
        names = sorted(set(labels), key=lambda v: (v is not None, v))
        code = np.array(list(map({v: i for i, v in enumerate(names)}.__getitem__, labels)), np.int64)
        tree = LeafTree(x, code, rows.column("__w").to_numpy(), leaf_rows)
        return pa.table({"__cell": rows.column("__cell")[:1], "__tree": pa.array([pickle.dumps((tree, names))], pa.binary())})

    return reliable_checkpoint(placed.select("__cell", "__label", "__w", *vec).groupBy("__cell").applyInArrow(build, "__cell int, __tree binary"))


def _search(queries: DataFrame, stored: DataFrame, feats: list[str], vec: list[str], label, k: int) -> DataFrame:
    """Per (query, cell) the up to ``k`` weighted nearest vectors within
    ``__bound``: ``__q, __d, __label, __w`` and the vector."""
    load = queries.groupBy("__cell").agg(F.count(F.lit(1)).alias("__n"))
    load = load.withColumn("__chunks", F.ceil(F.col("__n") / QUERY_ROWS).cast("int")).select("__cell", "__chunks")
    q = queries.join(load, "__cell").withColumn("__chunk", F.pmod(F.xxhash64("__q"), F.col("__chunks")).cast("int"))
    t = stored.join(load, "__cell").withColumn("__chunk", F.explode(F.sequence(F.lit(0), F.col("__chunks") - 1)))
    schema = f"__q bigint, __d double, __label {label.simpleString()}, __w bigint, " + ", ".join(f"`{v}` double" for v in vec)
    kind = to_arrow_type(label)

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, dist, rows = [], [], []
        names, tree = [], None
        if right.num_rows and left.num_rows:
            tree, names = pickle.loads(right.column("__tree")[0].as_py())
            x = np.column_stack([left.column(c).to_numpy() for c in feats])
            bounds = left.column("__bound").to_numpy()
            for q_id, point, bound in zip(left.column("__q").to_pylist(), x, bounds):
                for d, _, row in tree.search(point, k, float(bound)):
                    ids.append(q_id)
                    dist.append(d)
                    rows.append(row)
        at = np.array(rows, np.int64)
        got = [pa.array(ids, pa.int64()), pa.array(dist, pa.float64()),
               pa.array([names[c] for c in tree.code[at]] if tree else [], kind), pa.array(tree.weight[at] if tree else [], pa.int64())]
        got += [pa.array(tree.x[at, i] if tree else [], pa.float64()) for i in range(len(vec))]
        return pa.Table.from_arrays(got, names=["__q", "__d", "__label", "__w", *vec])

    return (q.select("__cell", "__chunk", "__q", "__bound", *feats).groupBy("__cell", "__chunk")
            .cogroup(t.select("__cell", "__chunk", "__tree").groupBy("__cell", "__chunk")).applyInArrow(best, schema))


def knn_classify(train: DataFrame, test: DataFrame, features: Sequence[str], label: str, key: str, k: int = 5,
                 leaf_rows: int = LEAF_ROWS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Returns (key, prediction, votes), one row for every test row."""
    ship(train.sparkSession)
    feats = list(features)
    num = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    vec = [f"__t_{c}" for c in feats]
    tv = train.groupBy(*[num(c).alias(f"__t_{c}") for c in feats], F.col(label).alias("__label")) \
        .agg(F.count(F.lit(1)).alias("__w"))
    tv = reliable_checkpoint(tv)
    total = tv.agg(F.sum("__w").alias("w"), F.count(F.lit(1)).alias("n")).first()
    if (total["w"] or 0) < k:
        raise ValueError(f"k = {k} neighbours asked for, {total['w'] or 0} training rows given")
    tree, placed = _build_cells(tv, vec, total["n"], cell_rows)
    stored = _store(placed, vec, leaf_rows)

    @F.pandas_udf("array<int>")
    def next_cells(visited: pd.Series, bound: pd.Series, *cols: pd.Series) -> pd.Series:
        """A query's next cells, nearest first: all within its bound, or twice as many again while it has none."""
        x = np.column_stack([c.to_numpy(float) for c in cols])
        out = []
        for point, gone, far in zip(x, visited, bound.to_numpy(float)):
            ahead = itertools.islice(tree.near_cells(point), int(gone), None if np.isfinite(far) else int(gone) + max(1, int(gone)))
            out.append([c for _, c in itertools.takewhile(lambda n: n[0] <= far, ahead)])  # noqa: B023
        return pd.Series(out)

    rows = test.select(key, *[num(c).alias(c) for c in feats])
    # distinct query vectors, with an id that is the same in every pass
    q = rows.groupBy(*feats).agg(F.first(F.xxhash64(*feats)).alias("__q"))
    q = reliable_checkpoint(q.withColumns({"__bound": F.lit(float("inf")), "__visited": F.lit(0)}))
    by_distance = Window.partitionBy("__q").orderBy("__d", "__label", *vec)
    running = F.sum("__w").over(by_distance.rowsBetween(Window.unboundedPreceding, 0))
    found, ahead = None, q
    while True:
        ahead = reliable_checkpoint(ahead.withColumn("__next", next_cells("__visited", "__bound", *feats)).where(F.size("__next") > 0))
        if ahead.isEmpty():
            break
        got = _search(ahead.withColumn("__cell", F.explode("__next")), stored, feats, vec, train.schema[label].dataType, k)
        both = got if found is None else found.unionByName(got)
        found = reliable_checkpoint(both.withColumn("__cum", running).where(F.col("__cum") - F.col("__w") < k).drop("__cum"))
        # a query with a finite bound has now been everywhere within it
        bound = found.groupBy("__q").agg(F.when(F.sum("__w") >= k, F.max("__d")).alias("__far"))
        ahead = (ahead.where(F.col("__bound") == float("inf")).withColumn("__visited", F.col("__visited") + F.size("__next"))
                 .join(bound, "__q", "left").withColumn("__bound", F.coalesce("__far", F.lit(float("inf")))).drop("__far", "__next"))
    top = found.withColumn("__cum", running)
    votes = top.withColumn("__take", F.least(F.col("__w"), F.lit(k) - (F.col("__cum") - F.col("__w")))) \
        .groupBy("__q", "__label").agg(F.sum("__take").alias("votes"))
    best = votes.groupBy("__q").agg(
        F.max_by("__label", F.struct(F.col("votes"), (-F.col("__label")).alias("__neg"))).alias("prediction"),
        F.max("votes").alias("votes"))
    return rows.withColumn("__q", F.xxhash64(*feats)).join(best, "__q").select(key, "prediction", "votes")

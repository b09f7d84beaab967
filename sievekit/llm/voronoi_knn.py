"""Exact top-k search by inner product: a kNN join over Voronoi groups.

Queries and data are whole-number vectors; the score is their inner product.

1. **Group.** Equal vectors become one, with its ``k + 1`` smallest ids (no
   query needs more of them: one at most is its own row). ``pivots`` vectors,
   drawn from a bounded sample, cut space into Voronoi cells; every vector goes
   to its nearest pivot's cell and keeps its distance ``d`` from it.
2. **Summarise.** Per cell: how many data and query vectors, the largest
   query distance ``U`` and query norm ``N``, and the ``k + 1`` smallest data
   distances. Neighbouring cells are put together to query groups of about
   ``QUERY_ROWS`` queries, dealt in chunks where one cell holds more.
3. **Bound.** For a query q of cell i and a vector x of cell j at distance d
   from pivot p_j:  q.p_j - N d <= q.x <= q.p_j + N d, and q.p_j lies within
   U |p_j| of p_i.p_j. The summaries' distances so give lower bounds of ``k + 1``
   real scores; the (k+1)-th largest bounds cell i's answer from below
   (``theta``). A vector of cell j can matter to it only if its upper bound reaches
   theta, that is from a distance of its own on: ``need[i, j]``.
4. **Replicate.** A data vector goes to those query groups only whose ``need``
   its distance reaches. A group's vectors are dealt in slices of about
   ``DATA_ROWS``; its queries (one in fifty rows of the data) go to each slice.
5. **Solve.** Each (group, chunk, slice) is multiplied in blocks of bounded size
   and keeps ``k + 1`` scores a query; the slices' answers are merged by Spark
   with partial limits. Each query row then drops itself and keeps ``k``.

What reaches the driver are the pivots and tables of cells x cells numbers,
whatever the size of the data. Where the bounds cut nothing off (vectors in all
directions), data goes to every query group: that is all the work there is.
Scores are exact: products are made in doubles while these hold them exactly
and in 64-bit integers otherwise.

Edge cases: vectors that are null or empty or hold null or non-finite
components, and rows without an id, take no part. Shorter vectors count as filled up with zeros.
Rows that repeat id and vector count once; two vectors under one id are two
rows, each a candidate of the other. Equal scores go to the smaller id.
Components beyond 31 bits raise. Fewer than ``k`` candidates give fewer ranks;
an empty table gives none. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievekit.llm.common import cut, ship

#: pivots come from at most so many vectors, and are at most so many
SAMPLE_VECTORS = 20_000
MAX_PIVOTS = 256
#: queries of a group's chunk and data vectors of a slice, about
QUERY_ROWS = 8_192
DATA_ROWS = 32_768
#: scores computed at once in a task
BLOCK = 2_000_000
#: bounds are widened by this share of their terms, for rounding
SLACK = 1e-9


def quantised(vector: str = "embedding", scale: int = 256) -> Column:
    """floor(scale * x) of every component as int; null for a vector that
    is null or empty or has a null or non-finite component."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    whole = lambda x: F.floor(x * float(scale))
    wide = F.exists(v, lambda x: F.abs(x * float(scale)) >= float(1 << 31))
    ints = F.transform(v, lambda x: whole(x).cast("int"))
    fine = F.coalesce(F.size(v) > 0, F.lit(False)) & ~F.coalesce(F.exists(v, bad), F.lit(True))
    return F.when(fine, F.when(wide, F.raise_error(F.lit("a component doesn't fit 31 bits")).cast("array<int>")).otherwise(ints))


def _matrix(col: pa.Array, dims: int) -> np.ndarray:
    """(rows, dims) int64; shorter vectors are filled up with zeros."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = col.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(flat) == len(sizes) * dims and (not len(sizes) or sizes.min() == dims):
        return flat.reshape(len(sizes), dims)
    out = np.zeros((len(sizes), dims), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    start = np.cumsum(sizes) - sizes
    out[row, np.arange(len(flat)) - np.repeat(start, sizes)] = flat
    return out


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """All inner products, exact: doubles hold whole numbers below 2^53."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    if most < float(1 << 53):
        return (q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
    if most >= float(1 << 63):
        raise OverflowError("an inner product may not fit 64 bits")
    return q @ x.T


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` distinct rows of the sample: farthest-first among the
    first ones, so that clusters get pivots of their own."""
    sample = np.unique(sample, axis=0)
    if len(sample) <= n:
        return sample
    order = np.random.default_rng(0).permutation(len(sample))[: max(n, 4 * n)]
    x = sample[order].astype(np.float64)
    chosen, gap = [0], ((x - x[0]) ** 2).sum(axis=1)
    while len(chosen) < n:
        best = int(gap.argmax())
        chosen.append(best)
        gap = np.minimum(gap, ((x - x[best]) ** 2).sum(axis=1))
    return sample[order][chosen]


def _cells(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest pivot and distance of each row (ties to the first pivot)."""
    cell, dist = np.empty(len(x), np.int32), np.empty(len(x))
    p, norm = pivots.astype(np.float64), (pivots.astype(np.float64) ** 2).sum(axis=1)
    for a in range(0, len(x), 4096):
        part = x[a : a + 4096].astype(np.float64)
        near = (norm - 2 * (part @ p.T)).argmin(axis=1)
        cell[a : a + 4096] = near
        dist[a : a + 4096] = np.sqrt(((part - p[near]) ** 2).sum(axis=1))
    return cell, dist


def bounds(pivots: np.ndarray, reach: np.ndarray, norm: np.ndarray, nearest: list[np.ndarray], keep: int) -> np.ndarray:
    """``need[i, j]``: a data vector of cell j matters to the queries of cell
    i only from this distance (from p_j) on; -inf if all do, +inf if none.
    ``reach`` and ``norm``: largest distance and norm of each cell's queries
    (NaN without queries); ``nearest``: each cell's smallest data distances."""
    p = pivots.astype(np.float64)
    dot, size = p @ p.T, np.sqrt((p * p).sum(axis=1))
    need = np.full((len(p), len(p)), np.inf)
    for i in np.flatnonzero(~np.isnan(reach)):
        spread = reach[i] * size
        slack = SLACK * (np.abs(dot[i]) + spread + 1.0)
        low = [dot[i, j] - spread[j] - slack[j] - norm[i] * (1 + SLACK) * d for j in range(len(p)) for d in nearest[j]]
        theta = np.sort(low)[-keep] if len(low) >= keep else -np.inf
        over = theta - dot[i] - spread - slack
        with np.errstate(divide="ignore", invalid="ignore"):
            need[i] = np.where(over <= 0, -np.inf, over / norm[i] * (1 - SLACK) if norm[i] > 0 else np.inf)
    return need


def group_cells(pivots: np.ndarray, queries: np.ndarray, rows: int) -> np.ndarray:
    """Query group of each cell (-1 without queries): neighbouring cells
    together while they hold up to ``rows`` queries."""
    group, left, g = np.full(len(pivots), -1), set(np.flatnonzero(queries > 0).tolist()), 0
    p = pivots.astype(np.float64)
    while left:
        seed = min(left)
        near = sorted(left, key=lambda c: (((p[c] - p[seed]) ** 2).sum(), c))
        held = 0
        for c in near:
            if held and held + queries[c] > rows:
                break
            group[c], held = g, held + queries[c]
            left.discard(c)
        g += 1
    return group


def top_k(table: DataFrame, is_query: Column, k: int = 5, vector: str = "embedding", key: str = "vec_id", scale: int = 256,
          pivots: int | None = None, query_rows: int = QUERY_ROWS, data_rows: int = DATA_ROWS) -> DataFrame:
    """For each row where ``is_query`` holds, the ``k`` best other rows:
    (query_id, rank, ``key``, score)."""
    spark, keep = table.sparkSession, k + 1
    ship(spark)
    rows = table.select(F.col(key).cast("long").alias("id"), quantised(vector, scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = rows.where("id IS NOT NULL AND v IS NOT NULL").groupBy("id", "v").agg(F.max("q").alias("q"))
    rows = cut(rows)  # read by three passes
    by_id = Window.partitionBy("v").orderBy("id")
    data = rows.withColumn("at", F.row_number().over(by_id)).where(F.col("at") <= keep).select("v", "id", F.col("at"))
    asked = rows.where("q").select("v", "id")
    distinct = asked.groupBy("v").agg(F.min("id").alias("qid"))
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dims")).first()
    n, dims = total["n"], total["dims"] or 0
    empty = spark.createDataFrame([], f"query_id bigint, rank int, `{key}` bigint, score bigint")
    if not n:
        return empty
    share = min(1.0, 1.2 * SAMPLE_VECTORS / n)
    some = rows.where(F.pmod(F.xxhash64("id", "v"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select("v").limit(SAMPLE_VECTORS).toArrow()
    sample = _matrix(some.column("v"), dims)
    p = choose_pivots(sample, pivots or int(min(MAX_PIVOTS, max(1, round(n**0.5 / 2)))))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, dist = _cells(_matrix(b.column("v"), dims), p)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(dist)], names=[*b.schema.names, "cell", "d"])

    placed = cut(data.mapInArrow(assign, "v array<int>, id bigint, at int, cell int, d double"))
    asking = cut(distinct.mapInArrow(assign, "v array<int>, qid bigint, cell int, d double"))

    # summaries: cells rows, (k + 1) x cells distances
    reach, norm, queries, load = np.full(len(p), np.nan), np.full(len(p), np.nan), np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    for r in asking.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("d"), F.max(length).alias("l")).collect():
        queries[r["cell"]], reach[r["cell"]], norm[r["cell"]] = r["n"], r["d"], r["l"]
    if not queries.sum():
        return empty
    for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect():
        load[r["cell"]] = r["n"]
    # by (distance, id): the smallest distances, of vectors as often as they have ids
    first = Window.partitionBy("cell").orderBy("d", "id")
    close = placed.select("cell", "d", "id").withColumn("r", F.row_number().over(first)).where(F.col("r") <= keep).select("cell", "d").collect()
    nearest = [np.array(sorted(r["d"] for r in close if r["cell"] == j)) for j in range(len(p))]
    need = bounds(p, reach, norm, nearest, keep)
    group = group_cells(p, queries, query_rows)
    groups = int(group.max()) + 1
    least = np.array([need[group == g].min(axis=0) for g in range(groups)])  # (groups, cells)
    held = np.array([queries[group == g].sum() for g in range(groups)])
    chunks = -(-held // query_rows)
    slices = np.maximum(1, -(-np.where(np.isfinite(least) | (least < 0), load[None, :], 0).sum(axis=1) // data_rows))
    plan = [(int(g), int(j), float(least[g, j]), int(chunks[g]), int(slices[g])) for g in range(groups) for j in range(len(p)) if least[g, j] < np.inf]
    wants = spark.createDataFrame(plan, "g int, cell int, least double, chunks int, slices int")  # at most cells x cells rows
    of_cell = spark.createDataFrame([(int(c), int(g), int(chunks[g]), int(slices[g])) for c, g in enumerate(group) if g >= 0],
                                    "cell int, g int, chunks int, slices int")
    span = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    sent = (placed.join(F.broadcast(wants), "cell").where(F.col("d") >= F.col("least"))
            .withColumn("s", F.pmod(F.xxhash64("v", "id"), F.col("slices")).cast("int")).withColumn("c", span("chunks")).select("g", "c", "s", "id", "v"))
    going = (asking.join(F.broadcast(of_cell), "cell").withColumn("c", F.pmod(F.xxhash64("qid"), F.col("chunks")).cast("int"))
             .withColumn("s", span("slices")).select("g", "c", "s", "qid", "v"))

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        qid, ids = left.column("qid").to_numpy(), right.column("id").to_numpy()
        names = ["qid", "id", "same", "score"]
        if not len(qid) or not len(ids):
            return pa.Table.from_arrays([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.bool_(), pa.int64())], names=names)
        q, x = _matrix(left.column("v"), dims), _matrix(right.column("v"), dims)
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]  # equal scores keep the smaller id first
        out = []
        for a in range(0, len(qid), 1024):
            best = np.empty((len(q[a : a + 1024]), 0), np.int64)
            at = best
            width = max(keep, BLOCK // 1024)
            for b in range(0, len(ids), width):
                s = _scores(q[a : a + 1024], x[b : b + width])
                best = np.concatenate([best, s], axis=1)
                at = np.concatenate([at, np.broadcast_to(np.arange(b, b + s.shape[1]), s.shape)], axis=1)
                if best.shape[1] > keep:
                    # the k + 1 best, and of those equal to the last of them the first ones
                    last = -np.partition(-best, keep - 1, axis=1)[:, keep - 1]
                    row, col = np.nonzero(best >= last[:, None])
                    o = np.lexsort((at[row, col], -best[row, col], row))
                    row, col = row[o], col[o]
                    nth = np.arange(len(row)) - np.searchsorted(row, row)
                    row, col = row[nth < keep], col[nth < keep]
                    best, at = best[row, col].reshape(-1, keep), at[row, col].reshape(-1, keep)
            same = (q[a : a + 1024, None, :] == x[at]).all(axis=2)
            out.append((np.repeat(qid[a : a + 1024], best.shape[1]), ids[at].ravel(), same.ravel(), best.ravel()))
        return pa.Table.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=names)

    found = (going.groupBy("g", "c", "s").cogroup(sent.groupBy("g", "c", "s")).applyInArrow(solve, "qid bigint, id bigint, same boolean, score bigint"))
    ranked = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc("id"))
    best = (found.withColumn("r", F.row_number().over(ranked)).where(F.col("r") <= keep)
            .groupBy("qid").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("neg"), F.col("id"), F.col("same")))).alias("best")))  # k + 1 of a query
    answers = distinct.join(best, "qid").select(F.col("v").alias("of"), "best")
    others = F.slice(F.filter("best", lambda b: (b["id"] != F.col("id")) | ~b["same"]), 1, k)
    got = asked.join(answers, F.col("v") == F.col("of")).select(F.col("id").alias("query_id"), F.posexplode(others).alias("at", "hit"))
    return got.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.id").alias(key), (-F.col("hit.neg")).alias("score"))

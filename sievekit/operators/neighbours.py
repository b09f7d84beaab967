"""Mutual information of numeric features with a class, by nearest neighbours.

The estimator for a continuous feature and a discrete target: with r the
distance from a value to its k-th neighbour of the same class (k at most the
class size less one) and m the number of values of any class nearer than r
(itself included),

    MI = psi(N) + mean psi(k) - mean psi(class size) - mean psi(m),  at least 0.

Where the k-th neighbour is at distance 0 (ties), k is the number of rows of
the class with that very value and m that of all rows, in place of the random
noise by which ties are otherwise broken; so the result is exact and
repeatable. Classes of one row and rows with a null value or class take no part.

All features go along one sorted axis. Equal values become one row with a
count. The k neighbours on either side come from a streaming pass over range
partitions, with the k border rows of the neighbouring partitions as context;
the counts within r are differences of running sums at x - r and x + r. No class,
feature or value is gathered in one task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..session import reliable_checkpoint
from .prefix import _same_as_before, running_sum, ship


def digamma(n: Column) -> Column:
    """psi of a positive whole number: the asymptotic series at n + 10."""
    x = n.cast("double") + 10.0
    series = F.log(x) - 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4) - 1 / (252 * x**6) + 1 / (240 * x**8)
    return series - sum((1 / (n + float(j)) for j in range(10)), F.lit(0.0))


def _plain(batch: pa.RecordBatch, names: list[str]) -> pa.Table:
    """The columns without schema details, so that tables can be joined."""
    return pa.table([batch.column(c) for c in names], names=names)


def kth_distances(points: DataFrame, groups: Sequence[str], value: str, count: str, k: str, most: int, out: str = "radius") -> DataFrame:
    """``points`` with ``out``: the distance to the ``k``-th nearest other row
    (column ``k``, at most ``most``) of the same group, on the line. Rows are
    distinct in (groups, value) and stand for ``count`` rows each."""
    spark, groups = points.sparkSession, list(groups)
    ship(spark)
    by = [*groups, value]
    p = int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = reliable_checkpoint(points.repartitionByRange(p, *by).sortWithinPartitions(*by))
    names = d.columns
    tagged = d.withColumn("__pid", F.spark_partition_id())
    border_names = [*groups, value, count]

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, tail = None, None
        for b in batches:
            if b.num_rows:
                t = _plain(b, ["__pid", *border_names])
                head = t.slice(0, most) if head is None else head if head.num_rows == most else pa.concat_tables([head, t]).slice(0, most)
                both = t if tail is None else pa.concat_tables([tail, t])
                tail = both.slice(max(0, both.num_rows - most))
        for last, t in ((False, head), (True, tail)):
            if t is not None:
                for b in t.combine_chunks().to_batches():
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.arange(b.num_rows), pa.int32()), pa.array([last] * b.num_rows)],
                                                     names=["__pid", *border_names, "at", "last"])

    schema = T.StructType([T.StructField("__pid", T.IntegerType()), *[points.schema[c] for c in border_names],
                           T.StructField("at", T.IntegerType()), T.StructField("last", T.BooleanType())])
    rows = tagged.mapInArrow(ends, schema).collect()  # 2 x most a partition
    order = sorted({r["__pid"] for r in rows})
    heads = {i: [tuple(r[c] for c in border_names) for r in sorted((r for r in rows if r["__pid"] == i and not r["last"]), key=lambda r: r["at"])] for i in order}
    tails = {i: [tuple(r[c] for c in border_names) for r in sorted((r for r in rows if r["__pid"] == i and r["last"]), key=lambda r: r["at"])] for i in order}
    before, after, held = {}, {}, []
    for i in order:
        before[i] = held
        held = (held + tails[i])[-most:]
    held = []
    for i in reversed(order):
        after[i] = held
        held = (heads[i] + held)[:most]
    types = [to_arrow_type(points.schema[c].dataType) for c in border_names]

    def context(some: list[tuple]) -> pa.Table:
        return pa.table([pa.array([r[j] for r in some], t) for j, t in enumerate(types)], names=border_names)

    def radii(t: pa.Table, a: int, b: int, wanted: np.ndarray) -> np.ndarray:
        """Of rows a to b of ``t``, which holds their neighbours too."""
        n = t.num_rows
        new = np.zeros(n, bool)
        for g in groups:
            new[1:] |= ~_same_as_before(pa.concat_arrays(t.column(g).chunks))
        of, x, c = np.cumsum(new), t.column(value).to_numpy().astype(float), t.column(count).to_numpy()
        i = np.arange(a, b)
        dist, weight = [np.zeros(b - a)], [c[a:b] - 1]
        for j in range(1, most + 1):
            for other in (i - j, i + j):
                at = np.clip(other, 0, n - 1)
                ok = (other >= 0) & (other < n) & (of[at] == of[i])
                dist.append(np.where(ok, np.abs(x[at] - x[i]), np.inf))
                weight.append(np.where(ok, c[at], 0))
        dist, weight = np.array(dist).T, np.array(weight).T
        by_distance = np.argsort(dist, axis=1, kind="stable")
        reached = np.cumsum(np.take_along_axis(weight, by_distance, 1), axis=1) >= wanted[:, None]
        return np.take_along_axis(dist, by_distance, 1)[np.arange(b - a), reached.argmax(axis=1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        past, held, pid = None, None, None  # rows already out, rows that wait for what follows

        def out(follow: pa.Table, upto: int) -> pa.RecordBatch:
            t = pa.concat_tables([past, held.select(border_names), follow])
            r = radii(t, past.num_rows, past.num_rows + upto, held.column(k).to_numpy()[:upto])
            columns = [pa.concat_arrays(held.column(c).slice(0, upto).chunks) for c in names]
            return pa.RecordBatch.from_arrays([*columns, pa.array(r)], names=[*names, out_name])

        for b in batches:
            if not b.num_rows:
                continue
            if past is None:
                pid = b.column("__pid")[0].as_py()
                past = context(before[pid])
            t = _plain(b, names)
            held = t if held is None else pa.concat_tables([held, t])
            ready = held.num_rows - most
            if ready > 0:
                yield out(held.slice(ready).select(border_names), ready)
                gone = pa.concat_tables([past, held.slice(0, ready).select(border_names)])
                past, held = gone.slice(max(0, gone.num_rows - most)), held.slice(ready)
        if held is not None and held.num_rows:
            yield out(context(after[pid]), held.num_rows)

    out_name = out
    return tagged.mapInArrow(run, T.StructType([*d.schema.fields, T.StructField(out, T.DoubleType())]))


def mutual_information_knn(df: DataFrame, features: Sequence[str], label: str, neighbours: int = 3) -> DataFrame:
    """(feature, mi) in nats, for every feature."""
    feats = list(features)
    long = df.where(F.col(label).isNotNull()).select(F.col(label).alias("y"), F.explode(F.array(*[
        F.struct(F.lit(i).alias("feature"), F.col(c).cast("double").alias("x")) for i, c in enumerate(feats)])).alias("kv")) \
        .select("y", "kv.feature", "kv.x").where(F.col("x").isNotNull() & ~F.isnan("x"))
    d = reliable_checkpoint(long.select("feature", "y", (F.col("x") + 0.0).alias("x")).groupBy("feature", "y", "x").agg(F.count(F.lit(1)).alias("c")))
    size = d.groupBy("feature", "y").agg(F.sum("c").alias("n_y")).where(F.col("n_y") > 1)
    d = d.join(size, ["feature", "y"]).withColumn("k", F.least(F.lit(neighbours).cast("long"), F.col("n_y") - 1))
    near = reliable_checkpoint(kth_distances(d, ["feature", "y"], "x", "c", "k", neighbours))
    # along the axis: a point's borders are marks without weight; of equal values, 0 comes before the data, 1 is data, 2 after
    tie = F.col("radius") == 0
    none = F.lit(0).cast("long")
    axis = near.select("feature", "y", "x", F.explode(F.array(
        F.struct((F.col("x") - F.col("radius")).alias("v"), F.when(tie, 0).otherwise(2).alias("side"), none.alias("c"), F.lit(-1).alias("sign")),
        F.struct(F.col("x").alias("v"), F.lit(1).alias("side"), F.col("c"), F.lit(0).alias("sign")),
        F.struct((F.col("x") + F.col("radius")).alias("v"), F.when(tie, 2).otherwise(0).alias("side"), none.alias("c"), F.lit(1).alias("sign")))).alias("m"))
    axis = running_sum(axis.select("feature", "y", "x", "m.*"), ["feature"], [F.col("v"), F.col("side")], ["c"])
    within = axis.where("sign != 0").groupBy("feature", "y", "x").agg(F.sum(F.col("sign") * F.col("cum_c")).alias("m"))
    p = near.join(within, ["feature", "y", "x"]).withColumn("k", F.when(tie, F.col("c")).otherwise(F.col("k")))
    total = F.sum("c")
    mean = lambda n: F.sum(F.col("c") * digamma(F.col(n))) / total
    mi = p.groupBy("feature").agg((digamma(total) + mean("k") - mean("n_y") - mean("m")).alias("mi"))
    names = F.array(*[F.lit(c) for c in feats])
    every = df.sparkSession.range(len(feats)).select(F.col("id").cast("int").alias("feature"))  # a feature without values has 0
    return every.join(mi, "feature", "left").select(names[F.col("feature")].alias("feature"), F.greatest(F.coalesce("mi", F.lit(0.0)), F.lit(0.0)).alias("mi"))

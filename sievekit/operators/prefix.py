"""Running sums and positions over a range-sorted table, with one shuffle.

The rows are range-partitioned on (groups, order), sorted within their
partitions and checkpointed; that is the only exchange. Everything after it
reads the partitions as they lie:

1. a streaming pass returns one row per partition: the keys of its first and
   of its last group, the sums of the last, and whether these are one group;
2. the driver folds these rows (as many as there are partitions) into what
   each partition's first group brings along from earlier ones: every other
   group of a partition begins in it, so it starts from zero;
3. a second streaming pass adds these to its own cumulative sums.

A group may spread over any number of partitions and a partition may hold any
number of groups; a task keeps one Arrow batch and one carried row. Sums of
whole numbers are exact. Nulls add nothing. Rows that are equal in groups and
order take their places in an arbitrary but fixed order.
"""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterator, Sequence
from threading import Lock

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import reliable_checkpoint

_SHIPPED: set[str] = set()
_SHIPPING = Lock()


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors, once per application, for
    Python tasks of a driver that was started from somewhere else. Fits of several
    folds come here at the same time: the first one ships, the others wait for it."""
    app = spark.sparkContext.applicationId
    with _SHIPPING:
        if app in _SHIPPED:
            return
        package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        archive = os.path.join(tempfile.mkdtemp(prefix="sievekit-src-"), "sievekit_operators.zip")
        with zipfile.ZipFile(archive, "w") as z:
            for folder, _, names in os.walk(package):
                for name in sorted(names):
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        z.write(path, os.path.relpath(path, os.path.dirname(package)))
        spark.sparkContext.addPyFile(archive)
        _SHIPPED.add(app)


def _same_as_before(column: pa.Array) -> np.ndarray:
    """For each row but the first: is it equal to the row before it (nulls
    are equal to nulls, NaN to NaN)?"""
    a, b = column[:-1], column[1:]
    same = pc.fill_null(pc.equal(a, b), False)
    same = pc.or_(same, pc.and_(pc.is_null(a, nan_is_null=True), pc.is_null(b, nan_is_null=True)))
    return same.to_numpy(zero_copy_only=False)


def _starts(batch: pa.RecordBatch, groups: list[str], last: tuple | None) -> tuple[np.ndarray, tuple]:
    """Which rows start another group than the row before, and the last key."""
    fresh = np.zeros(batch.num_rows, bool)
    for g in groups:
        fresh[1:] |= ~_same_as_before(batch.column(g))
    key = lambda i: tuple("nan" if isinstance(v := batch.column(g)[i].as_py(), float) and v != v else v for g in groups)
    fresh[0] = last is None or key(0) != last
    return fresh, key(batch.num_rows - 1)


def _numbers(batch: pa.RecordBatch, col: str, kind) -> np.ndarray:
    return pc.fill_null(batch.column(col), 0).to_numpy(zero_copy_only=False).astype(kind)


def running_sum(df: DataFrame, groups: Sequence[str], order: Sequence[Column], cols: Sequence[str],
                partitions: int | None = None) -> DataFrame:
    """``df`` with ``cum_<c>`` for each of ``cols``: the sum of ``c`` over the
    rows of the same group up to and including the row, in ``order``. Whole
    numbers give bigint, others double."""
    groups, cols = list(groups), list(cols)
    ship(df.sparkSession)
    p = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*[F.col(g).asc() for g in groups], *order]
    d = reliable_checkpoint(df.repartitionByRange(p, *by).sortWithinPartitions(*by))
    whole = {c: isinstance(df.schema[c].dataType, (T.IntegerType, T.LongType, T.ShortType, T.ByteType)) for c in cols}
    kinds = [np.int64 if whole[c] else np.float64 for c in cols]
    pid = "__pid"
    tagged = d.withColumn(pid, F.spark_partition_id())

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, first_key, at, n_groups = None, None, None, 0
        tail = [k(0) for k in kinds]
        for b in batches:
            if not b.num_rows:
                continue
            at = b.column(pid)[0].as_py()
            new, key = _starts(b, groups, last)
            where = np.flatnonzero(new)
            for j, c in enumerate(cols):
                v = _numbers(b, c, kinds[j])
                tail[j] = v[where[-1] :].sum() if len(where) else tail[j] + v.sum()
            if first_key is None:
                first_key = tuple(b.column(g)[0].as_py() for g in groups)
            n_groups += len(where)
            last = key
        if at is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([at], pa.int32()), pa.array([n_groups == 1]),
                 *[pa.array([t]) for t in tail],
                 *[pa.array([first_key[i]], d_types[i]) for i in range(len(groups))],
                 *[pa.array([_plain(last[i])], d_types[i]) for i in range(len(groups))]],
                names=end_names)

    def _plain(v):
        return float("nan") if v == "nan" and not isinstance(v, float) else v

    from pyspark.sql.pandas.types import to_arrow_type

    d_types = [to_arrow_type(df.schema[g].dataType) for g in groups]
    sums = ["bigint" if whole[c] else "double" for c in cols]
    end_fields = [T.StructField(pid, T.IntegerType()), T.StructField("one", T.BooleanType()),
                  *[T.StructField(f"tail{j}", T.LongType() if whole[c] else T.DoubleType()) for j, c in enumerate(cols)],
                  *[T.StructField(f"a{i}", df.schema[g].dataType) for i, g in enumerate(groups)],
                  *[T.StructField(f"z{i}", df.schema[g].dataType) for i, g in enumerate(groups)]]
    end_names = [f.name for f in end_fields]
    borders = sorted(tagged.mapInArrow(ends, T.StructType(end_fields)).collect(), key=lambda r: r[pid])  # a row per partition
    brings: dict[int, tuple] = {}
    key, carried = None, [0] * len(cols)
    plain = lambda v: "nan" if isinstance(v, float) and v != v else v
    for r in borders:
        first = tuple(plain(r[f"a{i}"]) for i in range(len(groups)))
        same = key is not None and first == key
        brings[r[pid]] = tuple(carried) if same else tuple([0] * len(cols))
        carried = [(carried[j] if same and r["one"] else 0) + r[f"tail{j}"] for j in range(len(cols))]
        key = tuple(plain(r[f"z{i}"]) for i in range(len(groups)))
    names = [*d.columns, *[f"cum_{c}" for c in cols]]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, run = None, None
        for b in batches:
            if not b.num_rows:
                continue
            new, key = _starts(b, groups, last)
            if last is None:
                run = list(brings[b.column(pid)[0].as_py()])
                new[0] = False  # the first group goes on with what the partition brings along
            where = np.flatnonzero(new)
            which = np.cumsum(new)
            out = []
            for j, c in enumerate(cols):
                v = _numbers(b, c, kinds[j])
                cum = np.cumsum(v)
                base = np.concatenate([np.array([-run[j]], kinds[j]), (cum[where] - v[where])])
                got = cum - base[which]
                out.append(pa.array(got))
                run[j] = got[-1]
            last = key
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names[: len(names) - len(cols)]], *out], names=names)

    schema = T.StructType([*d.schema.fields, *[T.StructField(f"cum_{c}", T._parse_datatype_string(k)) for c, k in zip(cols, sums)]])
    return tagged.mapInArrow(add, schema)


def positions(df: DataFrame, groups: Sequence[str], order: Sequence[Column], out: str = "position",
              partitions: int | None = None) -> DataFrame:
    """``df`` with ``out``: the row's place (from 0) within its group, in
    ``order``, for groups of any size."""
    one = "__one"
    counted = running_sum(df.withColumn(one, F.lit(1).cast("long")), groups, order, [one], partitions)
    return counted.withColumn(out, F.col(f"cum_{one}") - 1).drop(one, f"cum_{one}")

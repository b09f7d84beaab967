"""Multilayer perceptron (T7): rectified units, softmax, Adam on minibatches.

Rows are dealt to shards of about ``shardRows`` by hash and each shard is packed
into one row of a checkpointed table. A round is one job: every shard goes on from
the shared state (weights and Adam's two moments) for ``roundEpochs`` epochs of
minibatches, and the states are averaged by their numbers of rows (local SGD with
averaging). With one shard this is plain minibatch Adam.

Tasks add their shards' states as whole numbers (2**-52 units of the weighted
mean), so the sum doesn't depend on its order; shards are sorted inside and shuffled
from (seed, epoch, shard). The result is the same for any partitioning. Sums go
through about sqrt(tasks) groups, so the driver gets that many states, not one per
shard or task.

Equal rows are counted first and numbered, so copies of one row spread over the
shards like any others. Null features and NaN count as 0; rows without a label
aren't learned from; an empty table raises. Training ends after ``maxIter`` epochs,
or once the mean loss hasn't improved by ``tol`` for ten epochs, at the end of a round.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasMaxIter, HasSeed, HasTol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import reliable_checkpoint
from .prefix import ship

RATE, BETA1, BETA2, EPS = 1e-3, 0.9, 0.999, 1e-8
PATIENCE = 10
_UNIT = float(1 << 52)
#: a weight beyond this would leave the range of the whole-number sums
_LARGEST = 512.0


def unpack(flat: np.ndarray, layers: Sequence[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Views of (weights, biases) per layer in the flat parameter vector."""
    out, at = [], 0
    for a, b in zip(layers, layers[1:]):
        out.append((flat[at : at + a * b].reshape(a, b), flat[at + a * b : at + a * b + b]))
        at += a * b + b
    return out


def n_weights(layers: Sequence[int]) -> int:
    return sum(a * b + b for a, b in zip(layers, layers[1:]))


def start(layers: Sequence[int], seed: int) -> np.ndarray:
    """Uniform weights and biases within sqrt(6 / (inputs + outputs))."""
    rng = np.random.default_rng(seed)
    parts = []
    for a, b in zip(layers, layers[1:]):
        bound = math.sqrt(6.0 / (a + b))
        parts += [rng.uniform(-bound, bound, a * b), rng.uniform(-bound, bound, b)]
    return np.concatenate(parts)


def forward(flat: np.ndarray, layers: Sequence[int], x: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Inputs of every layer, and class probabilities."""
    seen = [x]
    pairs = unpack(flat, layers)
    for w, b in pairs[:-1]:
        seen.append(np.maximum(seen[-1] @ w + b, 0.0))
    z = seen[-1] @ pairs[-1][0] + pairs[-1][1]
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return seen, z / z.sum(axis=1, keepdims=True)


class _Work:
    """Arrays that every minibatch of up to ``rows`` rows writes into."""

    def __init__(self, layers: Sequence[int], rows: int):
        self.out = [np.empty((rows, b)) for b in layers[1:]]
        self.back = [np.empty((rows, b)) for b in layers[1:-1]]
        self.on = [np.empty((rows, b), bool) for b in layers[1:-1]]
        self.weights = [np.empty((a, b)) for a, b in zip(layers, layers[1:])]


def loss_and_gradient(flat: np.ndarray, layers: Sequence[int], x: np.ndarray, y: np.ndarray, alpha: float) -> tuple[float, np.ndarray]:
    """Mean cross-entropy plus ``alpha / 2`` times the squared weights (not
    the biases) by the number of rows."""
    grad = np.empty_like(flat)
    return _step(unpack(flat, layers), unpack(grad, layers), _Work(layers, len(x)), x, y, alpha), grad


def _step(pairs: list[tuple[np.ndarray, np.ndarray]], into: list[tuple[np.ndarray, np.ndarray]], work: _Work, x: np.ndarray, y: np.ndarray,
          alpha: float) -> float:
    """``loss_and_gradient`` on views of the weights and of the gradient."""
    n, last, rows = len(x), len(pairs) - 1, np.arange(len(x))
    seen = [x]
    for k, (w, b) in enumerate(pairs):
        z = np.matmul(seen[-1], w, out=work.out[k][:n])
        z += b
        seen.append(np.maximum(z, 0.0, out=z) if k < last else z)
    d = seen.pop()
    d -= d.max(axis=1, keepdims=True)
    np.exp(d, out=d)
    d /= d.sum(axis=1, keepdims=True)
    loss = -np.log(np.maximum(d[rows, y], 1e-300)).mean()
    d[rows, y] -= 1.0
    d /= n
    for k in range(last, -1, -1):
        w, square = pairs[k][0], work.weights[k]
        loss += 0.5 * alpha * float(np.multiply(w, w, out=square).sum()) / n
        np.matmul(seen[k].T, d, out=into[k][0])
        into[k][0][:] += np.multiply(w, alpha / n, out=square)
        d.sum(axis=0, out=into[k][1])
        if k:
            on = np.greater(seen[k], 0, out=work.on[k - 1][:n])
            d = np.matmul(d, w.T, out=work.back[k - 1][:n])
            d *= on
    return float(loss)


def train_epochs(state: np.ndarray, t: int, layers: Sequence[int], x: np.ndarray, y: np.ndarray, epochs: Sequence[int],
                 seed: int, shard: int, batch: int, alpha: float) -> tuple[np.ndarray, list[float]]:
    """Go on from ``state`` (weights, first and second moments in a row) over
    the given epochs; the new state and the mean loss of each epoch."""
    size = n_weights(layers)
    flat, m, v = (state[k * size : (k + 1) * size].copy() for k in range(3))
    g, by, root = (np.empty(size) for _ in range(3))
    pairs, into, work = unpack(flat, layers), unpack(g, layers), _Work(layers, min(batch, len(x)))
    losses = []
    for epoch in epochs:
        order = np.random.default_rng([seed, epoch, shard]).permutation(len(x))
        xs, ys = x[order], y[order]
        total = 0.0
        for a in range(0, len(x), batch):
            some = ys[a : a + batch]
            total += _step(pairs, into, work, xs[a : a + batch], some, alpha) * len(some)
            t += 1
            np.subtract(g, m, out=by)
            by *= 1 - BETA1
            m += by
            np.multiply(g, g, out=by)
            by -= v
            by *= 1 - BETA2
            v += by
            np.multiply(m, RATE * math.sqrt(1 - BETA2**t) / (1 - BETA1**t), out=by)
            np.sqrt(v, out=root)
            root += EPS
            by /= root
            flat -= by
        losses.append(total / len(x))
    return np.concatenate([flat, m, v]), losses


def shards_of(df: DataFrame, features: str, label: str, shard_rows: int, seed: int) -> tuple[DataFrame, int, int]:
    """One row per shard (shard, n, x, y as bytes), the rows and the shards."""
    zero = F.lit(0.0)
    xs = F.transform(vector_to_array(features), lambda v: F.coalesce(F.nanvl(v, zero), zero) + zero)
    equal = reliable_checkpoint(df.where(F.col(label).isNotNull()).groupBy(xs.alias("x"), F.col(label).cast("int").alias("y")).agg(F.count(F.lit(1)).alias("c")))
    n = equal.agg(F.sum("c")).first()[0]
    if not n:
        raise ValueError("no labelled row to learn from")
    count = -(-n // shard_rows)
    rows = equal.select("x", "y", F.explode(F.sequence(F.lit(1).cast("long"), F.col("c"))).alias("nth"))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "x", "y", "nth"), F.lit(count)))

    def pack(table: pa.Table) -> pa.Table:
        x = table.column("x").combine_chunks()
        x = x.flatten().to_numpy().reshape(table.num_rows, -1)
        y = table.column("y").to_numpy().astype(np.int64)
        order = np.lexsort((y, *x.T[::-1]))
        return pa.table({"shard": pa.array([table.column("shard")[0].as_py()], pa.int64()), "n": pa.array([len(y)], pa.int64()),
                         "x": pa.array([x[order].tobytes()], pa.binary()), "y": pa.array([y[order].tobytes()], pa.binary())})

    packed = rows.groupBy("shard").applyInArrow(pack, "shard bigint, n bigint, x binary, y binary")
    return reliable_checkpoint(packed), n, count


def dealt(shards: DataFrame, tasks: int) -> DataFrame:
    """The shards in ``tasks`` partitions. Their numbers are dense, so by range every
    task gets about as many as the next; by hash the fullest would hold up every round."""
    return shards.repartitionByRange(tasks, "shard")


def _add(rows: Iterator[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray] | None:
    """Sum of whole-number states, and of the steps' numbers taken the largest."""
    total = steps = None
    for blob, step in rows:
        got = np.frombuffer(blob, np.int64)
        total = got.copy() if total is None else total + got
        steps = step if steps is None else max(steps, step)
    return None if total is None else (total, steps)


def one_round(shards: DataFrame, n_rows: int, groups: int, state: np.ndarray, t: int, layers: Sequence[int], epochs: Sequence[int],
              seed: int, batch: int, alpha: float) -> tuple[np.ndarray, list[float], int]:
    """The averaged state after ``epochs``, their mean losses and the steps."""
    layers, epochs = list(layers), list(epochs)
    width = layers[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def trained():
            for b in batches:
                for shard, n, x, y in zip(*(c.to_pylist() for c in b.columns)):
                    new, losses = train_epochs(state, t, layers, np.frombuffer(x).reshape(-1, width), np.frombuffer(y, np.int64), epochs, seed, shard, batch, alpha)
                    own = np.concatenate([new, losses])
                    if not np.abs(own).max() < _LARGEST:
                        raise ValueError("training diverged; scale the features")
                    yield np.rint(own * (n / n_rows * _UNIT)).astype(np.int64).tobytes(), len(epochs) * -(-n // batch)

        from pyspark import TaskContext

        got = _add(trained())
        if got is not None:
            at = TaskContext.get().partitionId() % groups
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([got[0].tobytes()], pa.binary()), pa.array([got[1]], pa.int64())], names=["at", "state", "steps"])

    def merge(table: pa.Table) -> pa.Table:
        total, steps = _add(zip(table.column("state").to_pylist(), table.column("steps").to_pylist()))
        return pa.table({"at": table.column("at")[:1], "state": pa.array([total.tobytes()], pa.binary()), "steps": pa.array([steps], pa.int64())})

    kind = "at bigint, state binary, steps bigint"
    sums = shards.mapInArrow(run, kind)
    if groups > 1:
        sums = sums.groupBy("at").applyInArrow(merge, kind)
    total, steps = _add((r["state"], r["steps"]) for r in sums.collect())  # about sqrt(tasks) rows
    mean = total / _UNIT
    return mean[: len(state)], mean[len(state) :].tolist(), t + steps


class _Layers(HasFeaturesCol, HasLabelCol):
    layers = Param(Params._dummy(), "layers", "units per layer, inputs and classes included", typeConverter=TypeConverters.toListInt)

    def getLayers(self) -> list[int]:  # noqa: N802 - the name MLlib uses
        return self.getOrDefault("layers")


class AdamPerceptron(Estimator, _Layers, HasMaxIter, HasTol, HasSeed, DefaultParamsReadable, DefaultParamsWritable):
    """Labels are the codes 0 .. classes - 1."""

    alpha = Param(Params._dummy(), "alpha", "weight of the squared weights", typeConverter=TypeConverters.toFloat)
    batchSize = Param(Params._dummy(), "batchSize", "rows of a minibatch", typeConverter=TypeConverters.toInt)
    shardRows = Param(Params._dummy(), "shardRows", "rows of a shard, about", typeConverter=TypeConverters.toInt)
    roundEpochs = Param(Params._dummy(), "roundEpochs", "epochs between averages", typeConverter=TypeConverters.toInt)

    @keyword_only
    def __init__(self, layers=None, maxIter=300, tol=1e-4, seed=42, alpha=1e-4, batchSize=200, shardRows=8192, roundEpochs=5, featuresCol="features", labelCol="label"):
        super().__init__()
        self._setDefault(maxIter=300, tol=1e-4, seed=42, alpha=1e-4, batchSize=200, shardRows=8192, roundEpochs=5)
        self._set(**self._input_kwargs)

    def setLayers(self, layers: Sequence[int]) -> AdamPerceptron:  # noqa: N802
        return self._set(layers=list(layers))

    def setFeaturesCol(self, name: str) -> AdamPerceptron:  # noqa: N802
        return self._set(featuresCol=name)

    def setLabelCol(self, name: str) -> AdamPerceptron:  # noqa: N802
        return self._set(labelCol=name)

    def _fit(self, dataset: DataFrame) -> AdamPerceptronModel:
        ship(dataset.sparkSession)
        of = self.getOrDefault
        layers, seed, most, step = self.getLayers(), of("seed"), of("maxIter"), of("roundEpochs")
        shards, n, count = shards_of(dataset, of("featuresCol"), of("labelCol"), of("shardRows"), seed)
        tasks = min(count, 2 * dataset.sparkSession.sparkContext.defaultParallelism)
        shards = reliable_checkpoint(dealt(shards, tasks)) if count > 1 else shards.coalesce(1)
        groups = math.isqrt(tasks)
        flat = start(layers, seed)
        state, t, curve = np.concatenate([flat, np.zeros(2 * len(flat))]), 0, []
        best, stale = math.inf, 0
        while len(curve) < most and stale <= PATIENCE:
            epochs = range(len(curve), min(most, len(curve) + step))
            state, losses, t = one_round(shards, n, groups, state, t, layers, epochs, seed, of("batchSize"), of("alpha"))
            for loss in losses:
                stale = stale + 1 if loss > best - of("tol") else 0
                best = min(best, loss)
            curve += losses
        return self._copyValues(AdamPerceptronModel(layers=layers, weights=state[: len(flat)].tolist(), lossCurve=curve))


class AdamPerceptronModel(Model, _Layers, DefaultParamsReadable, DefaultParamsWritable):
    """Adds ``probability`` and ``rawPrediction`` (vectors) and ``prediction``."""

    weights = Param(Params._dummy(), "weights", "all weights and biases", typeConverter=TypeConverters.toListFloat)
    lossCurve = Param(Params._dummy(), "lossCurve", "mean loss of each epoch", typeConverter=TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, layers=None, weights=None, lossCurve=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        ship(dataset.sparkSession)
        layers, flat = self.getLayers(), np.array(self.getOrDefault("weights"))

        @F.pandas_udf("array<double>")
        def probabilities(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=object)
            return pd.Series(list(forward(flat, layers, np.nan_to_num(np.stack(x.to_numpy()).astype(float), posinf=np.inf, neginf=-np.inf))[1]))

        zero = F.lit(0.0)
        xs = F.transform(vector_to_array(self.getOrDefault("featuresCol")), lambda v: F.coalesce(F.nanvl(v, zero), zero))
        out = dataset.withColumn("__p", probabilities(xs))
        best = (F.array_position("__p", F.array_max("__p")) - 1).cast("double")
        raw = F.transform("__p", lambda p: F.log(F.greatest(p, F.lit(1e-300))))
        return out.withColumns({"probability": array_to_vector("__p"), "rawPrediction": array_to_vector(raw), "prediction": best}).drop("__p")

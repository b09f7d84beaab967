"""Landmark features for the RBF kernel (T5).

``LandmarkKernel`` keeps a bounded sample of distinct rows, the landmarks, and maps a
row to coordinates whose inner products are those of the kernel's projection onto the
landmarks' span (Williams and Seeger 2001). A linear machine on these columns is the
kernel machine restricted to that span; where all distinct rows are landmarks it is
the exact one. The squared length a row loses, ``1 - |phi|^2``, bounds the error: a
decision of norm w moves by at most ``|w| * sqrt(residual)``, so a row whose margin is
larger is certain (``margin_gap``).

The landmarks are the ``landmarks`` rows of smallest seeded hash among all distinct
ones: a stated bound of the sample, the same for any partitioning. Everything else
reads all rows: one projection per row, in Arrow batches, without a shuffle. Null
features and NaN count as 0; an empty table raises.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCol, HasSeed
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .prefix import ship

#: directions whose share of the largest one is less are left out
LEAST_SHARE = 1e-10


def _inputs(cols: Sequence[str]) -> Column:
    zero = F.lit(0.0)
    return F.array(*[F.coalesce(F.nanvl(F.col(c).cast("double"), zero), zero) + zero for c in cols])


def rbf(x: np.ndarray, y: np.ndarray, gamma: float) -> np.ndarray:
    square = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1) - 2 * x @ y.T
    return np.exp(-gamma * np.maximum(square, 0.0))


class _Kernel(HasInputCols, HasOutputCol):
    gamma = Param(Params._dummy(), "gamma", "kernel width", typeConverter=TypeConverters.toFloat)


class LandmarkKernel(Estimator, _Kernel, HasSeed, DefaultParamsReadable, DefaultParamsWritable):
    landmarks = Param(Params._dummy(), "landmarks", "most rows kept", typeConverter=TypeConverters.toInt)

    @keyword_only
    def __init__(self, inputCols=None, outputCol="features", gamma=0.1, landmarks=128, seed=42):
        super().__init__()
        self._setDefault(outputCol="features", gamma=0.1, landmarks=128, seed=42)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> LandmarkKernelModel:
        x = dataset.select(_inputs(self.getInputCols()).alias("x")).distinct()
        kept = x.orderBy(F.xxhash64(F.lit(self.getOrDefault("seed")), "x"), "x").limit(self.getOrDefault("landmarks")).collect()
        if not kept:
            raise ValueError("no row to learn from")
        marks = np.array([r["x"] for r in kept])
        value, vector = np.linalg.eigh(rbf(marks, marks, self.getOrDefault("gamma")))
        used = value > LEAST_SHARE * value[-1]
        root = vector[:, used] / np.sqrt(value[used])
        return self._copyValues(LandmarkKernelModel(marks=marks.ravel().tolist(), root=root.ravel().tolist()))


class LandmarkKernelModel(Model, _Kernel, DefaultParamsReadable, DefaultParamsWritable):
    marks = Param(Params._dummy(), "marks", "landmarks, row by row", typeConverter=TypeConverters.toListFloat)
    root = Param(Params._dummy(), "root", "inverse root of their kernel, row by row", typeConverter=TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, marks=None, root=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def coordinates(self) -> Column:
        """The row's coordinates as an array column."""
        width, gamma = len(self.getInputCols()), self.getOrDefault("gamma")
        marks = np.array(self.getOrDefault("marks")).reshape(-1, width)
        root = np.array(self.getOrDefault("root")).reshape(len(marks), -1)

        @F.arrow_udf("array<double>")
        def phi(x: pa.Array) -> pa.Array:
            out = rbf(x.flatten().to_numpy().reshape(len(x), width), marks, gamma) @ root
            ends = np.arange(len(x) + 1, dtype=np.int32) * out.shape[1]
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(out.ravel()))

        return phi(_inputs(self.getInputCols()))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        ship(dataset.sparkSession)
        return dataset.withColumn(self.getOrDefault("outputCol"), array_to_vector(self.coordinates()))


def margin_gap(df: DataFrame, kernel: LandmarkKernelModel, weights: Sequence[float], intercept: float) -> DataFrame:
    """``df`` with ``margin`` (the decision), ``gap`` (how far the kernel's part that
    the landmarks don't span can move a decision of this norm) and ``certain``."""
    ship(df.sparkSession)
    w = F.array(*[F.lit(float(v)) for v in weights])
    norm = float(np.linalg.norm(weights))
    phi = F.col("__phi")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    out = df.withColumn("__phi", kernel.coordinates())
    out = out.withColumns({"margin": dot(phi, w) + float(intercept), "gap": norm * F.sqrt(F.greatest(F.lit(0.0), 1 - dot(phi, phi)))})
    return out.withColumn("certain", F.abs("margin") > F.col("gap")).drop("__phi")

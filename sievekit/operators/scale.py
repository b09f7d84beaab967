"""Feature scaling (E5-E10) with explicit, reusable fitted state.

``fit_scaler`` runs one aggregate pass (exact quantiles for ``robust``) and
returns a small ``ScalerState`` (a few numbers per column); ``transform``
applies it as literal arithmetic inside whole-stage codegen, so scoring new
rows never re-reads the training data. The state round-trips through a
one-row-per-column DataFrame for persistence.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cleaning import numeric_columns
from .quantiles import quantile_map

METHODS = ("minmax", "standard", "robust", "maxabs", "unit_vector")


@dataclass
class ScalerState:
    method: str
    columns: list[str]
    center: dict[str, float]
    scale: dict[str, float]

    def to_df(self, spark: SparkSession) -> DataFrame:
        rows = [(self.method, c, float(self.center.get(c, 0.0)), float(self.scale.get(c, 1.0))) for c in self.columns]
        return spark.createDataFrame(rows, "method string, column string, center double, scale double")

    @staticmethod
    def from_df(df: DataFrame) -> "ScalerState":
        rows = df.collect()
        if not rows:
            raise ValueError("empty scaler state")
        return ScalerState(rows[0]["method"], [r["column"] for r in rows],
                           {r["column"]: r["center"] for r in rows}, {r["column"]: r["scale"] for r in rows})


def _nz(x: float | None) -> float:
    """Zero (or missing) scale -> 1, as scikit-learn's scalers do."""
    return 1.0 if x is None or x == 0.0 else float(x)


def fit_scaler(df: DataFrame, method: str = "standard", columns: Sequence[str] | None = None) -> ScalerState:
    if method not in METHODS:
        raise ValueError(f"Unknown scaling method '{method}'. Choose from {list(METHODS)}")
    cols = numeric_columns(df) if columns is None else list(columns)
    if method == "unit_vector":
        return ScalerState(method, cols, {}, {})
    if method == "robust":
        q = quantile_map(df, cols, [0.25, 0.5, 0.75])
        return ScalerState(method, cols, {c: q[c].get(0.5, 0.0) for c in cols},
                           {c: _nz((q[c].get(0.75) or 0.0) - (q[c].get(0.25) or 0.0)) for c in cols})
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        if method == "standard":
            aggs += [F.avg(x).alias(f"{c}__a"), F.stddev_pop(x).alias(f"{c}__b")]
        elif method == "minmax":
            aggs += [F.min(x).alias(f"{c}__a"), F.max(x).alias(f"{c}__b")]
        else:  # maxabs
            aggs += [F.max(F.abs(x)).alias(f"{c}__b")]
    row = df.agg(*aggs).collect()[0]
    if method == "standard":
        return ScalerState(method, cols, {c: row[f"{c}__a"] for c in cols}, {c: _nz(row[f"{c}__b"]) for c in cols})
    if method == "minmax":
        return ScalerState(method, cols, {c: row[f"{c}__a"] for c in cols},
                           {c: _nz((row[f"{c}__b"] or 0.0) - (row[f"{c}__a"] or 0.0)) for c in cols})
    return ScalerState(method, cols, {c: 0.0 for c in cols}, {c: _nz(row[f"{c}__b"]) for c in cols})


def transform(df: DataFrame, state: ScalerState) -> DataFrame:
    """Apply fitted state; columns are replaced by DOUBLE scaled values."""
    if state.method == "unit_vector":
        sq = sum((F.col(c).cast("double") * F.col(c).cast("double") for c in state.columns), F.lit(0.0))
        norm = F.sqrt(sq)
        div = F.when(norm == 0, F.lit(1.0)).otherwise(norm)
        return df.withColumns({c: F.col(c).cast("double") / div for c in state.columns})
    return df.withColumns({
        c: (F.col(c).cast("double") - F.lit(float(state.center.get(c) or 0.0))) / F.lit(float(state.scale[c]))
        for c in state.columns})


def scale_features(df: DataFrame, method: str = "standard",
                   columns: Sequence[str] | None = None) -> tuple[DataFrame, ScalerState]:
    """Fit + transform in one call, returning the reusable state."""
    state = fit_scaler(df, method, columns)
    return transform(df, state), state

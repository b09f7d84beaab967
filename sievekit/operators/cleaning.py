"""Profiling and cleaning of labelled payload tables.

Parameter statistics (null counts, medians, modes, distinct ratios) are
computed with one aggregation pass per kind over all columns at once and
come back to the driver as small, bounded results (one value per column).
The cleaned table itself stays a lazy plan.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip_py
from ..session import reliable_checkpoint
from .quantiles import exact_quantiles, unpivot_numeric

NUMERIC_TYPES = (T.DoubleType, T.FloatType, T.LongType, T.IntegerType, T.ShortType, T.ByteType, T.DecimalType)
# fixed values: columns that the cleaning rules never drop
PROTECTED_BASE = ("Label", "text_label", "label")
PROTECTED_DEMO = ("label",)


# --------------------------------------------------------------------- C10
def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC_TYPES)]


def categorical_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BooleanType))]


# --------------------------------------------------------------------- C1
def drop_duplicates(df: DataFrame) -> DataFrame:
    """Exact duplicate rows removed (nulls compare equal)."""
    return df.dropDuplicates()


def duplicate_report(df: DataFrame) -> DataFrame:
    """C1 report in one pass: rows before, distinct rows, duplicates removed."""
    g = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("__n"))
    return g.agg(
        F.sum("__n").cast("bigint").alias("rows_before"),
        F.count(F.lit(1)).cast("bigint").alias("rows_after"),
        (F.sum("__n") - F.count(F.lit(1))).cast("bigint").alias("duplicates_removed"),
    )


# --------------------------------------------------------------------- C2
def null_profile(df: DataFrame, nonzero_only: bool = False) -> DataFrame:
    """(column, n_null) for every column, from a single aggregate."""
    counts = df.agg(*[
        F.sum(F.when(F.col(c).isNull(), 1).otherwise(0)).cast("bigint").alias(c) for c in df.columns
    ])
    long = counts.unpivot([], df.columns, "column", "n_null")
    return long.where(F.col("n_null") > 0) if nonzero_only else long


def null_counts(df: DataFrame) -> dict[str, int]:
    row = df.agg(*[F.sum(F.when(F.col(c).isNull(), 1).otherwise(0)).alias(c) for c in df.columns]).collect()[0]
    return {c: int(row[c] or 0) for c in df.columns}


# --------------------------------------------------------------------- C3 / C4
def column_medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Exact interpolated median per column (distributed; see quantiles)."""
    if not columns:
        return {}
    q = exact_quantiles(unpivot_numeric(df, columns), "value", [0.5], groups=["column"]).collect()
    return {r["column"]: r["q"] for r in q}


def column_modes(df: DataFrame, columns: Sequence[str]) -> dict[str, object]:
    """C4: most frequent non-null value per column; ties -> smallest value
    (pandas ``mode().iloc[0]``). One shuffle of (column, value) counts with
    map-side combine; ``min_by`` keeps a bounded buffer per column."""
    if not columns:
        return {}
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns
    ])).alias("kv")).select("kv.column", "kv.value").where(F.col("value").isNotNull())
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("column").agg(F.min_by("value", F.struct((-F.col("n")).alias("neg"), F.col("value"))).alias("mode"))
    types = dict(df.dtypes)
    out = {}
    for r in best.collect():
        out[r["column"]] = r["mode"]
    # cast back to the column's type on the driver (values are few)
    return {c: _cast_py(out[c], types[c]) for c in out}


def _cast_py(v, dtype: str):
    if v is None:
        return None
    if dtype in ("bigint", "int", "smallint", "tinyint"):
        return int(v)
    if dtype in ("double", "float") or dtype.startswith("decimal"):
        return float(v)
    if dtype == "boolean":
        return v == "true"
    return v


def impute(df: DataFrame, medians: dict[str, float], modes: dict[str, object]) -> DataFrame:
    """Fill nulls: numeric columns with their median (integer columns become
    DOUBLE, as a pandas int column holding NaN is float64), others with their mode."""
    cols = {}
    for c, m in medians.items():
        if m is not None:
            cols[c] = F.coalesce(F.col(c).cast("double"), F.lit(float(m)))
    for c, m in modes.items():
        if m is not None:
            cols[c] = F.coalesce(F.col(c), F.lit(m).cast(dict(df.dtypes)[c]))
    return df.withColumns(cols) if cols else df


# --------------------------------------------------------------------- C5
def strip_strings(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Python-style strip of every string column."""
    columns = string_columns(df) if columns is None else list(columns)
    return df.withColumns({c: strip_py(c) for c in columns}) if columns else df


# --------------------------------------------------------------------- C6 / C7
def distinct_ratios(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """C6 ratio table: (column, n_distinct, n_rows, ratio), exact counts. Values
    travel as 256-bit digests, after map-side removal of repeats, in one
    shuffle for all columns."""
    columns = list(df.columns if columns is None else columns)
    n_rows = df.count()
    exact = {}
    if columns:
        long = df.select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("column"), F.sha2(F.col(c).cast("string"), 256).alias("value")) for c in columns
        ])).alias("kv")).select("kv.column", "kv.value").where(F.col("value").isNotNull())
        for r in long.distinct().groupBy("column").count().collect():
            exact[r["column"]] = int(r["count"])
    rows = [(c, exact.get(c, 0), n_rows, exact.get(c, 0) / n_rows if n_rows else 0.0) for c in columns]
    return df.sparkSession.createDataFrame(rows, "column string, n_distinct bigint, n_rows bigint, ratio double")


def _below_ratio(df: DataFrame, threshold: float) -> list[str]:
    """Columns with fewer than ``threshold`` distinct values per row. A
    HyperLogLog pass rules out columns far above it (5 sigma of its error);
    the others are counted exactly, so the answer is exact."""
    approx = df.agg(F.count(F.lit(1)).alias("__rows"),
                    *[F.approx_count_distinct(c, 0.05).alias(c) for c in df.columns]).collect()[0]
    near = [c for c in df.columns if approx[c] <= threshold * approx["__rows"] * 1.25 + 1]
    return [r["column"] for r in distinct_ratios(df, near).collect() if r["ratio"] < threshold] if near else []


def _at_most_one_value(df: DataFrame) -> list[str]:
    """Columns whose smallest and largest value agree: one pass, no shuffle of values."""
    r = df.agg(*[(F.min(F.col(c).cast("string")).eqNullSafe(F.max(F.col(c).cast("string")))).alias(c)
                 for c in df.columns]).collect()[0]
    return [c for c in df.columns if r[c]]


def near_constant_columns(df: DataFrame, threshold: float = 0.001, protect: Sequence[str] = PROTECTED_BASE,
                          mode: str = "ratio") -> list[str]:
    """C6 (``mode='ratio'``: distinct/rows < threshold) or C7
    (``mode='nunique'``: at most one distinct value)."""
    if mode not in ("ratio", "nunique"):
        raise ValueError(f"Unknown mode '{mode}'. Choose from ['ratio', 'nunique']")
    drop = _below_ratio(df, threshold) if mode == "ratio" else _at_most_one_value(df)
    return [c for c in drop if c not in set(protect)]


# --------------------------------------------------------------------- C8
@dataclass
class CleanReport:
    duplicates_removed: int
    missing_before: dict[str, int]
    missing_after: int
    constant_cols_dropped: list[str] = field(default_factory=list)

    def to_df(self, spark) -> DataFrame:
        return spark.createDataFrame(
            [(self.duplicates_removed, self.missing_before, self.missing_after, self.constant_cols_dropped)],
            "duplicates_removed bigint, missing_before map<string,bigint>, missing_after bigint, "
            "constant_cols_dropped array<string>")


def clean(df: DataFrame, mode: str = "ratio", threshold: float = 0.001,
          protect: Sequence[str] | None = None) -> tuple[DataFrame, CleanReport]:
    """Dedupe -> impute (median / mode) -> strip -> drop (near-)constant
    columns. ``mode='ratio'`` is the batch rule (< 0.001 distinct per row),
    ``'nunique'`` the demo rule (<= 1 distinct value). Rows made identical
    by stripping are kept, as in the original order of steps."""
    if protect is None:
        protect = PROTECTED_BASE if mode == "ratio" else PROTECTED_DEMO
    before = df.count()
    # the dedupe shuffle feeds five statistics passes: materialise it once
    # (reliable checkpoint: survives executor loss, cuts the lineage)
    deduped = reliable_checkpoint(drop_duplicates(df))
    after = deduped.count()
    nulls = null_counts(deduped)
    with_nulls = [c for c, n in nulls.items() if n > 0]
    num = set(numeric_columns(deduped))
    medians = column_medians(deduped, [c for c in with_nulls if c in num])
    modes = column_modes(deduped, [c for c in with_nulls if c not in num])
    filled = strip_strings(impute(deduped, medians, modes))
    missing_after = sum(null_counts(filled).values())
    drop = near_constant_columns(filled, threshold, protect, mode)
    out = filled.drop(*drop) if drop else filled
    report = CleanReport(before - after, {c: n for c, n in nulls.items() if n > 0}, missing_after, drop)
    return out, report


# --------------------------------------------------------------------- C11 / C12 / C13
def as_key_string(c: str, null_text: str = "None"):
    """C11: ``astype(str)`` of a key; nulls become the literal text."""
    return F.coalesce(F.col(c).cast("string"), F.lit(null_text))


def check_batch(df: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Refuse an empty batch, and (optionally) one above ``max_rows``.
    Uses ``limit(n+1).count()``, so it never scans more than needed."""
    probe = max_rows + 1 if max_rows is not None else 1
    n = df.limit(probe).count()
    if n == 0:
        raise ValueError("batch must contain at least one payload")
    if max_rows is not None and n > max_rows:
        raise ValueError(f"batch exceeds the maximum of {max_rows} payloads")
    return df


def table_profile(df: DataFrame) -> DataFrame:
    """One row per column: position, type family, rows, non-null count."""
    fam = {}
    for f in df.schema.fields:
        t = f.dataType
        fam[f.name] = ("integer" if isinstance(t, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)) else
                       "float" if isinstance(t, (T.DoubleType, T.FloatType, T.DecimalType)) else
                       "string" if isinstance(t, T.StringType) else
                       "timestamp" if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)) else
                       t.simpleString())
    agg = df.agg(F.count(F.lit(1)).alias("__rows"), *[F.count(c).alias(c) for c in df.columns])
    stacked = agg.select("__rows", F.explode(F.array(*[
        F.struct(F.lit(i + 1).alias("position"), F.lit(c).alias("column"), F.lit(fam[c]).alias("type_family"),
                 F.col(c).cast("bigint").alias("n_non_null"))
        for i, c in enumerate(df.columns)])).alias("s"))
    return stacked.select("s.position", "s.column", "s.type_family", F.col("__rows").cast("bigint").alias("n_rows"),
                          "s.n_non_null")

"""Categorical encoding.

Code tables are built without a driver collect and without a single-
partition window: distinct values are range-partitioned and numbered where
they lie (``positions``), with one shuffle after the distinct.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .prefix import positions


def code_table(df: DataFrame, col: str, code_col: str | None = None, as_string: bool = True,
               partitions: int | None = None) -> DataFrame:
    """E1/E3 state: (value, code) with codes 0..k-1 in sorted value order.
    ``as_string`` sorts the text form (``astype(str)``: '1' < '10' < '2');
    nulls become the text 'None' as in the original encoder."""
    code_col = code_col or f"{col}_code"
    v = F.coalesce(F.col(col).cast("string"), F.lit("None")) if as_string else F.col(col)
    return positions(df.select(v.alias("value")).distinct(), [], [F.col("value")], code_col, partitions)


def label_encode(df: DataFrame, col: str, table: DataFrame | None = None, out_col: str | None = None,
                 as_string: bool = True) -> tuple[DataFrame, DataFrame]:
    """Replace ``col`` by its code (``out_col`` keeps the original).
    A value that a supplied table lacks raises when the row is computed."""
    out_col, given = out_col or col, table is not None
    table = table if table is not None else code_table(df, col, "__code", as_string)
    if "__code" not in table.columns:
        table = table.withColumnRenamed(table.columns[1], "__code")
    key = F.coalesce(F.col(col).cast("string"), F.lit("None")) if as_string else F.col(col)
    j = df.withColumn("__key", key).join(table.withColumnRenamed("value", "__key"), "__key", "left")
    code = F.col("__code")
    if given:
        unseen = F.raise_error(F.concat(F.lit(f"{col} has a value that the code table lacks: "), F.col("__key")))
        code = F.when(code.isNotNull(), code).otherwise(unseen.cast("bigint"))
    return j.withColumn(out_col, code).drop("__key", "__code"), table


def label_decode(df: DataFrame, code_col: str, table: DataFrame, out_col: str) -> DataFrame:
    """Code -> original value."""
    t = table.select(F.col(table.columns[1]).alias("__code"), F.col("value").alias(out_col))
    return df.join(t, F.col(code_col) == F.col("__code"), "left").drop("__code")


def encode_features(df: DataFrame, cat_cols: Sequence[str] | None = None, strategy: str = "label",
                    max_categories: int | None = None) -> tuple[DataFrame, dict]:
    """E3/E4 dispatch: ``label`` codes per column, or dense ``onehot``."""
    from .cleaning import categorical_columns

    cat_cols = categorical_columns(df) if cat_cols is None else list(cat_cols)
    if strategy == "label":
        tables = {}
        for c in cat_cols:
            df, tables[c] = label_encode(df, c)
        return df, tables
    if strategy == "onehot":
        cats = {c: category_values(df, c, max_categories) for c in cat_cols}
        return one_hot(df, cats), cats
    raise ValueError(f"Unknown strategy '{strategy}'. Choose from ['label', 'onehot']")


def category_values(df: DataFrame, col: str, max_categories: int | None = None) -> list[str]:
    """Sorted distinct text values of a column. They name the columns of the
    dense form, so they come to the driver; a caller may set
    ``max_categories`` to be refused instead. ``one_hot_sparse`` has no such need."""
    vals = df.select(F.coalesce(F.col(col).cast("string"), F.lit("None")).alias("v")).distinct().orderBy("v")
    if max_categories is not None:
        vals = vals.limit(max_categories + 1)
    vals = vals.collect()
    if max_categories is not None and len(vals) > max_categories:
        raise ValueError(f"column {col} has more than {max_categories} categories; use one_hot_sparse")
    return [r["v"] for r in vals]


def one_hot_sparse(df: DataFrame, col: str, out: str = "onehot") -> DataFrame:
    """E4 for any number of categories: a struct ``(size, index)`` in place
    of the 0/1 columns, where ``index`` is the position of the one that is 1.
    Positions come from the distributed code table; nothing is collected
    but its size."""
    coded, table = label_encode(df, col, out_col=f"__{out}")
    size = table.count()
    return coded.withColumn(out, F.struct(F.lit(size).cast("bigint").alias("size"),
                                          F.col(f"__{out}").cast("bigint").alias("index"))).drop(f"__{out}")


def one_hot(df: DataFrame, categories: dict[str, list[str]], drop_original: bool = True) -> DataFrame:
    """Dense 0/1 DOUBLE columns ``col_value``; unseen values -> all zeros."""
    new = {}
    for c, vals in categories.items():
        key = F.coalesce(F.col(c).cast("string"), F.lit("None"))
        for v in vals:
            new[f"{c}_{v}"] = F.when(key == F.lit(v), 1.0).otherwise(0.0)
    out = df.withColumns(new)
    return out.drop(*categories.keys()) if drop_original else out

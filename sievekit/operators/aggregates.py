"""Summary tables behind the charts.

Every operator groups first and only then applies windows/joins, so the
unpartitioned windows used for totals and ranks see grouped (small) tables,
never raw rows. Fixed dimensions (class lists, bin numbers) are generated by
``explode`` on the grouped rows, not by cross joins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import exact_quantiles, unpivot_numeric


def value_counts(df: DataFrame, col: str, name: str = "n") -> DataFrame:
    """A1: count per value, most frequent first (ties by value)."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias(name)).orderBy(F.desc(name), F.asc(col))


def proportions(df: DataFrame, col: str, groups: Sequence[str] = (), digits: int = 3) -> DataFrame:
    """A2: share of each value (per ``groups``) as ``round(n/total, digits)*100``."""
    counts = df.groupBy(*groups, col).agg(F.count(F.lit(1)).alias("n"))
    if groups:
        total = F.sum("n").over(Window.partitionBy(*groups))
    else:  # one number: fetch it rather than funnel all groups through one window task
        total = F.lit(counts.agg(F.sum("n")).collect()[0][0] or 0)
    return counts.select(*groups, col, "n", (F.round(F.col("n") / total, digits) * 100).alias("share_pct"))


def reindexed_counts(df: DataFrame, col: str, order: Sequence[str], name: str = "n") -> DataFrame:
    """A3: counts in a fixed value order; values absent from the data get 0.
    The order list becomes a tiny dimension (bounded by the list)."""
    spark = df.sparkSession
    dim = spark.range(1).select(F.posexplode(F.array(*[F.lit(v) for v in order])).alias("position", col))
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias(name))
    return (F.broadcast(dim).join(counts, col, "left")
            .select("position", col, F.coalesce(F.col(name), F.lit(0)).cast("bigint").alias(name)))


def rollup_counts(df: DataFrame, col: str, total_label: str = "Total", name: str = "n") -> DataFrame:
    """A4: per-value counts plus a grand-total row."""
    r = df.rollup(col).agg(F.count(F.lit(1)).alias(name), F.grouping(col).alias("__g"))
    return r.select(F.when(F.col("__g") == 1, F.lit(total_label)).otherwise(F.col(col).cast("string")).alias(col),
                    F.col(name).cast("bigint").alias(name))


def group_mean_pct(df: DataFrame, group: str, cols: Sequence[str], digits: int = 6) -> DataFrame:
    """A5: mean of 0/1 columns per group, in percent."""
    return df.groupBy(group).agg(*[F.round(F.avg(c) * 100, digits).alias(f"{c}_pct") for c in cols])


def equality_tally(df: DataFrame, a: str, b: str) -> DataFrame:
    """Number of rows where ``a`` equals / differs from ``b``."""
    eq = (F.col(a) == F.col(b))
    return df.agg(F.sum(F.when(eq, 1).otherwise(0)).cast("bigint").alias("correct"),
                  F.sum(F.when(eq, 0).otherwise(1)).cast("bigint").alias("incorrect"))


def equal_width_histogram(df: DataFrame, value: str, bins: int, groups: Sequence[str] = ()) -> DataFrame:
    """``bins`` equal-width bins between the per-group min and max; the
    last bin is closed (the maximum falls into it). Empty bins are present
    with n = 0. Returns (groups, bin, lo, hi, n)."""
    groups, single = list(groups), not groups
    if single:  # the one range is applied as literals: no join of the raw rows
        df, groups = df.withColumn("__g", F.lit(0)), ["__g"]
    v = F.col(value).cast("double")
    base = df.select(*groups, v.alias("__v")).where(F.col("__v").isNotNull())
    rng = base.groupBy(*groups).agg(F.min("__v").alias("__mn"), F.max("__v").alias("__mx"))
    width = (F.col("__mx") - F.col("__mn")) / bins
    if single:
        one = rng.first()
        rng = df.sparkSession.createDataFrame([tuple(one)] if one else [], rng.schema)
        low, high = (one["__mn"], one["__mx"]) if one else (None, None)
        joined = base.withColumns({"__mn": F.lit(low).cast("double"), "__mx": F.lit(high).cast("double")})
    else:
        joined = base.join(rng, groups)
    b = F.when(F.col("__mx") == F.col("__mn"), F.lit(0)).otherwise(
        F.least(F.floor((F.col("__v") - F.col("__mn")) / (F.col("__mx") - F.col("__mn")) * bins), F.lit(bins - 1)))
    counts = joined.groupBy(*groups, b.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    dim = rng.select(*groups, "__mn", "__mx", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    out = dim.join(counts, [*groups, "bin"], "left")
    out = out.select(*groups, "bin", (F.col("__mn") + F.col("bin") * width).alias("lo"),
                     (F.col("__mn") + (F.col("bin") + 1) * width).alias("hi"),
                     F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n"))
    return out.drop("__g") if single else out


def box_stats(df: DataFrame, value: str, groups: Sequence[str] = ()) -> DataFrame:
    """A10: quartiles (linear), 1.5 IQR fences, whisker ends (extreme values
    inside the fences) and outlier count per group."""
    groups, single = list(groups), not groups
    if single:
        df, groups = df.withColumn("__g", F.lit(0)), ["__g"]
    q = exact_quantiles(df, value, [0.25, 0.5, 0.75], groups)
    wide = q.groupBy(*groups).agg(*[F.max(F.when(F.col("p") == p, F.col("q"))).alias(n)
                                    for p, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))])
    wide = wide.withColumn("iqr", F.col("q3") - F.col("q1")) \
        .withColumn("lo_fence", F.col("q1") - 1.5 * F.col("iqr")).withColumn("hi_fence", F.col("q3") + 1.5 * F.col("iqr"))
    v = F.col(value).cast("double")
    inside = (v >= F.col("lo_fence")) & (v <= F.col("hi_fence"))
    j = df.select(*groups, v.alias(value)).where(F.col(value).isNotNull())
    if single:
        one = wide.first()
        wide = df.sparkSession.createDataFrame([tuple(one)] if one else [], wide.schema)
        j = j.withColumns({c: F.lit(one[c] if one else None).cast("double") for c in ("lo_fence", "hi_fence")})
    else:
        j = j.join(wide, groups)
    stats = j.groupBy(*groups).agg(
        F.min(F.when(inside, F.col(value))).alias("whisker_lo"),
        F.max(F.when(inside, F.col(value))).alias("whisker_hi"),
        F.sum(F.when(inside, 0).otherwise(1)).cast("bigint").alias("n_outliers"),
        F.count(F.lit(1)).cast("bigint").alias("n"))
    out = wide.join(stats, groups)
    return out.drop("__g") if single else out


def iqr_outliers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per numeric column, the 1.5 IQR fences and the outlier count,
    all columns in one long-form pass."""
    long = unpivot_numeric(df, columns)
    q = exact_quantiles(long, "value", [0.25, 0.75], ["column"])
    wide = q.groupBy("column").agg(F.max(F.when(F.col("p") == 0.25, F.col("q"))).alias("q1"),
                                   F.max(F.when(F.col("p") == 0.75, F.col("q"))).alias("q3"))
    wide = wide.withColumn("lo_fence", F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))) \
        .withColumn("hi_fence", F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    # wide has one row per input column: a proven bound for the broadcast
    j = long.where(F.col("value").isNotNull()).join(F.broadcast(wide), "column")
    out = (F.col("value") < F.col("lo_fence")) | (F.col("value") > F.col("hi_fence"))
    cnt = j.groupBy("column").agg(F.sum(F.when(out, 1).otherwise(0)).cast("bigint").alias("n_outliers"))
    return wide.join(cnt, "column")


def correlation_pairs(df: DataFrame, columns: Sequence[str], digits: int = 6) -> DataFrame:
    """Pearson correlation of every pair below the diagonal, one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[:i]]
    row = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).agg(
        *[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    stacked = row.select(F.explode(F.array(*[
        F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.col(f"`{a}|{b}`").alias("corr"))
        for a, b in pairs])).alias("s"))
    return stacked.select("s.col_a", "s.col_b", F.round("s.corr", digits).alias("corr"))


def score_summary(df: DataFrame, score: str, groups: Sequence[str] = ()) -> DataFrame:
    """Mean and population standard deviation of scores."""
    return df.groupBy(*groups).agg(F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"),
                                   F.count(F.lit(1)).alias("n"))

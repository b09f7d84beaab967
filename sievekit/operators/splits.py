"""Exact, repeatable splits and folds (K1-K3, H6 helpers, G2 selection).

Rows are ordered by ``md5(seed|key)``. "The first n rows of a class in that
order" is found without ranking a whole class in one task:

1. bucket = first 4 hex digits of the hash (65 536 order-preserving buckets);
2. count rows per (group, bucket) - a small table - and cumulate it;
3. rows in buckets before the boundary bucket are selected, rows after it
   are not, and only the boundary bucket's rows are ranked.

Fold numbers need every row's rank; there the window is partitioned by
(group, bucket), so its partitions are ~rows/65 536 each, never a whole class.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordering import hash_key

_B = "__bucket"
_H = "__h"


def _with_hash(df: DataFrame, key: str, seed: int, purpose: str | None = None) -> DataFrame:
    k = F.col(key).cast("string")
    h = F.md5(F.concat(F.lit(f"{seed}|{purpose}|" if purpose else f"{seed}|"), k))
    return df.withColumn(_H, h).withColumn(_B, F.substring(h, 1, 4))


def mark_first_by_hash(df: DataFrame, key: str, quota: DataFrame, groups: Sequence[str], flag: str,
                       seed: int = 42, purpose: str | None = None) -> DataFrame:
    """Add boolean ``flag``: True for the first ``quota`` rows of each group
    in md5(seed|[purpose|]key) order (ties by key). ``quota`` is a small
    table ``(groups..., quota)``; groups missing from it select nothing."""
    groups = list(groups)
    hashed = _with_hash(df, key, seed, purpose)
    if not groups:
        return _mark_first_ungrouped(hashed, key, int(quota.collect()[0]["quota"]), flag)
    counts = hashed.groupBy(*groups, _B).agg(F.count(F.lit(1)).alias("__c"))
    w = Window.partitionBy(*groups).orderBy(_B).rowsBetween(Window.unboundedPreceding, 0)
    cum = counts.withColumn("__cum", F.sum("__c").over(w)).join(quota, groups)
    # boundary bucket: the first bucket whose cumulative count reaches the quota
    boundary = (cum.where(F.col("__cum") >= F.col("quota"))
                .groupBy(*groups).agg(F.min_by(F.struct(_B, (F.col("__cum") - F.col("__c")).alias("__before")), _B)
                                      .alias("__bd"), F.first("quota").alias("__quota")))
    boundary = boundary.select(*groups, F.col("__bd." + _B).alias("__bb"), F.col("__bd.__before").alias("__before"),
                               "__quota")
    # groups whose quota covers all rows have no boundary: select all of them
    # (quota >= rows). The boundary table has one row per group: small.
    j = hashed.join(F.broadcast(boundary), groups, "left").join(
        F.broadcast(quota.withColumnRenamed("quota", "__q")), groups, "left")
    inside = F.col(_B) == F.col("__bb")
    not_boundary = j.where(~inside | F.col("__bb").isNull()).withColumn(
        flag, F.when(F.col("__bb").isNull(), F.coalesce(F.col("__q"), F.lit(0)) > 0).otherwise(F.col(_B) < F.col("__bb")))
    rank_w = Window.partitionBy(*groups, _B).orderBy(_H, key)
    in_boundary = j.where(inside).withColumn(
        flag, (F.col("__before") + F.row_number().over(rank_w)) <= F.col("__quota"))
    out = not_boundary.unionByName(in_boundary)
    return out.drop(_B, _H, "__bb", "__before", "__quota", "__q")


def _mark_first_ungrouped(hashed: DataFrame, key: str, quota: int, flag: str) -> DataFrame:
    """Ungrouped ``mark_first_by_hash``: the boundary (one bucket) is found
    on the small per-bucket count table and applied as literals, so no join
    on a constant key (which the optimizer would turn into a nested loop)."""
    counts = hashed.groupBy(_B).agg(F.count(F.lit(1)).alias("__c"))
    w = Window.orderBy(_B).rowsBetween(Window.unboundedPreceding, 0)  # <= 65 536 bucket rows
    hit = (counts.withColumn("__cum", F.sum("__c").over(w)).where(F.col("__cum") >= quota)
           .orderBy(_B).limit(1).collect())
    if quota <= 0 or not hit:  # nothing, or everything, is selected
        out = hashed.withColumn(flag, F.lit(quota > 0))
        return out.drop(_B, _H)
    bb, before = hit[0][_B], int(hit[0]["__cum"] - hit[0]["__c"])
    rest = hashed.where(F.col(_B) != bb).withColumn(flag, F.col(_B) < F.lit(bb))
    rank_w = Window.partitionBy(_B).orderBy(_H, key)
    edge = hashed.where(F.col(_B) == bb).withColumn(flag, (F.lit(before) + F.row_number().over(rank_w)) <= quota)
    return rest.unionByName(edge).drop(_B, _H)


def allocate_largest_remainder(counts: DataFrame, group: str, total: int) -> DataFrame:
    """Split ``total`` draws across groups proportionally to ``n``: floor of
    the exact share plus one for the largest remainders (ties: group order).
    ``counts`` is a small (group, n) table; returns (group, quota)."""
    w_all = Window.partitionBy()  # over the per-class table only (few rows)
    n_all = F.sum("n").over(w_all)
    c = counts.withColumn("__cont", F.lit(total) * F.col("n") / n_all)
    c = c.withColumn("__fl", F.floor("__cont").cast("long")).withColumn("__rem", F.col("__cont") - F.col("__fl"))
    c = c.withColumn("__need", F.lit(total) - F.sum("__fl").over(w_all))
    c = c.withColumn("__r", F.row_number().over(Window.orderBy(F.desc("__rem"), F.asc(group))))
    return c.select(group, (F.col("__fl") + F.when(F.col("__r") <= F.col("__need"), 1).otherwise(0)).alias("quota"))


def stratified_split(df: DataFrame, label: str, key: str, test_size: float = 0.2, seed: int = 42,
                     split_col: str = "split") -> DataFrame:
    """K1: exact stratified train/test split. Test size is ceil(test_size x n)
    rows (as scikit-learn), spread over classes by largest remainder; the test
    rows of a class are its first rows in md5(seed|key) order."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    rows = counts.collect()  # one row per class
    n = sum(r["n"] for r in rows)
    if len(rows) < 2:
        raise ValueError("stratified split needs at least two classes")
    n_test = math.ceil(test_size * n)
    quota = allocate_largest_remainder(df.sparkSession.createDataFrame(rows, counts.schema), label, n_test)
    marked = mark_first_by_hash(df, key, quota, [label], "__test", seed)
    return marked.withColumn(split_col, F.when(F.col("__test"), "test").otherwise("train")).drop("__test")


def assign_folds(df: DataFrame, key: str, k: int, seed: int = 42, label: str | None = None,
                 fold_col: str = "fold") -> DataFrame:
    """K2 (with ``label``) / K3 (without): fold = (offset + rank) mod k where
    rank is the 0-based position in md5(seed|key) order within the class and
    offset the number of rows of the classes before it, so every class and
    the whole table are spread as evenly as possible over the k folds."""
    if k < 2:
        raise ValueError("k must be at least 2")
    groups = [label] if label else []
    tmp = df if label else df.withColumn("__all", F.lit(0))
    groups = groups or ["__all"]
    hashed = _with_hash(tmp, key, seed)
    counts = hashed.groupBy(*groups, _B).agg(F.count(F.lit(1)).alias("__c"))
    # cumulative rows before each (class, bucket), plus rows of earlier classes
    w_cls = Window.partitionBy(*groups).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.withColumn("__boff", F.coalesce(F.sum("__c").over(w_cls), F.lit(0)))
    if label:
        cls_tot = counts.groupBy(*groups).agg(F.sum("__c").alias("__ct"))
        w_prev = Window.orderBy(*groups).rowsBetween(Window.unboundedPreceding, -1)  # over classes only
        cls_off = cls_tot.withColumn("__coff", F.coalesce(F.sum("__ct").over(w_prev), F.lit(0))).drop("__ct")
        offs = offs.join(cls_off, groups)
    else:
        offs = offs.withColumn("__coff", F.lit(0).cast("long"))
    j = hashed.join(offs.drop("__c"), [*groups, _B])
    rank = F.col("__boff") + F.row_number().over(Window.partitionBy(*groups, _B).orderBy(_H, key)) - 1
    out = j.withColumn(fold_col, ((F.col("__coff") + rank) % k).cast("int"))
    return out.drop(_B, _H, "__boff", "__coff", *(["__all"] if not label else []))


def n_splits_for(df: DataFrame, label: str, max_splits: int = 5) -> int:
    """K2's k = clamp(smallest class size, 2, 5)."""
    smallest = df.groupBy(label).count().agg(F.min("count")).collect()[0][0]
    return max(2, min(max_splits, int(smallest or 0)))


def group_folds(df: DataFrame, group_key: str, k: int, seed: int = 42, fold_col: str = "fold") -> DataFrame:
    """GroupKFold-style: every row of a group lands in the same fold."""
    h = F.conv(F.substring(hash_key(group_key, seed), 1, 8), 16, 10).cast("bigint")
    return df.withColumn(fold_col, (h % k).cast("int"))


def time_folds(df: DataFrame, ts: str, key: str, k: int, fold_col: str = "fold") -> DataFrame:
    """Time-ordered folds for an expanding-window split: rows ordered by
    (ts, key) get fold = floor(rank x k / n), rank 0-based. Ranks come from
    a range-partitioned running count (no single-partition window)."""
    from .prefix import positions

    n = df.count()
    ranked = positions(df, [], [F.col(ts), F.col(key)], "__rank")
    fold = F.floor(F.col("__rank") * F.lit(k) / F.lit(max(n, 1))).cast("int")
    return ranked.withColumn(fold_col, fold).drop("__rank")

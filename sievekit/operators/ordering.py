"""Sorting, top-k, seeded sampling and reshaping (H1-H8).

Randomness is replaced by a seeded hash order ``md5(seed|key)``: exact,
repeatable and independent of partitioning, unlike ``rand``/``sample``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_key(key, seed: int = 42) -> Column:
    """md5 hex of ``seed|key``: the order used for shuffles, samples, folds."""
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}|"), k.cast("string")))


def hash_pick(key, seed: int, purpose: str, modulus: int) -> Column:
    """Deterministic integer in [0, modulus) from the first 32 bits of
    md5(seed|purpose|key)."""
    k = F.col(key) if isinstance(key, str) else key
    h = F.md5(F.concat(F.lit(f"{seed}|{purpose}|"), k.cast("string")))
    return (F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") % F.lit(modulus)).cast("int")


def sort_desc(df: DataFrame, col: str, tiebreak: Sequence[str] = ()) -> DataFrame:
    """H1: descending sort with an explicit ascending tie-break."""
    return df.orderBy(F.desc(col), *[F.asc(c) for c in tiebreak])


def top_k(df: DataFrame, k: int, order: Sequence[Column]) -> DataFrame:
    """H2: global top-k; Spark plans TakeOrderedAndProject (a bounded heap
    per partition, then a merge of k x partitions rows)."""
    return df.orderBy(*order).limit(k)


def top_k_per_group(df: DataFrame, groups: Sequence[str], order: Sequence[Column], k: int,
                    rank_col: str = "rank") -> DataFrame:
    """H4 per group: ``row_number() <= k``. Spark inserts a partial
    WindowGroupLimit before the shuffle, so a hot group ships at most k rows
    per map task; no group is ever sorted whole in one task."""
    w = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)


def exact_sample(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """H5: exactly min(n, rows) rows, chosen by and returned in seeded hash
    order. Only the hash bucket in which the n-th row lies is ranked, and the
    order comes from a range-partitioned sort, so no task gathers the sample."""
    from .splits import mark_first_by_hash

    quota = df.sparkSession.createDataFrame([(n,)], "quota bigint")
    chosen = mark_first_by_hash(df, key, quota, [], "__in", seed).where("__in").drop("__in")
    return chosen.orderBy(hash_key(key, seed), F.col(key))


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """H6: a seeded, repeatable permutation (range-partitioned global sort)."""
    return df.orderBy(hash_key(key, seed), F.col(key))


def shuffle_positions(df: DataFrame, key: str, seed: int = 42, out: str = "position") -> DataFrame:
    """H6 as numbers: each row's place (from 0) in the seeded permutation,
    counted over range-sorted partitions (one shuffle, no single-task window)."""
    from .prefix import positions

    return positions(df.withColumn("__h", hash_key(key, seed)), [], [F.col("__h"), F.col(key)], out).drop("__h")


def wide_to_long(df: DataFrame, ids: Sequence[str], values: Sequence[str], var: str = "metric",
                 val: str = "value") -> DataFrame:
    """H7: melt."""
    return df.unpivot(list(ids), list(values), var, val)


def long_to_wide(df: DataFrame, ids: Sequence[str], var: str, val: str, values: Sequence[str]) -> DataFrame:
    """H8: pivot with an explicit value list (no extra distinct job)."""
    return df.groupBy(*ids).pivot(var, list(values)).agg(F.first(val))

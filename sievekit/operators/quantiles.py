"""Exact order statistics by radix selection, without sorting or collecting a
group.

``exact_quantiles`` returns pandas/NumPy "linear" quantiles (the default of
``Series.median``/``quantile`` and ``np.percentile``) per group. Spark's
exact ``percentile`` keeps a value->count map per group in one buffer, which
is unbounded for a global quantile over a large column; this module selects
by digits instead:

1. every value becomes a 64-bit whole number of the same order (``order_key``,
   plain arithmetic on exponent and fraction, so it stays in generated code);
2. a pass counts the rows by the leading ``DIGIT_BITS`` bits, per group: at most
   2^13 counts a group and task leave the map side, whatever the data. Sums of
   these counts tell which buckets hold the wanted ranks; all ranks of all
   groups are looked up at once;
3. the next pass counts the next digit of the rows in those buckets only (a row
   meets its own bucket, so there is no row x rank product), and so on: five
   passes at most, fewer once every bucket holds a single value.

No shuffle carries rows, only counts. A value holding a third of all rows is
one count. The wanted buckets (groups x ranks rows at most) are broadcast while
they are few, and joined by shuffle otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import reliable_checkpoint

DIGIT_BITS = 13
#: wanted buckets that are broadcast; more are joined by shuffle
BROADCAST_ROWS = 50_000
_FRACTION = 1 << 52
_TINY = 2.0**-1022  # smallest normal double


def order_key(x: Column) -> Column:
    """A bigint with the order of the doubles (NaN excluded): exponent and
    fraction of the absolute value, negated for negative ones. -0.0 is 0."""
    a = F.abs(x)
    near = F.floor(F.log2(a))
    power = lambda e: F.pow(F.lit(2.0), e)
    # the logarithm may round across a power of two
    e = F.when(power(near) > a, near - 1).when(power(near + 1) <= a, near + 1).otherwise(near).cast("long")
    normal = F.shiftleft(e + 1023, 52) + ((a / power(e) - 1.0) * float(_FRACTION)).cast("long")
    small = (a * 2.0**537 * 2.0**537).cast("long")
    key = F.when(a == float("inf"), F.lit(2047 << 52)).when(a < _TINY, small).otherwise(normal)
    return F.when(x < 0, -key).otherwise(key)


def key_value(k: Column) -> Column:
    """The double of an ``order_key``."""
    a = F.abs(k)
    e, fraction = F.shiftright(a, 52), a.bitwiseAND(F.lit(_FRACTION - 1)).cast("double")
    normal = (1.0 + fraction / float(_FRACTION)) * F.pow(F.lit(2.0), e - 1023)
    v = F.when(e == 2047, F.lit(float("inf"))).when(e == 0, fraction * 2.0**-537 * 2.0**-537).otherwise(normal)
    return F.when(k < 0, -v).otherwise(v)


def values_at_ranks(keys: DataFrame, groups: list[str], key: str, ranks) -> DataFrame:
    """The key at 0-based ranks of each group's sorted keys.

    ``ranks`` makes the sorted array of wanted ranks from the group's number
    of rows (a Column). Returns (groups, ``__n``, ``__rank``, key)."""
    spark = keys.sparkSession
    shift, state, done = 64 - DIGIT_BITS, None, None
    rows, at = keys, list(groups)
    while True:
        counts = rows.groupBy(*at, F.shiftright(key, shift).alias("__next")).agg(  # all bits down to this digit
            F.count(F.lit(1)).alias("__c"), F.min(key).alias("__lo"), F.max(key).alias("__hi"))
        w = Window.partitionBy(*at).orderBy("__next")
        end = F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, 0))
        counts = counts.withColumn("__end", end)
        if state is None:
            counts = counts.withColumns({"__n": F.sum("__c").over(Window.partitionBy(*at)), "__before": F.lit(0).cast("long")})
            counts = counts.withColumn("__ranks", ranks(F.col("__n")))
        else:
            counts = _joined(counts, state, at, "inner")
        start = F.col("__before") + F.col("__end") - F.col("__c")
        inside = F.filter("__ranks", lambda r: (r >= start) & (r < F.col("__before") + F.col("__end")))
        found = counts.withColumn("__in", inside).where(F.size("__in") > 0).select(
            *groups, F.col("__next").alias("__prefix"), start.alias("__before"), F.col("__in").alias("__ranks"), "__n", "__lo", "__hi")
        head = found.limit(BROADCAST_ROWS + 1).collect()  # bounded; usually groups x ranks rows
        few = len(head) <= BROADCAST_ROWS
        found = spark.createDataFrame(head, found.schema) if few else reliable_checkpoint(found)
        settled = found.where("__lo = __hi").select(*groups, "__n", F.explode("__ranks").alias("__rank"), F.col("__lo").alias(key))
        done = settled if done is None else done.unionByName(settled)
        if all(r["__lo"] == r["__hi"] for r in head) if few else found.where("__lo < __hi").isEmpty():
            return done
        state = found.where("__lo < __hi").drop("__lo", "__hi")
        state = F.broadcast(state) if few else state
        at = [*groups, "__prefix"]
        rows = _joined(keys.withColumn("__prefix", F.shiftright(key, shift)), state.select(*at), at, "left_semi")
        shift = max(0, shift - DIGIT_BITS)


def _joined(left: DataFrame, right: DataFrame, on: list[str], how: str) -> DataFrame:
    """Join on equal columns, where a null group equals a null group."""
    r = right.select(*[F.col(c).alias(f"__r_{c}" if c in on else c) for c in right.columns])
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"__r_{c}"))
    return left.join(r, same, how).drop(*[f"__r_{c}" for c in on])


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], groups: Sequence[str] = ()) -> DataFrame:
    """Linear-interpolated quantiles of ``value`` per ``groups`` (nulls ignored).
    Returns (groups, p, q); groups without non-null values are absent."""
    groups = list(groups)
    single = not groups
    if single:  # a constant group keeps every join an equi-join
        df, groups = df.withColumn("__g", F.lit(0)), ["__g"]
    # NaN is treated as missing (pandas). nanvl keeps the column's
    # nullability, so for provably non-null inputs the filter folds away
    # instead of being pushed below the projection that computes ``value``.
    v = F.col(value).cast("double")
    vals = df.select(*groups, F.nanvl(v, F.lit(None).cast("double")).alias("v")).where(F.col("v").isNotNull())
    # the passes read narrow keys, not the input again (reliable checkpoint, no shuffle)
    keys = reliable_checkpoint(vals.select(*groups, order_key(F.col("v")).alias("k")))
    place = lambda n, p: (n - 1) * F.lit(float(p))
    wanted = lambda n: F.array_sort(F.array_distinct(F.flatten(F.array(*[
        F.array(F.floor(place(n, p)).cast("long"), F.ceil(place(n, p)).cast("long")) for p in probs]))))
    picked = values_at_ranks(keys, groups, "k", wanted).withColumn("v", key_value(F.col("k")))
    # a group's few picked values side by side: no join is needed to interpolate
    per = picked.groupBy(*groups, "__n").agg(F.map_from_entries(F.collect_list(F.struct("__rank", "v"))).alias("__at"))
    h = place(F.col("__n"), 1.0) * F.col("p")
    out = per.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
    low, high = F.col("__at")[F.floor(h).cast("long")], F.col("__at")[F.ceil(h).cast("long")]
    out = out.select(*groups, "p", F.when(low == high, low).otherwise(low + (h - F.floor(h)) * (high - low)).alias("q"))
    return out.drop("__g") if single else out


def unpivot_numeric(df: DataFrame, columns: Sequence[str], name: str = "column", value: str = "value") -> DataFrame:
    """Long form (name, value DOUBLE) of several numeric columns, for one-pass
    multi-column statistics."""
    return df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for c in columns
    ])).alias("__kv")).select(f"__kv.{name}", f"__kv.{value}")


def quantile_map(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> dict[str, dict[float, float]]:
    """Driver-side {column: {p: q}} for a handful of columns (bounded)."""
    if not columns:
        return {}
    long = unpivot_numeric(df, columns)
    rows = exact_quantiles(long, "value", probs, groups=["column"]).collect()
    out: dict[str, dict[float, float]] = {c: {} for c in columns}
    for r in rows:
        out[r["column"]][round(r["p"], 12)] = r["q"]
    return out

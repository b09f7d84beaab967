"""Payload feature operators.

``add_payload_features`` is the workhorse: a single narrow projection, no
shuffle, so it pipelines with the scan and with whatever follows. The
keyed ``entropy_table`` is the explode/two-level-aggregate form, useful when
texts have very many distinct characters (its cost is O(length) rather than
O(length x distinct characters)).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.charcounts import char_stats
from ..functions.dialect import BASE, FEATURE_COLUMNS, QUICK_SPECIAL_CHARS, FeatureDialect, get_dialect
from ..functions.text import count_chars, counted_feature_columns, digit_count, payload_feature_columns, text_or_empty

#: the column of character statistics while features are made of them
STATS = "__char_stats"


def add_payload_features(df: DataFrame, payload_col: str = "Payload", dialect: "str | FeatureDialect" = BASE,
                         counted: bool = False) -> DataFrame:
    """F8: input columns plus the seven lexical features. ``counted`` takes
    them from one Arrow pass over the text, whose cost is O(length), in place of
    JVM expressions of O(length x distinct characters); the values are the same."""
    if not counted:
        return df.withColumns(payload_feature_columns(payload_col, dialect))
    d = get_dialect(dialect)
    stats = char_stats(text_or_empty(payload_col), d.special_chars, d.sql_keywords, d.xss_keywords)
    # a column of its own, so that no feature makes the statistics again
    return df.withColumn(STATS, stats).withColumns(counted_feature_columns(payload_col, F.col(STATS), d)).drop(STATS)


def extract_features(df: DataFrame, payload_col: str = "payload", keep: tuple[str, ...] = (),
                     dialect: "str | FeatureDialect" = BASE) -> DataFrame:
    """F8 (serving form): ``keep`` columns plus the seven features in fixed order."""
    feats = payload_feature_columns(payload_col, dialect)
    return df.select(*keep, *[feats[c].alias(c) for c in FEATURE_COLUMNS])


def quick_features(df: DataFrame, payload_col: str, keep: tuple[str, ...] = (),
                   unicode_digits: bool = False) -> DataFrame:
    """length, digit count and count of ``<>"\\()`` per payload."""
    s = text_or_empty(payload_col)
    return df.select(
        *keep,
        F.length(s).cast("int").alias("q_len"),
        digit_count(s, unicode_digits).alias("q_digits"),
        count_chars(s, QUICK_SPECIAL_CHARS).alias("q_special"),
    )


def entropy_table(df: DataFrame, key: str, payload_col: str) -> DataFrame:
    """F2, keyed form: ``(key, payload_entropy)`` by exploding characters.

    The (key, char) counts are partially aggregated inside the scan task
    (a row's characters never leave it before the combine), so the first
    shuffle carries at most one row per distinct character of each text.
    Keys whose text is empty get 0. ``key`` must be unique per row.
    """
    s = text_or_empty(payload_col)
    chars = df.select(F.col(key), F.explode(F.split(s, "")).alias("__ch")).where(F.length("__ch") > 0)
    per_char = chars.groupBy(key, "__ch").agg(F.count(F.lit(1)).alias("__k"))
    per_key = per_char.groupBy(key).agg(
        F.sum("__k").alias("__n"),
        F.sum(F.col("__k") * F.log2("__k")).alias("__s"),
    )
    ent = per_key.select(key, (F.log2("__n") - F.col("__s") / F.col("__n")).alias("payload_entropy"))
    empties = df.where(F.length(s) == 0).select(key, F.lit(0.0).alias("payload_entropy"))
    return ent.unionByName(empties)

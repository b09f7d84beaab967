"""Queries for the payload feature functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dialect import BASE, EXTENDED, QUICK_SPECIAL_CHARS
from ..functions.text import contains_any, count_chars, preview, text_or_empty
from ..operators.features import add_payload_features, entropy_table, quick_features
from ..session import read_table
from .catalog import query
from .corpus import CORPUS_SQL, labelled_corpus
from .sqltext import sql_any, sql_count_chars, sql_count_regex, sql_entropy_cte, sql_features

_F = sql_features("Payload")


def keyword_rate_by_lang(docs):
    """Flagship: documents -> features -> per-language keyword hit rates and
    mean entropy/length (A5)."""
    feats = add_payload_features(docs.select("lang", "text"), "text")
    return feats.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.round(F.avg("kw_sql") * 100, 6).alias("kw_sql_rate"),
        F.round(F.avg("kw_xss") * 100, 6).alias("kw_xss_rate"),
        F.round(F.avg("payload_entropy"), 6).alias("avg_entropy"),
        F.round(F.avg("payload_len"), 6).alias("avg_len"),
        F.round(F.avg("special_char_cnt"), 6).alias("avg_special"),
    )


_FD = sql_features("text")
SQL_KEYWORD_RATE_BY_LANG = f"""
SELECT lang, count(*) AS n_docs,
  round(avg({_FD['kw_sql']}) * 100, 6) AS kw_sql_rate,
  round(avg({_FD['kw_xss']}) * 100, 6) AS kw_xss_rate,
  round(avg({_FD['payload_entropy']}), 6) AS avg_entropy,
  round(avg({_FD['payload_len']}), 6) AS avg_len,
  round(avg({_FD['special_char_cnt']}), 6) AS avg_special
FROM documents GROUP BY lang
"""


@query("keyword_rate_by_lang", SQL_KEYWORD_RATE_BY_LANG)
def q_keyword_rate_by_lang(spark, sf_dir):
    return keyword_rate_by_lang(read_table(spark, sf_dir, "documents"))


@query("payload_features", f"""
SELECT ID, Label, {_F['payload_len']} AS payload_len, round({_F['payload_entropy']}, 6) AS payload_entropy,
  {_F['special_char_cnt']} AS special_char_cnt, {_F['digit_ratio']} AS digit_ratio, {_F['upper_ratio']} AS upper_ratio,
  {_F['kw_sql']} AS kw_sql, {_F['kw_xss']} AS kw_xss
FROM {CORPUS_SQL}
""")
def q_payload_features(spark, sf_dir):
    """F8 per row over the three-class corpus (base dialect)."""
    df = add_payload_features(labelled_corpus(spark, sf_dir), "Payload", BASE)
    return df.select("ID", "Label", "payload_len", F.round("payload_entropy", 6).alias("payload_entropy"),
                     "special_char_cnt", "digit_ratio", "upper_ratio", "kw_sql", "kw_xss")


@query("payload_entropy", f"""
WITH {sql_entropy_cte('documents', 'doc_id', 'text')}
SELECT d.doc_id, round(coalesce(e.payload_entropy, 0.0), 6) AS payload_entropy
FROM documents d LEFT JOIN ent e ON e.k = d.doc_id
""")
def q_payload_entropy(spark, sf_dir):
    """F2 keyed (explode) form over every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return entropy_table(docs, "doc_id", "text").select(
        "doc_id", F.round("payload_entropy", 6).alias("payload_entropy"))


@query("keyword_flags", f"""
SELECT ID, {sql_any('Payload', BASE.sql_keywords)} AS kw_sql_base, {sql_any('Payload', BASE.xss_keywords)} AS kw_xss_base,
  {sql_any('Payload', EXTENDED.sql_keywords)} AS kw_sql_ext, {sql_any('Payload', EXTENDED.xss_keywords)} AS kw_xss_ext
FROM {CORPUS_SQL}
""")
def q_keyword_flags(spark, sf_dir):
    """F6/F7 in both dialects."""
    s = text_or_empty("Payload")
    return labelled_corpus(spark, sf_dir).select(
        "ID",
        contains_any(s, BASE.sql_keywords).alias("kw_sql_base"), contains_any(s, BASE.xss_keywords).alias("kw_xss_base"),
        contains_any(s, EXTENDED.sql_keywords).alias("kw_sql_ext"), contains_any(s, EXTENDED.xss_keywords).alias("kw_xss_ext"))


@query("special_chars", f"""
SELECT ID, {sql_count_chars('Payload', BASE.special_chars)} AS special_base,
  {sql_count_chars('Payload', EXTENDED.special_chars)} AS special_ext,
  {sql_count_chars('Payload', QUICK_SPECIAL_CHARS)} AS special_quick
FROM {CORPUS_SQL}
""")
def q_special_chars(spark, sf_dir):
    """F3 with the three character sets."""
    s = text_or_empty("Payload")
    return labelled_corpus(spark, sf_dir).select(
        "ID", count_chars(s, BASE.special_chars).alias("special_base"),
        count_chars(s, EXTENDED.special_chars).alias("special_ext"),
        count_chars(s, QUICK_SPECIAL_CHARS).alias("special_quick"))


@query("quick_features", f"""
SELECT ID, CAST(length(Payload) AS INTEGER) AS q_len, {sql_count_regex('Payload', '[0-9]')} AS q_digits,
  {sql_count_chars('Payload', QUICK_SPECIAL_CHARS)} AS q_special
FROM {CORPUS_SQL}
""")
def q_quick_features(spark, sf_dir):
    """notebook's three-feature vector."""
    return quick_features(labelled_corpus(spark, sf_dir), "Payload", keep=("ID",))


@query("payload_preview", """
SELECT ID,
  CASE WHEN length(Payload) > 50 THEN substring(Payload, 1, 50) || '…' ELSE Payload END AS preview_50,
  CASE WHEN length(Payload) > 80 THEN substring(Payload, 1, 80) || '…' ELSE Payload END AS preview_80
FROM """ + CORPUS_SQL)
def q_payload_preview(spark, sf_dir):
    """truncated previews."""
    return labelled_corpus(spark, sf_dir).select(
        "ID", preview("Payload", 50).alias("preview_50"), preview("Payload", 80).alias("preview_80"))

"""Queries for profiling and cleaning.

Input with natural nulls: every document left-joined to its (partial)
quality labels; unlabelled documents carry null ``quality``/``toxic`` and a
null ``quality_tag`` string.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import py_whitespace, strip_py
from ..operators.cleaning import (
    clean, column_medians, column_modes, distinct_ratios, duplicate_report, impute, null_profile, table_profile,
)
from ..session import read_table
from .catalog import query

DOC_LABELS_SQL = """(
  SELECT d.doc_id, d.text, d.lang, d.source, l.quality, l.toxic,
         CASE WHEN l.quality = 1 THEN 'good' WHEN l.quality = 0 THEN 'poor' END AS quality_tag
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
)"""
DOC_LABEL_COLUMNS = ("doc_id", "text", "lang", "source", "quality", "toxic", "quality_tag")
PY_WS_SQL = "'" + py_whitespace().replace("'", "''") + "'"


def doc_labels(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    j = docs.join(labels, "doc_id", "left")
    tag = F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor")
    return j.select(*[c for c in DOC_LABEL_COLUMNS if c != "quality_tag"], tag.alias("quality_tag"))


@query("clean_dedup", f"""
WITH g AS (SELECT text, lang, source, quality, toxic, quality_tag, count(*) AS n FROM {DOC_LABELS_SQL} GROUP BY ALL)
SELECT CAST(sum(n) AS BIGINT) AS rows_before, CAST(count(*) AS BIGINT) AS rows_after,
       CAST(sum(n) - count(*) AS BIGINT) AS duplicates_removed FROM g
""")
def q_clean_dedup(spark, sf_dir):
    """Duplicates over all columns but the row id."""
    return duplicate_report(doc_labels(spark, sf_dir).drop("doc_id"))


@query("null_profile", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", CAST(count(*) - count({c}) AS BIGINT) AS n_null FROM {DOC_LABELS_SQL}"
    for c in DOC_LABEL_COLUMNS))
def q_null_profile(spark, sf_dir):
    """Nulls per column in one pass."""
    return null_profile(doc_labels(spark, sf_dir))


@query("impute_median", f"""
WITH t AS {DOC_LABELS_SQL}
SELECT doc_id, coalesce(CAST(quality AS DOUBLE), (SELECT median(quality) FROM t)) AS quality,
       coalesce(CAST(toxic AS DOUBLE), (SELECT median(toxic) FROM t)) AS toxic
FROM t
""")
def q_impute_median(spark, sf_dir):
    """Exact interpolated medians fill the numeric nulls."""
    df = doc_labels(spark, sf_dir)
    med = column_medians(df, ["quality", "toxic"])
    return impute(df, med, {}).select("doc_id", "quality", "toxic")


@query("impute_mode", f"""
WITH t AS {DOC_LABELS_SQL},
m AS (SELECT quality_tag AS v FROM t WHERE quality_tag IS NOT NULL GROUP BY quality_tag
      ORDER BY count(*) DESC, quality_tag LIMIT 1)
SELECT doc_id, coalesce(quality_tag, (SELECT v FROM m)) AS quality_tag,
       coalesce(lang, (SELECT lang FROM t WHERE lang IS NOT NULL GROUP BY lang ORDER BY count(*) DESC, lang LIMIT 1)) AS lang
FROM t
""")
def q_impute_mode(spark, sf_dir):
    """C4: most frequent value (smallest on ties) fills the string nulls."""
    df = doc_labels(spark, sf_dir)
    modes = column_modes(df, ["quality_tag", "lang"])
    return impute(df, {}, modes).select("doc_id", "quality_tag", "lang")


@query("scan_text_lines", f"""
SELECT doc_id, line FROM (
  SELECT doc_id, trim(unnest(string_split(text, chr(10))), {PY_WS_SQL}) AS line FROM documents
) WHERE length(line) > 0
""")
def q_scan_text_lines(spark, sf_dir):
    """One payload per line, Python-stripped, blanks dropped."""
    docs = read_table(spark, sf_dir, "documents")
    lines = docs.select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.select("doc_id", strip_py("line").alias("line")).where(F.length("line") > 0)


_RATIO_COLS = [c for c in DOC_LABEL_COLUMNS if c != "doc_id"]


@query("near_constant_cols", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", CAST(count(DISTINCT {c}) AS BIGINT) AS n_distinct, CAST(count(*) AS BIGINT) AS n_rows, "
    f"round(count(DISTINCT {c}) / count(*), 9) AS ratio, "
    f"CAST(count(DISTINCT {c}) / count(*) < 0.001 AS INTEGER) AS below_threshold FROM {DOC_LABELS_SQL}"
    for c in _RATIO_COLS))
def q_near_constant_cols(spark, sf_dir):
    """Exact distinct ratio per column (the drop rule's input)."""
    t = distinct_ratios(doc_labels(spark, sf_dir).drop("doc_id"))
    return t.select("column", "n_distinct", "n_rows", F.round("ratio", 9).alias("ratio"),
                    (F.col("ratio") < 0.001).cast("int").alias("below_threshold"))


def _clean_report_sql() -> str:
    cols = _RATIO_COLS
    num = ("quality", "toxic")
    dedup = f"SELECT DISTINCT {', '.join(cols)} FROM {DOC_LABELS_SQL}"
    fills = []
    for c in cols:
        if c in num:
            fills.append(f"coalesce(CAST({c} AS DOUBLE), (SELECT median({c}) FROM dd)) AS {c}")
        else:
            fills.append(f"trim(coalesce({c}, (SELECT {c} FROM dd WHERE {c} IS NOT NULL GROUP BY {c} "
                         f"ORDER BY count(*) DESC, {c} LIMIT 1)), {PY_WS_SQL}) AS {c}")
    ratios = " UNION ALL ".join(
        f"SELECT '{c}' AS c, count(DISTINCT {c}) / count(*) AS r FROM filled" for c in cols)
    nulls_before = " + ".join(f"(count(*) - count({c}))" for c in cols)
    nulls_after = " + ".join(f"(count(*) - count({c}))" for c in cols)
    return f"""
WITH dd AS ({dedup}),
filled AS (SELECT {', '.join(fills)} FROM dd),
ratios AS ({ratios})
SELECT
  CAST((SELECT count(*) FROM {DOC_LABELS_SQL}) - (SELECT count(*) FROM dd) AS BIGINT) AS duplicates_removed,
  CAST((SELECT {nulls_before} FROM dd) AS BIGINT) AS missing_before,
  CAST((SELECT {nulls_after} FROM filled) AS BIGINT) AS missing_after,
  coalesce((SELECT string_agg(c, ',' ORDER BY c) FROM ratios
            WHERE r < 0.001 AND c NOT IN ('Label', 'text_label', 'label')), '') AS constant_cols_dropped,
  CAST((SELECT count(*) FROM dd) AS BIGINT) AS rows_out
"""


@query("clean_report", _clean_report_sql())
def q_clean_report(spark, sf_dir):
    """Dedupe -> impute -> strip -> drop near-constant, reported as one row."""
    cleaned, rep = clean(doc_labels(spark, sf_dir).drop("doc_id"), mode="ratio")
    rows_out = cleaned.count()
    return spark.createDataFrame(
        [(rep.duplicates_removed, sum(rep.missing_before.values()), rep.missing_after,
          ",".join(sorted(rep.constant_cols_dropped)), rows_out)],
        "duplicates_removed bigint, missing_before bigint, missing_after bigint, constant_cols_dropped string, "
        "rows_out bigint")


_LINEITEM = (("l_orderkey", "integer"), ("l_partkey", "integer"), ("l_suppkey", "integer"),
             ("l_linenumber", "integer"), ("l_quantity", "float"), ("l_extendedprice", "float"),
             ("l_discount", "float"), ("l_tax", "float"), ("l_returnflag", "string"), ("l_linestatus", "string"),
             ("l_shipdate", "timestamp"))


def _family_sql(c: str) -> str:
    return (f"CASE WHEN typeof(any_value({c})) IN ('BIGINT','INTEGER','SMALLINT','TINYINT') THEN 'integer' "
            f"WHEN typeof(any_value({c})) IN ('DOUBLE','FLOAT') OR typeof(any_value({c})) LIKE 'DECIMAL%' THEN 'float' "
            f"WHEN typeof(any_value({c})) = 'VARCHAR' THEN 'string' "
            f"WHEN typeof(any_value({c})) LIKE 'TIMESTAMP%' OR typeof(any_value({c})) = 'DATE' THEN 'timestamp' "
            f"ELSE lower(typeof(any_value({c}))) END")


@query("table_profile", "\nUNION ALL\n".join(
    f"SELECT {i + 1} AS position, '{c}' AS \"column\", {_family_sql(c)} AS type_family, "
    f"CAST(count(*) AS BIGINT) AS n_rows, CAST(count({c}) AS BIGINT) AS n_non_null FROM lineitem"
    for i, (c, _) in enumerate(_LINEITEM)))
def q_table_profile(spark, sf_dir):
    """Shape, type family and non-null count per column."""
    return table_profile(read_table(spark, sf_dir, "lineitem"))

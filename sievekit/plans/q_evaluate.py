"""Queries for evaluation tables (M1-M8, H7, H8) on the scored corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.classes import BASE_CLASS_ORDER
from ..operators.enrich import class_name
from ..operators.evaluate import (
    classification_report, confusion_table, evaluate, overall_metrics, per_class_metrics, pr_curve, roc_auc, roc_curve,
)
from ..operators.features import add_payload_features
from ..operators.ordering import long_to_wide, wide_to_long
from ..session import read_table
from .catalog import query
from .corpus import scored_corpus, scored_corpus_sql

S = scored_corpus_sql()
PRED = "CASE prediction WHEN 1 THEN 'XSS' WHEN 2 THEN 'SQLi' WHEN 3 THEN 'Normal' ELSE CAST(prediction AS VARCHAR) END"
SCORES = {"XSS": "p_xss", "SQLi": "p_sqli", "Normal": "p_normal"}
R6 = ("precision", "recall", "f1")


def _named(spark, sf_dir):
    return scored_corpus(spark, sf_dir).withColumn("predicted", class_name("prediction"))


def _per_class_sql(source: str, actual: str, predicted: str, classes) -> str:
    vals = ", ".join(f"({i}, '{c}')" for i, c in enumerate(classes))
    return f"""
src AS (SELECT {actual} AS actual, {predicted} AS predicted FROM {source}),
grid AS (SELECT a.pos AS a_pos, a.c AS actual, p.pos AS p_pos, p.c AS predicted
         FROM (VALUES {vals}) a(pos, c), (VALUES {vals}) p(pos, c)),
conf AS (SELECT grid.a_pos, grid.actual, grid.p_pos, grid.predicted, CAST(coalesce(k.n, 0) AS BIGINT) AS n
         FROM grid LEFT JOIN (SELECT actual, predicted, count(*) AS n FROM src GROUP BY ALL) k
         ON k.actual = grid.actual AND k.predicted = grid.predicted),
pc AS (SELECT a_pos AS position, actual AS class, sum(CASE WHEN actual = predicted THEN n ELSE 0 END) AS tp, sum(n) AS support
       FROM conf GROUP BY ALL),
pt AS (SELECT predicted AS class, sum(n) AS pred_n FROM conf GROUP BY 1),
m0 AS (SELECT pc.*, pred_n, CASE WHEN pred_n = 0 THEN 0.0 ELSE tp / pred_n END AS precision,
              CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS recall FROM pc JOIN pt USING (class)),
m AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM m0)"""


PER_CLASS = _per_class_sql(S, "text_label", PRED, BASE_CLASS_ORDER)


@query("confusion_matrix", f"WITH {PER_CLASS}\nSELECT a_pos, actual, p_pos, predicted, n FROM conf")
def q_confusion_matrix(spark, sf_dir):
    """M5: confusion counts in class order, zero cells kept."""
    return confusion_table(_named(spark, sf_dir), "text_label", "predicted", BASE_CLASS_ORDER)


@query("metrics_overall", f"""WITH {PER_CLASS}
SELECT round(sum(tp) / sum(support), 6) AS accuracy, round(sum(precision * support) / sum(support), 6) AS precision,
       round(sum(recall * support) / sum(support), 6) AS recall, round(sum(f1 * support) / sum(support), 6) AS f1 FROM m""")
def q_metrics_overall(spark, sf_dir):
    """M1/M2: accuracy and weighted precision / recall / F1."""
    per = per_class_metrics(confusion_table(_named(spark, sf_dir), "text_label", "predicted", BASE_CLASS_ORDER))
    o = overall_metrics(per)
    return o.select(*[F.round(c, 6).alias(c) for c in ("accuracy", *R6)])


@query("classification_report", f"""WITH {PER_CLASS}
SELECT CAST(position AS INTEGER) AS position, class AS "row", round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM m
UNION ALL SELECT 1000, 'accuracy', NULL, NULL, round(sum(tp) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM m
UNION ALL SELECT 1001, 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM m
UNION ALL SELECT 1002, 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
                 round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM m""")
def q_classification_report(spark, sf_dir):
    """M6: per-class P/R/F1/support plus accuracy, macro and weighted rows."""
    per = per_class_metrics(confusion_table(_named(spark, sf_dir), "text_label", "predicted", BASE_CLASS_ORDER))
    r = classification_report(per)
    return r.select(F.col("position").cast("int"), "row", *[F.round(c, 6).alias(c) for c in R6], "support")


_BIN_SQL = """(SELECT l.quality AS actual,
  CASE WHEN round({ent}, 6) >= 4.2 THEN 1 ELSE 0 END AS predicted
  FROM documents d JOIN labels l ON l.doc_id = d.doc_id)"""


def _binary_sql() -> str:
    from .sqltext import sql_features
    src = _BIN_SQL.format(ent=sql_features("d.text")["payload_entropy"])
    return f"""WITH {_per_class_sql(src, 'actual', 'predicted', (0, 1)).replace("'0'", '0').replace("'1'", '1')}
SELECT round((SELECT sum(tp) / sum(support) FROM m), 6) AS accuracy, round(precision, 6) AS precision,
       round(recall, 6) AS recall, round(f1, 6) AS f1 FROM m WHERE class = 1"""


@query("metrics_binary", _binary_sql())
def q_metrics_binary(spark, sf_dir):
    """M3: two classes (document quality) -> metrics of the positive class."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    lab = read_table(spark, sf_dir, "labels").select("doc_id", "quality")
    f = add_payload_features(docs.join(lab, "doc_id"), "text")
    t = f.select(F.col("quality").alias("actual"),
                 F.when(F.round("payload_entropy", 6) >= 4.2, 1).otherwise(0).alias("predicted"))
    m = evaluate(t, "actual", "predicted", [0, 1])
    return m.select(*[F.round(c, 6).alias(c) for c in ("accuracy", *R6)])


_GAPS_SQL = """WITH src AS (SELECT lang AS actual, CASE WHEN n_chars % 5 = 0 THEN NULL WHEN n_chars % 7 = 0 THEN 'xx'
                    WHEN n_chars % 3 = 0 THEN 'en' ELSE lang END AS predicted FROM documents),
n AS (SELECT count(*) AS n, count(*) FILTER (WHERE actual = predicted AND actual IN ('en', 'fr', 'de')) AS hit FROM src),
c AS (SELECT k.c, count(*) FILTER (WHERE actual = k.c) AS support, count(*) FILTER (WHERE predicted = k.c) AS pred,
             count(*) FILTER (WHERE actual = k.c AND predicted = k.c) AS tp
      FROM (VALUES ('en'), ('fr'), ('de')) k(c), src GROUP BY k.c),
m AS (SELECT support, CASE WHEN pred = 0 THEN 0.0 ELSE tp / pred END AS p, CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS r FROM c)
SELECT round(max(hit / n), 6) AS accuracy, round(sum(support * p) / max(n), 6) AS precision, round(sum(support * r) / max(n), 6) AS recall,
       round(sum(support * CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END) / max(n), 6) AS f1 FROM m, n"""


@query("metrics_with_gaps", _GAPS_SQL)
def q_metrics_with_gaps(spark, sf_dir):
    """M1/M2 when predictions are missing and labels or predictions lie
    outside the class list: every row stays in the denominators."""
    d = read_table(spark, sf_dir, "documents").select(
        F.col("lang").alias("actual"),
        F.when(F.col("n_chars") % 5 == 0, None).when(F.col("n_chars") % 7 == 0, "xx").when(F.col("n_chars") % 3 == 0, "en")
        .otherwise(F.col("lang")).alias("predicted"))
    o = overall_metrics(per_class_metrics(confusion_table(d, "actual", "predicted", ("en", "fr", "de"))))
    return o.select(*[F.round(c, 6).alias(c) for c in ("accuracy", *R6)])


@query("metrics_long", f"""WITH {PER_CLASS}
SELECT class, 'precision' AS metric, round(precision, 6) AS value FROM m
UNION ALL SELECT class, 'recall', round(recall, 6) FROM m
UNION ALL SELECT class, 'f1', round(f1, 6) FROM m""")
def q_metrics_long(spark, sf_dir):
    """H7: per-class metric table melted to (class, metric, value)."""
    per = per_class_metrics(confusion_table(_named(spark, sf_dir), "text_label", "predicted", BASE_CLASS_ORDER))
    wide = per.select("class", *[F.round(c, 6).alias(c) for c in R6])
    return wide_to_long(wide, ["class"], list(R6))


@query("metrics_wide", f"""WITH {PER_CLASS}
SELECT 'precision' AS metric, {', '.join(f"max(CASE WHEN class = '{c}' THEN round(precision, 6) END) AS {c}" for c in BASE_CLASS_ORDER)} FROM m
UNION ALL SELECT 'recall', {', '.join(f"max(CASE WHEN class = '{c}' THEN round(recall, 6) END)" for c in BASE_CLASS_ORDER)} FROM m
UNION ALL SELECT 'f1', {', '.join(f"max(CASE WHEN class = '{c}' THEN round(f1, 6) END)" for c in BASE_CLASS_ORDER)} FROM m""")
def q_metrics_wide(spark, sf_dir):
    """H8: the long table transposed to one row per metric, one column per class."""
    per = per_class_metrics(confusion_table(_named(spark, sf_dir), "text_label", "predicted", BASE_CLASS_ORDER))
    long = wide_to_long(per.select("class", *[F.round(c, 6).alias(c) for c in R6]), ["class"], list(R6))
    return long_to_wide(long, ["metric"], "class", "value", list(BASE_CLASS_ORDER))


def _curve_cte() -> str:
    longs = " UNION ALL ".join(
        f"SELECT '{c}' AS class, CAST(text_label = '{c}' AS INTEGER) AS y, {s} AS score FROM s" for c, s in SCORES.items())
    return f"""WITH s AS {S}, lg AS ({longs}),
g AS (SELECT class, score, sum(y) AS tp, sum(1 - y) AS fp FROM lg GROUP BY ALL),
c AS (SELECT class, score, tp, fp,
        sum(tp) OVER (PARTITION BY class ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ctp,
        sum(fp) OVER (PARTITION BY class ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cfp,
        sum(tp) OVER (PARTITION BY class) AS P, sum(fp) OVER (PARTITION BY class) AS N FROM g)"""


@query("roc_curve", f"""{_curve_cte()}
SELECT class, score AS threshold, round(cfp / N, 6) AS fpr, round(ctp / P, 6) AS tpr FROM c
UNION ALL SELECT DISTINCT class, CAST('infinity' AS DOUBLE), 0.0, 0.0 FROM c""")
def q_roc_curve(spark, sf_dir):
    """M7: one-vs-rest ROC points per class."""
    r = roc_curve(scored_corpus(spark, sf_dir), "text_label", SCORES)
    return r.select("class", "threshold", F.round("fpr", 6).alias("fpr"), F.round("tpr", 6).alias("tpr"))


@query("roc_auc", f"""{_curve_cte()}
SELECT class, round(sum(fp * (2 * ctp - tp) / (2.0 * P * N)), 6) AS auc FROM c GROUP BY class""")
def q_roc_auc(spark, sf_dir):
    """M7: trapezoidal ROC AUC per class."""
    return roc_auc(scored_corpus(spark, sf_dir), "text_label", SCORES).select("class", F.round("auc", 6).alias("auc"))


@query("pr_curve", f"""{_curve_cte()}
SELECT class, score AS threshold, round(ctp / (ctp + cfp), 6) AS precision, round(ctp / P, 6) AS recall FROM c
UNION ALL SELECT DISTINCT class, CAST(NULL AS DOUBLE), 1.0, 0.0 FROM c""")
def q_pr_curve(spark, sf_dir):
    """M8: precision-recall points per class with the (1, 0) end point."""
    r = pr_curve(scored_corpus(spark, sf_dir), "text_label", SCORES)
    return r.select("class", "threshold", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))

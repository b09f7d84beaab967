"""Queries for summaries, lookups and ordering."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.classes import DEMO_CLASS_ORDER
from ..functions.dialect import FEATURE_COLUMNS
from ..functions.text import epoch_micros
from ..operators.aggregates import (
    box_stats, correlation_pairs, equal_width_histogram, equality_tally, group_mean_pct, iqr_outliers,
    proportions, reindexed_counts, rollup_counts,
)
from ..operators.enrich import class_name, enrich_severity
from ..operators.features import add_payload_features
from ..operators.ordering import exact_sample, top_k, top_k_per_group
from ..session import read_table
from .catalog import query
from .corpus import CORPUS_SQL, labelled_corpus, scored_corpus, scored_corpus_sql
from .sqltext import sql_features

S = scored_corpus_sql()
PRED_NAME_SQL = "CASE prediction WHEN 1 THEN 'XSS' WHEN 2 THEN 'SQLi' WHEN 3 THEN 'Normal' ELSE CAST(prediction AS VARCHAR) END"


@query("class_counts", f"""
SELECT Label, CASE Label WHEN 1 THEN 'XSS' WHEN 2 THEN 'SQLi' WHEN 3 THEN 'Normal' END AS class_name,
       CAST(count(*) AS BIGINT) AS n
FROM {CORPUS_SQL} GROUP BY Label
""")
def q_class_counts(spark, sf_dir):
    """Counts per label code, with the class name."""
    c = labelled_corpus(spark, sf_dir).select("Label")
    return c.groupBy("Label").agg(F.count(F.lit(1)).alias("n")).select(
        "Label", class_name("Label").alias("class_name"), "n")


@query("class_share", f"""
SELECT text_label, CAST(n AS BIGINT) AS n, round(n / sum(n) OVER (), 3) * 100 AS share_pct
FROM (SELECT text_label, count(*) AS n FROM {CORPUS_SQL} GROUP BY text_label)
""")
def q_class_share(spark, sf_dir):
    """A2: share of each class in percent."""
    return proportions(labelled_corpus(spark, sf_dir).select("text_label"), "text_label")


@query("class_counts_full", f"""
WITH dim AS (SELECT * FROM (VALUES (0, 'Normal'), (1, 'XSS'), (2, 'SQLi')) AS t(position, predicted)),
c AS (SELECT {PRED_NAME_SQL} AS predicted, count(*) AS n FROM {S} GROUP BY 1)
SELECT CAST(position AS INTEGER) AS position, dim.predicted, CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM dim LEFT JOIN c ON c.predicted = dim.predicted
""")
def q_class_counts_full(spark, sf_dir):
    """A3: predicted-class counts in the fixed class order, zeros kept."""
    s = scored_corpus(spark, sf_dir).select(class_name("prediction").alias("predicted"))
    return reindexed_counts(s, "predicted", DEMO_CLASS_ORDER)


@query("batch_summary", f"""
SELECT {PRED_NAME_SQL} AS predicted, CAST(count(*) AS BIGINT) AS n FROM {S} GROUP BY 1
UNION ALL SELECT 'Total', CAST(count(*) AS BIGINT) FROM {S}
""")
def q_batch_summary(spark, sf_dir):
    """A4: per-class counts of a scored batch plus the total (rollup)."""
    s = scored_corpus(spark, sf_dir).select(class_name("prediction").alias("predicted"))
    return rollup_counts(s, "predicted")


@query("keyword_hit_rate", f"""
SELECT text_label, round(avg(kw_sql) * 100, 6) AS kw_sql_pct, round(avg(kw_xss) * 100, 6) AS kw_xss_pct FROM {S} GROUP BY 1
""")
def q_keyword_hit_rate(spark, sf_dir):
    """A5: keyword hit rate per class in percent."""
    return group_mean_pct(scored_corpus(spark, sf_dir), "text_label", ["kw_sql", "kw_xss"])


@query("prediction_tally", f"""
SELECT CAST(sum(CASE WHEN Label = prediction THEN 1 ELSE 0 END) AS BIGINT) AS correct,
       CAST(sum(CASE WHEN Label = prediction THEN 0 ELSE 1 END) AS BIGINT) AS incorrect FROM {S}
""")
def q_prediction_tally(spark, sf_dir):
    """Correct / incorrect predictions."""
    return equality_tally(scored_corpus(spark, sf_dir), "Label", "prediction")


@query("entropy_histogram", f"""
WITH s AS {S},
r AS (SELECT text_label, min(payload_entropy) AS mn, max(payload_entropy) AS mx FROM s GROUP BY 1),
c AS (SELECT s.text_label, CAST(CASE WHEN mx = mn THEN 0 ELSE least(floor((payload_entropy - mn) / (mx - mn) * 40), 39) END AS INTEGER) AS bin,
             count(*) AS n FROM s JOIN r USING (text_label) GROUP BY ALL),
d AS (SELECT text_label, mn, mx, CAST(unnest(range(0, 40)) AS INTEGER) AS bin FROM r)
SELECT d.text_label, d.bin, round(mn + d.bin * ((mx - mn) / 40), 6) AS lo, round(mn + (d.bin + 1) * ((mx - mn) / 40), 6) AS hi,
       CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM d LEFT JOIN c ON c.text_label = d.text_label AND c.bin = d.bin
""")
def q_entropy_histogram(spark, sf_dir):
    """40 equal-width entropy bins per class, last bin closed, empty bins kept."""
    h = equal_width_histogram(scored_corpus(spark, sf_dir, True).select("text_label", "payload_entropy"), "payload_entropy", 40, ["text_label"])
    return h.select("text_label", "bin", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), "n")


@query("box_stats", f"""
WITH s AS {S},
q AS (SELECT text_label, quantile_cont(payload_len, 0.25) AS q1, quantile_cont(payload_len, 0.5) AS median,
             quantile_cont(payload_len, 0.75) AS q3 FROM s GROUP BY 1),
f AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lo_fence, q3 + 1.5 * (q3 - q1) AS hi_fence FROM q)
SELECT f.text_label, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(iqr, 6) AS iqr,
  round(lo_fence, 6) AS lo_fence, round(hi_fence, 6) AS hi_fence,
  CAST(min(CASE WHEN payload_len BETWEEN lo_fence AND hi_fence THEN payload_len END) AS DOUBLE) AS whisker_lo,
  CAST(max(CASE WHEN payload_len BETWEEN lo_fence AND hi_fence THEN payload_len END) AS DOUBLE) AS whisker_hi,
  CAST(sum(CASE WHEN payload_len BETWEEN lo_fence AND hi_fence THEN 0 ELSE 1 END) AS BIGINT) AS n_outliers,
  CAST(count(*) AS BIGINT) AS n
FROM s JOIN f USING (text_label) GROUP BY ALL
""")
def q_box_stats(spark, sf_dir):
    """A10: box-plot statistics of payload length per class."""
    b = box_stats(scored_corpus(spark, sf_dir, True), "payload_len", ["text_label"])
    return b.select("text_label", *[F.round(c, 6).alias(c) for c in ("q1", "median", "q3", "iqr", "lo_fence", "hi_fence")],
                    "whisker_lo", "whisker_hi", "n_outliers", "n")


def _iqr_sql() -> str:
    parts = []
    for c in FEATURE_COLUMNS:
        parts.append(f"""SELECT '{c}' AS "column", round(q1, 6) AS q1, round(q3, 6) AS q3,
  round(q1 - 1.5 * (q3 - q1), 6) AS lo_fence, round(q3 + 1.5 * (q3 - q1), 6) AS hi_fence,
  CAST((SELECT count(*) FROM s WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS BIGINT) AS n_outliers
FROM (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM s)""")
    return f"WITH s AS {S}\n" + "\nUNION ALL\n".join(parts)


@query("iqr_outliers", _iqr_sql())
def q_iqr_outliers(spark, sf_dir):
    """1.5 IQR fences and outlier counts of the seven features."""
    t = iqr_outliers(scored_corpus(spark, sf_dir, True), list(FEATURE_COLUMNS))
    return t.select("column", *[F.round(c, 6).alias(c) for c in ("q1", "q3", "lo_fence", "hi_fence")], "n_outliers")


_CORR_COLS = [*FEATURE_COLUMNS, "Label"]


@query("feature_correlation", f"WITH s AS {S}\n" + "\nUNION ALL\n".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 6) AS corr FROM s"
    for i, a in enumerate(_CORR_COLS) for b in _CORR_COLS[:i]))
def q_feature_correlation(spark, sf_dir):
    """Pearson correlations of features and label, lower triangle."""
    return correlation_pairs(scored_corpus(spark, sf_dir), _CORR_COLS)


@query("severity_enrich", f"""
SELECT ID, label_demo, coalesce(sd.sev, 'UNKNOWN') AS demo_severity, CAST(coalesce(sd.score, 50) AS INTEGER) AS demo_severity_score,
       predicted, coalesce(sb.sev, 'UNKNOWN') AS base_severity, CAST(coalesce(sb.score, 50) AS INTEGER) AS base_severity_score
FROM (SELECT ID, CASE Label WHEN 0 THEN 'Normal' WHEN 1 THEN 'XSS' WHEN 2 THEN 'SQLi' ELSE CAST(Label AS VARCHAR) END AS label_demo,
             {PRED_NAME_SQL} AS predicted FROM {S}) s
LEFT JOIN (VALUES ('Normal', 'SAFE', 5), ('XSS', 'HIGH', 75), ('SQLi', 'CRITICAL', 95)) AS sd(lbl, sev, score) ON sd.lbl = s.label_demo
LEFT JOIN (VALUES ('XSS', 'CRITICAL', 95), ('SQLi', 'HIGH', 85), ('Normal', 'SAFE', 10)) AS sb(lbl, sev, score) ON sb.lbl = s.predicted
""")
def q_severity_enrich(spark, sf_dir):
    """J1 with both severity tables; label codes read with the demo code map
    (code 3 is unknown there and gets UNKNOWN / 50)."""
    s = scored_corpus(spark, sf_dir).select(
        "ID", class_name("Label", "demo").alias("label_demo"), class_name("prediction", "base").alias("predicted"))
    s = enrich_severity(s, "label_demo", "demo", prefix="demo_")
    s = enrich_severity(s, "predicted", "base", prefix="base_")
    return s.select("ID", "label_demo", "demo_severity", "demo_severity_score", "predicted", "base_severity",
                    "base_severity_score")


@query("label_names", f"""
SELECT ID, Label, CASE Label WHEN 1 THEN 'XSS' WHEN 2 THEN 'SQLi' WHEN 3 THEN 'Normal' ELSE CAST(Label AS VARCHAR) END AS base_name,
       CASE Label WHEN 0 THEN 'Normal' WHEN 1 THEN 'XSS' WHEN 2 THEN 'SQLi' ELSE CAST(Label AS VARCHAR) END AS demo_name
FROM {CORPUS_SQL}
""")
def q_label_names(spark, sf_dir):
    """class-name resolution with both code maps."""
    return labelled_corpus(spark, sf_dir).select(
        "ID", "Label", class_name("Label", "base").alias("base_name"), class_name("Label", "demo").alias("demo_name"))


_FDOC = sql_features("text")


@query("rank_sources", f"""
SELECT source, avg_entropy, CAST(row_number() OVER (ORDER BY avg_entropy DESC, source) AS INTEGER) AS rank
FROM (SELECT source, round(avg({_FDOC['payload_entropy']}), 6) AS avg_entropy FROM documents GROUP BY source)
""")
def q_rank_sources(spark, sf_dir):
    """H1: sources ranked by mean entropy (grouped first, then ranked)."""
    from pyspark.sql import Window
    d = add_payload_features(read_table(spark, sf_dir, "documents").select("source", "text"), "text")
    g = d.groupBy("source").agg(F.round(F.avg("payload_entropy"), 6).alias("avg_entropy"))
    w = Window.orderBy(F.desc("avg_entropy"), F.asc("source"))  # over the grouped rows only
    return g.withColumn("rank", F.row_number().over(w).cast("int"))


@query("topk_entropy", f"""
SELECT doc_id, round({_FDOC['payload_entropy']}, 6) AS payload_entropy FROM documents
ORDER BY payload_entropy DESC, doc_id LIMIT 10
""")
def q_topk_entropy(spark, sf_dir):
    """H2: the ten highest-entropy documents (top-k report)."""
    d = add_payload_features(read_table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    d = d.select("doc_id", F.round("payload_entropy", 6).alias("payload_entropy"))
    return top_k(d, 10, [F.desc("payload_entropy"), F.asc("doc_id")])


@query("recent_scans", """
SELECT event_id, epoch_us(ts) AS ts_us, user_id, event_type FROM events ORDER BY ts DESC, event_id LIMIT 50
""")
def q_recent_scans(spark, sf_dir):
    """H4: the 50 most recent entries of the scan log."""
    e = read_table(spark, sf_dir, "events")
    t = top_k(e, 50, [F.desc("ts"), F.asc("event_id")])
    return t.select("event_id", epoch_micros("ts").alias("ts_us"), "user_id", "event_type")


@query("recent_per_user", """
SELECT user_id, event_id, epoch_us(ts) AS ts_us, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS rank FROM events
) WHERE rank <= 50
""")
def q_recent_per_user(spark, sf_dir):
    """H4 per user: newest 50 per user (partial WindowGroupLimit before the shuffle)."""
    e = read_table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    t = top_k_per_group(e, ["user_id"], [F.desc("ts"), F.asc("event_id")], 50)
    return t.select("user_id", "event_id", epoch_micros("ts").alias("ts_us"), F.col("rank").cast("int"))


@query("sample_exact", """
SELECT event_id, user_id, event_type FROM events ORDER BY md5('42|' || CAST(event_id AS VARCHAR)), event_id LIMIT 3000
""")
def q_sample_exact(spark, sf_dir):
    """H5: exactly min(3000, n) events by seeded hash order."""
    e = read_table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return exact_sample(e, 3000, "event_id", seed=42)

"""Queries for sources/sinks (S1-S4), feature selection (X1-X5) and the
re-aimed streaming jobs (L1, L2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dialect import FEATURE_COLUMNS
from ..functions.text import epoch_micros
from ..operators.select import (
    mutual_information, pca_project, recursive_elimination, rf_importances, select_from_model, select_k_best,
)
from ..session import read_table
from ..sources.io import read_labelled_csv, scratch_path, write_csv
from ..streaming.live import latest_per_key, run_available_now, run_update_to_table, table_stream, windowed_label_counts
from .catalog import ORACLE, query
from .corpus import scored_corpus, scored_corpus_sql

FEATS = list(FEATURE_COLUMNS)
S = scored_corpus_sql()


@query("scan_csv_roundtrip", "SELECT doc_id AS ID, text AS Payload, lang AS text_label, CAST(3 AS BIGINT) AS Label FROM documents")
def q_scan_csv_roundtrip(spark, sf_dir):
    """Documents written as quoted multi-line CSV, read back with the
    labelled schema and NA tokens (texts keep quotes, commas and newlines)."""
    docs = read_table(spark, sf_dir, "documents").select(
        F.col("text").alias("Payload"), F.lit(3).cast("bigint").alias("Label"), F.col("lang").alias("text_label"),
        F.col("doc_id").alias("ID"))
    path = scratch_path(spark, "csv")
    write_csv(docs, path)
    return read_labelled_csv(spark, path)


def _mi_sql(bins: int = 10) -> str:
    probs = ", ".join(str(i / bins) for i in range(1, bins))
    parts = []
    for c in FEATS:
        parts.append(f"""SELECT '{c}' AS feature, y, len(list_filter(cuts, lambda q: q < x)) AS b FROM
  (SELECT Label AS y, CAST({c} AS DOUBLE) AS x FROM s),
  (SELECT quantile_cont(CAST({c} AS DOUBLE), [{probs}]) AS cuts FROM s)""")
    return f"""WITH s AS {S}, bb AS ({' UNION ALL '.join(parts)}),
j AS (SELECT feature, b, y, count(*) AS n_by FROM bb GROUP BY ALL),
t AS (SELECT *, sum(n_by) OVER (PARTITION BY feature) AS n, sum(n_by) OVER (PARTITION BY feature, b) AS n_b,
             sum(n_by) OVER (PARTITION BY feature, y) AS n_y FROM j),
mi AS (SELECT feature, sum((n_by / n) * ln((n_by * n) / (n_b * n_y))) AS mi FROM t GROUP BY feature),
pos AS (SELECT * FROM (VALUES {', '.join(f"('{c}', {i})" for i, c in enumerate(FEATS))}) AS p(feature, position))
SELECT feature, round(mi, 6) AS mi, CAST(row_number() OVER (ORDER BY round(mi, 6) DESC, position) AS INTEGER) AS rank,
       CAST(row_number() OVER (ORDER BY round(mi, 6) DESC, position) <= 5 AS INTEGER) AS selected
FROM mi JOIN pos USING (feature)"""


def _psi(n: str) -> str:
    x = f"({n} + 10.0)"
    series = f"ln({x}) - 1 / (2 * {x}) - 1 / (12 * {x} ** 2) + 1 / (120 * {x} ** 4) - 1 / (252 * {x} ** 6) + 1 / (240 * {x} ** 8)"
    return f"({series} - ({' + '.join(f'1 / ({n} + {j}.0)' for j in range(10))}))"


def _mi_knn_sql(k: int = 3) -> str:
    parts = " UNION ALL ".join(f"SELECT '{c}' AS feature, Label AS y, CAST({c} AS DOUBLE) AS x FROM s" for c in FEATS)
    return f"""WITH s AS {S}, l AS ({parts}),
d AS (SELECT feature, y, x, count(*) AS c, sum(count(*)) OVER (PARTITION BY feature, y) AS n_y FROM l GROUP BY feature, y, x),
e AS (SELECT * FROM d WHERE n_y > 1),
nb AS (SELECT a.feature, a.y, a.x, abs(a.x - b.x) AS dist,
              sum(b.c - CASE WHEN a.x = b.x THEN 1 ELSE 0 END) OVER (PARTITION BY a.feature, a.y, a.x ORDER BY abs(a.x - b.x)) AS upto, least({k}, a.n_y - 1) AS k
       FROM e a JOIN e b ON a.feature = b.feature AND a.y = b.y),
r AS (SELECT feature, y, x, min(dist) AS r FROM nb WHERE upto >= k GROUP BY feature, y, x),
m AS (SELECT r.feature, r.y, r.x, sum(b.c) AS m FROM r JOIN e b ON r.feature = b.feature
        AND ((r.r > 0 AND b.x > r.x - r.r AND b.x < r.x + r.r) OR (r.r = 0 AND b.x = r.x)) GROUP BY r.feature, r.y, r.x),
p AS (SELECT e.feature, e.c, e.n_y, m.m, CASE WHEN r.r = 0 THEN e.c ELSE least({k}, e.n_y - 1) END AS k
      FROM e JOIN r USING (feature, y, x) JOIN m USING (feature, y, x))
SELECT feature, round(greatest({_psi('sum(c)')} + (sum(c * {_psi('k')}) - sum(c * {_psi('n_y')}) - sum(c * {_psi('m')})) / sum(c), 0.0), 6) AS mi
FROM p GROUP BY feature"""


@query("mutual_information_knn", _mi_knn_sql())
def q_mutual_information_knn(spark, sf_dir):
    """Nearest-neighbour estimate of each feature's mutual information
    with the class."""
    from ..operators.neighbours import mutual_information_knn

    s = scored_corpus(spark, sf_dir, counted=True).select("Label", *FEATS)
    return mutual_information_knn(s, FEATS, "Label").withColumn("mi", F.round("mi", 6))


@query("mutual_information", _mi_sql())
def q_mutual_information(spark, sf_dir):
    """Binned mutual information of each feature with the class, top-5 selected."""
    s = scored_corpus(spark, sf_dir, True)
    mi = mutual_information(s, FEATS, "Label").withColumn("mi", F.round("mi", 6))
    return select_k_best(mi, 5, FEATS).select("feature", "mi", F.col("rank").cast("int"), "selected")


@query("rf_importance")
def q_rf_importance(spark, sf_dir):
    """Random-forest importances (sum 1) and the mean-threshold selection."""
    s = scored_corpus(spark, sf_dir, True).select("Label", *FEATS)
    return select_from_model(rf_importances(s, FEATS, "Label"), "mean")


@query("rfe_select")
def q_rfe_select(spark, sf_dir):
    """Recursive elimination down to four features."""
    s = scored_corpus(spark, sf_dir, True).select("Label", *FEATS)
    kept = recursive_elimination(s, FEATS, "Label", 4)
    return spark.createDataFrame([(f, i) for i, f in enumerate(kept)], "feature string, position int")


@query("pca_project")
def q_pca_project(spark, sf_dir):
    """Centred 2-D PCA of the seven features, with the class."""
    s = scored_corpus(spark, sf_dir, True)
    return pca_project(s, FEATS, 2, keep=("ID", "text_label"))


@query("label_counts_by_window", """
SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS window_start_us, event_type, CAST(count(*) AS BIGINT) AS n
FROM events GROUP BY ALL
""")
def q_label_counts_by_window(spark, sf_dir):
    """L2 batch twin: counts per event type and tumbling hour."""
    e = read_table(spark, sf_dir, "events")
    g = e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return g.select(epoch_micros("w.start").alias("window_start_us"), "event_type", "n")


@query("stream_label_counts", ORACLE["label_counts_by_window"])
def q_stream_label_counts(spark, sf_dir):
    """L2: the same counts from a watermarked Structured Streaming job over
    the scan-log files (update mode, foreachBatch sink, availableNow)."""
    e = read_table(spark, sf_dir, "events")
    # watermarks need TIMESTAMP: read the wall-clock NTZ value as a UTC instant
    # (independent of the session time zone)
    stream = table_stream(spark, sf_dir, "events", e.schema).withColumn("ts", F.timestamp_micros(epoch_micros("ts")))
    counts = windowed_label_counts(stream, "ts", "event_type").select(
        F.col("w.start").alias("window_start"), "event_type", "n")
    sink, ck = scratch_path(spark, "l2-sink"), scratch_path(spark, "l2-ckpt")
    run_update_to_table(counts, sink, ck)
    out = latest_per_key(spark.read.parquet(sink), ["window_start", "event_type"], "n")
    return out.select(F.unix_micros("window_start").alias("window_start_us"), "event_type", "n")


@query("live_history", ORACLE["recent_per_user"])
def q_live_history(spark, sf_dir):
    """L1: newest 50 entries per user from a stream of the scan log, kept as
    keyed state; the second start finds nothing new."""
    from ..streaming.history import history, recent_entries

    e = read_table(spark, sf_dir, "events")
    sink, ck = scratch_path(spark, "l1-history"), scratch_path(spark, "l1-history-ckpt")
    for _ in range(2):
        stream = table_stream(spark, sf_dir, "events", e.schema).withColumn("ts", F.timestamp_micros(epoch_micros("ts")))
        run_update_to_table(recent_entries(stream, "user_id", "event_id", "ts"), sink, ck)
    out = history(spark.read.parquet(sink))
    return out.select(F.col("user").alias("user_id"), F.col("entry").alias("event_id"), "ts_us", F.col("rank").cast("int").alias("rank"))


@query("stream_scoring")
def q_stream_scoring(spark, sf_dir):
    """L1: benchmark texts streamed through a pipeline trained on the corpus,
    with severity, appended to a Parquet history."""
    from ..operators.training import load_artifact
    from ..streaming.live import live_scoring
    from .training import saved_model

    model = load_artifact(spark, saved_model(spark, sf_dir, "RandomForest"))
    stream = table_stream(spark, sf_dir, "benchmark", read_table(spark, sf_dir, "benchmark").schema) \
        .select("item_id", F.col("text").alias("payload"))
    scored = live_scoring(stream, model.model, model.labels).select(
        "item_id", "payload", "label", "confidence", "severity", "severity_score", *FEATS)
    sink, ck = scratch_path(spark, "l1-sink"), scratch_path(spark, "l1-ckpt")
    run_available_now(scored, sink, ck)
    return spark.read.parquet(sink)

"""Streaming equals batch; sources and sinks round-trip."""

import os
import tempfile

from pyspark.sql import functions as F

import __spark_entry__ as entry
from sievekit.sources.io import (
    read_first_column_csv, read_labelled_csv, read_metrics_report, read_or_materialize, read_text_lines, write_csv,
)

from conftest import SF001


def test_stream_counts_equal_batch(spark):
    q = entry.queries()
    a = sorted(tuple(r) for r in q["stream_label_counts"](spark, SF001).select("window_start_us", "event_type", "n").collect())
    b = sorted(tuple(r) for r in q["label_counts_by_window"](spark, SF001).select("window_start_us", "event_type", "n").collect())
    assert a == b


def _folder_tables(spark, name):
    """sf0.001 with one table as a folder of part files, the others as they are."""
    d = tempfile.mkdtemp()
    for f in os.listdir(SF001):
        if f != f"{name}.parquet":
            os.symlink(os.path.join(SF001, f), os.path.join(d, f))
    spark.read.parquet(os.path.join(SF001, f"{name}.parquet")).repartition(3).write.parquet(os.path.join(d, f"{name}.parquet"))
    return d


def test_stream_counts_of_a_folder_table(spark):
    """L2: a table of several part files is streamed whole; a single file still is."""
    q, d = entry.queries(), _folder_tables(spark, "events")
    got = sorted(tuple(r) for r in q["stream_label_counts"](spark, d).select("window_start_us", "event_type", "n").collect())
    want = sorted(tuple(r) for r in q["label_counts_by_window"](spark, d).select("window_start_us", "event_type", "n").collect())
    assert got == want and sum(r[2] for r in got) == spark.read.parquet(os.path.join(d, "events.parquet")).count() > 0


def test_stream_scoring_of_a_folder_table(spark):
    """L1: as many rows are scored as the batch reader finds, and the same as from a single file."""
    q, d = entry.queries(), _folder_tables(spark, "benchmark")
    cols = ["item_id", "payload", "label", "severity"]
    got = sorted(tuple(r) for r in q["stream_scoring"](spark, d).select(*cols).collect())
    texts = spark.read.parquet(os.path.join(d, "benchmark.parquet")).where(F.length(F.trim("text")) > 0)
    assert len(got) == texts.count() > 0
    assert [r[:2] for r in got] == [r[:2] for r in sorted(tuple(r) for r in q["stream_scoring"](spark, SF001).select(*cols).collect())]


def test_table_stream_of_partitioned_folders(spark):
    """Partition columns come along, also beside a single-file table."""
    from sievekit.streaming.live import run_available_now, table_stream

    d = tempfile.mkdtemp()
    spark.range(10).selectExpr("id", "id % 3 AS part").write.partitionBy("part").parquet(os.path.join(d, "a.parquet"))
    os.symlink(os.path.join(SF001, "events.parquet"), os.path.join(d, "events.parquet"))
    for name in ("a", "events"):
        batch = spark.read.parquet(os.path.join(d, f"{name}.parquet"))
        out, ck = os.path.join(d, f"out-{name}"), os.path.join(d, f"ck-{name}")
        run_available_now(table_stream(spark, d, name, batch.schema), out, ck)
        back = spark.read.parquet(out).select(*batch.columns)
        assert back.count() == batch.count() > 0 and back.exceptAll(batch).count() == 0


def test_csv_roundtrip_and_na_tokens(spark):
    d = tempfile.mkdtemp()
    rows = [('a "quoted", multi\nline', 1, "XSS", 1), ("NULL", 2, "SQLi", 2), ("  x ", 3, "N/A", 3)]
    df = spark.createDataFrame(rows, "Payload string, Label bigint, text_label string, ID bigint")
    write_csv(df, os.path.join(d, "c"))
    back = {r["ID"]: r for r in read_labelled_csv(spark, os.path.join(d, "c")).collect()}
    assert back[1]["Payload"] == 'a "quoted", multi\nline'
    assert back[2]["Payload"] is None and back[3]["text_label"] is None
    cached = read_or_materialize(spark, os.path.join(d, "pq"), lambda: df)
    assert cached.count() == 3 and read_or_materialize(spark, os.path.join(d, "pq"), None).count() == 3


def test_text_and_first_column(spark):
    d = tempfile.mkdtemp()
    with open(os.path.join(d, "p.txt"), "w") as fh:
        fh.write("  <script>\n\n1' OR 1=1 \n   \nhello\n")
    assert [r[0] for r in read_text_lines(spark, os.path.join(d, "p.txt")).collect()] == ["<script>", "1' OR 1=1", "hello"]
    with open(os.path.join(d, "f.csv"), "w") as fh:
        fh.write('payload,other\n"a\nb",1\nc,2\n')
    assert sorted(r[0] for r in read_first_column_csv(spark, os.path.join(d, "f.csv")).collect()) == ["a", "b", "c"]
    assert read_metrics_report(spark, os.path.join(d, "missing.csv")).count() == 0


def test_live_scoring_stream_equals_batch(spark):
    """L1: the streaming scorer returns exactly what the same transform gives in batch."""
    from sievekit.functions.dialect import FEATURE_COLUMNS
    from sievekit.operators.models import DEFAULT_MODELS, build_pipeline
    from sievekit.plans.training import _prepared
    from sievekit.streaming.live import live_scoring, run_available_now

    data, train, _t, idx = _prepared(spark, SF001)
    model = build_pipeline(DEFAULT_MODELS["DecisionTree"], list(FEATURE_COLUMNS), train.count(), len(idx.labels)).fit(train)
    data.unpersist()
    payloads = spark.createDataFrame([(1, " <script>alert(1)</script> "), (2, "1' OR '1'='1'--"), (3, "   "),
                                      (4, "What is the weather today?")], "item_id int, payload string")
    d = tempfile.mkdtemp()
    payloads.write.parquet(os.path.join(d, "src"))
    stream = spark.readStream.schema(payloads.schema).parquet(os.path.join(d, "src"))
    cols = ["item_id", "label", "severity", "severity_score"]
    run_available_now(live_scoring(stream, model, list(idx.labels)).select(*cols), os.path.join(d, "out"),
                      os.path.join(d, "ck"))
    got = sorted(tuple(r) for r in spark.read.parquet(os.path.join(d, "out")).collect())
    want = sorted(tuple(r) for r in live_scoring(payloads, model, list(idx.labels)).select(*cols).collect())
    assert got == want and len(got) == 3  # the blank payload is dropped


def test_metadata_report_and_model_io(spark):
    """S7 metadata JSON, S9 text report, S10 model save / first-readable load."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import VectorAssembler

    from sievekit.operators.evaluate import classification_report, confusion_table, per_class_metrics
    from sievekit.operators.models import FeatureScaler
    from sievekit.sources.io import load_model, read_metadata, save_model, write_metadata, write_text_report

    d = tempfile.mkdtemp()
    meta = spark.createDataFrame([("RandomForest", 0.97, ["payload_len", "kw_xss"], 13120)],
                                 "best_model string, final_f1 double, features array<string>, train_rows bigint")
    write_metadata(meta, os.path.join(d, "meta"))
    back = read_metadata(spark, os.path.join(d, "meta")).collect()[0]
    assert back["best_model"] == "RandomForest" and back["features"] == ["payload_len", "kw_xss"]

    preds = spark.createDataFrame([("XSS", "XSS"), ("SQLi", "XSS"), ("Normal", "Normal")], "y string, p string")
    conf = confusion_table(preds, "y", "p", ["XSS", "SQLi", "Normal"])
    write_text_report(spark, os.path.join(d, "rep"), "RandomForest", conf, classification_report(per_class_metrics(conf)))
    lines = [r[0] for r in spark.read.text(os.path.join(d, "rep")).collect()]
    assert lines[0] == "Best model: RandomForest" and any(l.startswith("weighted avg") for l in lines)

    train = spark.createDataFrame([(float(i % 3), float(i), float(i % 5)) for i in range(60)], "label double, a double, b double")
    model = Pipeline(stages=[FeatureScaler(inputCols=["a", "b"], method="minmax"),
                             VectorAssembler(inputCols=["a", "b"], outputCol="features"),
                             DecisionTreeClassifier(maxDepth=3)]).fit(train)
    save_model(model, os.path.join(d, "model"))
    loaded = load_model([os.path.join(d, "missing"), os.path.join(d, "model")])
    assert loaded is not None
    assert [r.prediction for r in loaded.transform(train).collect()] == [r.prediction for r in model.transform(train).collect()]
    assert load_model([os.path.join(d, "missing")]) is None

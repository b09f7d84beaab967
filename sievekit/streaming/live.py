"""Structured Streaming jobs (L1, L2): the live scanner and its history.

L1 is stateless: files of payloads -> features (the stateless entropy form)
-> fitted pipeline -> severity -> append. L2 counts labels per event-time
window with a watermark, so state for closed windows is dropped. Both run
with ``availableNow`` for catch-up and survive restarts through their
checkpoint locations (which must live on shared storage).
"""

from __future__ import annotations

import os

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.enrich import enrich_severity
from ..operators.features import add_payload_features
from ..operators.models import probability_columns


def payload_stream(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def table_stream(spark: SparkSession, sf_dir: str, name: str, schema: T.StructType) -> DataFrame:
    """A table as a stream, whether it is stored as a folder of part files or
    as one file. A file source watches a directory or a pattern: the table's
    own folder, or a pattern that only the single file matches (the folder
    around it may hold partitioned tables, which can't be listed together)."""
    path = os.path.join(sf_dir, f"{name}.parquet")
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory():
        return payload_stream(spark, path, schema)
    return payload_stream(spark, os.path.join(sf_dir, f"{{{name}}}.parquet"), schema)


def live_scoring(stream: DataFrame, model: PipelineModel, label_names: list[str], payload_col: str = "payload",
                 severity: str = "base") -> DataFrame:
    """L1 transform: strip/drop blank -> features -> prediction -> severity."""
    from ..functions.text import strip_py

    s = stream.withColumn(payload_col, strip_py(payload_col)).where(F.length(payload_col) > 0)
    feats = add_payload_features(s, payload_col)
    pred = model.transform(feats)
    names = F.array(*[F.lit(x) for x in label_names])
    pred = pred.withColumn("label", F.element_at(names, F.col("prediction").cast("int") + 1))
    if "probability" in pred.columns:
        pred = probability_columns(pred, label_names)  # confidence in percent
    return enrich_severity(pred, "label", severity)


def run_available_now(df: DataFrame, sink_path: str, checkpoint: str, mode: str = "append") -> None:
    """Process everything available, then stop (append to Parquet)."""
    q = (df.writeStream.format("parquet").outputMode(mode).option("path", sink_path)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def windowed_label_counts(stream: DataFrame, ts: str, label: str, window: str = "1 hour",
                          watermark: str = "10 minutes") -> DataFrame:
    """L2: counts per label and tumbling event-time window."""
    return (stream.withWatermark(ts, watermark)
            .groupBy(F.window(ts, window).alias("w"), F.col(label))
            .agg(F.count(F.lit(1)).alias("n")))


def run_update_to_table(df: DataFrame, sink_path: str, checkpoint: str) -> None:
    """Update-mode aggregation materialised by foreachBatch: each micro-batch
    appends its changed rows tagged with the batch id; readers keep the
    latest row per key (see ``latest_per_key``)."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(sink_path)

    q = (df.writeStream.outputMode("update").foreachBatch(write)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def latest_per_key(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.max_by(value, "batch_id").alias(value))

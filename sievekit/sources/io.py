"""Sources and sinks.

CSV is read with an explicit schema (no inference pass) and pandas-like NA
tokens, by byte ranges even where fields hold newlines; ``read_or_materialize``
converts a landed CSV to Parquet once and every later job scans that copy.
Paths may be any Hadoop filesystem URI.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip_py
from ..session import checkpoint_dir
from .csv_split import read_csv_records

# ---------------------------------------------------------------------------
# The text tokens pandas' CSV reader turns into missing values
# by default (as documented for ``read_csv(na_values=...)``).
# ---------------------------------------------------------------------------
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
             "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
# ---------------------------------------------------------------------------

LABELLED_SCHEMA = T.StructType([
    T.StructField("Payload", T.StringType()), T.StructField("Label", T.LongType()),
    T.StructField("text_label", T.StringType()), T.StructField("ID", T.LongType()),
])


def _fs_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def apply_na_tokens(df: DataFrame, tokens: Sequence[str] = NA_TOKENS) -> DataFrame:
    """String cells equal to an NA token become null (pandas semantics)."""
    cols = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    toks = list(tokens)
    return df.withColumns({c: F.when(F.col(c).isin(toks), F.lit(None)).otherwise(F.col(c)) for c in cols}) if cols else df


def read_labelled_csv(spark: SparkSession, path: str, schema: T.StructType = LABELLED_SCHEMA,
                      na_tokens: Sequence[str] | None = NA_TOKENS) -> DataFrame:
    """Header row, quoted multi-line text, doubled quotes as escapes; read
    by byte ranges, so a large file takes many tasks (see ``csv_split``)."""
    df = read_csv_records(spark, path, schema)
    return apply_na_tokens(df, na_tokens) if na_tokens else df


def read_or_materialize(spark: SparkSession, path: str, source) -> DataFrame:
    """Reuse the Parquet copy at ``path`` if it is complete (a write that
    broke off leaves no ``_SUCCESS``); otherwise build ``source()`` (a DataFrame
    or a zero-argument callable), write it there and read it back (so later
    scans are splittable and pruned)."""
    if not _fs_exists(spark, f"{path.rstrip('/')}/_SUCCESS"):
        df = source() if callable(source) else source
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def read_text_lines(spark: SparkSession, path: str) -> DataFrame:
    """S3: one payload per line, Python-stripped, blank lines dropped."""
    t = spark.read.option("wholetext", False).text(path)
    return t.select(strip_py("value").alias("payload")).where(F.length("payload") > 0)


def read_first_column_csv(spark: SparkSession, path: str) -> DataFrame:
    """The first CSV column as text; embedded newlines split payloads."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    first = F.col(f"`{df.columns[0]}`").cast("string")
    lines = df.select(F.explode(F.split(first, "\n")).alias("payload"))
    return lines.select(strip_py("payload").alias("payload")).where(F.length("payload") > 0)


REPORT_SCHEMA = "Model string, accuracy double, precision double, recall double, f1 double"


def read_metrics_report(spark: SparkSession, path: str) -> DataFrame:
    """Model comparison CSV; an unnamed first column becomes ``Model``;
    a missing file gives an empty table with the report schema."""
    if not _fs_exists(spark, path):
        return spark.createDataFrame([], REPORT_SCHEMA)
    df = spark.read.option("header", True).option("inferSchema", True).csv(path)
    first = df.columns[0]
    if first in ("", "_c0") or first.startswith("Unnamed"):
        df = df.withColumnRenamed(first, "Model")
    return df


def write_metadata(df: DataFrame, path: str) -> None:
    """One-row metadata table as a single JSON object file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", False).json(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Header + RFC-4180 quoting (quotes doubled); white space around a
    value is part of it."""
    (df.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def write_text_report(spark: SparkSession, path: str, best_model: str, confusion: DataFrame,
                      report: DataFrame) -> None:
    """Best model + confusion matrix + classification report as text.
    The inputs are small fixed-shape tables (classes x classes, classes + 3)."""
    lines = spark.createDataFrame([(0, f"Best model: {best_model}"), (1, ""), (2, "Confusion matrix:")],
                                  "ord int, value string")
    conf = confusion.select((F.lit(100) + F.col("a_pos") * 100 + F.col("p_pos")).alias("ord"),
                            F.format_string("%s -> %s: %d", "actual", "predicted", "n").alias("value"))
    rep = report.select((F.lit(10_000) + F.col("position")).alias("ord"),
                        F.format_string("%-14s %9s %9s %9s %9d", "row",
                                        F.coalesce(F.format_number("precision", 2), F.lit("")),
                                        F.coalesce(F.format_number("recall", 2), F.lit("")),
                                        F.format_number("f1", 2), "support").alias("value"))
    head = spark.createDataFrame([(9_999, "Classification report:")], "ord int, value string")
    out = lines.unionByName(conf).unionByName(head).unionByName(rep)
    out.orderBy("ord").select("value").coalesce(1).write.mode("overwrite").text(path)


def save_model(model: PipelineModel, path: str) -> None:
    """MLlib persistence (any Hadoop filesystem)."""
    model.write().overwrite().save(path)


def load_model(candidates: Sequence[str]) -> PipelineModel | None:
    """The first candidate directory holding a readable model, else None."""
    for p in candidates:
        try:
            return PipelineModel.load(p)
        except Exception:  # noqa: BLE001 - a missing/corrupt candidate: try the next
            continue
    return None


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory (never a
    machine-local temp folder on a cluster)."""
    return f"{checkpoint_dir(spark).rstrip('/')}/sievekit-{name}-{uuid.uuid4().hex}"

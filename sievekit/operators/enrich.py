"""Reference lookups: class names (F12) and severity.

The lookup tables are fixed and tiny, so they are joined as broadcast
dimensions (their size is bounded by the constant lists below).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.classes import BASE_CLASS_MAP, DEMO_CLASS_MAP
from ..functions.text import map_lookup

# ---------------------------------------------------------------------------
# Severity per class name as (severity, colour, score).
# "base" is the batch/CLI table, "demo" the one the demo app and API use;
# an unknown class gets UNKNOWN_SEVERITY.
# ---------------------------------------------------------------------------
SEVERITY_BASE = {
    "XSS": ("CRITICAL", "#ef4444", 95),
    "SQLi": ("HIGH", "#f59e0b", 85),
    "Normal": ("SAFE", "#10b981", 10),
}
SEVERITY_DEMO = {
    "Normal": ("SAFE", "#10b981", 5),
    "XSS": ("HIGH", "#f59e0b", 75),
    "SQLi": ("CRITICAL", "#ef4444", 95),
}
UNKNOWN_SEVERITY = ("UNKNOWN", "#94a3b8", 50)
# ---------------------------------------------------------------------------

SEVERITY_MAPS = {"base": SEVERITY_BASE, "demo": SEVERITY_DEMO}
CLASS_MAPS = {"base": BASE_CLASS_MAP, "demo": DEMO_CLASS_MAP}


def class_name(code_col, version: str = "base"):
    """class code -> name; an unknown code is returned as its text."""
    mapping = {int(k): v for k, v in CLASS_MAPS[version].items()}
    return map_lookup(F.col(code_col).cast("int") if isinstance(code_col, str) else code_col.cast("int"), mapping)


def severity_dim(spark: SparkSession, version: str = "base") -> DataFrame:
    rows = [(k, *v) for k, v in SEVERITY_MAPS[version].items()]
    return spark.createDataFrame(rows, "label string, severity string, colour string, severity_score int")


def enrich_severity(df: DataFrame, label_col: str, version: str = "base", prefix: str = "") -> DataFrame:
    """Left lookup of severity by class name with the UNKNOWN default."""
    dim = severity_dim(df.sparkSession, version).withColumnRenamed("label", "__sev_label")
    j = df.join(F.broadcast(dim), F.col(label_col) == F.col("__sev_label"), "left")
    unk_name, unk_colour, unk_score = UNKNOWN_SEVERITY
    return j.withColumns({
        f"{prefix}severity": F.coalesce(F.col("severity"), F.lit(unk_name)),
        f"{prefix}colour": F.coalesce(F.col("colour"), F.lit(unk_colour)),
        f"{prefix}severity_score": F.coalesce(F.col("severity_score"), F.lit(unk_score)),
    }).drop("__sev_label", *[c for c in ("severity", "colour", "severity_score") if prefix])

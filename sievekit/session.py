"""Session helpers: a configured SparkSession for tests/bench, table loading,
and the reliable-checkpoint directory rule.

On a cluster the checkpoint directory must be a shared folder named by
``spark.checkpoint.dir``. We only invent one (a temp dir) when the session
runs in local mode and the setting is absent, as in tests.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "sievekit") -> SparkSession:
    """A local session sized for tests and the bench (UI off, AQE on, UTC)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config(SPREAD, "true")
        .config("spark.driver.memory", os.environ.get("SIEVEKIT_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: set to true in local sessions only: spread a text table that was written as
#: one row group over the cores (see ``spread_for_cpu``)
SPREAD = "spark.sievekit.spreadTextScans"

# tables whose rows carry long texts: per-row feature work is CPU-bound
TEXT_TABLES = ("documents", "pages", "conversations", "benchmark")


def read_table(spark: SparkSession, sf_dir: str, name: str, spread: bool | None = None) -> DataFrame:
    """Scan one table as it lies. Only if the caller asks for it, or the
    session says so (``SPREAD``, off by default), a text table with too few
    splits is spread over the cores first."""
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    if spread is None:
        spread = name in TEXT_TABLES and spark.conf.get(SPREAD, "false") == "true"
    return spread_for_cpu(df) if spread else df


def spread_for_cpu(df: DataFrame) -> DataFrame:
    """Round-robin repartition to the default parallelism, but only when the
    input has fewer partitions than that (e.g. a file written as one row
    group). A large input already has many splits and is left untouched, so
    this never adds a shuffle at scale; on a small input it is a cheap
    shuffle that lets CPU-heavy per-row expressions use every core."""
    target = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(target) if df.rdd.getNumPartitions() < target else df


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory, setting it from
    ``spark.checkpoint.dir`` when needed. Only a local-mode session without
    the setting gets a private temp folder."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="sievekit-ckpt-"))
        return sc.getCheckpointDir()
    raise RuntimeError("set spark.checkpoint.dir to a shared folder before running lineage-cutting operators")


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage with an eager reliable checkpoint (survives executor loss)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)

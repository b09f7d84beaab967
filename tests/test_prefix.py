"""Running sums and positions over range-sorted partitions."""

import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from types import SimpleNamespace

from pyspark.sql import Window
from pyspark.sql import functions as F

from sievekit.operators.prefix import positions, running_sum, ship


def _rows(spark):
    # one group holds two thirds of all rows; a null group; values with nulls
    return spark.range(900).select(
        "id", F.when(F.col("id") % 9 == 0, None).when(F.col("id") % 3 == 0, F.col("id") % 5).otherwise(7).alias("g"),
        F.when(F.col("id") % 10 == 3, None).otherwise(F.col("id") % 11).alias("v"), (F.col("id") / 4).alias("x"))


def test_running_sum_equals_window(spark):
    df = _rows(spark)
    w = Window.partitionBy("g").orderBy(F.desc("id"))
    want = {r["id"]: (r["a"], r["b"]) for r in df.select("id", F.coalesce(F.sum("v").over(w), F.lit(0)).alias("a"), F.sum("x").over(w).alias("b")).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")  # groups cross batches as well as partitions
    try:
        for partitions in (1, 5, 40):
            got = running_sum(df, ["g"], [F.desc("id")], ["v", "x"], partitions).collect()
            assert {r["id"]: (r["cum_v"], r["cum_x"]) for r in got} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_positions_without_groups_and_of_nothing(spark):
    df = _rows(spark)
    assert {r["id"]: r["position"] for r in positions(df, [], [F.desc("id")], partitions=7).collect()} == {i: 899 - i for i in range(900)}
    assert positions(df.where("id < 0"), ["g"], [F.col("id")]).count() == 0


def test_one_exchange(spark):
    plan = running_sum(_rows(spark), ["g"], [F.col("id")], ["v"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan  # the range shuffle lies before the checkpoint, nothing follows


def test_sources_are_shipped_once_when_threads_ask_at_the_same_time():
    sent = []

    def add(path):
        time.sleep(0.2)
        if sent:
            raise ValueError("already registered with a different path")  # as Spark does
        sent.append(path)

    spark = SimpleNamespace(sparkContext=SimpleNamespace(applicationId=f"app-{uuid.uuid4()}", addPyFile=add))
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda _: ship(spark), range(8)))
    assert len(sent) == 1

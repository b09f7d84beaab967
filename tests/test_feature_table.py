"""The training table (F8): no text leaves the pass that counts it."""

from sievekit.functions.dialect import FEATURE_COLUMNS
from sievekit.plans.training import feature_table

from conftest import SF001


def test_feature_table_shuffles_no_text(spark):
    table = feature_table(spark, SF001)
    assert set(table.columns) == {"ID", "text_label", "split", *FEATURE_COLUMNS}
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert "Payload" not in plan and "char_stats" not in plan and "parquet" not in plan
    assert table.groupBy("split").count().count() == 2

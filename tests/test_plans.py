"""Plan hygiene for every value-checked query: no cartesian or nested-loop
join, and no Python UDF but where the operator is Python by design."""

import pytest

import __spark_entry__ as entry

from conftest import SF001

BAD = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "PythonUDF")

# exact kNN searches the leaves of its k-d partition in Arrow batches
PYTHON_BY_DESIGN = {"fit_knn"}


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_plan_hygiene(spark, name):
    df = entry.queries()[name](spark, SF001)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for bad in BAD[:2] if name in PYTHON_BY_DESIGN else BAD:
        assert bad not in plan, f"{name}: {bad}"

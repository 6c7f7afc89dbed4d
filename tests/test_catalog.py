import oracle
import pytest

import __spark_entry__
from noteloom.plans import catalog


@pytest.mark.parametrize("name", [*catalog.QUERIES])
def test_query_equals_its_sql(spark, name):
    assert oracle.of_spark(catalog.QUERIES[name](spark, oracle.SF)) == oracle.of_sql(catalog.SQL[name])


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 6  # four of the ten best are vectors without a document here
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_filters_and_columns_reach_the_scan(spark):
    plan = catalog.knn_filtered_label(spark, oracle.SF)._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters: ") :].split("]  ")[0].split("ReadSchema")[0]
    assert "In(label, [2,3])" in pushed and "GreaterThanOrEqual(label,2)" in pushed and "TakeOrderedAndProject" in plan
    plan = catalog.keyword_bm25(spark, oracle.SF)._jdf.queryExecution().executedPlan().toString()
    assert "n_chars" not in plan

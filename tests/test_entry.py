"""The driver's contract."""

from __future__ import annotations

import __spark_entry__


def test_entry(spark):
    found = __spark_entry__.entry(spark)
    assert found.columns == ["film_id", "slug", "name", "subscribed", "quality"] and not found.isEmpty()


def test_every_sql_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_no_products_in_plans(spark):
    """No plan of a join of facts holds a Cartesian product or a nested loop."""
    queries = __spark_entry__.queries()
    for name in ("film_view", "blocking_match", "batch_arrivals", "search_fields", "merged_listings"):
        plan = queries[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name

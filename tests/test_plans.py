"""Plan checks over every registered query: no cartesian or nested-loop
joins, no row-at-a-time Python UDF, top-k windows planned as group limits."""

import pytest

from pagewright.plans.catalog import QUERIES

from conftest import SF_SMALL

EAGER = {"run_feed", "run_feed_workers", "read_objects", "read_feed", "read_table"}      # these run a job while building


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - EAGER))
def test_no_pairs_and_no_row_udf(spark, name):
    plan = plan_of(QUERIES[name](spark, SF_SMALL))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan


@pytest.mark.parametrize("name", ["knn_exact", "retrieve_sources", "bm25"])
def test_topk_uses_group_limit(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in final or "AdaptiveSparkPlan" in final


def test_filters_reach_the_scan(spark):
    from pyspark.sql import functions as F
    from pagewright.sources import TestTables
    t = TestTables(spark, SF_SMALL)
    df = t.documents.where(F.col("doc_id") > 5).select("doc_id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThan(doc_id,5)]" in plan
    assert "ReadSchema: struct<doc_id:bigint>" in plan

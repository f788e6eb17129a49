"""Plan checks: range joins must plan as equi-joins, statistics as scalar subqueries."""

import pytest

import __spark_entry__ as E

LAZY = [
    "points_events", "tokenise_documents", "tfidf_documents", "cosine_join_documents", "eps_join_events",
    "neighbour_count_events", "density_ratio_events", "scale_minmax_part", "scale_zscore_orders",
    "l2_normalise_embeddings", "dbscan_events",
]


@pytest.mark.parametrize("name", LAZY)
def test_no_nested_loop_or_cartesian(spark, name):
    plan = E.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_scan_reads_only_used_columns(spark):
    plan = E.queries()["points_events"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,value:double>" in plan

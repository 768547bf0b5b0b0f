"""Plan shape: no nested-loop or cartesian joins in the range-join and
neighbour operators; scans read only the needed columns."""

import pytest

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", ["influence_report", "influence_all_stores", "influence_control",
                                 "influence_own", "knn_classify", "dbscan_degrees", "dedup_keep_first"])
def test_no_nested_loop_or_cartesian(spark, key):
    from kestrel.plans import QUERIES
    p = _plan(QUERIES[key](spark, SF))
    assert "BroadcastNestedLoopJoin" not in p and "CartesianProduct" not in p


def test_scan_prunes_columns(spark):
    from kestrel.plans import QUERIES
    p = _plan(QUERIES["store_activity"](spark, SF))
    assert "ReadSchema: struct<l_partkey:bigint,l_suppkey:bigint,l_extendedprice:double>" in p

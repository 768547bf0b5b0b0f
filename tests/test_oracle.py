"""Registered queries against their DuckDB oracles on the sf0.001 tables
(the driver runs the full set at sf0.01 through ``tests/oracle_harness.py``)."""

import pytest

from tests.oracle_harness import compare, duck

FAST = ["store_activity", "count_na", "clean_strings", "convert_types", "fill_na_ffill", "fill_na_bfill",
        "dedup_keep_first", "union_by_name", "parse_business_day", "influence_windows", "influence_own",
        "influence_all_stores", "influence_control", "one_way_anova", "chi_square_2x2", "correlation_matrix",
        "association_rules", "stratified_split", "roc_auc", "knn_classify", "dbscan_degrees", "silhouette",
        "messages_since"]
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("key", FAST)
def test_query_matches_oracle(spark, con, key):
    from __spark_entry__ import oracle_sql, queries
    r = compare(spark, con, key, queries()[key], oracle_sql()[key], SF)
    assert r["status"].startswith("ok"), r


def test_entry_runs(spark):
    from __spark_entry__ import entry
    df = entry(spark)
    assert df.count() >= 0 and "store" in df.columns

import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F

from kestrel.plans import jobs
from tests.test_influence import _events, _facts
from tests.test_io_streaming import _xlsx


def test_report_job_partitions_by_parameters(spark):
    out = os.path.join(tempfile.mkdtemp(prefix="kestrel-job-"), "report")
    jobs.competitor_influence(_facts(spark), _events(spark), [5, 7], [0, 3], out=out)
    assert {"lead_days=5", "lead_days=7"} <= set(os.listdir(out))
    back = spark.read.parquet(out)
    assert back.select("lead_days", "gap_days").distinct().count() == 2


def test_unequal_parameter_lists_raise(spark):
    import pytest
    with pytest.raises(ValueError):
        jobs.competitor_influence(_facts(spark), _events(spark), [5, 7], [0])


def test_clean_and_merge_folder(spark):
    d = tempfile.mkdtemp(prefix="kestrel-merge-")
    with open(os.path.join(d, "a.csv"), "w") as f:
        f.write("store,v\ns1,1+2\n")
    _xlsx(os.path.join(d, "b.xlsx"), [["store", "w"], ["s2", "x*"]])
    out = os.path.join(tempfile.mkdtemp(prefix="kestrel-merge-out-"), "t")
    failed = jobs.clean_and_merge_folder(spark, d, out)
    rows = sorted((r.store, r.v, r.w) for r in spark.read.parquet(out).collect())
    assert rows == [("s1", "12", None), ("s2", None, "x")] and not failed
    assert os.path.exists(os.path.join(d, "a.csv"))      # sources are kept


def test_product_lookup_cleans_both_sides(spark):
    items = spark.createDataFrame([("卫龙魔芋爽微辣麻酱味乐享装180+45克",), ("other",)], "name string")
    got = [r.name for r in jobs.product_lookup(spark, None, items, "name", "weilong").collect()]
    assert got == ["卫龙魔芋爽微辣麻酱味乐享装180+45克"]

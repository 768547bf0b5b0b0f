import math

import numpy as np
from pyspark.sql import functions as F

from kestrel.functions import distributions as d
from kestrel.functions import text as tx


def test_distribution_tails_match_tables():
    assert abs(d.f_sf_np([3.7083], [3], [10])[0] - 0.05) < 1e-4
    assert abs(d.t_sf_np([2.228], [10])[0] - 0.025) < 1e-4
    assert abs(d.chi2_sf_np([3.841], [1])[0] - 0.05) < 1e-4
    assert abs(d.norm_sf_np([1.959964])[0] - 0.025) < 1e-6
    assert abs(d.norm_ppf_np([0.975])[0] - 1.959964) < 1e-6
    p = np.linspace(0.001, 0.999, 50)
    assert np.allclose(d.norm_sf_np(-d.norm_ppf_np(p)), p, atol=1e-9)


def test_clean_names_unicode_and_collisions():
    assert tx.clean_names([" 名 称(元) ", "名 称(元)", "a+b"]) == ["名_称_元", "名_称_元_2", "a_b"]


def test_to_number_and_dates(spark):
    rows = [(" 12 ",), ("1e3",), ("5d",), ("1,000",), ("",), ("abc",), ("nan",), ("-inf",)]
    got = [r[0] for r in spark.createDataFrame(rows, "s string").select(tx.to_number(F.col("s"))).collect()]
    assert got[:6] == [12.0, 1000.0, None, None, None, None]
    assert got[6] is None and got[7] == -math.inf
    days = spark.createDataFrame([("20240215",), ("20240215.0",), (" 20240215 ",), ("20240230",), (None,)], "s string")
    out = [r[0] for r in days.select(tx.parse_yyyymmdd(F.col("s"))).collect()]
    assert [str(x) if x else None for x in out] == ["2024-02-15", "2024-02-15", "2024-02-15", None, None]


def test_clean_value_keeps_unicode_letters(spark):
    df = spark.createDataFrame([("Crème + Ёж *50%: ok！",), ("nan",), (None,)], "s string")
    out = [r[0] for r in df.select(tx.clean_value(F.col("s"))).collect()]
    assert out == ["Crème  Ёж 50 ok！", None, None]


def test_half_even_formatting(spark):
    df = spark.createDataFrame([(0.12125,), (None,)], "x double")
    out = [r[0] for r in df.select(tx.fmt_fixed(F.col("x") * 100, 1)).collect()]
    assert out[1] == "NA"

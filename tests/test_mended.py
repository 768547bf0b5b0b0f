"""Cases that earlier versions cut, lost or read wrong."""

from __future__ import annotations

import pytest
from pyspark.ml.feature import VectorAssembler

from kestrel.operators import neighbors, prep, stats
from kestrel.sources import excel, files


def test_csv_doubled_quotes_and_line_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,y\n"a ""b"" c",1\n"two\nlines",2\n', encoding="utf-8")
    rows = files.read_csv(spark, str(tmp_path / "a.csv"), multi_line=True).collect()
    assert [(r.x, r.y) for r in rows] == [('a "b" c', "1"), ("two\nlines", "2")]


def test_null_labels_stay_in_stratified_splits(spark):
    df = spark.createDataFrame([(i, "a" if i < 10 else "b" if i < 20 else None) for i in range(30)], "k long, y string")
    out = prep.hash_split(df, "k", "y").collect()
    assert len(out) == 30 and sum(r.is_test for r in out) == 6
    assert {r.y: sum(x.is_test for x in out if x.y == r.y) for r in out} == {"a": 2, "b": 2, None: 2}


def test_moments_do_not_depend_on_other_columns(spark):
    names = [f"c{i}" for i in range(10)]
    df = spark.createDataFrame([tuple(float(i) for _ in range(9)) + (None if i > 7 else float(i),) for i in range(10)], ", ".join(f"{n} double" for n in names))
    assert prep.scaler_stats(df, names[:8])["c0"] == prep.scaler_stats(df, names)["c0"]


def test_dbscan_raises_if_labels_do_not_settle(spark):
    line = spark.createDataFrame([(i, i * 0.4) for i in range(40)], "k long, x double")
    points = VectorAssembler(inputCols=["x"], outputCol="features").transform(line)
    assert {r.cluster for r in neighbors.dbscan(points, "k", eps=0.5, min_samples=2).collect()} == {0}
    with pytest.raises(RuntimeError):
        neighbors.dbscan(points, "k", eps=0.5, min_samples=2, max_iter=1)


def test_shapiro_has_p_above_the_table(spark):
    r = stats.shapiro_wilk(spark.range(6000).selectExpr("cast(id as double) as x"), "x").first()
    assert r.n == 6000 and r.beyond_table and 0 <= r.p_value < 1e-6


def test_repeated_headers_get_numbers():
    assert excel._unique(["a", "a", "b", "a"]) == ["a", "a_1", "b", "a_2"]

"""Steps whose cost must grow no faster than the rows."""

from __future__ import annotations

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from kestrel.operators import classify, clean, optimise, passes, prep, regress, stats
from kestrel.sources import derived


@pytest.mark.parametrize("by", [None, ["g"]])
def test_backward_fill_runs_one_frame(spark, by):
    rows = [(1, i, None if i % 4 else float(i)) for i in range(200)]
    out = clean.fill_na(spark.createDataFrame(rows, "g int, i int, v double"), ["v"], method="bfill", order_by=["i"], partition_by=by)
    assert "unboundedfollowing" not in out._jdf.queryExecution().toString().lower()
    got = {r.i: r.v for r in out.collect()}
    assert got == {i: float(-(-i // 4) * 4) if i <= 196 else None for i in range(200)}


def test_newton_settles_each_model_in_a_few_passes():
    def evaluate(points):
        a = np.array([1.0, 100.0])[:, None]
        return [((0.5 * a * (x - 3) ** 2).sum(axis=1), a * (x - 3)) for x in points], a[:, :, None] * np.eye(2)

    got = optimise.newton(evaluate, np.zeros((2, 2)), 1e-6)
    assert got.converged and got.passes <= 4 and np.allclose(got.x, 3)


def test_svr_passes_do_not_run_into_hundreds(spark):
    rng = np.random.default_rng(1)
    z = rng.normal(size=(300, 4))
    y = z @ [1.0, -2.0, 0.5, 0.0] + rng.normal(size=300) * 0.3
    rows = spark.createDataFrame([([float(v) for v in a], float(b)) for a, b in zip(z, y, strict=True)], "z array<double>, y double").coalesce(2).persist()
    got = regress.fit_svr(rows, 4, 300)
    assert got["converged"] and got["passes"] < 150
    assert np.allclose(got["w"], [1.0, -2.0, 0.5, 0.0], atol=0.1)


@pytest.mark.parametrize("parts", [4, 20])
def test_large_vectors_reach_the_driver_as_one(spark, parts, monkeypatch):
    rows = spark.range(0, 1000, 1, parts)
    seen, collect = [], type(rows).collect
    monkeypatch.setattr(type(rows), "collect", lambda df: seen.append(collect(df)) or seen[-1])

    def partial(batches):
        out = np.zeros(1 << 17)
        for b in batches:
            out[0] += b.column(0).to_numpy().sum()
        return out

    assert passes.summed(rows, partial, 1 << 17)[0] == 499500
    assert [len(s) for s in seen] == [1]


def test_store_days_copy_no_row(spark, tmp_path):
    day = datetime.datetime(1998, 1, 2)
    spark.createDataFrame([(1, 7, day, 100.0, 0.0), (1, 7, day, 50.0, 0.5), (2, 7, day, 10.0, 0.0), (None, 7, day, 1.0, 0.0), (3, 8, day, 4.0, 0.0)], "l_orderkey long, l_suppkey long, l_shipdate timestamp, l_extendedprice double, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, 1), (2, 2), (2, 1)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, "BUILDING"), (2, "OTHER")], "c_custkey long, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    out = derived.store_days(spark, str(tmp_path))
    assert "Expand" not in out._jdf.queryExecution().toString()
    got = {r.store: (r.revenue, r.tickets, r.member_sales, r.member_tickets) for r in out.collect()}
    # order 2 is there twice, once for a member; a line without an order key is no ticket
    assert got == {7: (146.0, 2.0, 135.0, 2.0), 8: (4.0, 1.0, 0.0, 0.0)}


def test_few_levels_are_not_sorted_for_the_join(spark, monkeypatch):
    plans, packed = [], stats.packed
    monkeypatch.setattr(stats, "packed", lambda rows, *a: plans.append(rows._jdf.queryExecution().toString()) or packed(rows, *a))
    df = spark.createDataFrame([(f"a{i % 3}", f"b{i % 2}", float(i * i % 17)) for i in range(60)], "a string, b string, y double")
    assert stats.two_way_anova(df, "y", "a", "b").count() == 4
    assert "SortMergeJoin" not in plans[0] and "BroadcastHashJoin" in plans[0]


def test_text_counts_are_taken_once_and_no_text_is_joined(spark, tmp_path):
    texts = ["Ab C\nd", "", None, "\n\n", "Zürich  ÀB\n 漢字 🙂 X", "plain"]
    spark.createDataFrame([*enumerate(texts), (2, "again\n"), (None, "A")], "doc_id long, text string").withColumn("n_chars", F.length("text")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0), (1, 0, 0), (2, 1, 0), (3, None, 1), (4, 1, 1), (9, 1, 0), (None, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = derived.document_features(spark, str(tmp_path))
    assert out.columns == ["doc_id", "quality", "toxic", *derived.DOC_FEATURES]
    want = {(i, t) for i, t in [*enumerate(texts[:5]), (2, "again\n")]}
    counts = {(i, *([None] * 4 if t is None else map(float, (len(t), t.count("\n") + 1, t.count(" "), sum("A" <= c <= "Z" for c in t))))) for i, t in want}
    assert {tuple(r) for r in out.select("doc_id", *derived.DOC_FEATURES).collect()} == counts and out.count() == 6
    plan = out.select("doc_id", "quality", *derived.DOC_FEATURES).dropna()._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan[:plan.index("Join")], plan[plan.index("Join"):]
    joined, below = below.split("\n", 1)
    assert "text" not in above + joined and below.count("regexp_replace") == 1


def test_split_is_made_once(spark):
    df = spark.range(60).select("id", (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 2).alias("y"))
    p = classify.prepare(df, "y", "id", ["a"])
    for side in (p.train, p.test):  # each is read from the kept split
        plan = side._jdf.queryExecution().executedPlan().toString()
        kept = [line for line in plan.split("\n") if "InMemoryTableScan" in line and "is_test" in line]
        assert any("features" not in line for line in kept)
    assert p.test.count() == 12 and p.train.count() == 48


@pytest.mark.parametrize("keys", ["long", "string"])
def test_a_split_that_ranks_one_bucket_is_the_split(spark, keys):
    """Repeated keys, some in the bucket of the cut, and a missing one, which a
    split without classes leaves out."""
    rows = [(i // 3, float(i // 3)) for i in range(1200)] + [(7, 7.0)] * 90 + [(None, 0.0)]
    df = spark.createDataFrame(rows, "k long, v double").withColumn("k", F.col("k").cast(keys))
    kept = df.withColumn("_at", prep.split_bucket("k"))
    for fraction in (0.0, 0.2, 0.501, 1.0):
        want = prep.hash_split(df, "k", test_fraction=fraction)
        got = prep.hash_split(kept, "k", test_fraction=fraction, bucket="_at")
        assert sorted(got.columns) == sorted(want.columns)
        names = sorted(want.columns)
        assert sorted(map(tuple, got.select(names).collect()), key=str) == sorted(map(tuple, want.select(names).collect()), key=str)
    assert prep.hash_split(kept.limit(0), "k", bucket="_at").count() == 0


def test_many_rows_are_split_where_they_are(spark, monkeypatch):
    df = spark.range(5000).select("id", (F.col("id") % 97).cast("double").alias("a"), (F.col("id") % 2).cast("double").alias("y"))
    few = classify.prepare(df, "y", "id", ["a"], stratify=False, encode=False)
    monkeypatch.setattr(prep, "RANKED_ROWS", 4999)
    plans, split = [], prep.hash_split

    def seen(*a, **b):
        out = split(*a, **b)
        plans.append(out._jdf.queryExecution().optimizedPlan().toString())
        return out

    monkeypatch.setattr(prep, "hash_split", seen)
    many = classify.prepare(df, "y", "id", ["a"], stratify=False, encode=False)
    plan, = plans
    moved = plan[plan.index("Window ["):].split("InMemoryRelation")[0]
    assert "Union" in plan and plan.count("Window [") == 1 and "Filter (isnotnull(_bucket" in moved
    assert set(many.test.columns) == set(few.test.columns)
    for a, b in ((many.test, few.test), (many.train, few.train)):
        assert {r.id for r in a.select("id").collect()} == {r.id for r in b.select("id").collect()}
    assert many.test.count() == 1000 and many.train.count() == 4000
    for c, s in few.stats.items():
        assert many.stats[c] == pytest.approx(s, rel=1e-12)

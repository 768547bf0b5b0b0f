"""Trees grown by subtrees against MLlib's, and forests against their parts."""

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import functions as F

from kestrel.operators import classify, regress, trees


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 4)).round(2)
    x[:, 3] = 1.0  # nothing to split on
    label = (x[:, 0] + x[:, 1] > 0).astype(float) + (x[:, 2] > 0.7) + (rng.random(400) < 0.1)
    rows = [(i, r.tolist(), float(v)) for i, (r, v) in enumerate(zip(x, label, strict=True))]
    df = spark.createDataFrame(rows, "id long, x array<double>, label double")
    return df.select("id", "x", "label", array_to_vector("x").alias("features")).cache()


def _columns(df, *cols):
    return np.array([[v for c in r for v in (c if isinstance(c, list) else [c])] for r in df.orderBy("id").select(*cols).collect()], float)


@pytest.mark.parametrize("depth", [0, 3, 30])
def test_a_tree_of_classes_is_mllibs(points, depth):
    want = DecisionTreeClassifier(maxDepth=depth, maxBins=64).fit(points).transform(points)
    got = trees.fit(points, "id", 4, max_depth=depth, max_bins=64).transform(points)
    cols = ["prediction", vector_to_array("probability")]
    np.testing.assert_allclose(_columns(got, *cols), _columns(want, *cols), atol=1e-9)


@pytest.mark.parametrize("limit", [None, 60, 5])
def test_a_tree_is_the_same_wherever_it_is_grown(points, limit):
    want = DecisionTreeClassifier(maxDepth=30, maxBins=64).fit(points).transform(points)
    got = trees.fit(points, "id", 4, max_depth=30, max_bins=64, local_rows=limit).transform(points)
    np.testing.assert_array_equal(_columns(got, "prediction"), _columns(want, "prediction"))


@pytest.mark.parametrize("limit", [None, 60])
def test_a_tree_of_numbers_is_mllibs(points, limit):
    df = points.withColumn("label", F.col("x")[0] * F.col("x")[1] + 1000)
    want = DecisionTreeRegressor(maxDepth=6).fit(df).transform(df)
    got = trees.fit(df, "id", 0, max_depth=6, local_rows=limit).transform(df)
    np.testing.assert_allclose(_columns(got, "prediction"), _columns(want, "prediction"), rtol=1e-9)


@pytest.mark.parametrize("limit", [None, 100])
def test_a_forest_learns_and_repeats_itself(points, limit):
    def fitted():
        return trees.fit(points, "id", 4, trees=12, max_depth=8, tries=2, local_rows=limit).transform(points)

    first = _columns(fitted(), "label", "prediction", vector_to_array("probability"))
    np.testing.assert_array_equal(first, _columns(fitted(), "label", "prediction", vector_to_array("probability")))
    assert (first[:, 0] == first[:, 1]).mean() > 0.85
    np.testing.assert_allclose(first[:, 2:].sum(axis=1), 1, atol=1e-9)
    assert len(np.unique(first[:, 2:])) > 12  # the trees differ


def test_repeated_and_missing_keys_do_not_join_rows(points):
    df = points.unionByName(points).withColumn("id", F.lit(7))
    got = trees.fit(df, "id", 4, max_bins=64).transform(df)
    assert got.count() == 800
    assert got.where("prediction != label").count() <= 0.02 * 800


def test_subtrees_hold_no_histogram_of_every_node(points):
    """What a forest keeps follows its nodes: 23 tasks do not make it grow."""
    cut = points.repartition(23)
    model = trees.fit(cut, "id", 4, trees=3, max_depth=10, max_bins=64)
    sizes = model.nodes.agg(F.sum(F.length("feature") / 4).alias("nodes"), F.sum(F.length("value")).alias("bytes")).first()
    assert sizes["bytes"] == sizes["nodes"] * 4 * 8 and model.nodes.count() == 3


@pytest.fixture(scope="module")
def cells(spark):
    """Rows of few cells, a third of them in one; missing and repeated keys."""
    rng = np.random.default_rng(6)
    x = rng.integers(0, [6, 5, 2], (900, 3)).astype(float)
    x[:300] = 2.0, 3.0, 1.0
    y = 1e6 + x[:, 0] * x[:, 1] + 5 * x[:, 2] + rng.normal(size=900)
    rows = [(i, None if i % 50 == 0 else i // 2, r.tolist(), float(v)) for i, (r, v) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "id long, key long, x array<double>, label double").withColumn("features", array_to_vector("x")).cache(), x, y


def test_a_tree_of_cells_is_the_tree_of_their_rows():
    rng = np.random.default_rng(7)
    bins = rng.integers(0, [7, 6, 1], (3000, 3)).astype(np.uint16)
    y, w = 1e5 + bins[:, 0] * (bins[:, 1] > 2) + rng.normal(size=3000), rng.integers(1, 4, 3000).astype(float)
    kinds, of = np.unique(bins, axis=0, return_inverse=True)
    of = of.ravel()
    n = np.bincount(of, w)
    mean = np.bincount(of, w * y) / n
    spread = np.bincount(of, w * (y - mean[of]) ** 2)

    def all_features(first, m):
        return np.ones((m, 3), bool)

    for depth in (0, 3, 15):
        want = trees.grow(bins, y, w, 0, depth, all_features)
        got = trees.grow(kinds, mean, n, 0, depth, all_features, spread)
        for a, b in zip(got[:3], want[:3], strict=True):
            np.testing.assert_array_equal(a, b)
        np.testing.assert_allclose(got[3], want[3], rtol=1e-12)


def test_cells_of_one_label_are_not_split():
    made = trees.grow(np.array([[0], [1], [2]], np.uint16), np.full(3, 0.1), np.array([3.0, 1, 2]), 0, 9, lambda first, m: np.ones((m, 1), bool), np.zeros(3))
    assert made[0].tolist() == [-1]


def test_weights_are_poisson():
    w = trees.poisson(np.random.default_rng(3), 200_000, 5)
    p = np.exp(-1) / np.cumprod([1, 1, 2, 3, 4, 5, 6])
    np.testing.assert_allclose(np.bincount(w.astype(int).ravel())[:7] / w.size, p, atol=2e-3)
    # what is drawn at once and what a finer number decides are all there is
    sure = [(trees._WEIGHTS == i).mean() for i in range(7)]
    assert all(p[i] - 2 / 65536 <= sure[i] <= p[i] for i in range(7)) and 0 < (trees._WEIGHTS < 0).sum() < 20


def test_a_forest_of_numbers_is_grown_from_its_cells(cells):
    """The nodes and predictions of plain trees on all rows of the same weights; no
    tree needs passes or subtrees, however many rows a cell has."""
    df, x, y = cells
    model = trees.fit(df, "key", 0, trees=4, max_depth=6, local_rows=20)
    assert model.whole and model.nodes.count() == 4 and all(len(t.rows) == 1 for t in model.tops)
    cell = trees.cells_of(x, model.cuts)
    few = trees._sample(df, 900, "key", 32)
    sums = [r.asDict() for r in trees._cell_sums(df, "key", 900, model.cuts, few, 4, float(y.mean()), 42).collect()]
    found = {}
    for r in sums:
        for p, n, m, s in zip(*(np.frombuffer(r[c], kind) for c, kind in (("piece", np.int64), ("n", float), ("mean", float), ("spread", float))), strict=True):
            found.setdefault(r["tree"], []).append((p, n, m, s))
    want = np.zeros(900)
    for tree, rows in found.items():
        p, n, m, s = (np.array(v) for v in zip(*sorted(rows), strict=True))
        at = p >> trees._PIECE_BITS
        assert np.isin(at, cell).all() and len(np.unique(p)) == len(p) and (n > 0).all()
        assert len(p) > len(np.unique(at))  # the large cell comes in pieces
        for c in np.unique(at):
            own = y[cell == c] - y.mean()
            assert (m[at == c] >= own.min() - 1e-9).all() and (m[at == c] <= own.max() + 1e-9).all()
        bins = trees.bins_of(at, model.cuts)
        made = trees.grow(bins, m, n, 0, 6, lambda first, k: np.ones((k, 3), bool), s)
        want += made[3][trees.reached(*made[:3], trees.bins_of(cell, model.cuts)), 0] + y.mean()
    got = model.transform(df)
    assert got.columns == [*df.columns, "prediction"]
    np.testing.assert_allclose(_columns(got, "prediction")[:, 0], want / 4, rtol=1e-12)
    np.testing.assert_array_equal(_columns(got, "prediction"), _columns(trees.fit(df, "key", 0, trees=4, max_depth=6, local_rows=20).transform(df), "prediction"))


def test_each_row_draws_its_own_weights(cells):
    """The sums of a cell are those of its rows, sorted, with the weights drawn for
    its piece."""
    df, x, y = cells
    one = df.where("x[0] != 2")
    cuts = [np.arange(5) + 0.5, np.arange(4) + 0.5, np.array([0.5])]
    got = {t: {} for t in range(3)}
    for r in trees._cell_sums(one, "key", 900, cuts, one, 3, 0.0, 1).collect():
        for p, n, m, s in zip(*(np.frombuffer(r[c], kind) for c, kind in (("piece", np.int64), ("n", float), ("mean", float), ("spread", float))), strict=True):
            got[r["tree"]][int(p)] = n, m, s
    keep = x[:, 0] != 2
    cell, label = trees.cells_of(x[keep], cuts), y[keep]
    cut = {p >> trees._PIECE_BITS for g in got.values() for p in g if p % (1 << trees._PIECE_BITS)}
    whole = sorted(set(cell.tolist()) - cut)
    assert len(whole) > 5
    for c in whole:
        own, p = np.sort(label[cell == c]), c << trees._PIECE_BITS
        w = trees.poisson(np.random.default_rng([1, p]), len(own), 3)
        for t in range(3):
            if not w[:, t].any():
                assert p not in got[t]
                continue
            mean = np.average(own, weights=w[:, t])
            np.testing.assert_allclose(got[t][p], (w[:, t].sum(), mean, (w[:, t] * (own - mean) ** 2).sum()), rtol=1e-9, atol=1e-6)


def test_a_forest_learns_from_cells(cells):
    df, x, y = cells
    for key, rows in (("key", df), ("label", df.repartition(9))):
        got = trees.fit(rows, key, 0, trees=10, max_depth=8, local_rows=100).transform(rows)
        assert got.count() == 900
        error = _columns(got, "prediction")[:, 0] - y
        assert (error ** 2).mean() < 1.1 and (y - y.mean()).var() > 20


def test_operators_return_their_tables(points):
    df = points.select("id", F.col("x")[0].alias("a"), F.col("x")[1].alias("b"), F.col("label").cast("int").alias("y"))
    res = classify.random_forest(df, "y", "id", ["a", "b"], n_estimators=5)
    assert res.predictions.count() == res.metrics.first()["n_test"]
    res = regress.random_forest_regression(df, "b", "id", ["a", "y"], n_estimators=5)
    assert res.predictions.count() == res.metrics.first()["n_test"]

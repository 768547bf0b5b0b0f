"""Classification operators (C1-C5) with the shared evaluation.

Shared preparation: validate columns, drop rows with missing values,
stratified deterministic 80/20 split, scaler fitted on the training rows,
labels encoded in sorted order. Every operator returns a ``ModelResult``
of DataFrames plus the fitted model."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import evaluate as ev
from . import margins, prep, trees
from .features import fit_kernel_map
from .passes import packed

MAX_TREE_DEPTH = 30        # MLlib's limit; "unlimited" depth maps here
FOREST_DEFAULT_DEPTH = 15  # documented cap for unlimited forest depth


@dataclass
class ModelResult:
    metrics: DataFrame
    predictions: DataFrame
    model: object = None
    extra: dict = field(default_factory=dict)


@dataclass
class Prepared:
    train: DataFrame
    test: DataFrame
    features: list
    classes: list | None
    stats: dict


def prepare(df: DataFrame, target: str, key: str, features=None, stratify: bool = True,
            encode: bool = True) -> Prepared:
    """``features``: list of numeric columns, or the name of one array
    column (wide inputs such as embeddings stay one column)."""
    if isinstance(features, str):
        return _prepare_array(df, target, key, features, stratify, encode)
    feats = list(features) if features else prep.default_features(df, target, exclude=[key])
    prep.validate_columns(df, [target, key, *feats])
    d = df.select(key, target, *feats).dropna()
    if not stratify:
        d = d.withColumn("_bucket", prep.split_bucket(key))
    kept = d = d.persist()  # classes, split and scaler read it several times
    classes = None
    if encode:
        d, classes = prep.label_encode(d, target, "label")
    else:
        d = d.withColumn("label", F.col(target).cast("double"))
    if stratify:
        split = prep.hash_split(d, key, label=target)
    elif kept.count() > prep.RANKED_ROWS:
        split = prep.hash_split(d, key, bucket="_bucket")
    else:
        split = prep.hash_split(d.drop("_bucket"), key)
    split = split.persist()  # for the scaler, train and test
    train = split.filter(~F.col("is_test"))
    test = split.filter(F.col("is_test"))
    stats = prep.scaler_stats(train, feats)
    kept.unpersist()  # all of the split is kept by now
    train = prep.assemble(prep.standardize(train, feats, stats), feats)
    test = prep.assemble(prep.standardize(test, feats, stats), feats)
    return Prepared(train.cache(), test.cache(), feats, classes, stats)


def _prepare_array(df, target, key, arr, stratify, encode) -> Prepared:
    prep.validate_columns(df, [target, key, arr])
    d = df.select(key, target, F.col(arr).cast("array<double>").alias("_x")).dropna().persist()
    classes = None
    if encode:
        d, classes = prep.label_encode(d, target, "label")
    else:
        d = d.withColumn("label", F.col(target).cast("double"))
    split = prep.hash_split(d, key, label=target if stratify else None)
    train = split.filter(~F.col("is_test"))
    test = split.filter(F.col("is_test"))
    mean, sd = prep.array_scaler(train)
    train = prep.scale_array(train, mean, sd).drop("_x")
    test = prep.scale_array(test, mean, sd).drop("_x")
    return Prepared(train.cache(), test.cache(), [arr], classes, {"mean": mean, "sd": sd})


def _evaluate(p: Prepared, pred: DataFrame, key: str, target: str, model, score_col: str | None,
              raw_is_margin: bool = False) -> ModelResult:
    out = pred.select(key, F.col("label").cast("long").alias("label"),
                      F.col("prediction").cast("long").alias("prediction"),
                      *([F.col(score_col)] if score_col else []))
    out = prep.label_decode(out, "label", p.classes, "true_label")
    out = prep.label_decode(out, "prediction", p.classes, "predicted_label")
    metrics = ev.classification_metrics(out)
    auc = None
    if score_col is not None:
        arr = out.withColumn("_s", vector_to_array(score_col))
        if len(p.classes) == 2:
            auc = ev.roc_auc(arr.withColumn("_p", F.col("_s")[1]), "label", "_p", 1).first()["auc"]
        elif not raw_is_margin:
            cols = {i: f"_p{i}" for i in range(len(p.classes))}
            for i, c in cols.items():
                arr = arr.withColumn(c, F.col("_s")[i])
            auc = ev.macro_ovr_auc(arr, "label", cols)
    n_train, n_test = p.train.count(), p.test.count()
    metrics = metrics.select("accuracy", "precision", "recall", "f1",
                             F.lit(auc).cast("double").alias("roc_auc"),
                             F.lit(n_train).alias("n_train"), F.lit(n_test).alias("n_test"))
    predictions = out
    if score_col is not None:  # class probabilities as an array in the order of the classes; margins are none
        predictions = out.drop(score_col) if raw_is_margin else out.withColumn(score_col, vector_to_array(score_col))
    return ModelResult(metrics, predictions, model,
                       {"confusion": ev.confusion_matrix(out, "true_label", "predicted_label"),
                        "classes": p.classes})


def logistic_regression(df: DataFrame, target: str, key: str, features=None, C: float = 1.0,
                        max_iter: int = 1000) -> ModelResult:
    """L2 logistic regression; ``regParam = 1 / (C n_train)`` matches
    the reference objective; multinomial when more than two classes."""
    p = prepare(df, target, key, features)
    n = p.train.count()
    lr = LogisticRegression(featuresCol="features", labelCol="label", regParam=1.0 / (C * n),
                            elasticNetParam=0.0, standardization=False, maxIter=max_iter, tol=1e-8)
    m = lr.fit(p.train)
    res = _evaluate(p, m.transform(p.test), key, target, m, "probability")
    coefs = m.coefficientMatrix.toArray().tolist()
    res.extra["coefficients"] = coefs
    return res


def decision_tree(df: DataFrame, target: str, key: str, features=None, max_depth: int | None = None,
                  max_bins: int = 256) -> ModelResult:
    """Gini tree; unlimited depth → MLlib's limit of 30."""
    p = prepare(df, target, key, features)
    depth = min(max_depth or MAX_TREE_DEPTH, MAX_TREE_DEPTH)
    m = trees.fit(p.train, key, len(p.classes), max_depth=depth, max_bins=max_bins)
    return _evaluate(p, m.transform(p.test), key, target, m, "probability")


def random_forest(df: DataFrame, target: str, key: str, features=None, n_estimators: int = 100,
                  max_depth: int | None = None) -> ModelResult:
    """C4: 100 trees, sqrt features per split, bootstrap."""
    p = prepare(df, target, key, features)
    depth = min(max_depth or FOREST_DEFAULT_DEPTH, MAX_TREE_DEPTH)
    dim = len(p.train.select(vector_to_array("features").alias("x")).first()["x"])
    m = trees.fit(p.train, key, len(p.classes), n_estimators, depth, tries=int(np.ceil(np.sqrt(dim))))
    return _evaluate(p, m.transform(p.test), key, target, m, "probability")


def platt(rows: DataFrame, k: int, tol: float = 1e-8, max_passes: int = 100) -> list[tuple[float, float]]:
    """For each class ``c`` the ``(a, b)`` with P(c) = 1 / (1 + exp(a f + b)) for
    its margin ``f``: Newton steps on the log-loss with Platt's smoothed targets.
    ``rows`` has ``margins`` (an array) and ``label``. A pass sums the loss,
    slopes and curvatures of all classes at once."""
    counts = {int(r["label"]): r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n = sum(counts.values())
    at = np.array([[0.0, np.log((n - counts.get(c, 0) + 1) / (counts.get(c, 0) + 1))] for c in range(k)])

    def sums(points):
        out = []
        for c in range(k):
            f, own = F.col("margins")[c], F.col("label") == c
            m = counts.get(c, 0)
            t = F.when(own, F.lit((m + 1) / (m + 2))).otherwise(F.lit(1 / (n - m + 2)))
            z = F.lit(float(points[c][0])) * f + F.lit(float(points[c][1]))
            p = 1 / (1 + F.exp(z))
            # -t log p - (1 - t) log(1 - p), without overflow
            loss = F.when(z >= 0, t * z + F.log1p(F.exp(-z))).otherwise((t - 1) * z + F.log1p(F.exp(z)))
            v = p * (1 - p)
            out += [F.sum(loss), F.sum(f * (t - p)), F.sum(t - p), F.sum(f * f * v), F.sum(f * v), F.sum(v)]
        return np.array(rows.agg(*[x.alias(f"s{i}") for i, x in enumerate(out)]).first(), float).reshape(k, 6)

    got, step = sums(at), np.ones(k)
    direction = np.zeros_like(at)
    for _ in range(max_passes):
        for c in range(k):
            _, g1, g2, h11, h12, h22 = got[c]
            h11, h22 = h11 + 1e-12, h22 + 1e-12
            direction[c] = -np.linalg.solve(np.array([[h11, h12], [h12, h22]]) + 1e-12 * np.eye(2), [g1, g2])
        if np.abs(got[:, 1:3]).max() <= tol * n:
            break
        step[:] = 1.0
        while True:  # halve the steps of the classes whose loss has not gone down
            tried = sums(at + step[:, None] * direction)
            worse = tried[:, 0] > got[:, 0] + 1e-12 * n
            if not worse.any() or step.min() < 1e-9:
                break
            step[worse] *= 0.5
        at, got = at + step[:, None] * direction, tried
    return [tuple(map(float, x)) for x in at]


def _fit_svms(rows: DataFrame, dim: int, sizes: dict[int, int], k: int, C: float, accuracy: float) -> tuple[np.ndarray, np.ndarray, dict]:
    """One-vs-rest hinge models of ``rows`` (``z, label, fold``) without each
    fold and of all rows: ``w`` (folds + 1, classes, dim), ``b``. Two classes
    are one model."""
    left_out = [*sizes, -1] if len(sizes) > 1 else [-1]
    classes = [1] if k == 2 else list(range(k))
    total = sum(sizes.values())
    n = np.repeat([float(total - sizes.get(f, 0)) for f in left_out], len(classes))
    own, out = np.tile(classes, len(left_out)), np.repeat(left_out, len(classes))

    def loss(f, batch, mu):
        y = np.where(batch.column(1).to_numpy()[:, None] == own, 1.0, -1.0)
        value, slope = margins.corner(1 - y * f, mu)
        used = batch.column(2).to_numpy()[:, None] != out
        return value * used, -y * slope * used, margins.bend(1 - y * f, mu) * used

    got = margins.fit(rows, dim, n, loss, C, accuracy)
    shape = (len(left_out), len(classes))
    return got["w"].reshape(*shape, dim), got["b"].reshape(shape), got


def _margins(w: np.ndarray, b: np.ndarray, z):
    """An array of each class's margin; one model gives the second class's and
    its negative."""
    each = [F.aggregate(F.zip_with(z, F.array(*[F.lit(float(v)) for v in ws]), lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v) + F.lit(float(bs)) for ws, bs in zip(w, b, strict=True)]
    return F.array(-each[0], each[0]) if len(each) == 1 else F.array(*each)


def support_vector(df: DataFrame, target: str, key: str, features=None, kernel: str = "rbf", C: float = 1.0,
                   gamma="scale", folds: int = 5, accuracy: float = margins.ACCURACY) -> ModelResult:
    """Kernel SVM approximated by an explicit feature map and a linear hinge
    model (one-vs-rest beyond two classes), with class probabilities: margins of
    ``folds`` out-of-fold fits, made in the same passes as the model itself, are
    calibrated by Platt's sigmoid, and beyond
    two classes the classes' probabilities are scaled to sum 1. The AUC is of
    the probabilities, macro one-vs-rest beyond two classes. ``approximate``
    is set."""
    p = prepare(df, target, key, features)
    km = fit_kernel_map(p.train, kernel, gamma, key=key)
    fold = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("fold")), F.lit(folds)).cast("int")
    rows = km.transform(p.train).select(vector_to_array("kfeatures").alias("z"), F.col("label").cast("int").alias("label"), fold.alias("fold"))
    k, dim = len(p.classes), len(rows.first()["z"])
    sizes = {r["fold"]: r["n"] for r in rows.groupBy("fold").agg(F.count("*").alias("n")).collect()}
    rows = packed(rows, sum(sizes.values()), 8 * dim)
    w, b, fitted = _fit_svms(rows, dim, sizes, k, C, accuracy)
    apart = _margins(w[-1], b[-1], F.col("z"))
    for i, f in enumerate(sizes if len(sizes) > 1 else ()):
        apart = F.when(F.col("fold") == f, _margins(w[i], b[i], F.col("z"))).otherwise(apart)
    calibration = platt(rows.select(apart.alias("margins"), "label").persist(), k)
    out = km.transform(p.test).withColumn("margins", _margins(w[-1], b[-1], vector_to_array("kfeatures")))
    raw = [1 / (1 + F.exp(F.lit(slope) * F.col("margins")[c] + F.lit(shift))) for c, (slope, shift) in enumerate(calibration)]
    raw = F.array(1 - raw[1], raw[1]) if k == 2 else F.array(*raw)  # two classes have one sigmoid
    out = out.withColumn("raw_p", raw)
    whole = F.aggregate("raw_p", F.lit(0.0), lambda s, v: s + v)
    best = F.array_position("margins", F.array_max("margins")) - 1
    scored = out.withColumn("probability", array_to_vector(F.transform("raw_p", lambda v: v / whole))).withColumn("prediction", best.cast("double"))
    res = _evaluate(p, scored, key, target, {"w": w[-1], "b": b[-1], "kernel": km}, "probability")
    res.extra |= {"calibration": calibration, "passes": fitted["passes"]}
    res.metrics = res.metrics.withColumns({"approximate": F.lit(True), "converged": F.lit(fitted["converged"])})
    rows.unpersist()
    return res

"""Regression operators (G1-G6) with the shared evaluation.

Preparation: validate, drop missing, plain deterministic 80/20 split,
scaler fitted on training rows. Objective maps to MLlib (measured):
ridge ``regParam = alpha * sd_pop(y_train) / n_train`` with the normal
solver; lasso ``regParam = alpha``; features never re-standardised."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import evaluate as ev
from . import margins, trees
from .classify import FOREST_DEFAULT_DEPTH, MAX_TREE_DEPTH, ModelResult, prepare
from .features import fit_kernel_map
from .passes import packed


def _finish(p, pred: DataFrame, key: str, model, extra=None) -> ModelResult:
    out = pred.select(key, F.col("label").alias("actual"), F.col("prediction"))
    m = ev.regression_metrics(out, "actual", "prediction")
    n_train, n_test = p.train.count(), p.test.count()
    m = m.select("mse", "rmse", "mae", "r2", F.lit(n_train).alias("n_train"), F.lit(n_test).alias("n_test"))
    return ModelResult(m, out, model, extra or {})


def _coef_table(spark, feats, coefs, intercept):
    rows = [(f, float(c)) for f, c in zip(feats, coefs)] + [("(intercept)", float(intercept))]
    return spark.createDataFrame(rows, "feature string, coefficient double")


def linear_regression(df: DataFrame, target: str, key: str, features=None) -> ModelResult:
    """G1: ordinary least squares on scaled features."""
    p = prepare(df, target, key, features, stratify=False, encode=False)
    m = LinearRegression(featuresCol="features", labelCol="label", regParam=0.0, solver="normal",
                         standardization=False).fit(p.train)
    return _finish(p, m.transform(p.test), key, m,
                   {"coefficients": _coef_table(df.sparkSession, p.features, m.coefficients, m.intercept)})


def ridge_regression(df: DataFrame, target: str, key: str, features=None, alpha: float = 1.0) -> ModelResult:
    """L2 penalty alpha (sklearn scale)."""
    p = prepare(df, target, key, features, stratify=False, encode=False)
    r = p.train.agg(F.stddev_pop("label").alias("sd"), F.count(F.lit(1)).alias("n")).first()
    reg = alpha * (r["sd"] or 1.0) / r["n"]
    m = LinearRegression(featuresCol="features", labelCol="label", regParam=reg, elasticNetParam=0.0,
                         solver="normal", standardization=False).fit(p.train)
    return _finish(p, m.transform(p.test), key, m,
                   {"coefficients": _coef_table(df.sparkSession, p.features, m.coefficients, m.intercept)})


def lasso_regression(df: DataFrame, target: str, key: str, features=None, alpha: float = 1.0,
                     max_iter: int = 10000) -> ModelResult:
    """L1 penalty alpha; also lists the features kept (non-zero)."""
    p = prepare(df, target, key, features, stratify=False, encode=False)
    m = LinearRegression(featuresCol="features", labelCol="label", regParam=alpha, elasticNetParam=1.0,
                         standardization=False, maxIter=max_iter, tol=1e-9).fit(p.train)
    kept = [f for f, c in zip(p.features, m.coefficients) if abs(c) > 0]
    return _finish(p, m.transform(p.test), key, m,
                   {"coefficients": _coef_table(df.sparkSession, p.features, m.coefficients, m.intercept),
                    "selected_features": kept})


def decision_tree_regression(df: DataFrame, target: str, key: str, features=None,
                             max_depth: int | None = None) -> ModelResult:
    """Variance-reduction tree; unlimited depth → 30."""
    p = prepare(df, target, key, features, stratify=False, encode=False)
    m = trees.fit(p.train, key, 0, max_depth=min(max_depth or MAX_TREE_DEPTH, MAX_TREE_DEPTH))
    return _finish(p, m.transform(p.test), key, m)


def random_forest_regression(df: DataFrame, target: str, key: str, features=None, n_estimators: int = 100,
                             max_depth: int | None = None) -> ModelResult:
    """100 trees, all features considered per split."""
    p = prepare(df, target, key, features, stratify=False, encode=False)
    m = trees.fit(p.train, key, 0, n_estimators, min(max_depth or FOREST_DEFAULT_DEPTH, MAX_TREE_DEPTH))
    return _finish(p, m.transform(p.test), key, m)


def fit_svr(rows: DataFrame, dim: int, n: int, C: float = 1.0, epsilon: float = 0.1, accuracy: float = margins.ACCURACY) -> dict:
    """Weights of ``1 / (2 C n) |w|^2`` plus the mean epsilon-insensitive loss
    for rows ``z, y``, with the ``objective`` reached."""

    def loss(f, batch, mu):
        r = f - batch.column(1).to_numpy()[:, None]
        value, slope = margins.corner(np.abs(r) - epsilon, mu)
        return value, slope * np.sign(r), margins.bend(np.abs(r) - epsilon, mu)

    got = margins.fit(rows, dim, np.array([float(n)]), loss, C, accuracy)
    return got | {"w": got["w"][0], "b": float(got["b"][0]), "objective": float(got["objective"][0])}


def support_vector_regression(df: DataFrame, target: str, key: str, features=None, kernel: str = "rbf",
                              C: float = 1.0, epsilon: float = 0.1, gamma="scale") -> ModelResult:
    """Epsilon-insensitive SVR on the standardised target (predictions
    inverse-scaled), kernel approximated by an explicit feature map; solved to
    its optimum by Newton steps (L-BFGS for large models) with gradients summed in Spark. The metrics carry
    ``converged`` and the ``objective`` reached."""
    p = prepare(df, target, key, features, stratify=False, encode=False)
    ys = p.train.agg(F.avg("label").alias("m"), F.stddev_pop("label").alias("s"), F.count(F.lit(1)).alias("n")).first()
    y_m, y_s, n = ys["m"], (ys["s"] or 1.0), ys["n"]
    km = fit_kernel_map(p.train, kernel, gamma, key=key)
    rows = km.transform(p.train).select(vector_to_array("kfeatures").alias("z"), ((F.col("label") - y_m) / y_s).alias("y"))
    dim = len(rows.first()["z"])
    rows = packed(rows, n, 8 * dim)
    fit = fit_svr(rows, dim, n, C, epsilon)
    rows.unpersist()
    te = km.transform(p.test)
    wl, b = [float(x) for x in fit["w"]], fit["b"]
    pred = te.withColumn("_z", vector_to_array("kfeatures")).withColumn(
        "prediction",
        (F.aggregate(F.zip_with("_z", F.array(*[F.lit(x) for x in wl]), lambda a, c: a * c),
                     F.lit(0.0), lambda acc, v: acc + v) + F.lit(b)) * F.lit(y_s) + F.lit(y_m))
    res = _finish(p, pred, key, {"w": wl, "b": b, "kernel": km, "passes": fit["passes"]})
    res.metrics = res.metrics.withColumns({"approximate": F.lit(True), "converged": F.lit(fit["converged"]), "objective": F.lit(fit["objective"])})
    return res


def simple_ols(df: DataFrame, y: str, x: str) -> DataFrame:
    """One-feature least squares on all rows: slope, intercept, R², n."""
    d = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    d = d.withColumn("features", F.array("x"))
    from pyspark.ml.functions import array_to_vector
    d = d.withColumn("features", array_to_vector("features"))
    m = LinearRegression(featuresCol="features", labelCol="y", regParam=0.0, solver="normal",
                         standardization=False).fit(d)
    return df.sparkSession.createDataFrame(
        [(float(m.coefficients[0]), float(m.intercept), float(m.summary.r2), int(m.summary.numInstances))],
        "slope double, intercept double, r2 double, n long")

"""Kernel feature maps for the SVM/SVR operators (C5, G6): the kernel
machine is replaced by an explicit map followed by a linear model.

* rbf     random Fourier features z(x) = sqrt(2/D) cos(Wx + b),
          W ~ N(0, 2 gamma), b ~ U[0, 2 pi) (Rahimi & Recht 2007)
* poly    degree-3 monomials (``PolynomialExpansion``), inputs scaled by
          sqrt(gamma)
* sigmoid Nystroem map on landmarks picked by hash order (Williams &
          Seeger 2001)
* linear  identity

The projection matrix is a small driver-side array (D x d) shipped with
the task closure; rows stream through Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.feature import PolynomialExpansion
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

N_FOURIER = 256
N_LANDMARKS = 128


def gamma_scale(df: DataFrame, features: str = "features") -> float:
    """sklearn's gamma='scale': 1 / (d * Var(X)) over all entries."""
    arr = df.select(F.explode(vector_to_array(features)).alias("v"))
    v = arr.agg(F.var_pop("v")).first()[0] or 0.0
    d = len(df.select(features).first()[0])
    return 1.0 / (d * v) if v > 0 else 1.0


def _matmul_udf(w: np.ndarray, b: np.ndarray, kind: str, scale: float):
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def fmap(x: pd.Series) -> pd.Series:
        if len(x) == 0:
            return pd.Series([], dtype=object)
        m = np.vstack(x.to_numpy())
        z = m @ w.T + b
        if kind == "cos":
            z = scale * np.cos(z)
        elif kind == "tanh":
            z = np.tanh(z)
        return pd.Series(list(z))
    return fmap


class KernelMap:
    """Fitted feature map; ``transform`` adds ``out`` (a vector column)."""

    def __init__(self, kernel: str, gamma: float, d: int, seed: int = 42, n_components: int = N_FOURIER,
                 landmarks: np.ndarray | None = None, coef0: float = 0.0, degree: int = 3):
        self.kernel, self.gamma, self.d, self.seed = kernel, gamma, d, seed
        self.degree, self.coef0 = degree, coef0
        rng = np.random.default_rng(seed)
        if kernel == "rbf":
            self.w = rng.normal(0.0, np.sqrt(2.0 * gamma), size=(n_components, d))
            self.b = rng.uniform(0.0, 2 * np.pi, size=n_components)
        elif kernel == "sigmoid":
            lm = landmarks
            k_mm = np.tanh(gamma * lm @ lm.T + coef0)
            u, s, vt = np.linalg.svd(k_mm)
            s = np.maximum(s, 1e-12)
            self.norm = (u / np.sqrt(s)) @ vt
            self.w, self.b = gamma * lm, np.full(len(lm), coef0)

    def transform(self, df: DataFrame, features: str = "features", out: str = "kfeatures") -> DataFrame:
        if self.kernel == "linear":
            return df.withColumn(out, F.col(features))
        if self.kernel == "poly":
            scaled = df.withColumn("_kx", array_to_vector(
                F.transform(vector_to_array(features), lambda v: v * F.lit(float(np.sqrt(self.gamma))))))
            pe = PolynomialExpansion(degree=self.degree, inputCol="_kx", outputCol=out)
            return pe.transform(scaled).drop("_kx")
        if self.kernel == "rbf":
            f = _matmul_udf(self.w, self.b, "cos", float(np.sqrt(2.0 / len(self.b))))
            return df.withColumn(out, array_to_vector(f(vector_to_array(features))))
        if self.kernel == "sigmoid":
            f = _matmul_udf(self.w, self.b, "tanh", 1.0)
            norm = self.norm

            @F.pandas_udf(T.ArrayType(T.DoubleType()))
            def proj(x: pd.Series) -> pd.Series:
                if len(x) == 0:
                    return pd.Series([], dtype=object)
                return pd.Series(list(np.vstack(x.to_numpy()) @ norm.T))
            return df.withColumn(out, array_to_vector(proj(f(vector_to_array(features)))))
        raise ValueError(f"unknown kernel {self.kernel!r}")


def fit_kernel_map(train: DataFrame, kernel: str = "rbf", gamma="scale", features: str = "features",
                   seed: int = 42, key: str | None = None) -> KernelMap:
    g = gamma_scale(train, features) if gamma == "scale" else float(gamma)
    d = len(train.select(features).first()[0])
    landmarks = None
    if kernel == "sigmoid":
        order = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))) if key else F.rand(seed)
        rows = train.orderBy(order).limit(N_LANDMARKS).select(vector_to_array(features).alias("a")).collect()
        landmarks = np.array([r["a"] for r in rows])
    return KernelMap(kernel, g, d, seed, landmarks=landmarks)

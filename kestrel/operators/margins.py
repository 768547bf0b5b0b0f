"""Regularised linear models with a piecewise linear loss (SVM, SVR), solved to
their optimum: all models of a fit (classes, folds) advance in shared passes."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame

from .optimise import lbfgs, newton
from .passes import summed

#: Share of the objective that smoothing may hide at the end.
ACCURACY = 0.005
#: Numbers of all models' second derivatives up to which Newton steps are taken.
NEWTON_CELLS = 1 << 20


def corner(over: np.ndarray, mu: float) -> tuple[np.ndarray, np.ndarray]:
    """``max(over, 0)`` and its slope with a parabola of width ``mu`` at the
    corner: never above the true loss, and below it by at most ``mu / 2``."""
    if not mu:
        return np.maximum(over, 0), (over > 0).astype(float)
    value = np.where(over <= 0, 0.0, np.where(over < mu, over**2 / (2 * mu), over - mu / 2))
    return value, np.clip(over / mu, 0, 1)


def bend(over: np.ndarray, mu: float) -> np.ndarray:
    """The curvature of ``corner``."""
    return np.where((over > 0) & (over < mu), 1 / mu, 0.0) if mu else np.zeros_like(over)


def fit(rows: DataFrame, dim: int, sizes: np.ndarray, loss: Callable, C: float = 1.0, accuracy: float = ACCURACY) -> dict:
    """Weights ``w`` (models, dim) and ``b`` that minimise, for each model, ``1 /
    (2 C n) |w|^2`` plus the mean of ``loss`` over its ``n = sizes[m]`` rows.

    ``rows`` starts with ``z``; ``loss(f, batch, mu)`` gives values, slopes and
    curvatures (rows, models) at the linear scores ``f``, 0 for rows that are not
    a model's. Newton steps (L-BFGS beyond ``NEWTON_CELLS``, or where Newton does
    not settle) on ever smaller corners, each started at the last solution, until
    the corners hide at most ``accuracy`` of the objective."""
    models, size = len(sizes), dim + 1
    lam = 1.0 / (C * sizes)
    cells = models * (dim + 2)
    second = models * size * size <= NEWTON_CELLS

    def evaluate(points: list[np.ndarray], mu: float, curved: bool = False):
        """For each point the models' values and gradients, and with ``curved``
        the first point's second derivatives."""
        at = [p.reshape(models, size) for p in points]

        def partial(batches):
            total = np.zeros((len(at), models, dim + 2))
            curves = np.zeros((models if curved else 0, size, size))
            for b in batches:
                z = b.column(0).flatten().to_numpy().reshape(-1, dim)
                for k, (t, w) in enumerate(zip(total, at, strict=True)):
                    value, slope, curve = loss(z @ w[:, :dim].T + w[:, dim], b, mu)
                    t[:, 0] += value.sum(axis=0)
                    t[:, 1:dim + 1] += slope.T @ z
                    t[:, dim + 1] += slope.sum(axis=0)
                    for m in range(models if curved and k == 0 else 0):
                        near = np.flatnonzero(curve[:, m])
                        side = np.column_stack([z[near], np.ones(len(near))])
                        curves[m] += side.T @ (side * curve[near, m][:, None])
            return np.concatenate([total.ravel(), curves.ravel()])

        got = summed(rows, partial, len(at) * cells + (models * size * size if curved else 0))
        sums = got[:len(at) * cells].reshape(len(at), models, dim + 2) / sizes[:, None]
        out = []
        for t, w in zip(sums, at, strict=True):
            inner = w[:, :dim]
            value = t[:, 0] + 0.5 * lam * (inner**2).sum(axis=1)
            out.append((value, np.column_stack([t[:, 1:dim + 1] + lam[:, None] * inner, t[:, dim + 1]])))
        if not curved:
            return out
        h = got[len(at) * cells:].reshape(models, size, size) / sizes[:, None, None]
        h[:, range(dim), range(dim)] += lam[:, None]
        return out, h

    x, mu, passes = np.zeros(models * size), 1.0 if second else 0.1, 0
    while True:
        tol, settled = max(1e-5, 0.02 * mu), False
        if second:
            got = newton(lambda points, mu=mu: evaluate(points, mu, True), x.reshape(models, size), tol)
            x, passes, settled = got.x.ravel(), passes + got.passes, got.converged
        if not settled:
            got = lbfgs(lambda points, mu=mu: [(float(v.sum()), g.ravel()) for v, g in evaluate(points, mu)], x, tol=tol)
            x, passes = got.x, passes + got.passes
        objective = evaluate([x], 0.0)[0][0]
        passes += 1
        if mu / 2 <= accuracy * objective.mean() or mu < 1e-6:
            w = x.reshape(models, size)
            return {"w": w[:, :dim], "b": w[:, dim], "objective": objective, "passes": passes, "converged": got.converged}
        mu = max(mu * (0.25 if second else 0.1), 2 * accuracy * objective.mean() * 0.99)

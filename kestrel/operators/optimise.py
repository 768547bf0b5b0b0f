"""Smooth convex minimisation where one evaluation is a pass over the data.

L-BFGS keeps a few vectors of the size of the model on the driver, Newton steps
a matrix of its size squared; sums over rows are made in Spark. A pass evaluates several step lengths at once, so a
line search seldom needs a second one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

MEMORY = 10
#: Step lengths tried in one pass, as shares of the proposed step.
STEPS = (1.0, 0.5, 0.25, 0.05)
ARMIJO = 1e-4


@dataclass
class Minimum:
    x: np.ndarray
    value: float
    gradient: float
    passes: int
    converged: bool


def lbfgs(evaluate: Callable[[list[np.ndarray]], list[tuple[float, np.ndarray]]], x0: np.ndarray, tol: float = 1e-4,
          max_passes: int = 2000) -> Minimum:
    """Minimise until the gradient's largest entry is at most ``tol`` or no step
    lowers the value any more (to rounding). ``evaluate`` takes a list of points
    and gives their values and gradients."""
    (f, g), passes = evaluate([x0])[0], 1
    x, pairs = x0, []
    while passes < max_passes:
        if np.abs(g).max(initial=0) <= tol:
            return Minimum(x, f, float(np.abs(g).max(initial=0)), passes, True)
        d = -_inverse_hessian(g, pairs)
        slope = float(g @ d)
        if slope >= 0:
            pairs, d = [], -g
            slope = float(g @ d)
        scale = 1.0 if pairs else min(1.0, 1.0 / np.abs(g).sum())
        found = None
        while found is None and scale > 1e-12 and passes < max_passes:
            steps = [scale * s for s in STEPS]
            tried = evaluate([x + s * d for s in steps])
            passes += 1
            good = [(v, i) for i, ((v, _), s) in enumerate(zip(tried, steps, strict=True)) if v <= f + ARMIJO * s * slope]
            if good:
                i = min(good)[1]
                found = (x + steps[i] * d, *tried[i])
            scale *= STEPS[-1] * 0.5
        if found is None:
            if pairs:  # start again from the gradient
                pairs = []
                continue
            return Minimum(x, f, float(np.abs(g).max(initial=0)), passes, passes < max_passes)
        new_x, new_f, new_g = found
        s, y = new_x - x, new_g - g
        if s @ y > 1e-12 * (s @ s):
            pairs = [*pairs, (s, y)][-MEMORY:]
        x, f, g = new_x, new_f, new_g
    return Minimum(x, f, float(np.abs(g).max(initial=0)), passes, False)


def newton(evaluate: Callable, x0: np.ndarray, tol: float = 1e-4, max_passes: int = 60) -> Minimum:
    """Minimise independent models, a row of ``x0`` each, by Newton steps with a
    line search of each model's own, until the gradients' largest entry is at most
    ``tol``. ``evaluate`` takes points and gives their values and gradients by
    model, and the first point's second derivatives."""
    ((f, g),), h = evaluate([x0])
    x, passes, models = x0, 1, range(len(x0))
    while np.abs(g).max(initial=0) > tol and passes < max_passes:
        # the offset has no penalty: a little keeps the system regular
        d = np.stack([-np.linalg.solve(h[m] + 1e-9 * np.trace(h[m]) / len(h[m]) * np.eye(len(h[m])), g[m]) for m in models])
        slope, taken, scale = (g * d).sum(axis=1), np.zeros(len(x)), 1.0
        while (taken == 0).any() and scale > 1e-9 and passes < max_passes:
            steps = [scale * s for s in STEPS]
            tried, h_full = evaluate([x + s * d for s in steps])
            passes += 1
            for m in np.flatnonzero(taken == 0):
                taken[m] = next((s for s, (v, _) in zip(steps, tried, strict=True) if v[m] <= f[m] + ARMIJO * s * slope[m] + 1e-15 * abs(f[m])), 0.0)
            if scale == 1.0 and (taken == 1.0).all():
                (f, g), h = tried[0], h_full
            scale *= STEPS[-1] * 0.5
        if (taken == 0).all():
            break
        x = x + taken[:, None] * d
        if not (taken == 1.0).all():
            ((f, g),), h = evaluate([x])
            passes += 1
    top = float(np.abs(g).max(initial=0))
    return Minimum(x, float(f.sum()), top, passes, top <= tol)


def _inverse_hessian(g: np.ndarray, pairs: list) -> np.ndarray:
    """The two-loop recursion."""
    q, coefs = g.copy(), []
    for s, y in reversed(pairs):
        a = (s @ q) / (s @ y)
        coefs.append(a)
        q -= a * y
    if pairs:
        s, y = pairs[-1]
        q *= (s @ y) / (y @ y)
    for (s, y), a in zip(pairs, reversed(coefs), strict=True):
        q += s * (a - (y @ q) / (s @ y))
    return q

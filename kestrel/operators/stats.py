"""Statistics and hypothesis tests.

Design rule: one grouped aggregation produces the sufficient statistics;
the statistic and its p-value are column expressions / Arrow UDFs on the
aggregate rows. Every test takes ``by`` (group columns): one test per group
in the same job. Significance is ``p < 0.05``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import distributions as dist
from ..session import ensure_checkpoint_dir
from . import ordering
from .passes import packed, summed

ALPHA = 0.05


def _by(by) -> list[str]:
    if by is None:
        return []
    return [by] if isinstance(by, str) else list(by)


def _clean(df: DataFrame, cols) -> DataFrame:
    """Drop rows where any of ``cols`` is NULL or NaN."""
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(c).isNotNull()
        if dict(df.dtypes)[c] in ("double", "float"):
            cond = cond & ~F.isnan(F.col(c))
    return df.filter(cond)


def group_moments(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """A10: per key n, mean, sample variance (partial/final aggregate)."""
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"),
                                 F.var_samp(value).alias("var"))


# ------------------------------------------------------------------ T1
def one_way_anova(df: DataFrame, value: str, group: str, by=None) -> DataFrame:
    """One-way ANOVA per ``by`` group: k, N, SSB, SSW, F, p."""
    by = _by(by)
    d = _clean(df, [value, group])
    g = group_moments(d, value, by + [group])
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    g = g.withColumn("_gm", F.sum(F.col("n") * F.col("mean")).over(w) / F.sum("n").over(w))
    t = g.groupBy(*by).agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"),
        F.sum(F.col("n") * (F.col("mean") - F.col("_gm")) ** 2).alias("ssb"),
        F.sum(F.coalesce((F.col("n") - 1) * F.col("var"), F.lit(0.0))).alias("ssw"))
    df_b, df_w = F.col("k") - 1, F.col("n") - F.col("k")
    f = F.try_divide(F.col("ssb") / df_b, F.try_divide(F.col("ssw"), df_w))
    out = t.select(*by, "k", "n", "ssb", "ssw", df_b.alias("df_between"), df_w.alias("df_within"),
                   f.alias("f_stat"))
    return _with_p(out, dist.f_sf(F.col("f_stat"), F.col("df_between").cast("double"),
                                  F.col("df_within").cast("double")), valid=F.col("k") >= 2)


def _with_p(df: DataFrame, p, valid=None) -> DataFrame:
    pv = dist.nan_null(p)
    if valid is not None:
        pv = F.when(valid, pv)
    return df.withColumn("p_value", pv).withColumn("significant", F.col("p_value") < F.lit(ALPHA))


# ------------------------------------------------------------------ T2
def two_way_cells(df: DataFrame, value: str, factor_a: str, factor_b: str) -> DataFrame:
    """Cell table of the two-way design: n, mean and within-cell SS."""
    d = _clean(df, [value, factor_a, factor_b])
    return d.groupBy(factor_a, factor_b).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"),
        F.coalesce(F.var_samp(value) * (F.count(value) - 1), F.lit(0.0)).alias("ss_within"))


MAX_LEVELS = 1 << 22
BROADCAST_LEVELS = 1 << 16


def _level_ids(cells: DataFrame, factor: str, name: str) -> tuple[DataFrame, int]:
    """A factor's levels with numbers from 0; the driver numbers them."""
    levels = cells.select(factor).distinct().orderBy(factor).limit(MAX_LEVELS + 1).collect()
    if len(levels) > MAX_LEVELS:
        raise ValueError(f"{factor!r} has more than {MAX_LEVELS} levels")
    kind = cells.schema[factor].dataType.simpleString()
    return cells.sparkSession.createDataFrame([(r[0], i) for i, r in enumerate(levels)], f"{name}_level {kind}, {name} int"), len(levels)


class _Design:
    """Passes over numbered cells ``i, j, n, mean``; a vector has a number for
    each level of the first factor, then of the second."""

    def __init__(self, cells: DataFrame, n_a: int, n_b: int):
        self.cells, self.n_a, self.n_b, self.total = cells, n_a, n_b, n_a + n_b

    @staticmethod
    def arrays(batches):
        for b in batches:
            yield tuple(b.column(k).to_numpy() for k in range(4))

    def sides(self, weigh, extra=None) -> np.ndarray:
        """Sums of ``weigh(i, j, n, m)`` by level, then of ``extra`` over all cells."""
        n_a, n_b = self.n_a, self.n_b

        def partial(batches):
            out = np.zeros(n_a + n_b + 1)
            for i, j, n, m in _Design.arrays(batches):
                v = weigh(i, j, n, m)
                out[:n_a] += np.bincount(i, v, n_a)
                out[n_a:-1] += np.bincount(j, v, n_b)
                out[-1] += extra(i, j, n, m).sum() if extra else 0.0
            return out

        return summed(self.cells, partial, self.total + 1)

    def additive_rss(self, r: np.ndarray, diagonal: np.ndarray, tol: float) -> float:
        """Residual sum of squares of the additive model: conjugate gradients on
        the normal equations, diagonal preconditioner; one pass a step."""
        n_a, x, z = self.n_a, np.zeros(self.total), r / diagonal
        p, rz = z, float(r @ z)
        first = rz
        while rz > tol * tol * first and first > 0:
            q = self.sides(lambda i, j, n, m, p=p: n * (p[i] + p[n_a + j]))[:-1]
            curve = float(p @ q)
            if curve <= 0:  # the rest lies in the null space
                break
            x, r = x + rz / curve * p, r - rz / curve * q
            z = r / diagonal
            rz, old = float(r @ z), rz
            p = z + rz / old * p
        return float(self.sides(lambda i, j, n, m: n, lambda i, j, n, m: n * (m - x[i] - x[n_a + j]) ** 2)[-1])

    def parts(self) -> int:
        """Connected parts of the levels: smallest labels over the cells, with
        jumps along the labels between passes."""
        n_a, n_b, label = self.n_a, self.n_b, np.arange(self.total)
        while True:

            def partial(batches, label=label):
                out = label.astype(float)
                for i, j, _, _ in _Design.arrays(batches):
                    least = np.minimum(label[i], label[n_a + j])
                    np.minimum.at(out, i, least)
                    np.minimum.at(out, n_a + j, least)
                return out

            new = summed(self.cells, partial, n_a + n_b, np.minimum, np.inf).astype(np.int64)
            while (new[new] != new).any():
                new = new[new]
            if (new == label).all():
                return len(np.unique(label))
            label = new


def two_way_anova(df: DataFrame, value: str, factor_a: str, factor_b: str, tol: float = 1e-9) -> DataFrame:
    """Two-way ANOVA with interaction, Type II sums of squares.

    The cell table stays in Spark however many levels there are; the additive
    model is solved by conjugate gradients, so the driver holds one number a
    level (at most ``MAX_LEVELS``, else an error) and no cell."""
    spark = df.sparkSession
    schema = "source string, sum_sq double, df double, f_stat double, p_value double, significant boolean"
    ensure_checkpoint_dir(spark)
    cells = two_way_cells(df, value, factor_a, factor_b).checkpoint()
    whole = cells.agg(F.count("*").alias("cells"), F.sum("n").alias("n"), F.sum("ss_within").alias("ssw"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean")).first()
    if not whole["cells"]:
        return spark.createDataFrame([], schema)
    (ids_a, n_a), (ids_b, n_b) = (_level_ids(cells, f, n) for f, n in ((factor_a, "i"), (factor_b, "j")))
    # few levels are broadcast: a sort-merge join of a handful of cells claims its
    # buffers in every partition, and one packed task would add them all up
    ids_a, ids_b = (F.broadcast(ids) if n <= BROADCAST_LEVELS else ids for ids, n in ((ids_a, n_a), (ids_b, n_b)))
    placed = cells.join(ids_a, F.col(factor_a) == F.col("i_level")).join(ids_b, F.col(factor_b) == F.col("j_level"))
    placed = packed(placed.select("i", "j", F.col("n").cast("double").alias("n"), (F.col("mean") - F.lit(whole["mean"])).alias("mean")), whole["cells"], 24)
    design = _Design(placed, n_a, n_b)
    diagonal = design.sides(lambda i, j, n, m: n)[:-1]
    rhs = design.sides(lambda i, j, n, m: n * m, lambda i, j, n, m: n * m * m)
    rhs, spread = rhs[:-1], rhs[-1]
    by_level = rhs**2 / diagonal
    rest, ssw = design.additive_rss(rhs, diagonal, tol), float(whole["ssw"])
    ss_a, ss_b = spread - by_level[n_a:].sum() - rest, spread - by_level[:n_a].sum() - rest
    parts = design.parts()
    placed.unpersist()
    df_res = whole["n"] - whole["cells"]
    df_ab = whole["cells"] - (n_a + n_b - parts)
    mse = ssw / df_res if df_res > 0 else float("nan")
    rows = []
    for name, ss, d in ((factor_a, ss_a, n_a - 1), (factor_b, ss_b, n_b - 1), (f"{factor_a}:{factor_b}", rest, df_ab)):
        f = (ss / d) / mse if d > 0 and mse > 0 else float("nan")
        p = float(dist.f_sf_np([f], [d], [df_res])[0]) if f == f else float("nan")
        rows.append((name, float(ss), float(d), float(f) if f == f else None,
                     float(p) if p == p else None, bool(p < ALPHA) if p == p else None))
    rows.append(("Residual", ssw, float(df_res), None, None, None))
    return spark.createDataFrame(rows, schema)


# ------------------------------------------------------------------ T4/T5
def two_sample_moments(df: DataFrame, value: str, group: str, first, second, by=None) -> DataFrame:
    """n, mean, sample variance of two groups side by side (one pass)."""
    by = _by(by)
    d = _clean(df, [value, group]).filter(F.col(group).isin(first, second))
    aggs = []
    for tag, lvl in (("1", first), ("2", second)):
        v = F.when(F.col(group) == F.lit(lvl), F.col(value))
        aggs += [F.count(v).alias(f"n{tag}"), F.avg(v).alias(f"mean{tag}"), F.var_samp(v).alias(f"var{tag}")]
    return (d.groupBy(*by) if by else d.groupBy()).agg(*aggs)


def f_test(df: DataFrame, value: str, group: str, first, second, by=None) -> DataFrame:
    """Variance-ratio F test, larger variance on top, p = 2 min(cdf, sf)."""
    m = two_sample_moments(df, value, group, first, second, by)
    top1 = F.col("var1") >= F.col("var2")
    f = F.try_divide(F.greatest("var1", "var2"), F.least("var1", "var2"))
    dn = F.when(top1, F.col("n1") - 1).otherwise(F.col("n2") - 1).cast("double")
    dd = F.when(top1, F.col("n2") - 1).otherwise(F.col("n1") - 1).cast("double")
    out = m.select(*_by(by), "n1", "n2", "var1", "var2", f.alias("f_stat"), dn.alias("df_num"),
                   dd.alias("df_den"))
    sf = dist.f_sf(F.col("f_stat"), F.col("df_num"), F.col("df_den"))
    return _with_p(out, F.least(F.lit(1.0), 2 * F.least(sf, 1 - sf)))


def t_test_welch(df: DataFrame, value: str, group: str, first, second, by=None) -> DataFrame:
    """Independent two-sample t test, unequal variances (Welch)."""
    m = two_sample_moments(df, value, group, first, second, by)
    a, b = F.col("var1") / F.col("n1"), F.col("var2") / F.col("n2")
    t = F.try_divide(F.col("mean1") - F.col("mean2"), F.sqrt(a + b))
    dfw = F.try_divide((a + b) ** 2, a ** 2 / (F.col("n1") - 1) + b ** 2 / (F.col("n2") - 1))
    out = m.select(*_by(by), "n1", "n2", "mean1", "mean2", "var1", "var2", t.alias("t_stat"),
                   dfw.alias("df_welch"), (F.col("n1") + F.col("n2") - 2).cast("double").alias("df_reported"))
    return _with_p(out, 2 * dist.t_sf(F.abs(F.col("t_stat")), F.col("df_welch")))


def t_test_paired(df: DataFrame, first: str, second: str, by=None) -> DataFrame:
    """Paired t test on two columns of the same rows (pairs joined first)."""
    d = _clean(df, [first, second]).withColumn("_d", F.col(first) - F.col(second))
    g = (d.groupBy(*_by(by)) if by else d.groupBy()).agg(
        F.count("_d").alias("n"), F.avg("_d").alias("mean_diff"), F.stddev_samp("_d").alias("sd_diff"),
        F.avg(first).alias("mean1"), F.avg(second).alias("mean2"))
    t = F.try_divide(F.col("mean_diff"), F.col("sd_diff") / F.sqrt(F.col("n")))
    out = g.select(*_by(by), "n", "mean1", "mean2", "mean_diff", "sd_diff", t.alias("t_stat"),
                   (F.col("n") - 1).cast("double").alias("df"))
    return _with_p(out, 2 * dist.t_sf(F.abs(F.col("t_stat")), F.col("df")))


# ------------------------------------------------------------------ T6
def contingency(df: DataFrame, row: str, col: str) -> DataFrame:
    """Observed counts, completed with zero cells.

    The category lists (bounded by the number of levels, not rows) are
    collected and exploded as literals, so the grid needs no cross join."""
    d = df.filter(F.col(row).isNotNull() & F.col(col).isNotNull())
    obs = d.groupBy(row, col).agg(F.count(F.lit(1)).alias("observed"))
    cols = [r[0] for r in d.select(col).distinct().collect()]
    grid = d.select(row).distinct().select(row, F.explode(F.array(*[F.lit(c) for c in cols])).alias(col))
    return grid.join(obs, [row, col], "left").select(
        row, col, F.coalesce("observed", F.lit(0)).alias("observed"))


def chi_square_expected(df: DataFrame, row: str, col: str) -> DataFrame:
    """Expected counts ``row_total * col_total / n`` per cell."""
    obs = contingency(df, row, col)
    rt = obs.groupBy(row).agg(F.sum("observed").alias("row_total"))
    ct = obs.groupBy(col).agg(F.sum("observed").alias("col_total"))
    n = obs.agg(F.sum("observed")).first()[0] or 0
    e = obs.join(rt, row).join(ct, col)
    return e.select(row, col, "observed",
                    F.try_divide(F.col("row_total") * F.col("col_total"), F.lit(float(n))).alias("expected"))


def chi_square_test(df: DataFrame, row: str, col: str, correction: bool = True) -> DataFrame:
    """Chi-square test of independence; Yates' continuity correction when
    the table has one degree of freedom."""
    e = chi_square_expected(df, row, col)
    s = e.agg(F.countDistinct(row).alias("n_rows"), F.countDistinct(col).alias("n_cols"),
              F.sum("observed").alias("n"),
              F.collect_list(F.struct("observed", "expected")).alias("_cells"))
    dof = (F.col("n_rows") - 1) * (F.col("n_cols") - 1)
    yates = F.lit(correction) & (dof == 1)
    term = F.expr("aggregate(_cells, CAST(0.0 AS DOUBLE), (acc, c) -> acc + "
                  "pow(abs(c.observed - c.expected) - IF(_yates, least(0.5D, abs(c.observed - c.expected)), 0.0D), 2)"
                  " / c.expected)")
    out = s.withColumn("_yates", yates).select(
        "n", "n_rows", "n_cols", dof.alias("dof"), yates.alias("yates"), term.alias("statistic"))
    return _with_p(out, dist.chi2_sf(F.col("statistic"), F.col("dof").cast("double")))


# ------------------------------------------------------------------ T7
def proportion_z_test(df: DataFrame, flag: str, group: str, first, second) -> DataFrame:
    """Two-proportion z test with pooled variance, two-sided."""
    d = df.filter(F.col(group).isin(first, second) & F.col(flag).isNotNull())
    aggs = []
    for tag, lvl in (("1", first), ("2", second)):
        sel = F.col(group) == F.lit(lvl)
        aggs += [F.count_if(sel).alias(f"n{tag}"),
                 F.sum(F.when(sel, F.col(flag).cast("long"))).alias(f"x{tag}")]
    g = d.agg(*aggs)
    p1, p2 = F.col("x1") / F.col("n1"), F.col("x2") / F.col("n2")
    pp = (F.col("x1") + F.col("x2")) / (F.col("n1") + F.col("n2"))
    z = F.try_divide(p1 - p2, F.sqrt(pp * (1 - pp) * (1 / F.col("n1") + 1 / F.col("n2"))))
    out = g.select("n1", "x1", "n2", "x2", p1.alias("p1"), p2.alias("p2"), z.alias("z_stat"))
    return _with_p(out, 2 * dist.norm_sf(F.abs(F.col("z_stat"))))


# ------------------------------------------------------------------ A9/O1
def correlation_matrix(df: DataFrame, columns=None) -> DataFrame:
    """Pearson matrix, pairwise-complete, long ``(col_a, col_b, r)``; a
    constant column gives NULL (no ANSI divide-by-zero). One aggregate
    pass: Spark's covariance/variance aggregates are numerically stable
    (merge of centred moments)."""
    from .clean import numeric_columns
    cols = columns or numeric_columns(df)
    aggs, pairs = [], []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            if j < i:
                continue
            xa = F.when(F.col(b).isNotNull(), F.col(a).cast("double"))
            xb = F.when(F.col(a).isNotNull(), F.col(b).cast("double"))
            aggs += [F.covar_samp(xa, xb).alias(f"c{i}_{j}"), F.stddev_samp(xa).alias(f"sa{i}_{j}"),
                     F.stddev_samp(xb).alias(f"sb{i}_{j}")]
            pairs.append((i, j))
    wide = df.agg(*aggs)
    rows = []
    for i, j in pairs:
        r = F.try_divide(F.col(f"c{i}_{j}"), F.col(f"sa{i}_{j}") * F.col(f"sb{i}_{j}"))
        # greatest/least skip NULLs, so clamp only a defined coefficient
        defined = (F.col(f"sa{i}_{j}") > 0) & (F.col(f"sb{i}_{j}") > 0) & r.isNotNull()
        r = F.when(defined, F.least(F.lit(1.0), F.greatest(F.lit(-1.0), r)))
        rows.append(F.struct(F.lit(cols[i]).alias("col_a"), F.lit(cols[j]).alias("col_b"), r.alias("r")))
        if i != j:
            rows.append(F.struct(F.lit(cols[j]).alias("col_a"), F.lit(cols[i]).alias("col_b"), r.alias("r")))
    return wide.select(F.explode(F.array(*rows)).alias("x")).select("x.col_a", "x.col_b", "x.r")


def target_correlation(df: DataFrame, target: str, columns=None) -> DataFrame:
    """Correlations with ``target`` ordered by |r| (rank 1 = strongest)."""
    m = correlation_matrix(df, columns).filter((F.col("col_a") == target) & (F.col("col_b") != target))
    w = Window.orderBy(F.abs("r").desc_nulls_last(), "col_b")
    return m.select(F.col("col_b").alias("feature"), "r", F.abs("r").alias("abs_r"),
                    F.row_number().over(w).alias("rank"))


def correlation_analysis(df: DataFrame, target: str, columns=None) -> dict:
    """Matrix, target column, sample size (all rows) and variable count."""
    from .clean import numeric_columns
    cols = columns or numeric_columns(df)
    return {"matrix": correlation_matrix(df, cols), "target": target_correlation(df, target, cols),
            "summary": df.agg(F.count(F.lit(1)).alias("sample_size")).withColumn(
                "n_variables", F.lit(len(cols))).withColumn("p_value", F.lit(None).cast("double"))}


# ------------------------------------------------------------------ T9
def histogram(df: DataFrame, value: str, bins: int = 20) -> DataFrame:
    """Equal-width histogram over [min, max]: the max falls in the last bin."""
    d = _clean(df, [value])
    mm = d.agg(F.min(value).alias("lo"), F.max(value).alias("hi")).first()
    if mm["lo"] is None:
        return df.sparkSession.createDataFrame([], "bin int, bin_lo double, bin_hi double, n long")
    lo, hi = F.lit(float(mm["lo"])), F.lit(float(mm["hi"]))
    width = (hi - lo) / F.lit(bins)
    b = F.when(hi == lo, F.lit(1)).otherwise(
        F.least(F.floor((F.col(value) - lo) / (hi - lo) * bins) + 1, F.lit(bins)))
    j = d.select(value, lo.alias("lo"), hi.alias("hi"))
    return j.groupBy(b.cast("int").alias("bin"), "lo", "hi").agg(F.count(F.lit(1)).alias("n")).select(
        "bin", (F.col("lo") + (F.col("bin") - 1) * width).alias("bin_lo"),
        (F.col("lo") + F.col("bin") * width).alias("bin_hi"), "n")


KDE_BINS = 4096


def kde_curve(df: DataFrame, value: str, grid_points: int = 200, bins: int = KDE_BINS, bandwidth: float | None = None) -> DataFrame:
    """Gaussian density of all values on ``grid_points`` from their smallest to
    their largest: ``x, density``. The bandwidth is Scott's (sample deviation
    times n**-0.2) unless given.

    Each value is shared between the two nearest of ``bins + 1`` places (linear
    binning), one aggregate; the curve is then the places' weighted kernels. The
    binning moves the curve by at most ``d**2 / (8 h**2)`` of a kernel's peak
    ``1 / (h sqrt(2 pi))``, where d is the places' distance and h the bandwidth."""
    d = _clean(df, [value]).select(F.col(value).cast("double").alias("v"))
    s = d.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.stddev_samp("v").alias("sd"), F.count("v").alias("n")).first()
    schema = "x double, density double"
    h = bandwidth or ((s["sd"] or 0.0) * s["n"] ** -0.2 if s["n"] else 0.0)
    if not h or s["hi"] == s["lo"]:
        return df.sparkSession.createDataFrame([], schema)
    lo, hi = float(s["lo"]), float(s["hi"])
    step = (hi - lo) / bins
    at = (F.col("v") - F.lit(lo)) / F.lit(step)
    left = F.least(F.floor(at), F.lit(bins - 1)).cast("int")
    share = at - left
    places = d.select(F.explode(F.array(F.struct(left.alias("i"), (1 - share).alias("w")), F.struct((left + 1).alias("i"), share.alias("w")))).alias("p"))
    weights = places.groupBy("p.i").agg(F.sum("p.w").alias("w"))  # at most bins + 1 rows
    grid = F.sequence(F.lit(0), F.lit(grid_points - 1))
    points = weights.select((F.lit(lo) + F.col("i") * F.lit(step)).alias("c"), "w", F.explode(grid).alias("g"))
    x = F.lit(lo) + F.col("g") * F.lit((hi - lo) / max(grid_points - 1, 1))
    k = F.col("w") * F.exp(-0.5 * ((x - F.col("c")) / F.lit(h)) ** 2)
    return points.groupBy("g").agg(F.sum(k).alias("s")).select(x.alias("x"), (F.col("s") / F.lit(h * np.sqrt(2 * np.pi) * s["n"])).alias("density"))


# ------------------------------------------------------------------ W7/T8
def _order_medians(i, n: int):
    """Filliben's medians of the order statistics' probabilities."""
    last = 0.5 ** (1.0 / n) if n else 0.0
    return (F.when(i == 1, F.lit(1.0 - last)).when(i == n, F.lit(last))
            .otherwise((i.cast("double") - 0.3175) / (n + 0.365)))


def qq_points(df: DataFrame, value: str) -> DataFrame:
    """Normal Q-Q points: ordered sample vs Filliben order-statistic medians
    (global rank without a single-partition window)."""
    d = _clean(df, [value]).select(value)
    n = d.count()
    ranked = ordering.global_row_number(d, [value], "i")
    return ranked.select("i", F.col(value).alias("sample"), dist.norm_ppf(_order_medians(F.col("i"), n)).alias("theoretical"))


#: The three views of the normality report; all keep the order of the values,
#: and a view's domain is the upper part of it.
VIEWS = {"raw": (lambda x: x, None), "sqrt": (F.sqrt, lambda x: x >= 0), "log1p": (F.log1p, lambda x: x > -1)}


def ordered_views(df: DataFrame, value: str) -> tuple[DataFrame, dict[str, int]]:
    """``x`` with its rank ``i`` over all values, from one sort, and each view's
    number of values. A view's rank is ``i`` less the values below its domain."""
    ranked = ordering.global_row_number(_clean(df, [value]).select(F.col(value).cast("double").alias("x")), ["x"], "i").persist()
    counts = ranked.agg(F.count("*").alias("raw"), *[F.count_if(ok(F.col("x"))).alias(v) for v, (_, ok) in VIEWS.items() if ok]).first().asDict()
    return ranked, counts


def view_of(ranked: DataFrame, counts: dict[str, int], view: str) -> DataFrame:
    """``i, x`` of one view."""
    change, ok = VIEWS[view]
    rows = ranked if ok is None else ranked.where(ok(F.col("x")))
    return rows.select((F.col("i") - F.lit(counts["raw"] - counts[view])).alias("i"), change(F.col("x")).alias("x"))


@dataclass
class NormalityReport:
    tests: DataFrame
    qq: DataFrame
    histograms: DataFrame
    curves: DataFrame


def normality_report(df: DataFrame, value: str, bins: int = 20) -> NormalityReport:
    """The tests, Q-Q points, histograms and density curves of the raw,
    square-root and log1p values, all from one order of the values."""
    ranked, counts = ordered_views(df, value)

    def each(make):
        out = None
        for view in VIEWS:
            part = make(view).select(F.lit(view).alias("transform"), "*")
            out = part if out is None else out.unionByName(part)
        return out

    def points(view):
        rows = view_of(ranked, counts, view)
        return rows.select("i", F.col("x").alias("sample"), dist.norm_ppf(_order_medians(F.col("i"), counts[view])).alias("theoretical"))

    tests = each(lambda v: _shapiro(view_of(ranked, counts, v), counts[v]))
    dropped = F.lit(None).cast("long")
    for v in VIEWS:
        dropped = F.when(F.col("transform") == v, F.lit(counts["raw"] - counts[v]).cast("long")).otherwise(dropped)
    return NormalityReport(tests.withColumn("n_dropped", dropped), each(points), each(lambda v: histogram(view_of(ranked, counts, v), "x", bins)),
                           each(lambda v: kde_curve(view_of(ranked, counts, v), "x")))


# Royston (1995) polynomial coefficients for Shapiro-Wilk.
_SW_C1 = [0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056]
_SW_C2 = [0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633]
_SW_C3 = [0.544, -0.39978, 0.025054, -6.714e-4]
_SW_C4 = [1.3822, -0.77857, 0.062767, -0.0020322]
_SW_C5 = [-1.5861, -0.31082, -0.083751, 0.0038915]
_SW_C6 = [-0.4803, -0.082676, 0.0030302]
_SW_G = [-2.273, 0.459]
SW_TABLE_N = 5000  # the published approximation is checked up to here


def _poly(c, x):
    return sum(ci * x ** k for k, ci in enumerate(c))


def shapiro_wilk(df: DataFrame, value: str) -> DataFrame:
    """Shapiro-Wilk W and p (Royston 1995). Ranks come from the
    range-partitioned global row number; the weights are a function of
    (i, n, Σm²), so W is two aggregate passes. p is given at every n;
    ``beyond_table`` marks n above 5000, where the approximation of p has
    not been published."""
    d = _clean(df, [value]).select(F.col(value).alias("x"))
    ranked = ordering.global_row_number(d, ["x"], "i")
    return _shapiro(ranked, ranked.count())


def _shapiro(ranked: DataFrame, n: int) -> DataFrame:
    """``shapiro_wilk`` of ranked values ``i, x``."""
    value, spark = "x", ranked.sparkSession
    schema = "n long, w double, p_value double, significant boolean, beyond_table boolean"
    if n < 3:
        return spark.createDataFrame([(n, None, None, None, False)], schema)
    m_expr = dist.norm_ppf((F.col("i").cast("double") - 0.375) / (n + 0.25))
    mm = ranked.withColumn("m", m_expr)
    mm.persist()
    ssm = mm.agg(F.sum(F.col("m") ** 2).alias("s")).first()["s"]
    u = 1.0 / np.sqrt(n)
    m_n = float(dist.norm_ppf_np([(n - 0.375) / (n + 0.25)])[0])
    m_n1 = float(dist.norm_ppf_np([(n - 1 - 0.375) / (n + 0.25)])[0])
    a_n = m_n / np.sqrt(ssm) + _poly(_SW_C1, u)
    if n > 5:
        a_n1 = m_n1 / np.sqrt(ssm) + _poly(_SW_C2, u)
        phi = (ssm - 2 * m_n ** 2 - 2 * m_n1 ** 2) / (1 - 2 * a_n ** 2 - 2 * a_n1 ** 2)
        ends = {1: -a_n, n: a_n, 2: -a_n1, n - 1: a_n1}
    else:
        phi = (ssm - 2 * m_n ** 2) / (1 - 2 * a_n ** 2)
        ends = {1: -a_n, n: a_n}
    a = F.col("m") / F.lit(float(np.sqrt(phi)))
    for k, v in ends.items():
        a = F.when(F.col("i") == k, F.lit(float(v))).otherwise(a)
    if n == 3:
        a = F.when(F.col("i") == 1, F.lit(-np.sqrt(0.5))).when(F.col("i") == 3, F.lit(np.sqrt(0.5))).otherwise(0.0)
    r = mm.agg(F.sum(a * F.col(value)).alias("num"), F.var_pop(value).alias("vp")).first()
    mm.unpersist()
    ss = r["vp"] * n
    w = min(1.0, r["num"] ** 2 / ss) if ss > 0 else None
    p = None
    if w is not None:
        if n == 3:
            p = max(0.0, 6 / np.pi * (np.arcsin(np.sqrt(w)) - np.arcsin(np.sqrt(0.75))))
        elif n <= 11:
            gamma = _poly(_SW_G, n)
            y = -np.log(gamma - np.log1p(-w))
            mu, sigma = _poly(_SW_C3, n), np.exp(_poly(_SW_C4, n))
            p = float(dist.norm_sf_np([(y - mu) / sigma])[0])
        else:
            ln = np.log(n)
            y = np.log1p(-min(w, 1 - 1e-15))
            mu, sigma = _poly(_SW_C5, ln), np.exp(_poly(_SW_C6, ln))
            p = float(dist.norm_sf_np([(y - mu) / sigma])[0])
    return spark.createDataFrame([(n, w, p, (p < ALPHA) if p is not None else None, n > SW_TABLE_N)], schema)


def normality_test(df: DataFrame, value: str) -> DataFrame:
    """Shapiro-Wilk p for raw, sqrt and log1p data (negatives → dropped
    for sqrt, values <= -1 for log1p; dropped counts reported), one sort."""
    return normality_report(df, value).tests

"""Statistics queries. Oracle keys return the statistics DuckDB can compute
(counts, sums of squares, the statistic, degrees of freedom); p-values are
checked against closed forms and printed tables in tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stats as st
from ..sources import derived
from ..sources.tables import load_table
from .registry import register


@register("one_way_anova", sql="""
  WITH g AS (SELECT o_orderstatus, o_orderpriority, count(o_totalprice) AS n, avg(o_totalprice) AS m,
                    var_samp(o_totalprice) AS v
             FROM orders WHERE o_totalprice IS NOT NULL AND o_orderpriority IS NOT NULL GROUP BY 1, 2),
       gm AS (SELECT o_orderstatus, sum(n * m) / sum(n) AS gm FROM g GROUP BY 1),
       t AS (SELECT g.o_orderstatus, count(*) AS k, CAST(sum(n) AS BIGINT) AS n,
                    sum(n * (m - gm) * (m - gm)) AS ssb, sum(coalesce((n - 1) * v, 0)) AS ssw
             FROM g JOIN gm USING (o_orderstatus) GROUP BY g.o_orderstatus)
  SELECT o_orderstatus, k, n, ssb, ssw, k - 1 AS df_between, n - k AS df_within,
         (ssb / (k - 1)) / (ssw / (n - k)) AS f_stat FROM t
""", round_cols=["ssb", "ssw", "f_stat"])
def one_way_anova(spark, sf_dir):
    """Order price by priority, one test per order status."""
    o = load_table(spark, sf_dir, "orders")
    return st.one_way_anova(o, "o_totalprice", "o_orderpriority", by="o_orderstatus").drop(
        "p_value", "significant")


@register("two_way_anova_cells", sql="""
  SELECT o_orderpriority, o_orderstatus, count(o_totalprice) AS n, avg(o_totalprice) AS mean,
         coalesce(var_samp(o_totalprice) * (count(o_totalprice) - 1), 0.0) AS ss_within
  FROM orders WHERE o_totalprice IS NOT NULL AND o_orderpriority IS NOT NULL AND o_orderstatus IS NOT NULL
  GROUP BY 1, 2
""", round_cols=["mean", "ss_within"])
def two_way_anova_cells(spark, sf_dir):
    """T2 input: cell table (n, mean, within SS) of priority x status."""
    o = load_table(spark, sf_dir, "orders")
    return st.two_way_cells(o, "o_totalprice", "o_orderpriority", "o_orderstatus")


@register("two_way_anova")
def two_way_anova(spark, sf_dir):
    """Type II two-way ANOVA table with p-values."""
    o = load_table(spark, sf_dir, "orders")
    return st.two_way_anova(o, "o_totalprice", "o_orderpriority", "o_orderstatus")


@register("two_way_anova_table", sql="""
  WITH c AS (SELECT o_orderpriority AS a, o_orderstatus AS b, count(o_totalprice) AS n, avg(o_totalprice) AS m,
                    coalesce(var_samp(o_totalprice) * (count(o_totalprice) - 1), 0.0) AS ss
             FROM orders WHERE o_totalprice IS NOT NULL AND o_orderpriority IS NOT NULL AND o_orderstatus IS NOT NULL GROUP BY 1, 2),
  g AS (SELECT sum(n * m) / sum(n) AS mean, sum(ss) AS ssw, sum(n) AS n, count(*) AS cells, count(DISTINCT a) AS ka, count(DISTINCT b) AS kb FROM c),
  z AS (SELECT a, b, c.n, m - mean AS y FROM c, g),
  ra AS (SELECT sum(n * y * y) - (SELECT sum(s * s / w) FROM (SELECT sum(n * y) AS s, sum(n) AS w FROM z GROUP BY a)) AS rss FROM z),
  rb AS (SELECT sum(n * y * y) - (SELECT sum(s * s / w) FROM (SELECT sum(n * y) AS s, sum(n) AS w FROM z GROUP BY b)) AS rss FROM z),
  -- the second factor's three levels after the first is swept out: two unknowns
  sw AS (SELECT z.*, sum(n * y) OVER (PARTITION BY a) / sum(n) OVER (PARTITION BY a) AS ya, sum(n) OVER (PARTITION BY a) AS na FROM z),
  r AS (SELECT sum(n * (y - ya)) FILTER (b = 'O') AS r1, sum(n * (y - ya)) FILTER (b = 'P') AS r2,
               sum(n - n * n / na) FILTER (b = 'O') AS s11, sum(n - n * n / na) FILTER (b = 'P') AS s22,
               -(SELECT sum(x.n * w.n / x.na) FROM sw x JOIN sw w ON x.a = w.a AND x.b = 'O' AND w.b = 'P') AS s12 FROM sw),
  ab AS (SELECT ra.rss - (r1 * (s22 * r1 - s12 * r2) + r2 * (s11 * r2 - s12 * r1)) / (s11 * s22 - s12 * s12) AS rest FROM r, ra),
  t AS (SELECT 'o_orderpriority' AS source, rb.rss - rest AS ss, ka - 1 AS d FROM rb, ab, g
        UNION ALL SELECT 'o_orderstatus', ra.rss - rest, kb - 1 FROM ra, ab, g
        UNION ALL SELECT 'o_orderpriority:o_orderstatus', rest, cells - (ka + kb - 1) FROM ab, g
        UNION ALL SELECT 'Residual', ssw, n - cells FROM g)
  SELECT source, ss AS sum_sq, CAST(d AS DOUBLE) AS df, CASE WHEN source <> 'Residual' THEN ss / d / (g.ssw / (g.n - g.cells)) END AS f_stat FROM t, g
""", round_cols=["sum_sq", "f_stat"])
def two_way_anova_table(spark, sf_dir):
    """Sums of squares, degrees of freedom and F of the Type II table."""
    o = load_table(spark, sf_dir, "orders")
    return st.two_way_anova(o, "o_totalprice", "o_orderpriority", "o_orderstatus").select("source", "sum_sq", "df", "f_stat")


_TWO = """
  SELECT count(CASE WHEN {g} = '{a}' THEN {v} END) AS n1, count(CASE WHEN {g} = '{b}' THEN {v} END) AS n2,
         avg(CASE WHEN {g} = '{a}' THEN {v} END) AS mean1, avg(CASE WHEN {g} = '{b}' THEN {v} END) AS mean2,
         var_samp(CASE WHEN {g} = '{a}' THEN {v} END) AS var1, var_samp(CASE WHEN {g} = '{b}' THEN {v} END) AS var2
  FROM {t} WHERE {v} IS NOT NULL AND {g} IN ('{a}', '{b}')"""


@register("f_test", sql=f"""
  SELECT n1, n2, var1, var2, greatest(var1, var2) / least(var1, var2) AS f_stat,
         CAST(CASE WHEN var1 >= var2 THEN n1 - 1 ELSE n2 - 1 END AS DOUBLE) AS df_num,
         CAST(CASE WHEN var1 >= var2 THEN n2 - 1 ELSE n1 - 1 END AS DOUBLE) AS df_den
  FROM ({_TWO.format(g="event_type", v="value", a="click", b="view", t="events")})
""", round_cols=["var1", "var2", "f_stat"])
def f_test(spark, sf_dir):
    """T4: variance ratio of click vs view event values."""
    ev = load_table(spark, sf_dir, "events")
    return st.f_test(ev, "value", "event_type", "click", "view").drop("p_value", "significant")


@register("t_test_welch", sql=f"""
  SELECT n1, n2, mean1, mean2, var1, var2,
         (mean1 - mean2) / sqrt(var1 / n1 + var2 / n2) AS t_stat,
         pow(var1 / n1 + var2 / n2, 2) / (pow(var1 / n1, 2) / (n1 - 1) + pow(var2 / n2, 2) / (n2 - 1)) AS df_welch,
         CAST(n1 + n2 - 2 AS DOUBLE) AS df_reported
  FROM ({_TWO.format(g="o_orderstatus", v="o_totalprice", a="F", b="O", t="orders")})
""", round_cols=["mean1", "mean2", "var1", "var2", "t_stat", "df_welch"])
def t_test_welch(spark, sf_dir):
    """T5: Welch t test of order price, status F vs O."""
    o = load_table(spark, sf_dir, "orders")
    return st.t_test_welch(o, "o_totalprice", "o_orderstatus", "F", "O").drop("p_value", "significant")


@register("t_test_paired", sql="""
  SELECT count(d) AS n, avg(x) AS mean1, avg(y) AS mean2, avg(d) AS mean_diff, stddev_samp(d) AS sd_diff,
         avg(d) / (stddev_samp(d) / sqrt(count(d))) AS t_stat, CAST(count(d) - 1 AS DOUBLE) AS df
  FROM (SELECT l_extendedprice AS x, l_quantity * p_retailprice AS y, l_extendedprice - l_quantity * p_retailprice AS d
        FROM lineitem JOIN part ON l_partkey = p_partkey)
""", round_cols=["mean1", "mean2", "mean_diff", "sd_diff", "t_stat"])
def t_test_paired(spark, sf_dir):
    """T5 paired: line price vs quantity x list price, per line."""
    li = load_table(spark, sf_dir, "lineitem")
    part = load_table(spark, sf_dir, "part")
    pairs = li.join(part, li.l_partkey == part.p_partkey).select(
        F.col("l_extendedprice").alias("x"), (F.col("l_quantity") * F.col("p_retailprice")).alias("y"))
    return st.t_test_paired(pairs, "x", "y").drop("p_value", "significant")


def _chi_sql(t: str, r: str, c: str) -> str:
    return f"""
  WITH obs AS (SELECT {r} AS r, {c} AS c, count(*) AS o FROM {t} WHERE {r} IS NOT NULL AND {c} IS NOT NULL GROUP BY 1, 2),
       rk AS (SELECT DISTINCT r FROM obs), ck AS (SELECT DISTINCT c FROM obs),
       grid AS (SELECT rk.r, ck.c, coalesce(obs.o, 0) AS o FROM rk CROSS JOIN ck LEFT JOIN obs ON obs.r = rk.r AND obs.c = ck.c),
       rt AS (SELECT r, sum(o) AS rt FROM grid GROUP BY r), ct AS (SELECT c, sum(o) AS ct FROM grid GROUP BY c),
       tot AS (SELECT sum(o) AS n FROM grid),
       dims AS (SELECT (SELECT count(*) FROM rk) AS nr, (SELECT count(*) FROM ck) AS nc),
       e AS (SELECT grid.o, rt.rt * ct.ct / tot.n AS e FROM grid JOIN rt USING (r) JOIN ct USING (c), tot)
  SELECT CAST(tot.n AS BIGINT) AS n, dims.nr AS n_rows, dims.nc AS n_cols, (dims.nr - 1) * (dims.nc - 1) AS dof,
         (dims.nr - 1) * (dims.nc - 1) = 1 AS yates,
         (SELECT sum(pow(abs(o - e) - CASE WHEN (dims.nr - 1) * (dims.nc - 1) = 1 THEN least(0.5, abs(o - e)) ELSE 0 END, 2) / e) FROM e) AS statistic
  FROM tot, dims"""


@register("chi_square_2x2", sql=_chi_sql("labels", "quality", "toxic"), round_cols=["statistic"])
def chi_square_2x2(spark, sf_dir):
    """Quality x toxic labels, 2x2 with Yates' correction."""
    return st.chi_square_test(load_table(spark, sf_dir, "labels"), "quality", "toxic").drop(
        "p_value", "significant")


@register("chi_square_rxc", sql=_chi_sql("lineitem", "l_returnflag", "l_linestatus"), round_cols=["statistic"])
def chi_square_rxc(spark, sf_dir):
    """Return flag x line status (3x2)."""
    return st.chi_square_test(load_table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus").drop(
        "p_value", "significant")


@register("chi_square_expected", sql="""
  WITH obs AS (SELECT l_returnflag, l_linestatus, count(*) AS observed FROM lineitem GROUP BY 1, 2),
       rt AS (SELECT l_returnflag, sum(observed) AS rt FROM obs GROUP BY 1),
       ct AS (SELECT l_linestatus, sum(observed) AS ct FROM obs GROUP BY 1),
       tot AS (SELECT sum(observed) AS n FROM obs)
  SELECT l_returnflag, l_linestatus, observed, CAST(rt * ct AS DOUBLE) / n AS expected
  FROM obs JOIN rt USING (l_returnflag) JOIN ct USING (l_linestatus), tot
""", round_cols=["expected"])
def chi_square_expected(spark, sf_dir):
    """Expected counts of the contingency table."""
    return st.chi_square_expected(load_table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus")


@register("proportion_z_test", sql="""
  SELECT n1, x1, n2, x2, x1 / n1 AS p1, x2 / n2 AS p2,
         (x1 / n1 - x2 / n2) / sqrt(((x1 + x2) / (n1 + n2)) * (1 - (x1 + x2) / (n1 + n2)) * (1.0 / n1 + 1.0 / n2)) AS z_stat
  FROM (SELECT count_if(toxic = 0) AS n1, CAST(sum(CASE WHEN toxic = 0 THEN quality END) AS BIGINT) AS x1,
               count_if(toxic = 1) AS n2, CAST(sum(CASE WHEN toxic = 1 THEN quality END) AS BIGINT) AS x2
        FROM labels WHERE quality IS NOT NULL AND toxic IN (0, 1))
""", round_cols=["p1", "p2", "z_stat"])
def proportion_z_test(spark, sf_dir):
    """Share of quality documents, non-toxic vs toxic."""
    return st.proportion_z_test(load_table(spark, sf_dir, "labels"), "quality", "toxic", 0, 1).drop(
        "p_value", "significant")


_CORR_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("correlation_matrix", sql=" UNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, corr({a}, {b}) AS r FROM lineitem"
    for a in _CORR_COLS for b in _CORR_COLS), round_cols=["r"])
def correlation_matrix(spark, sf_dir):
    """Pairwise Pearson matrix of line measures."""
    return st.correlation_matrix(load_table(spark, sf_dir, "lineitem"), _CORR_COLS)


@register("target_correlation", sql="""
  SELECT feature, r, abs(r) AS abs_r, row_number() OVER (ORDER BY abs(r) DESC, feature) AS rank FROM (
""" + " UNION ALL ".join(f"SELECT '{b}' AS feature, corr(l_extendedprice, {b}) AS r FROM lineitem"
                         for b in _CORR_COLS if b != "l_extendedprice") + ")",
    round_cols=["r", "abs_r"])
def target_correlation(spark, sf_dir):
    """Correlations with the line price, ordered by |r|."""
    return st.target_correlation(load_table(spark, sf_dir, "lineitem"), "l_extendedprice", _CORR_COLS)


@register("histogram_bins", sql="""
  WITH mm AS (SELECT min(value) AS lo, max(value) AS hi FROM events WHERE value IS NOT NULL),
       b AS (SELECT CAST(CASE WHEN hi = lo THEN 1 ELSE least(floor((value - lo) / (hi - lo) * 20) + 1, 20) END AS INTEGER) AS bin, lo, hi
             FROM events, mm WHERE value IS NOT NULL)
  SELECT bin, lo + (bin - 1) * ((hi - lo) / 20) AS bin_lo, lo + bin * ((hi - lo) / 20) AS bin_hi, count(*) AS n
  FROM b GROUP BY bin, lo, hi
""", round_cols=["bin_lo", "bin_hi"])
def histogram_bins(spark, sf_dir):
    """20-bin histogram of event values."""
    return st.histogram(load_table(spark, sf_dir, "events"), "value", 20)


def _values(spark, sf_dir):
    return load_table(spark, sf_dir, "events").select("event_id", "value")


@register("qq_points")
def qq_points(spark, sf_dir):
    """Normal Q-Q points of all event values."""
    return st.qq_points(_values(spark, sf_dir), "value")


@register("shapiro_wilk")
def shapiro_wilk(spark, sf_dir):
    """Shapiro-Wilk for raw, sqrt and log1p event values."""
    return st.normality_test(_values(spark, sf_dir), "value")


@register("kde_curve", sql="""
  WITH v AS (SELECT CAST(value AS DOUBLE) AS v FROM events WHERE value IS NOT NULL AND NOT isnan(value)),
  s AS (SELECT min(v) AS lo, max(v) AS hi, (max(v) - min(v)) / 4096 AS step, stddev_samp(v) * pow(count(*), -0.2) AS h, count(*) AS n FROM v),
  pl AS (SELECT (v - lo) / step AS a, least(floor((v - lo) / step), 4095) AS i FROM v, s),
  w AS (SELECT i, sum(w) AS w FROM (SELECT i, 1 - (a - i) AS w FROM pl UNION ALL SELECT i + 1, a - i FROM pl) GROUP BY i)
  SELECT lo + g * ((hi - lo) / 199) AS x, sum(w * exp(-0.5 * pow((lo + g * ((hi - lo) / 199) - (lo + i * step)) / h, 2))) / any_value(h * sqrt(2 * pi()) * n) AS density
  FROM w, s, range(200) r(g) GROUP BY g, lo, hi
""", round_cols=["x", "density"])
def kde_curve(spark, sf_dir):
    """Gaussian density curve of all event values, from smallest to largest."""
    return st.kde_curve(load_table(spark, sf_dir, "events"), "value")


@register("normality_views", sql="""
  WITH v AS (SELECT CAST(value AS DOUBLE) AS x FROM events WHERE value IS NOT NULL AND NOT isnan(value)),
  t AS (SELECT 'raw' AS transform, x FROM v UNION ALL SELECT 'sqrt', sqrt(x) FROM v WHERE x >= 0 UNION ALL SELECT 'log1p', ln(1 + x) FROM v WHERE x > -1)
  SELECT transform, row_number() OVER (PARTITION BY transform ORDER BY x) AS i, x AS sample FROM t
""", round_cols=["sample"])
def normality_views(spark, sf_dir):
    """Order of the raw, sqrt and log1p values (Q-Q points without the
    normal quantiles), from one sort."""
    return st.normality_report(_values(spark, sf_dir), "value").qq.select("transform", "i", "sample")


__all__ = ["derived"]

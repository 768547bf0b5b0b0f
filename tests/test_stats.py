import numpy as np
from pyspark.sql import functions as F

from kestrel.operators import stats as st


def test_anova_partition_and_t_squared(spark):
    rng = np.random.default_rng(1)
    rows = [(g, float(x)) for g, m in (("a", 0.0), ("b", 0.5)) for x in rng.normal(m, 1, 30)]
    df = spark.createDataFrame(rows, "g string, v double")
    a = st.one_way_anova(df, "v", "g").first()
    sst = df.agg(F.var_pop("v") * F.count("v")).first()[0]
    assert abs(a.ssb + a.ssw - sst) < 1e-8
    t = st.t_test_welch(df, "v", "g", "a", "b").first()
    pooled_t2 = a.f_stat  # equal group sizes: Welch t equals pooled t
    assert abs(t.t_stat ** 2 - pooled_t2) < 1e-8
    # F(1, N-2) tail equals the two-sided t tail on N-2 degrees of freedom
    from kestrel.functions.distributions import t_sf_np
    assert abs(2 * t_sf_np([abs(t.t_stat)], [58])[0] - a.p_value) < 1e-9


def test_two_way_balanced_textbook(spark):
    rows = []
    vals = {("a1", "b1"): [3, 5], ("a1", "b2"): [6, 8], ("a2", "b1"): [4, 6], ("a2", "b2"): [10, 12]}
    for (a, b), xs in vals.items():
        rows += [(a, b, float(x)) for x in xs]
    t = {r.source: r for r in st.two_way_anova(spark.createDataFrame(rows, "a string, b string, y double"),
                                                 "y", "a", "b").collect()}
    # balanced design: SS_A = Σ n_a (m_a - m)², SS_B alike, SS_AB from cell means
    assert abs(t["a"].sum_sq - 12.5) < 1e-9 and abs(t["b"].sum_sq - 40.5) < 1e-9
    assert abs(t["a:b"].sum_sq - 4.5) < 1e-9 and abs(t["Residual"].sum_sq - 8.0) < 1e-9


def test_chi_square_uncorrected_equals_z_squared(spark):
    rows = [(0, 0)] * 49 + [(0, 1)] * 9 + [(1, 0)] * 299 + [(1, 1)] * 42
    df = spark.createDataFrame(rows, "quality int, toxic int")
    chi = st.chi_square_test(df, "quality", "toxic", correction=False).first()
    z = st.proportion_z_test(df.withColumnRenamed("quality", "q"), "q", "toxic", 0, 1).first()
    assert abs(chi.statistic - z.z_stat ** 2) < 1e-9
    yates = st.chi_square_test(df, "quality", "toxic").first()
    assert yates.yates and yates.statistic < chi.statistic


def test_shapiro_wilk_reference_weights(spark):
    w = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    r = st.shapiro_wilk(spark.createDataFrame([(float(x),) for x in w], "x double"), "x").first()
    assert abs(r.w - 0.7888) < 1e-3 and abs(r.p_value - 0.0067) < 5e-4


def test_correlation_constant_column_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.1, 5.0), (3.0, 5.9, 5.0)], "a double, b double, c double")
    m = {(r.col_a, r.col_b): r.r for r in st.correlation_matrix(df).collect()}
    assert m[("a", "c")] is None and abs(m[("a", "a")] - 1) < 1e-12 and m[("a", "b")] > 0.99

"""Preparation and evaluation queries (SQL-checkable) and model queries
(rows-only: fitted models agree with the reference statistically, not
bit for bit)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as ev
from ..operators import prep
from ..sources.tables import load_table
from .registry import register

_LI_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("standardize", sql="SELECT l_orderkey, l_linenumber, " + ", ".join(
    f"CASE WHEN stddev_pop({c}) OVER () > 0 THEN ({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () "
    f"ELSE {c} - avg({c}) OVER () END AS {c}" for c in _LI_FEATURES) + " FROM lineitem",
    round_cols=_LI_FEATURES)
def standardize(spark, sf_dir):
    """Zero mean, unit population variance."""
    li = load_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *_LI_FEATURES)
    return prep.standardize(li, _LI_FEATURES)


@register("stratified_split", sql="""
  SELECT doc_id, quality, rn <= ceil(0.2 * cnt) AS is_test FROM (
    SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5(CAST(doc_id AS VARCHAR) || ':42'), doc_id) AS rn,
           count(*) OVER (PARTITION BY quality) AS cnt FROM labels)
""")
def stratified_split(spark, sf_dir):
    """Stratified 80/20 split by a deterministic hash order."""
    lab = load_table(spark, sf_dir, "labels").select("doc_id", "quality")
    return prep.hash_split(lab, "doc_id", label="quality")


@register("random_split", sql="""
  SELECT o_orderkey, row_number() OVER (ORDER BY md5(CAST(o_orderkey AS VARCHAR) || ':42'), o_orderkey)
         <= ceil(0.2 * count(*) OVER ()) AS is_test FROM orders
""")
def random_split(spark, sf_dir):
    """Plain 80/20 split by the hash order."""
    return prep.hash_split(load_table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")


@register("label_encode", sql="""
  SELECT o_orderkey, o_orderpriority, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS BIGINT) AS label_index
  FROM orders WHERE o_orderpriority IS NOT NULL
""")
def label_encode(spark, sf_dir):
    """Labels to 0..k-1 in sorted order."""
    o = load_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority").filter(
        F.col("o_orderpriority").isNotNull())
    return prep.label_encode(o, "o_orderpriority")[0]


def _doc_labels(spark, sf_dir):
    lab = load_table(spark, sf_dir, "labels")
    docs = load_table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return lab.join(docs, "doc_id").select(
        "doc_id", F.col("quality").alias("label"),
        F.when(F.col("n_chars") >= 2000, 1).otherwise(0).alias("prediction"),
        F.col("n_chars").cast("double").alias("score"))


_P = """(SELECT quality AS label, CASE WHEN n_chars >= 2000 THEN 1 ELSE 0 END AS prediction,
                CAST(n_chars AS DOUBLE) AS score FROM labels JOIN documents USING (doc_id))"""


@register("confusion_matrix", sql=f"""
  WITH p AS {_P}, cls AS (SELECT label AS c FROM p UNION SELECT prediction FROM p)
  SELECT a.c AS label, b.c AS prediction, (SELECT count(*) FROM p WHERE p.label = a.c AND p.prediction = b.c) AS n
  FROM cls a CROSS JOIN cls b
""")
def confusion_matrix(spark, sf_dir):
    """Confusion counts with zero cells."""
    return ev.confusion_matrix(_doc_labels(spark, sf_dir))


@register("classification_metrics", sql=f"""
  WITH p AS {_P}, cls AS (SELECT label AS c FROM p UNION SELECT prediction FROM p),
  per AS (SELECT c, (SELECT count(*) FROM p WHERE label = c) AS support,
                 (SELECT count(*) FROM p WHERE label = c AND prediction = c) AS tp,
                 (SELECT count(*) FROM p WHERE prediction = c) AS predicted FROM cls),
  m AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS pr,
               CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS rc FROM per)
  SELECT sum(tp) / sum(support) AS accuracy, sum(pr * support) / sum(support) AS precision,
         sum(rc * support) / sum(support) AS recall,
         sum(CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0.0 END * support) / sum(support) AS f1,
         CAST(sum(support) AS BIGINT) AS n FROM m
""", round_cols=["accuracy", "precision", "recall", "f1"])
def classification_metrics(spark, sf_dir):
    """Accuracy and weighted precision / recall / F1."""
    return ev.classification_metrics(_doc_labels(spark, sf_dir))


@register("roc_curve", sql=f"""
  WITH s AS (SELECT score, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS pos,
                    sum(CASE WHEN label = 1 THEN 0 ELSE 1 END) AS neg FROM {_P} GROUP BY score),
       t AS (SELECT sum(pos) AS P, sum(neg) AS N FROM s),
       c AS (SELECT score, CAST(sum(pos) OVER (ORDER BY score DESC) AS BIGINT) AS tp,
                    CAST(sum(neg) OVER (ORDER BY score DESC) AS BIGINT) AS fp FROM s)
  SELECT score AS threshold, tp, fp, tp / P AS tpr, fp / N AS fpr FROM c, t
""", round_cols=["tpr", "fpr"])
def roc_curve(spark, sf_dir):
    """ROC points of document length as a quality score."""
    return ev.roc_curve(_doc_labels(spark, sf_dir), "label", "score", 1)


@register("roc_auc", sql=f"""
  WITH s AS (SELECT score, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS pos,
                    sum(CASE WHEN label = 1 THEN 0 ELSE 1 END) AS neg FROM {_P} GROUP BY score),
       c AS (SELECT *, sum(neg) OVER (ORDER BY score) - neg AS below FROM s)
  SELECT sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)) AS auc,
         CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg FROM c
""", round_cols=["auc"])
def roc_auc(spark, sf_dir):
    """Exact AUC with ties counted half."""
    return ev.roc_auc(_doc_labels(spark, sf_dir), "label", "score", 1)


@register("regression_metrics", sql="""
  SELECT avg(e * e) AS mse, sqrt(avg(e * e)) AS rmse, avg(abs(e)) AS mae,
         1 - avg(e * e) / var_pop(y) AS r2, count(*) AS n
  FROM (SELECT l_extendedprice AS y, l_extendedprice - l_quantity * p_retailprice AS e
        FROM lineitem JOIN part ON l_partkey = p_partkey)
""", round_cols=["mse", "rmse", "mae", "r2"])
def regression_metrics(spark, sf_dir):
    """MSE, RMSE, MAE, R² of a list-price prediction."""
    li = load_table(spark, sf_dir, "lineitem")
    part = load_table(spark, sf_dir, "part")
    d = li.join(part, li.l_partkey == part.p_partkey).select(
        F.col("l_extendedprice").alias("label"), (F.col("l_quantity") * F.col("p_retailprice")).alias("prediction"))
    return ev.regression_metrics(d)


# ---------------------------------------------------------------- models
from ..operators import classify as clf  # noqa: E402
from ..operators import cluster as cl  # noqa: E402
from ..operators import neighbors as nb  # noqa: E402
from ..operators import regress as rg  # noqa: E402
from ..sources import derived  # noqa: E402

_DF = derived.DOC_FEATURES
_CF = derived.CUSTOMER_FEATURES
_REG_FEATURES = ["l_quantity", "p_retailprice", "l_discount", "l_tax"]


def _metrics_with_model(res, name):
    return res.metrics.withColumn("model", F.lit(name))


@register("logistic_regression")
def logistic_regression(spark, sf_dir):
    """Document quality from text counts (L2, C=1)."""
    return _metrics_with_model(clf.logistic_regression(derived.document_features(spark, sf_dir), "quality",
                                                       "doc_id", _DF), "logistic")


@register("decision_tree_classify")
def decision_tree_classify(spark, sf_dir):
    """Embedding class by a gini tree."""
    emb = load_table(spark, sf_dir, "embeddings")
    return _metrics_with_model(clf.decision_tree(emb, "label", "vec_id", "embedding"), "decision_tree")


@register("random_forest_classify")
def random_forest_classify(spark, sf_dir):
    """C4: embedding class by a 100-tree forest."""
    emb = load_table(spark, sf_dir, "embeddings")
    return _metrics_with_model(clf.random_forest(emb, "label", "vec_id", "embedding"), "random_forest")


@register("svm_classify")
def svm_classify(spark, sf_dir):
    """Document quality by an RBF-feature linear SVM."""
    return _metrics_with_model(clf.support_vector(derived.document_features(spark, sf_dir), "quality", "doc_id",
                                                  _DF, kernel="rbf"), "svm_rbf")


def knn_classify_df(spark, sf_dir, k=5):
    p = clf.prepare(derived.document_features(spark, sf_dir), "quality", "doc_id", _DF)
    pred = nb.knn_predict(p.train, p.test, k=k, tid="doc_id", qid="doc_id")
    out = p.test.select("doc_id", F.col("label").alias("_l")).join(pred, "doc_id")
    out = clf.prep.label_decode(out, "_l", p.classes, "label")
    out = clf.prep.label_decode(out, "prediction", p.classes, "predicted")
    return out.select("doc_id", "label", F.col("predicted").alias("prediction"))


_Z = ", ".join(f"({c} - m_{c}) / CASE WHEN s_{c} > 0 THEN s_{c} ELSE 1 END AS z_{c}" for c in _DF)
_KNN_SQL = f"""
  WITH f AS ({derived.DOCUMENT_FEATURES_SQL}),
  sp AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY md5(CAST(doc_id AS VARCHAR) || ':42'), doc_id)
                   <= ceil(0.2 * count(*) OVER (PARTITION BY quality)) AS is_test FROM f),
  st AS (SELECT {", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in _DF)} FROM sp WHERE NOT is_test),
  z AS (SELECT doc_id, quality, is_test, {_Z} FROM sp, st),
  pr AS (SELECT q.doc_id AS qid, q.quality AS ql, t.doc_id AS tid, t.quality AS tl,
                sqrt({" + ".join(f"(q.z_{c} - t.z_{c}) * (q.z_{c} - t.z_{c})" for c in _DF)}) AS dist
         FROM z q JOIN z t ON q.is_test AND NOT t.is_test),
  top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, tid) AS r FROM pr) WHERE r <= 5),
  v AS (SELECT qid, ql, tl, count(*) AS cnt FROM top GROUP BY qid, ql, tl)
  SELECT qid AS doc_id, ql AS label, tl AS prediction FROM (
    SELECT *, row_number() OVER (PARTITION BY qid ORDER BY cnt DESC, tl) AS rr FROM v) WHERE rr = 1
"""


@register("knn_classify", sql=_KNN_SQL)
def knn_classify(spark, sf_dir):
    """Exact 5-NN vote on the test split (grid search, no all-pairs)."""
    return knn_classify_df(spark, sf_dir)


@register("linear_regression")
def linear_regression(spark, sf_dir):
    """G1: line price on quantity, list price, discount, tax."""
    return _metrics_with_model(rg.linear_regression(derived.line_regression_data(spark, sf_dir), "l_extendedprice",
                                                    "line_id", _REG_FEATURES), "ols")


@register("ols_single_feature", sql="""
  SELECT regr_slope(l_extendedprice, l_quantity) AS slope, regr_intercept(l_extendedprice, l_quantity) AS intercept,
         regr_r2(l_extendedprice, l_quantity) AS r2, regr_count(l_extendedprice, l_quantity) AS n FROM lineitem
""", round_cols=["slope", "intercept", "r2"])
def ols_single_feature(spark, sf_dir):
    """G1 (SQL-checkable form): one-feature least squares on all rows."""
    li = load_table(spark, sf_dir, "lineitem").select("l_extendedprice", "l_quantity")
    return rg.simple_ols(li, "l_extendedprice", "l_quantity")


@register("ridge_regression")
def ridge_regression(spark, sf_dir):
    """Ridge, alpha = 1."""
    return _metrics_with_model(rg.ridge_regression(derived.line_regression_data(spark, sf_dir), "l_extendedprice",
                                                   "line_id", _REG_FEATURES), "ridge")


@register("lasso_regression")
def lasso_regression(spark, sf_dir):
    """Lasso, alpha = 1, with the kept features."""
    res = rg.lasso_regression(derived.line_regression_data(spark, sf_dir), "l_extendedprice", "line_id",
                              _REG_FEATURES)
    return _metrics_with_model(res, "lasso").withColumn(
        "selected_features", F.lit(", ".join(res.extra["selected_features"])))


@register("decision_tree_regress")
def decision_tree_regress(spark, sf_dir):
    """Regression tree."""
    return _metrics_with_model(rg.decision_tree_regression(derived.line_regression_data(spark, sf_dir),
                                                           "l_extendedprice", "line_id", _REG_FEATURES), "tree")


@register("random_forest_regress")
def random_forest_regress(spark, sf_dir):
    """100-tree forest, all features per split."""
    return _metrics_with_model(rg.random_forest_regression(derived.line_regression_data(spark, sf_dir),
                                                           "l_extendedprice", "line_id", _REG_FEATURES), "forest")


@register("svr_regress")
def svr_regress(spark, sf_dir):
    """Epsilon-SVR with RBF features on the scaled target."""
    return _metrics_with_model(rg.support_vector_regression(derived.document_features(spark, sf_dir), "n_chars",
                                                            "doc_id", ["n_lines", "n_spaces", "n_upper"]), "svr_rbf")


@register("kmeans")
def kmeans(spark, sf_dir):
    """K1: k-means (k=3) of embeddings; per-row clusters."""
    emb = load_table(spark, sf_dir, "embeddings")
    return cl.kmeans(emb, "vec_id", "embedding", k=3).assignments


_LF = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("kmeans_assign", sql=f"""
  WITH s AS (SELECT {", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in _LF)} FROM lineitem),
  z AS (SELECT row_number() OVER () AS rid,
               md5(CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) || ':42') AS h,
               {", ".join(f"({c} - m_{c}) / s_{c} AS {c}" for c in _LF)} FROM lineitem, s),
  c AS (SELECT row_number() OVER (ORDER BY h, {", ".join(_LF)}) - 1 AS j, *
        FROM (SELECT * FROM z ORDER BY h, {", ".join(_LF)} LIMIT 3)),
  d AS (SELECT z.rid, c.j, {" + ".join(f"(z.{x} - c.{x}) * (z.{x} - c.{x})" for x in _LF)} AS dist FROM z, c),
  a AS (SELECT rid, arg_min(j, (dist, j)) AS cluster FROM d GROUP BY rid)
  SELECT CAST(cluster AS INTEGER) AS cluster, count(*) AS n, {", ".join(f"avg(z.{c}) AS {c}" for c in _LF)}
  FROM a JOIN z USING (rid) GROUP BY cluster
""", round_cols=_LF)
def kmeans_assign(spark, sf_dir):
    """K1 step: assign to 3 fixed centroids (first rows in hash order, ties
    by value) and recompute the centroids."""
    li = load_table(spark, sf_dir, "lineitem")
    z = clf.prep.standardize(li.select("l_orderkey", "l_linenumber", *_LF), _LF)
    z = z.withColumn("h", F.md5(F.concat_ws("", F.col("l_orderkey").cast("string"), F.lit("-"),
                                            F.col("l_linenumber").cast("string"), F.lit(":42"))))
    cents = [[r[c] for c in _LF] for r in z.orderBy("h", *_LF).limit(3).collect()]
    return cl.kmeans_assign(z, "h", _LF, cents)


@register("kmeans_k_scan")
def kmeans_k_scan(spark, sf_dir):
    """K5: inertia and silhouette for k = 2..10 (best of 10 starts)."""
    emb = load_table(spark, sf_dir, "embeddings")
    return cl.kmeans_k_scan(emb, "vec_id", "embedding")


@register("gaussian_mixture")
def gaussian_mixture(spark, sf_dir):
    """K4: 3-component mixture of customer features; responsibilities."""
    return cl.gaussian_mixture(derived.customer_features(spark, sf_dir), "c_custkey", _CF).assignments


@register("hierarchical")
def hierarchical(spark, sf_dir):
    """K2: ward agglomeration of customers into 3 clusters."""
    return cl.hierarchical(derived.customer_features(spark, sf_dir), "c_custkey", _CF, k=3).assignments


def _cust_points(spark, sf_dir):
    pts, _ = cl.prepare(derived.customer_features(spark, sf_dir), "c_custkey", _CF)
    return pts


_CZ = f"""
  WITH f AS ({derived.CUSTOMER_FEATURES_SQL}),
  st AS (SELECT {", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in _CF)} FROM f),
  z AS (SELECT c_custkey AS k, c_mktsegment AS seg, {", ".join(f"({c} - m_{c}) / CASE WHEN s_{c} > 0 THEN s_{c} ELSE 1 END AS {c}" for c in _CF)} FROM f, st)"""
_SQD = " + ".join(f"(x.{c} - y.{c}) * (x.{c} - y.{c})" for c in _CF)


# Core points and their components; a border point joins the cluster with the
# smallest first core key near it.
_DBSCAN_SQL = f"""{_CZ.replace("WITH f", "WITH RECURSIVE f", 1)},
  near AS MATERIALIZED (SELECT x.k AS a, y.k AS b FROM z x JOIN z y ON sqrt({_SQD}) <= 0.5),
  core AS MATERIALIZED (SELECT a AS k FROM near GROUP BY a HAVING count(*) >= 5),
  link AS MATERIALIZED (SELECT a, b FROM near WHERE a IN (SELECT k FROM core) AND b IN (SELECT k FROM core)),
  reach(a, b) AS (SELECT k, k FROM core UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
  comp AS MATERIALIZED (SELECT a AS k, min(b) AS first FROM reach GROUP BY a),
  num AS (SELECT first, row_number() OVER (ORDER BY first) - 1 AS cluster FROM (SELECT DISTINCT first FROM comp)),
  lab AS (SELECT n.a AS k, min(first) AS first FROM near n JOIN comp c ON c.k = n.b GROUP BY n.a),
  out AS (SELECT z.k AS c_custkey, CAST(coalesce(num.cluster, -1) AS INTEGER) AS cluster, core.k IS NOT NULL AS is_core
          FROM z LEFT JOIN core ON core.k = z.k LEFT JOIN lab ON lab.k = z.k LEFT JOIN num ON num.first = lab.first)"""


@register("dbscan", sql=f"{_DBSCAN_SQL} SELECT * FROM out")
def dbscan(spark, sf_dir):
    """K3: DBSCAN (eps 0.5, 5 samples) of customers; noise = -1."""
    return nb.dbscan(_cust_points(spark, sf_dir), "c_custkey", 0.5, 5, whole_counts=False)


@register("dbscan_report", sql=f"""{_DBSCAN_SQL},
  c AS (SELECT z.*, out.cluster FROM z JOIN out ON out.c_custkey = z.k WHERE out.cluster >= 0),
  pd AS (SELECT x.k, x.cluster AS own, y.cluster AS other, sum({_SQD}) AS sd, count(*) AS n FROM c x JOIN c y ON x.k <> y.k GROUP BY 1, 2, 3),
  ab AS (SELECT k, max(CASE WHEN own = other THEN sd / n END) AS a, min(CASE WHEN own <> other THEN sd / n END) AS b FROM pd GROUP BY k),
  s AS (SELECT CASE WHEN count(DISTINCT cluster) > 1 THEN avg(CASE WHEN a IS NULL THEN 0.0 ELSE (b - a) / greatest(a, b) END) END AS silhouette FROM c LEFT JOIN ab USING (k))
  SELECT count(DISTINCT cluster) FILTER (cluster >= 0) AS n_clusters, count(*) FILTER (cluster < 0) AS n_noise,
         count(*) FILTER (cluster < 0) / count(*) AS noise_share, any_value(s.silhouette) AS silhouette FROM out, s
""", round_cols=["silhouette", "noise_share"])
def dbscan_report(spark, sf_dir):
    """K3: cluster and noise counts, and the squared silhouette without noise."""
    pts = _cust_points(spark, sf_dir)
    return nb.dbscan_report(pts, nb.dbscan(pts, "c_custkey", 0.5, 5, whole_counts=False), "c_custkey")


@register("dbscan_degrees", sql=f"""{_CZ}
  SELECT x.k AS c_custkey, count(*) AS n_neighbors, count(*) >= 5 AS is_core
  FROM z x JOIN z y ON sqrt({_SQD}) <= 0.5 GROUP BY x.k
""")
def dbscan_degrees(spark, sf_dir):
    """K3 check: eps-neighbour counts and core flags."""
    return nb.eps_degrees(_cust_points(spark, sf_dir), "c_custkey", 0.5, 5)


@register("silhouette", sql=f"""{_CZ},
  pd AS (SELECT x.k, x.seg AS own, y.seg AS other, sum({_SQD}) AS sd, count(*) AS n
         FROM z x JOIN z y ON x.k <> y.k GROUP BY 1, 2, 3),
  ab AS (SELECT k, max(CASE WHEN own = other THEN sd / n END) AS a, min(CASE WHEN own <> other THEN sd / n END) AS b
         FROM pd GROUP BY k)
  SELECT avg(CASE WHEN a IS NULL THEN 0.0 ELSE (b - a) / greatest(a, b) END) AS silhouette,
         CAST((SELECT count(DISTINCT seg) FROM z) AS INTEGER) AS n_clusters
  FROM z LEFT JOIN ab USING (k)
""", round_cols=["silhouette"])
def silhouette(spark, sf_dir):
    """E5: exact mean silhouette (squared Euclidean) of market segments,
    linear time from per-cluster moments."""
    pts, _ = cl.prepare(derived.customer_features(spark, sf_dir).withColumnRenamed("c_mktsegment", "seg"),
                        "c_custkey", _CF)
    seg = derived.customer_features(spark, sf_dir).select("c_custkey", F.col("c_mktsegment").alias("cluster"))
    return cl.silhouette_squared(pts.join(seg, "c_custkey"), "cluster")


@register("pca_2d")
def pca_2d(spark, sf_dir):
    """First two principal components of the embeddings."""
    emb = load_table(spark, sf_dir, "embeddings")
    return cl.pca_2d(emb, "vec_id", "embedding")

"""Clustering operators.

Preparation: drop rows with missing features, standardise over all rows
(population deviation), assemble. Results come back keyed ``(key,
cluster)`` rather than positionally."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import prep
from .passes import matrices, summed


@dataclass
class ClusterResult:
    assignments: DataFrame
    metrics: DataFrame
    model: object = None
    extra: dict = field(default_factory=dict)


def prepare(df: DataFrame, key: str, features=None) -> tuple[DataFrame, list]:
    """``features``: numeric columns, or the name of one array column."""
    if isinstance(features, str):
        prep.validate_columns(df, [key, features])
        d = df.select(key, F.col(features).cast("array<double>").alias("_x")).dropna()
        mean, sd = prep.array_scaler(d)
        return prep.scale_array(d, mean, sd).drop("_x"), [features]
    feats = list(features) if features else prep.default_features(df, exclude=[key])
    prep.validate_columns(df, [key, *feats])
    d = df.select(key, *feats).dropna()
    d = prep.standardize(d, feats)
    return prep.assemble(d, feats), feats


def silhouette_squared(points: DataFrame, cluster: str = "cluster", features: str = "features") -> DataFrame:
    """Exact mean silhouette with squared Euclidean distance in linear time:
    the mean squared distance from x to cluster C is ``|x|² - 2 x·μ_C +
    mean_C |y|²``, so one aggregate per cluster (k rows) suffices; the own
    cluster's mean excludes x itself (n_C / (n_C - 1) factor), singletons
    score 0."""
    from pyspark.ml.stat import Summarizer
    arr = points.select(F.col(cluster).alias("c"), F.col(features).alias("v"), vector_to_array(features).alias("x"))
    arr = arr.withColumn("sq", F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v))
    stats = arr.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.avg("sq").alias("msq"),
                                 Summarizer.mean(F.col("v")).alias("mu")).collect()
    if len(stats) < 2:
        return points.sparkSession.createDataFrame([(None, len(stats))], "silhouette double, n_clusters int")
    ids = [r["c"] for r in stats]
    means = np.array([r["mu"].toArray() for r in stats])
    msq = [r["msq"] for r in stats]
    ns = [r["n"] for r in stats]
    dist = {}
    for j, cid in enumerate(ids):
        dot = F.aggregate(F.zip_with("x", F.array(*[F.lit(float(v)) for v in means[j]]), lambda a, b: a * b),
                          F.lit(0.0), lambda acc, v: acc + v)
        dist[cid] = F.greatest(F.col("sq") - 2 * dot + F.lit(float(msq[j])), F.lit(0.0))
    own_n = F.lit(None)
    own_d = F.lit(None)
    other = None
    for j, cid in enumerate(ids):
        is_own = F.col("c") == F.lit(cid)
        own_n = F.when(is_own, F.lit(ns[j])).otherwise(own_n)
        own_d = F.when(is_own, dist[cid]).otherwise(own_d)
        cand = F.when(~is_own, dist[cid])
        other = cand if other is None else F.least(other, cand)
    a = F.when(own_n > 1, own_d * own_n / (own_n - 1))
    s = F.when(own_n > 1, (other - a) / F.greatest(a, other)).otherwise(F.lit(0.0))
    return arr.select(F.coalesce(s, F.lit(0.0)).alias("s")).agg(F.avg("s").alias("silhouette")).withColumn(
        "n_clusters", F.lit(len(ids)))


def kmeans(df: DataFrame, key: str, features=None, k: int = 3, seed: int = 42, n_init: int = 1
           ) -> ClusterResult:
    """K1: k-means (k-means|| init); best of ``n_init`` seeds by cost."""
    pts, feats = prepare(df, key, features)
    pts = pts.cache()
    best = None
    for s in range(n_init):
        m = KMeans(k=k, seed=seed + s, featuresCol="features", predictionCol="cluster",
                   initMode="k-means||").fit(pts)
        if best is None or m.summary.trainingCost < best.summary.trainingCost:
            best = m
    out = best.transform(pts).select(key, "cluster", "features")
    sil = silhouette_squared(out).first()["silhouette"] if k > 1 else None
    metrics = df.sparkSession.createDataFrame(
        [(k, float(best.summary.trainingCost), sil)], "k int, inertia double, silhouette double")
    return ClusterResult(out.select(key, "cluster"), metrics, best,
                         {"centers": [c.tolist() for c in best.clusterCenters()], "features": feats,
                          "points": out})


def kmeans_assign(points: DataFrame, key: str, feats: list, centroids: list[list[float]]) -> DataFrame:
    """One Lloyd step from fixed centroids: nearest centroid (ties → lower
    index), then the new centroid and size of each cluster."""
    dists = []
    for j, c in enumerate(centroids):
        e = None
        for f, v in zip(feats, c):
            t = (F.col(f) - F.lit(float(v))) * (F.col(f) - F.lit(float(v)))
            e = t if e is None else e + t
        dists.append(F.struct(e.alias("d"), F.lit(j).alias("j")))
    assigned = points.withColumn("cluster", F.least(*dists)["j"])
    return assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *[F.avg(f).alias(f) for f in feats])


class _Scan:
    """All centres of a scan side by side: model ``m`` owns rows
    ``start[m]:start[m + 1]`` of ``centres``."""

    def __init__(self, sizes: list[int], centres: np.ndarray):
        self.start = np.concatenate([[0], np.cumsum(sizes)])
        self.centres = centres

    def nearest(self, x: np.ndarray, models) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """For each of ``models`` the nearest centre of each row and its squared
        distance, from one product with all their centres."""
        at = np.concatenate([np.arange(self.start[m], self.start[m + 1]) for m in models])
        c = self.centres[at]
        sq = np.maximum((x**2).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c**2).sum(axis=1)[None], 0)
        out, lo = {}, 0
        for m in models:
            hi = lo + self.start[m + 1] - self.start[m]
            j = sq[:, lo:hi].argmin(axis=1)
            out[m] = (j, sq[np.arange(len(x)), lo + j])
            lo = hi
        return out


def _plus_plus(sample: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means++ starting centres from a sample."""
    centres = [sample[rng.integers(len(sample))]]
    far = ((sample - centres[0]) ** 2).sum(axis=1)
    for _ in range(k - 1):
        total = far.sum()
        at = rng.choice(len(sample), p=far / total) if total > 0 else rng.integers(len(sample))
        centres.append(sample[at])
        far = np.minimum(far, ((sample - centres[-1]) ** 2).sum(axis=1))
    return np.array(centres)


def kmeans_k_scan(df: DataFrame, key: str, features=None, k_range=range(2, 11), seed: int = 42,
                  n_init: int = 10, tol: float = 1e-4, max_iter: int = 300, start_sample: int = 20_000) -> DataFrame:
    """K5: inertia (best of ``n_init`` starts) and silhouette per k; ``suggested``
    marks the best silhouette, ``converged`` whether the best start settled.

    All (k, start) fits advance together: an iteration is one pass that
    compares each row with the centres of every fit still moving and returns
    their sums. Starts are k-means++ on a sample of ``start_sample`` rows by
    hash; a fit ends when no centre moves by more than ``tol``. One more pass
    gives the silhouettes (squared distance, linear) of the best fits."""
    pts, _ = prepare(df, key, features)
    rows = pts.select(vector_to_array("features").alias("x"), F.xxhash64(F.col(key).cast("string"), F.lit(seed)).alias("h")).persist(StorageLevel.MEMORY_AND_DISK)
    n = rows.count()
    ks = [int(k) for k in k_range]
    spark = df.sparkSession
    if not n:
        return spark.createDataFrame([], "k int, inertia double, silhouette double, suggested boolean, converged boolean")
    sample = np.array([r["x"] for r in rows.orderBy("h").limit(start_sample).select("x").collect()])
    rng = np.random.default_rng(seed)
    sizes = [k for k in ks for _ in range(n_init)]
    scan = _Scan(sizes, np.concatenate([_plus_plus(sample, k, rng) for k in sizes]))
    d, total = sample.shape[1], len(scan.centres)
    rows = rows.select("x")
    inertia, moving, settled = np.full(len(sizes), np.inf), list(range(len(sizes))), np.zeros(len(sizes), bool)
    for _ in range(max_iter + 1):

        def sums(batches, scan=scan, moving=tuple(moving)):
            out, cost = np.zeros((total, d + 1)), np.zeros(len(sizes))
            for x in matrices(batches):
                for m, (j, dist) in scan.nearest(x, moving).items():
                    own = np.zeros((len(x), sizes[m]))
                    own[np.arange(len(x)), j] = 1
                    out[scan.start[m]:scan.start[m + 1], :d] += own.T @ x
                    out[scan.start[m]:scan.start[m + 1], d] += own.sum(axis=0)
                    cost[m] += dist.sum()
            return np.concatenate([out.ravel(), cost])

        got = summed(rows, sums, total * (d + 1) + len(sizes))
        cells, cost = got[:total * (d + 1)].reshape(total, d + 1), got[total * (d + 1):]
        after, still = scan.centres.copy(), []
        for m in moving:
            inertia[m] = cost[m]
            at = slice(scan.start[m], scan.start[m + 1])
            full = cells[at, d] > 0  # a centre without rows stays where it is
            new = np.where(full[:, None], cells[at, :d] / np.maximum(cells[at, d:], 1), scan.centres[at])
            if ((new - scan.centres[at]) ** 2).sum(axis=1).max() > tol * tol:
                after[at] = new
                still.append(m)
            else:
                settled[m] = True
        scan, moving = _Scan(sizes, after), still
        if not moving:
            break
    best = [min(range(i * n_init, (i + 1) * n_init), key=lambda m: inertia[m]) for i in range(len(ks))]
    sil = _scan_silhouettes(rows, scan, best, d)
    rows.unpersist()
    table = [(k, float(inertia[m]), sil[m], bool(settled[m])) for k, m in zip(ks, best, strict=True)]
    res = spark.createDataFrame(table, "k int, inertia double, silhouette double, converged boolean")
    top = max((r for r in table if r[2] is not None), key=lambda r: r[2], default=None)
    return res.select("k", "inertia", "silhouette", (F.col("k") == F.lit(top[0] if top else -1)).alias("suggested"), "converged")


def _scan_silhouettes(rows: DataFrame, scan: _Scan, models: list[int], d: int) -> dict[int, float | None]:
    """Mean squared-distance silhouette of each model in two shared passes: the
    clusters' counts, sums and sums of squares, then the mean over rows."""
    sizes = {m: scan.start[m + 1] - scan.start[m] for m in models}
    lo = dict(zip(models, np.cumsum([0, *[sizes[m] for m in models]]), strict=False))
    total = sum(sizes.values())

    def moments(batches):
        out = np.zeros((total, d + 2))
        for x in matrices(batches):
            sq = (x**2).sum(axis=1)
            for m, (j, _) in scan.nearest(x, models).items():
                own = np.zeros((len(x), sizes[m]))
                own[np.arange(len(x)), j] = 1
                out[lo[m]:lo[m] + sizes[m]] += own.T @ np.column_stack([x, sq, np.ones(len(x))])
        return out.ravel()

    cells = summed(rows, moments, total * (d + 2)).reshape(total, d + 2)

    def scores(batches):
        out = np.zeros(len(models) * 2)
        for x in matrices(batches):
            sq = (x**2).sum(axis=1)
            near = scan.nearest(x, models)
            for i, m in enumerate(models):
                own = cells[lo[m]:lo[m] + sizes[m]]
                full = np.flatnonzero(own[:, d + 1] > 0)
                n, mean, msq = own[full, d + 1], own[full, :d] / own[full, d + 1:], own[full, d] / own[full, d + 1]
                dist = np.maximum(sq[:, None] - 2 * (x @ mean.T) + msq, 0)
                j = np.searchsorted(full, near[m][0])
                mine = dist[np.arange(len(x)), j].copy()
                dist[np.arange(len(x)), j] = np.inf
                other = dist.min(axis=1)
                a = mine * n[j] / np.maximum(n[j] - 1, 1)
                with np.errstate(invalid="ignore", divide="ignore"):
                    s = np.where(n[j] > 1, (other - a) / np.maximum(a, other), 0.0)
                out[2 * i] += np.nan_to_num(s, nan=0.0, posinf=0.0, neginf=0.0).sum()
                out[2 * i + 1] += len(x)
        return out

    got = summed(rows, scores, len(models) * 2).reshape(-1, 2)
    several = {m: (cells[lo[m]:lo[m] + sizes[m], d + 1] > 0).sum() > 1 for m in models}
    return {m: float(got[i, 0] / got[i, 1]) if several[m] else None for i, m in enumerate(models)}


def gaussian_mixture(df: DataFrame, key: str, features=None, k: int = 3, seed: int = 42) -> ClusterResult:
    """K4: full-covariance mixture; per-row responsibilities."""
    pts, _ = prepare(df, key, features)
    m = GaussianMixture(k=k, seed=seed, tol=1e-3, featuresCol="features", predictionCol="cluster",
                        probabilityCol="probability").fit(pts)
    out = m.transform(pts).select(key, "cluster", vector_to_array("probability").alias("probability"))
    metrics = df.sparkSession.createDataFrame(
        [(k, float(m.summary.logLikelihood), list(map(float, m.weights)))],
        "k int, log_likelihood double, weights array<double>")
    return ClusterResult(out, metrics, m)


def pca_2d(df: DataFrame, key: str, features=None) -> DataFrame:
    """First two principal components of the standardised features;
    each component's sign is fixed so its largest absolute loading is
    positive."""
    pts, _ = prepare(df, key, features)
    m = PCA(k=2, inputCol="features", outputCol="pc").fit(pts)
    comps = m.pc.toArray()
    signs = [1.0 if comps[np.argmax(np.abs(comps[:, j])), j] >= 0 else -1.0 for j in range(2)]
    arr = m.transform(pts).select(key, vector_to_array("pc").alias("pc"))
    return arr.select(key, (F.col("pc")[0] * signs[0]).alias("pc1"), (F.col("pc")[1] * signs[1]).alias("pc2"))


# ---------------------------------------------------------------- K2
N_MICRO = 256


def _agglomerate(centers: np.ndarray, weights: np.ndarray, k: int, linkage: str) -> np.ndarray:
    """Lance-Williams agglomeration of weighted points down to k groups;
    returns the group of every input point."""
    m = len(centers)
    diff = centers[:, None, :] - centers[None, :, :]
    sq = np.einsum("ijk,ijk->ij", diff, diff)
    if linkage == "ward":
        w = weights
        d = 2.0 * (w[:, None] * w[None, :]) / (w[:, None] + w[None, :]) * sq
    else:
        d = np.sqrt(sq)
    np.fill_diagonal(d, np.inf)
    size = weights.astype(float).copy()
    active = np.ones(m, bool)
    group = np.arange(m)
    for _ in range(m - k):
        flat = np.argmin(d)
        i, j = divmod(int(flat), m)
        if i > j:
            i, j = j, i
        ni, nj = size[i], size[j]
        if linkage == "ward":
            nk = size
            new = ((ni + nk) * d[i] + (nj + nk) * d[j] - nk * d[i, j]) / (ni + nj + nk)
        elif linkage == "complete":
            new = np.maximum(d[i], d[j])
        elif linkage == "average":
            new = (ni * d[i] + nj * d[j]) / (ni + nj)
        elif linkage == "single":
            new = np.minimum(d[i], d[j])
        else:
            raise ValueError("linkage must be ward, complete, average or single")
        d[i, :] = new
        d[:, i] = new
        d[i, i] = np.inf
        d[j, :] = np.inf
        d[:, j] = np.inf
        size[i] = ni + nj
        active[j] = False
        group[group == j] = i
    _, labels = np.unique(group, return_inverse=True)
    return labels


def hierarchical(df: DataFrame, key: str, features=None, k: int = 3, linkage: str = "ward",
                 n_micro: int = N_MICRO, seed: int = 42) -> ClusterResult:
    """K2: agglomerative clustering in two stages, the same at every size:
    distributed k-means to ``n_micro`` weighted micro-clusters, Lance-Williams
    merging of those centres (a bounded set, whatever the table is), and a
    broadcast mapping back to the rows. The metrics carry ``approximate``."""
    pts, _ = prepare(df, key, features)
    pts = pts.persist(StorageLevel.MEMORY_AND_DISK)
    km = KMeans(k=n_micro, seed=seed, featuresCol="features", predictionCol="micro").fit(pts)
    weights = np.array(km.summary.clusterSizes, float)
    ids = np.flatnonzero(weights)
    centers = np.array(km.clusterCenters())[ids]
    groups = _agglomerate(centers, weights[ids], min(k, len(ids)), linkage)
    mapping = df.sparkSession.createDataFrame([(int(i), int(g)) for i, g in zip(ids, groups, strict=True)],
                                              "micro int, cluster int")
    out = km.transform(pts).select(key, "micro", "features").join(F.broadcast(mapping), "micro").select(key, "cluster", "features")
    # renumber the k clusters by their smallest key
    first = out.groupBy("cluster").agg(F.min(key).alias("_mk"))
    ren = first.select("cluster", (F.row_number().over(Window.orderBy("_mk")) - 1).alias("_c"))
    out = out.join(F.broadcast(ren), "cluster").select(key, F.col("_c").alias("cluster"), "features")
    sil = silhouette_squared(out).first()["silhouette"]
    metrics = df.sparkSession.createDataFrame(
        [(int(k), linkage, int(len(ids)), sil, True)], "k int, linkage string, n_micro int, silhouette double, approximate boolean")
    return ClusterResult(out.select(key, "cluster"), metrics, km)

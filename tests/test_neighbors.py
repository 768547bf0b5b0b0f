import numpy as np
from pyspark.ml.functions import array_to_vector

from kestrel.operators import neighbors as nb


def _brute_knn(train, test, k):
    out = {}
    for qi, q in test:
        d = sorted((float(np.sqrt(((q - x) ** 2).sum())), ti, lab) for ti, x, lab in train)[:k]
        votes = {}
        for _, _, lab in d:
            votes[lab] = votes.get(lab, 0) + 1
        out[qi] = min(votes, key=lambda c: (-votes[c], c))
    return out


def test_grid_knn_is_exact(spark):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(0, 1, (150, 3)), rng.normal(4, 0.3, (50, 3))])
    lab = (x[:, 0] > 1).astype(int)
    train = [(i, x[i], int(lab[i])) for i in range(0, 200, 1) if i % 5]
    test = [(i, x[i]) for i in range(0, 200, 5)]
    tr = spark.createDataFrame([(i, [float(a) for a in v], l) for i, v, l in train],
                               "tid long, f array<double>, label long").withColumn("features", array_to_vector("f"))
    te = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in test],
                               "qid long, f array<double>").withColumn("features", array_to_vector("f"))
    got = {r.qid: r.prediction for r in nb.knn_predict(tr, te, k=5).collect()}
    assert got == _brute_knn(train, test, 5)


def test_dbscan_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(0, 0.2, (60, 2)), rng.normal(3, 0.2, (60, 2)), rng.uniform(-2, 5, (15, 2))])
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)],
                               "k long, f array<double>").withColumn("features", array_to_vector("f"))
    res = {r.k: r for r in nb.dbscan(df, "k", eps=0.5, min_samples=5).collect()}
    dist = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    deg = (dist <= 0.5).sum(1)
    assert all(res[i].n_neighbors == deg[i] for i in range(len(x)))
    core = deg >= 5
    # core points of the two blobs fall into two clusters; noise is -1
    labels = {res[i].cluster for i in range(len(x)) if core[i]}
    assert len(labels) == 2 and -1 not in labels
    for i in range(len(x)):
        if not core[i] and not (dist[i][core] <= 0.5).any():
            assert res[i].cluster == -1

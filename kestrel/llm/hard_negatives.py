"""Hard-negative mining by a GNAT-style multiway hyperplane tree.

The tree is fitted on a bounded sample: each node has a few split points, far
from each other, and a row goes to the nearest one (the hyperplanes between
them). Every row is then sent down the tree, and for each pair (split point i,
subtree j of the same node) the smallest and largest distance from i to the
rows of j is taken over all rows, with the subtree's range of norms. These
tables are as large as the tree, whatever the table is.

A query asks for scores in a window. As ``d(a, x)^2 = |a|^2 + |x|^2 - 2 <a, x>``,
the window and a subtree's norms bound the distances that count: an annulus
around the anchor. Its split points bound the anchor's distance to the subtree
by the triangle inequality, from either side; a subtree whose interval misses
the annulus is eliminated, and what remains is searched one level down. Scores
that the sample's rows already reach narrow the window first (they are real
rows, so nothing better is lost). Leaves are exact: blocks of rows packed as
matrices meet packed blocks of queries in one equi-join, and one product gives
all scores of a pair of blocks.

Mining is two searches: the first positives of each anchor, then for each
positive the best rows of other labels in its window. Equal anchors search
once. A top-k needs at most the k smallest ids of rows that agree in label and
vector, so larger groups of copies are cut to these before they are dealt out
(a partial limit runs in front of the shuffle); the result is the same as over
all copies.

Defined results: rows with a NULL label or vector or any NULL or non-finite
component take no part; rows that agree in id, label and vector count once; a
NULL id comes after all others and is no anchor; rows with an anchor's id are
not its positives; components are held at ``LARGEST`` so that scores fit a
long; shorter vectors are filled with zeros; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kestrel.llm.tables import saved

SCALE = 256
ANCHOR_STEP, RELABEL_STEP, LABELS = 100, 7, 10
POSITIVES, NEGATIVES = 5, 5
LOW_SHARE, WHOLE = 80, 100
SAMPLE_ROWS = 16_384
WAYS = 8
LEAF_SAMPLE = 48
BLOCK_ROWS = 1024
QUERY_ROWS = 256
LARGEST = 1 << 27
_NO_ID = (1 << 63) - 1
_LEAST = -(1 << 62)
#: Room for rounding in the distances.
LESS, MORE = 1 - 1e-9, 1 + 1e-9


# --- rows -----------------------------------------------------------------

def _floored(batches):
    """Vectors as packed little-endian 32-bit integers; others are left out."""
    for b in batches:
        vec = b.column(2)
        n = len(vec)
        off = np.asarray(vec.offsets.to_numpy(), np.int64)
        flat = vec.values
        values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)
        with np.errstate(invalid="ignore"):
            good = np.isfinite(values)  # NULL components come as NaN
            whole = np.clip(np.nan_to_num(np.floor(values * SCALE), nan=0.0, posinf=LARGEST, neginf=-LARGEST), -LARGEST, LARGEST).astype("<i4")
        bad = np.r_[0, np.cumsum(~good)]
        keep = np.flatnonzero((bad[off[1:]] == bad[off[:-1]]) & vec.is_valid().to_numpy(zero_copy_only=False))
        raw = [whole[off[i]:off[i + 1]].tobytes() for i in keep.tolist()] if n else []
        at = pa.array(keep)
        yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(raw, pa.binary())], ["id", "label", "vec"])


def rows_of(df: DataFrame) -> DataFrame:
    """``id, label, vec`` (packed) of the rows that take part, each once."""
    rows = df.select(df["`vec_id`"].cast("long").alias("id"), df["`label`"].cast("long").alias("label"), df["`embedding`"].cast("array<double>").alias("vec"))
    flipped = F.when(F.col("id") % RELABEL_STEP == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    rows = rows.where("label IS NOT NULL AND vec IS NOT NULL").withColumn("label", flipped)
    return rows.mapInArrow(_floored, "id long, label long, vec binary").dropDuplicates(["id", "label", "vec"])


def matrix(raw: list[bytes], dim: int) -> np.ndarray:
    """Packed vectors as float64 rows of ``dim`` columns."""
    if raw and all(len(x) == 4 * dim for x in raw):
        return np.frombuffer(b"".join(raw), "<i4").reshape(len(raw), dim).astype(np.float64)
    out = np.zeros((len(raw), dim))
    for i, x in enumerate(raw):
        v = np.frombuffer(x, "<i4")[:dim]
        out[i, :len(v)] = v
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of integer rows as int64: by float64 where that is exact."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


# --- the tree ---------------------------------------------------------------

class Tree:
    """Split points per node; ``below[n][j]`` is a node number, or ``-1 - leaf``."""

    def __init__(self, sample: np.ndarray, ways: int = WAYS, leaf_rows: int = LEAF_SAMPLE):
        self.points: list[np.ndarray] = []
        self.below: list[list[int]] = []
        self.leaves = 0
        self.root = self._fit(sample, ways, leaf_rows)
        self.near: list[np.ndarray] = []  # filled in by with_ranges

    def _fit(self, rows: np.ndarray, ways: int, leaf_rows: int) -> int:
        points = self._apart(rows, ways) if len(rows) > leaf_rows else rows[:0]
        if len(points) < 2:
            self.leaves += 1
            return -self.leaves
        node = len(self.points)
        self.points.append(points)
        self.below.append([])
        side = distances(rows, points).argmin(axis=1)
        for j in range(len(points)):
            self.below[node].append(self._fit(rows[side == j], ways, leaf_rows))
        return node

    @staticmethod
    def _apart(rows: np.ndarray, ways: int) -> np.ndarray:
        """Rows far from each other, greedily."""
        first = rows[distances(rows, rows.mean(axis=0, keepdims=True))[:, 0].argmax()]
        points, far = [first], distances(rows, first[None])[:, 0]
        while len(points) < ways and far.max() > 0:
            points.append(rows[far.argmax()])
            far = np.minimum(far, distances(rows, points[-1][None])[:, 0])
        return np.array(points)

    def walk(self, rows: np.ndarray):
        """Send rows down: yields ``(node, row numbers, their distances to the
        node's points, their sides)`` and last ``(None, leaf of each row)``."""
        leaf = np.zeros(len(rows), np.int32)
        todo = [(self.root, np.arange(len(rows)))]
        while todo:
            node, at = todo.pop()
            if node < 0:
                leaf[at] = -1 - node
                continue
            d = distances(rows[at], self.points[node])
            side = d.argmin(axis=1)
            yield node, at, d, side
            todo.extend((self.below[node][j], at[side == j]) for j in np.unique(side).tolist())
        yield None, leaf, None, None

    def with_ranges(self, ranges: list[tuple]) -> Tree:
        """Set ``near[n][i, j]``: lowest and highest distance from point i to
        subtree j, and ``norms[n][j]``: its range of squared norms."""
        self.near = [np.stack([np.full((len(p), len(p)), np.inf), np.full((len(p), len(p)), -np.inf)], axis=2) for p in self.points]
        self.norms = [np.tile([np.inf, -np.inf], (len(p), 1)) for p in self.points]
        for node, i, j, low, high, short, long in ranges:
            self.near[node][i, j] = low, high
            self.norms[node][j] = short, long
        return self

    def reached(self, anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> dict[int, np.ndarray]:
        """For each leaf that is not eliminated the anchors that still need it,
        for scores of ``low`` to ``high`` (per anchor)."""
        own = (anchors**2).sum(axis=1)
        found: dict[int, np.ndarray] = {}
        todo = [(self.root, np.arange(len(anchors)))]
        while todo:
            node, at = todo.pop()
            if node < 0:
                found[-1 - node] = at
                continue
            d = distances(anchors[at], self.points[node])[:, :, None]  # anchor, split point
            near, far = self.near[node][None, :, :, 0], self.near[node][None, :, :, 1]  # split point, subtree
            least = np.maximum(near * LESS - d * MORE, d * LESS - far * MORE).max(axis=1)  # anchor, subtree
            most = (d * MORE + far * MORE).min(axis=1)
            norms = self.norms[node]
            inner = own[at, None] + norms[None, :, 0] - 2 * high[at, None]
            outer = own[at, None] + norms[None, :, 1] - 2 * low[at, None]
            slack = 1e-9 * (1 + own[at, None] + np.where(np.isfinite(norms[None, :, 1]), norms[None, :, 1], 0))
            hit = (outer + slack >= np.maximum(least, 0)**2) & (np.maximum(most, 0)**2 + slack >= inner) & (low <= high)[at, None]
            hit &= np.isfinite(norms[None, :, 0])  # subtrees without rows
            for j, below in enumerate(self.below[node]):
                if hit[:, j].any():
                    todo.append((below, at[hit[:, j]]))
        return found


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows to rows."""
    return np.sqrt(np.maximum((a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None] - 2 * (a @ b.T), 0))


class Index:
    """The broadcast part of the search: tree, sample, blocks of each leaf."""

    def __init__(self, rows: DataFrame, dim: int, sample_rows: int = SAMPLE_ROWS, leaf_rows: int = LEAF_SAMPLE, block_rows: int = BLOCK_ROWS):
        spark = rows.sparkSession
        n = rows.count()
        every = max(1, n // sample_rows)
        sample = rows.where(F.pmod(F.xxhash64("id", "vec"), F.lit(every)) == 0).orderBy("id", "label", "vec").limit(2 * sample_rows).collect()
        self.dim = dim
        self.sample = matrix([bytes(r["vec"]) for r in sample], dim)
        self.labels = np.array([r["label"] for r in sample], np.int64)
        # leaves of about a block of rows, and of leaf_rows of the sample at least
        leaf_rows = max(leaf_rows, len(sample) * block_rows // max(n, 1))
        shared = spark.sparkContext.broadcast(Tree(self.sample, leaf_rows=leaf_rows))
        kept = saved(rows.mapInArrow(_sent_down(shared, dim), "id long, label long, vec binary, leaf int"))
        ranges = (kept.mapInArrow(_ranges(shared, dim), "node int, i int, j int, low double, high double, short double, long double")
                  .groupBy("node", "i", "j").agg(F.min("low"), F.max("high"), F.min("short"), F.max("long")))
        self.tree = shared.value.with_ranges([tuple(r) for r in ranges.collect()])
        sizes = kept.groupBy("leaf").agg(F.ceil(F.count("*") / F.lit(block_rows)).cast("int").alias("n_blocks"))  # as many rows as the tree has leaves
        blocks = dict(map(tuple, sizes.collect()))
        self.blocks = [blocks.get(i, 0) for i in range(self.tree.leaves)]
        block = F.pmod(F.xxhash64("id", "label", "vec"), F.col("n_blocks")).cast("int")
        self.packed = saved(kept.join(F.broadcast(sizes), "leaf").select("leaf", block.alias("block"), "id", "label", "vec").groupBy("leaf", "block").applyInArrow(
            _pack(dim), "leaf int, block int, ids binary, labels binary, vecs binary"))


def _sent_down(tree, dim):
    def run(batches):
        for b in batches:
            leaf = np.zeros(b.num_rows, np.int32)
            for node, x, _, _ in tree.value.walk(matrix(b.column(2).to_pylist(), dim)):
                if node is None:
                    leaf = x
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf)], ["id", "label", "vec", "leaf"])

    return run


def _ranges(tree, dim):
    """Per partition, the range of distances of each (point, subtree)."""

    def run(batches):
        low: dict = {}
        for b in batches:
            rows = matrix(b.column(2).to_pylist(), dim)
            norms = (rows**2).sum(axis=1)
            for node, at, d, side in tree.value.walk(rows):
                if node is None:
                    continue
                for j in np.unique(side).tolist():
                    mine = side == j
                    new = (d[mine].min(axis=0), d[mine].max(axis=0), norms[at[mine]].min(), norms[at[mine]].max())
                    old = low.get((node, j), new)
                    low[node, j] = (np.minimum(old[0], new[0]), np.maximum(old[1], new[1]), min(old[2], new[2]), max(old[3], new[3]))
        out = [(n, i, j, a, z, s, g) for (n, j), (near, far, s, g) in low.items() for i, (a, z) in enumerate(zip(near.tolist(), far.tolist(), strict=True))]
        if out:
            kinds = (pa.int32(), pa.int32(), pa.int32(), *[pa.float64()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["node", "i", "j", "low", "high", "short", "long"])

    return run


def _pack(dim):
    """A block of rows as one: ids, labels and the matrix."""

    def run(t):
        ids = np.array([_NO_ID if x is None else x for x in t["id"].to_pylist()], "<i8")
        vecs = matrix(t["vec"].to_pylist(), dim).astype("<i4")
        first = [[t[c][0].as_py()] for c in ("leaf", "block")]
        blobs = [[x.tobytes()] for x in (ids, t["label"].to_numpy().astype("<i8"), vecs)]
        kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 3)
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip([*first, *blobs], kinds, strict=True)], names=["leaf", "block", "ids", "labels", "vecs"])

    return run


# --- the search -------------------------------------------------------------

def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` by descending score, then ascending id."""
    if len(scores) > 4 * k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def _ask(index, k: int, same: bool):
    """Queries ``qid, label, vec, low, high`` to packed query blocks per leaf
    block. The sample's own k-th best score in the window raises ``low``."""

    def run(batches):
        ix = index.value
        for whole in batches:
            for s in range(0, whole.num_rows, QUERY_ROWS):
                b = whole.slice(s, QUERY_ROWS)
                raw, labels = b.column(2).to_pylist(), b.column(1).to_numpy()
                low, high = (np.array(b.column(i).to_numpy(), np.int64) for i in (3, 4))
                anchors = matrix(raw, ix.dim)
                scores = products(anchors, ix.sample)
                fits = ((labels[:, None] == ix.labels[None]) == same) & (scores >= low[:, None]) & (scores <= high[:, None])
                if scores.shape[1] >= k:
                    scores = np.where(fits, scores, _LEAST)
                    low = np.maximum(low, np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k])
                out = []
                for leaf, at in ix.tree.reached(anchors, low.astype(np.float64), high.astype(np.float64)).items():
                    blob = [x.tobytes() for x in (b.column(0).to_numpy()[at], labels[at], low[at], high[at], anchors[at].astype("<i4"))]
                    out.extend((leaf, block, *blob) for block in range(ix.blocks[leaf]))
                if out:
                    kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 5)
                    for i in range(0, len(out), 256):
                        part = zip(*out[i:i + 256], strict=True)
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(part, kinds, strict=True)], ["q_leaf", "q_block", "qids", "q_labels", "lows", "highs", "q_vecs"])

    return run


def _answer(index, k: int, same: bool):
    """The ``k`` best rows of a leaf block for each query of a query block."""

    def run(batches):
        dim = index.value.dim
        for b in batches:
            out = []
            for ids, labels, vecs, qids, q_labels, lows, highs, q_vecs in zip(*(b.column(i).to_pylist() for i in range(8)), strict=True):
                ids, labels, qids, q_labels, lows, highs = (np.frombuffer(x, "<i8") for x in (ids, labels, qids, q_labels, lows, highs))
                rows, asked = (np.frombuffer(x, "<i4").reshape(n, dim).astype(np.float64) for x, n in ((vecs, len(ids)), (q_vecs, len(qids))))
                scores = products(asked, rows)
                fits = ((q_labels[:, None] == labels[None]) == same) & (scores >= lows[:, None]) & (scores <= highs[:, None])
                for q in np.flatnonzero(fits.any(axis=1)).tolist():
                    at = np.flatnonzero(fits[q])
                    at = at[best(scores[q, at], ids[at], k)]
                    out.append((np.full(len(at), qids[q]), np.full(len(at), highs[q]), scores[q, at], ids[at]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["qid", "high", "score", "id"])

    return run


def search(index, packed: DataFrame, queries: DataFrame, k: int, same: bool) -> DataFrame:
    """``qid, high, score, id, rank``: the first ``k`` rows for each query, of
    its own label (``same``) or of others, with scores of ``low`` to ``high``."""
    asked = queries.select("qid", "label", "vec", "low", "high").mapInArrow(
        _ask(index, k, same), "q_leaf int, q_block int, qids binary, q_labels binary, lows binary, highs binary, q_vecs binary")
    met = packed.join(asked, (packed["leaf"] == asked["q_leaf"]) & (packed["block"] == asked["q_block"]))
    found = met.select("ids", "labels", "vecs", "qids", "q_labels", "lows", "highs", "q_vecs").mapInArrow(_answer(index, k, same), "qid long, high long, score long, id long")
    order = Window.partitionBy("qid", "high").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(df: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, sample_rows: int = SAMPLE_ROWS, leaf_rows: int = LEAF_SAMPLE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score``: for each anchor and each of its first positives the first
    rows of other labels whose score is 80 to 100 % of the positive's."""
    rows = saved(rows_of(df))
    spark = df.sparkSession
    dim = rows.agg(F.max(F.octet_length("vec"))).first()[0]
    dim = (dim or 0) // 4 or 1
    # of equal rows, those that a top-k can reach; the anchor itself may be one of them
    reach = max(positives + 1, negatives)
    order = Window.partitionBy("vec", "label").orderBy(F.col("id").asc_nulls_last())
    slim = saved(rows.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= reach).drop("nth"))
    index = Index(slim, dim, sample_rows, leaf_rows, block_rows)
    packed = index.packed
    del index.packed
    shared = spark.sparkContext.broadcast(index)

    anchors = rows.where(F.col("id") % ANCHOR_STEP == 0).select("id", "label", "vec")
    classes = saved(anchors.groupBy("label", "vec").agg(F.min("id").alias("qid")))
    named = classes.select("qid", F.col("label").alias("of_label"), F.col("vec").alias("of_vec"))
    anchors = anchors.join(named, (F.col("label") == F.col("of_label")) & (F.col("vec") == F.col("of_vec"))).select(F.col("id").alias("anchor_id"), "qid")
    all_scores = [F.lit(x).cast("long").alias(c) for x, c in ((_LEAST, "low"), (-_LEAST, "high"))]
    near = saved(search(shared, packed, classes.select("*", *all_scores), positives + 1, True))

    # one query for each class and positive score; a negative score has an empty window
    levels = near.where("score >= 0").select(F.col("qid").alias("of"), F.col("score").alias("high")).distinct()
    low = F.expr(f"CAST((CAST(high AS DECIMAL(30, 0)) * {LOW_SHARE} + {WHOLE - 1}) DIV {WHOLE} AS BIGINT)")
    asked = classes.join(levels, F.col("qid") == F.col("of")).select("qid", "label", "vec", low.alias("low"), "high")
    hard = search(shared, packed, asked, negatives, False).select(
        F.col("qid").alias("hard_of"), F.col("high").alias("level"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))

    # each anchor drops itself from its class's rows and takes the first ones
    lists = near.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "score", "id"))).alias("near")).select(F.col("qid").alias("list_of"), "near")
    others = F.slice(F.filter("near", lambda x: x["id"] != F.col("anchor_id")), 1, positives)
    pairs = anchors.join(lists, F.col("qid") == F.col("list_of")).select("anchor_id", "qid", F.explode(others).alias("p"))
    pairs = pairs.select("anchor_id", "qid", F.col("p.id").alias("positive_id"), F.col("p.score").alias("positive_score"))
    joined = pairs.join(hard, (F.col("qid") == F.col("hard_of")) & (F.col("positive_score") == F.col("level")))
    known = lambda c: F.when(F.col(c) != _NO_ID, F.col(c)).alias(c)
    return joined.select("anchor_id", known("positive_id"), F.col("rank").cast("int").alias("rank"), known("negative_id"), "positive_score", "negative_score")

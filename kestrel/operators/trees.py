"""Decision trees and forests whose work follows the rows, not nodes x bins x tasks.

A node of more than ``LOCAL_ROWS`` rows is split on a histogram that all tasks
sum up; a smaller one's rows are brought together and its whole subtree is grown
in one pass over them, many subtrees side by side. Features are cut into bins,
splits are chosen and leaves of one prediction are merged as MLlib does it, so a
single tree of classes is MLlib's tree (above ``LOCAL_ROWS``, leaves are merged
within subtrees only). A forest draws Poisson(1) weights for each tree and row.
The trees stay a table: rows to predict are brought to the subtree they fall into.

Rows with the same bins in all features, a cell, are one to every split. Where a
forest of numbers has more than ``LOCAL_ROWS`` rows and at most ``MAX_CELLS`` cells,
a cell's rows are brought together once, each still drawing its weight in each
tree, and only the cell's count, mean and spread go to the trees. A tree is grown
whole from them, and rows to predict look up the mean of the trees for their cell.

The driver holds the nodes above the subtrees, about rows / ``LOCAL_ROWS`` of each
tree; histograms of a pass take at most ``PASS_BYTES`` in a task.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.session import ensure_checkpoint_dir, ship_package

LOCAL_ROWS = 1 << 16
PASS_BYTES = 64 << 20
MAX_TASKS = 2048
MAX_CELLS = 1 << 20
#: Cells whose predictions a tree makes at once, and the weights drawn at once.
CHUNK, DRAWN = 1 << 12, 1 << 18
_PIECE_BITS = 20  # of a cell's number, for the piece of a cell of very many rows
_NODES = "tree int, node int, feature binary, split binary, left binary, value binary"


def cuts_of(values: np.ndarray, max_bins: int) -> np.ndarray:
    """At most ``max_bins - 1`` thresholds between sorted values, by MLlib's rule."""
    kinds, counts = np.unique(values, return_counts=True)
    middles = (kinds[:-1] + kinds[1:]) / 2.0
    if len(middles) < max_bins:
        return middles
    stride = len(values) / max_bins
    target, out, before = stride, [], float(counts[0])
    for i, c in enumerate(counts[1:].tolist()):
        if abs(before - target) < abs(before + c - target):
            out.append(middles[i])
            target += stride
        before += c
    return np.array(out)


def _sample(rows: DataFrame, n: int, key: str, max_bins: int) -> DataFrame:
    """All rows, beyond max(max_bins squared, 10,000) about that many by the hash
    of key and features."""
    wanted, whole = max(max_bins * max_bins, 10_000), rows
    if n > wanted:
        rows = rows.where(F.pmod(F.xxhash64(F.col(key).cast("string"), vector_to_array("features")), F.lit(1 << 30)) < int(wanted / n * (1 << 30)))
        if rows.isEmpty():  # few different rows, often repeated
            rows = whole.limit(wanted)
    return rows


def _cuts(rows: DataFrame, bins: int) -> list[np.ndarray]:
    """Each feature's thresholds from a sample."""

    def one(t: pa.Table) -> pa.Table:
        return pa.table({"f": t.column("f").slice(0, 1), "cuts": pa.array([cuts_of(t.column("v").to_numpy(), bins)], pa.list_(pa.float64()))})

    values = rows.select(F.posexplode(vector_to_array("features")).alias("f", "v"))
    found = {r["f"]: np.array(r["cuts"], float) for r in values.groupBy("f").applyInArrow(one, "f int, cuts array<double>").collect()}
    return [found[f] for f in sorted(found)]


def _blocks(rows: DataFrame, cuts: list[np.ndarray], extra: str) -> DataFrame:
    """``bins, extra``: the bins and a number of the rows of each Arrow batch."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                x = b.column(0).flatten().to_numpy().reshape(b.num_rows, -1)
                bins = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1).astype(np.uint16)
                yield pa.RecordBatch.from_arrays([pa.array([bins.tobytes()]), pa.array([b.column(1).to_numpy().tobytes()])], ["bins", "extra"])

    return rows.select(vector_to_array("features").alias("x"), extra).mapInArrow(run, "bins binary, extra binary")


def cells_of(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """The number of each row's cell."""
    cell = np.zeros(len(x), np.int64)
    for f, c in enumerate(cuts):
        cell = cell * (len(c) + 1) + np.searchsorted(c, x[:, f], "left")
    return cell


def bins_of(cell: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """The bins of each cell."""
    return np.stack(np.unravel_index(cell, [len(c) + 1 for c in cuts]), axis=1).astype(np.uint16)


def _cell(cuts: list[np.ndarray]):
    """A function of the features: the number of their cell."""

    @F.arrow_udf("long")
    def cell(x: pa.Array) -> pa.Array:
        return pa.array(cells_of(x.flatten().to_numpy().reshape(len(x), len(cuts)), cuts))

    return cell


def _piece(cuts: list[np.ndarray], pieces: dict[int, int]):
    """A function of the features and a hash: the cell and which of its ``pieces``."""
    cut = np.array(sorted(pieces) or [-1], np.int64)
    count = np.array([pieces.get(c, 1) for c in cut.tolist()], np.int64)

    @F.arrow_udf("long")
    def piece(x: pa.Array, h: pa.Array) -> pa.Array:
        at = cells_of(x.flatten().to_numpy().reshape(len(x), len(cuts)), cuts)
        i = np.minimum(np.searchsorted(cut, at), len(cut) - 1)
        return pa.array(at << _PIECE_BITS | np.where(cut[i] == at, h.to_numpy() % count[i], 0))

    return piece


# the weight of each sixteen-bit number, -1 where a finer one decides
_UP_TO = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(20)])
_EDGES = np.searchsorted(_UP_TO, np.arange(65537) / 65536, "right")
_WEIGHTS = np.where(_EDGES[1:] == _EDGES[:-1], _EDGES[:-1], -1).astype(float)


def poisson(rng: np.random.Generator, rows: int, trees: int) -> np.ndarray:
    """Poisson(1) weights."""
    u = rng.integers(0, 1 << 16, (rows, trees), np.uint16)
    w = _WEIGHTS[u]
    open_ = np.flatnonzero(w < 0)
    w.flat[open_] = np.searchsorted(_UP_TO, (u.flat[open_] + rng.random(len(open_))) / 65536, "right")
    return w


def _cell_sums(train: DataFrame, key: str, n: int, cuts: list[np.ndarray], few: DataFrame, trees: int, shift: float, seed: int) -> DataFrame:
    """For each tree the drawn rows of the cells: their number, mean label (less
    ``shift``) and sum of squared deviations from it. A cell that holds more than a
    task's share of the sample ``few`` is cut into pieces."""
    parts = max(4 * train.sparkSession.sparkContext.defaultParallelism, min(8 * MAX_TASKS, n >> 20))
    x = vector_to_array("features")
    counts = few.select(x.alias("x")).repartition(1).select(_cell(cuts)("x").alias("cell")).groupBy("cell").count().collect()
    share = parts / sum(r["count"] for r in counts)
    pieces = {r["cell"]: p for r in counts if (p := round(r["count"] * share)) > 1}
    piece = _piece(cuts, pieces)(x, F.xxhash64(F.col(key).cast("string"), "label"))
    rows = train.select(piece.alias("piece"), (F.col("label") - F.lit(shift)).cast("double").alias("y"))
    step = max(1, DRAWN // trees)

    def made(done, sums):
        s, piece = np.stack(sums), np.array(done, np.int64)
        out = []
        for t in range(trees):
            at = np.flatnonzero(s[:, 1, t])
            base, w, d, dd = s[at, 0, t], s[at, 1, t], s[at, 2, t], s[at, 3, t]
            out.append([x.tobytes() for x in (piece[at], w, base + d / w, np.maximum(dd - d * (d / w), 0.0))])
        return pa.RecordBatch.from_arrays([pa.array(range(trees), pa.int32())] + [pa.array(x, pa.binary()) for x in zip(*out, strict=True)], ["tree", "piece", "n", "mean", "spread"])

    def summed(batches):
        done, sums, rng = [], [], None
        for b in batches:
            p, y = b.column(0).to_numpy(), b.column(1).to_numpy()
            starts = np.unique(np.r_[np.flatnonzero(p[1:] != p[:-1]) + 1, np.arange(0, len(p), step)])
            for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(p)], strict=False):
                if not done or p[lo] != done[-1]:
                    if len(done) * trees >= 4 * DRAWN:
                        yield made(done, sums)
                        done, sums = [], []
                    done.append(int(p[lo]))
                    sums.append(np.zeros((4, trees)))
                    sums[-1][0] = y[lo]  # deviations from a label of the cell stay small
                    rng = np.random.default_rng([seed, done[-1]])
                d = y[lo:hi] - sums[-1][0, 0]
                sums[-1][1:] += np.stack([np.ones(hi - lo), d, d * d]) @ poisson(rng, hi - lo, trees)
        if done:
            yield made(done, sums)

    return rows.repartition(parts, "piece").sortWithinPartitions("piece", "y").mapInArrow(summed, "tree int, piece binary, n binary, mean binary, spread binary")


def _impurity(s: np.ndarray, k: int) -> np.ndarray:
    """Gini impurity of class counts, or variance of (n, sum, sum of squares)."""
    if k:
        whole, out = s.sum(axis=1), np.ones(len(s))
        for c in range(k):
            p = s[:, c] / whole
            out -= p * p
        return out
    return (s[:, 2] - s[:, 1] * s[:, 1] / s[:, 0]) / s[:, 0]


def _weight(s: np.ndarray, k: int) -> np.ndarray:
    return s.sum(axis=1) if k else s[:, 0]


def best_splits(cells: np.ndarray, node: np.ndarray, k: int):
    """For each node its best ``(node, gain, cell)`` from the sums of its bins
    (``cells``, in order of node and bin); rows up to the cell go left. Of equal
    gains the first counts."""
    first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
    size = np.diff(np.r_[first, len(node)])
    run = np.cumsum(cells, axis=0)
    left = run - np.repeat(run[first] - cells[first], size, axis=0)
    whole = left[first + size - 1]
    right = np.repeat(whole, size, axis=0) - left
    right[first + size - 1] = left[first + size - 1]  # no split behind a node's last bin
    total = np.repeat(_weight(whole, k), size)
    gain = np.repeat(_impurity(whole, k), size) - _weight(left, k) / total * _impurity(left, k) - _weight(right, k) / total * _impurity(right, k)
    gain[first + size - 1] = -np.inf
    top = np.maximum.reduceat(gain, first)
    at = np.minimum.reduceat(np.where(gain == np.repeat(top, size), np.arange(len(gain)), len(gain)), first)
    return node[first], top, at


def _tried(seed: int, tree: int, node: int, m: int, dim: int, tries: int) -> np.ndarray:
    """Which features each of ``m`` nodes may be split on."""
    if tries >= dim:
        return np.ones((m, dim), bool)
    draw = np.random.default_rng([seed, tree, node]).random((m, dim))
    return draw <= np.partition(draw, tries - 1, axis=1)[:, tries - 1:tries]


def _bin_sums(slot: np.ndarray, b: np.ndarray, s: np.ndarray, m: int):
    """The filled bins of ``m`` nodes, in order, and their sums, from cells."""
    width = int(b.max()) + 1
    at = slot * width + b
    filled = np.flatnonzero(np.bincount(at, minlength=m * width))
    return filled // width << 16 | filled % width, np.stack([np.bincount(at, s[:, c], m * width)[filled] for c in range(s.shape[1])], axis=1)


def grow(bins: np.ndarray, y: np.ndarray, w: np.ndarray, k: int, depth: int, tried, spread: np.ndarray | None = None):
    """``feature, split, left, value`` of the nodes of a subtree, level by level;
    a leaf's feature is -1, the right child stands behind the left one.
    ``tried(first node, nodes)`` says which features may be split on. With
    ``spread`` a row stands for ``w`` rows of mean ``y``: the sum of their squared
    deviations from it."""
    feature, split, left, value = [], [], [], []
    slot, made, m = np.zeros(len(y), np.int64), 0, 1
    for level in range(depth + 1):
        # numbers stay small against the node's own: deviations from its mean
        mean = None if k else np.bincount(slot, w * y, m) / np.bincount(slot, w, m)
        s = np.eye(k)[y.astype(np.int64)] * w[:, None] if k else np.stack([w, w * (y - mean[slot]), w * (y - mean[slot]) ** 2], axis=1)
        if spread is not None:
            s[:, 2] += spread
        value.append(np.stack([np.bincount(slot, s[:, c], m) for c in range(k)], axis=1) if k else mean[:, None])
        f_of, b_of = np.full(m, -1), np.zeros(m, np.int64)
        if level < depth:
            low, high = np.full(m, np.inf), np.full(m, -np.inf)
            np.minimum.at(low, slot, y)
            np.maximum.at(high, slot, y)
            mixed = low < high
            if spread is not None:
                mixed |= np.bincount(slot, spread, m) > 0
            gain, may = np.zeros(m), tried(made, m) & mixed[:, None]
            for f in range(bins.shape[1]):
                rows = np.flatnonzero(may[slot, f])
                if not len(rows):
                    continue
                if spread is not None and m * (int(bins[:, f].max()) + 1) <= 4 * len(rows):
                    key, sums = _bin_sums(slot[rows], bins[rows, f], s[rows], m)
                else:
                    key = (slot[rows] << 16) | bins[rows, f]
                    order = np.argsort(key, kind="stable")
                    key = key[order]
                    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                    key, sums = key[first], np.add.reduceat(s[rows[order]], first, axis=0)
                at_node, g, cell = best_splits(sums, key >> 16, k)
                better = g > gain[at_node]
                at_node, cell = at_node[better], cell[better]
                gain[at_node], f_of[at_node], b_of[at_node] = g[better], f, key[cell] & 0xFFFF
        inner = np.flatnonzero(f_of >= 0)
        child = np.full(m, -1)
        child[inner] = made + m + 2 * np.arange(len(inner))
        feature.append(f_of)
        split.append(b_of)
        left.append(child)
        if not len(inner):
            break
        rows = np.flatnonzero(f_of[slot] >= 0)
        of = slot[rows]
        bins, y, w, spread = bins[rows], y[rows], w[rows], None if spread is None else spread[rows]
        slot = child[of] - (made + m) + (bins[np.arange(len(rows)), f_of[of]] > b_of[of])
        made, m = made + m, 2 * len(inner)
    return _merged(*(np.concatenate(x) for x in (feature, split, left, value)), k)


def _merged(feature, split, left, value, k: int):
    """Sibling leaves of one prediction become their parent."""
    answer = value.argmax(axis=1) if k else value[:, 0]
    for i in np.flatnonzero(feature >= 0)[::-1].tolist():
        a = left[i]
        if feature[a] < 0 and feature[a + 1] < 0 and answer[a] == answer[a + 1]:
            feature[i], left[i], answer[i] = -1, -1, answer[a]
    return feature.astype(np.int32), split.astype(np.int32), left.astype(np.int32), value


def reached(feature, split, left, bins: np.ndarray) -> np.ndarray:
    """The leaf that each row falls into."""
    at, live = np.zeros(len(bins), np.int64), np.arange(len(bins))
    while len(live):
        live = live[feature[at[live]] >= 0]
        here = at[live]
        at[live] = left[here] + (bins[live, feature[here]] > split[here])
    return at


class _Top:
    """The nodes of one tree above its subtrees."""

    def __init__(self, n: int):
        self.feature, self.split, self.left, self.rows, self.depth = [-1], [0], [-1], [n], [0]
        self.value = [None]  # set on the leaves

    def arrays(self):
        return tuple(np.array(x, np.int64) for x in (self.feature, self.split, self.left))

    def open(self, limit: int) -> list[int]:
        return [i for i, n in enumerate(self.rows) if self.feature[i] < 0 and self.value[i] is None and n > limit]

    def divide(self, i: int, feature: int, split: int, sides, k: int):
        self.feature[i], self.split[i], self.left[i] = feature, split, len(self.left)
        for s in sides:
            self.feature.append(-1)
            self.split.append(0)
            self.left.append(-1)
            self.rows.append(int(s.sum() if k else s[0]))
            self.depth.append(self.depth[i] + 1)
            self.value.append(None)


@dataclass
class Forest:
    """Fitted trees; ``nodes`` has a row for each subtree. ``whole``: each tree is
    one, grown from cells."""

    tops: list
    nodes: DataFrame
    cuts: list
    k: int
    shift: float
    whole: bool = False

    def _cell_means(self) -> DataFrame:
        """What the trees predict for each cell, on average: ``_cell, _mean``."""
        cuts, shift = self.cuts, self.shift
        cells = math.prod(len(c) + 1 for c in cuts)

        def predicted(batches):
            for b in batches:
                for r in b.to_pylist():
                    value, parts = np.frombuffer(r["value"], np.float64), [np.frombuffer(r[c], np.int32) for c in ("feature", "split", "left")]
                    for first in range(0, cells, CHUNK):
                        at = reached(*parts, bins_of(np.arange(first, min(first + CHUNK, cells)), cuts))
                        yield pa.RecordBatch.from_arrays([pa.array([first], pa.int32()), pa.array([r["tree"]], pa.int32()), pa.array([value[at].tobytes()])], ["first", "tree", "v"])

        def averaged(t):
            votes = np.stack([np.frombuffer(v, np.float64) for v in t.sort_by("tree").column("v").to_pylist()])
            return pa.table({"_cell": t.column("first")[0].as_py() + np.arange(votes.shape[1]), "_mean": votes.mean(axis=0) + shift})

        votes = self.nodes.select("tree", "feature", "split", "left", "value").mapInArrow(predicted, "first int, tree int, v binary")
        return votes.groupBy("first").applyInArrow(averaged, "_cell long, _mean double")

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` (with ``features``) with ``prediction`` and, for classes,
        ``probability``."""
        spark, k, shift = df.sparkSession, self.k, self.shift
        if self.whole:  # at most MAX_CELLS rows, whatever the input
            means = F.broadcast(self._cell_means().withColumnRenamed("_mean", "prediction"))
            return df.withColumn("_cell", _cell(self.cuts)(vector_to_array("features"))).join(means, "_cell").drop("_cell")
        ensure_checkpoint_dir(spark)
        df = df.withColumn("_row", F.monotonically_increasing_id()).checkpoint()
        tops, dim = [t.arrays() for t in self.tops], len(self.cuts)

        def dealt(batches):
            for b in batches:
                for raw, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    bins, ids = np.frombuffer(raw, np.uint16).reshape(-1, dim), np.frombuffer(ids, np.int64)
                    for tree, top in enumerate(tops):
                        at = reached(*top, bins)
                        parts = [(i, np.flatnonzero(at == i)) for i in np.unique(at).tolist()]
                        yield pa.RecordBatch.from_arrays([pa.array([tree] * len(parts), pa.int32()), pa.array([i for i, _ in parts], pa.int32()), pa.array([bins[r].tobytes() for _, r in parts]), pa.array([ids[r].tobytes() for _, r in parts])], ["tree", "node", "bins", "ids"])

        def predicted(rows, nodes):
            ids = np.frombuffer(b"".join(rows.column("ids").to_pylist()), np.int64)
            bins = np.frombuffer(b"".join(rows.column("bins").to_pylist()), np.uint16).reshape(-1, dim)
            at = np.zeros((0, k or 1))
            if not nodes.num_rows:  # a tree whose weights are all 0
                ids = ids[:0]
            if len(ids):
                part = nodes.slice(0, 1).to_pylist()[0]
                value = np.frombuffer(part["value"], np.float64).reshape(-1, k or 1)
                at = value[reached(*(np.frombuffer(part[c], np.int32) for c in ("feature", "split", "left")), bins)]
                at = at / at.sum(axis=1, keepdims=True) if k else at + shift
            return pa.table({"_row": ids, "v": pa.FixedSizeListArray.from_arrays(pa.array(at.ravel()), k or 1).cast(pa.list_(pa.float64()))})

        rows = _blocks(df, self.cuts, "_row").mapInArrow(dealt, "tree int, node int, bins binary, ids binary")
        parts = _tasks(spark, len(tops), len(self.tops[0].rows))
        votes = rows.repartition(parts, "tree", "node").groupBy("tree", "node").cogroup(self.nodes.groupBy("tree", "node")).applyInArrow(predicted, "_row long, v array<double>")
        # twelve digits: rows in the same leaves get the same number in whatever order it is summed
        mean = votes.groupBy("_row").agg(F.array(*[F.round(F.avg(F.col("v")[c]), 12) if k else F.avg(F.col("v")[c]) for c in range(k or 1)]).alias("_mean"))
        out = df.join(mean, "_row").drop("_row")
        if not k:
            return out.withColumn("prediction", F.col("_mean")[0]).drop("_mean")
        best = (F.array_position("_mean", F.array_max("_mean")) - 1).cast("double")
        return out.withColumn("prediction", best).withColumn("probability", array_to_vector("_mean")).drop("_mean")


def _tasks(spark, trees: int, nodes: int) -> int:
    """A number of its own, so that subtrees of few bytes are not packed into one task."""
    return max(1, min(MAX_TASKS, trees * nodes, max(4 * spark.sparkContext.defaultParallelism, trees * nodes // 8)))


def fit(train: DataFrame, key: str, k: int, trees: int = 1, max_depth: int = 30, max_bins: int = 32, tries: int | None = None, seed: int = 42, local_rows: int | None = None) -> Forest:
    """Trees of ``train`` (``features``, ``label``) for ``k`` classes, or for a
    number where ``k`` is 0. More than one tree: each row weighs Poisson(1) in
    each. A node is split on ``tries`` features, by default on all."""
    spark, local = train.sparkSession, local_rows or LOCAL_ROWS
    ship_package(spark)
    r = train.agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("mean")).first()
    n, shift = r["n"], 0.0 if k else float(r["mean"] or 0.0)
    if not n:
        raise ValueError("no training rows")
    few = _sample(train, n, key, max_bins)
    cuts = _cuts(few, min(max_bins, n))
    dim = len(cuts)
    tries = min(tries or dim, dim)
    width = max(len(c) for c in cuts) + 1
    ensure_checkpoint_dir(spark)
    if not k and trees > 1 and n > local and math.prod(len(c) + 1 for c in cuts) <= MAX_CELLS:
        sums = _cell_sums(train, key, n, cuts, few, trees, shift, seed)
        return Forest([_Top(n) for _ in range(trees)], _whole_trees(sums, cuts, trees, max_depth, tries, seed).checkpoint(), cuts, k, shift, whole=True)
    ordered = train.select("features", (F.col("label") - F.lit(shift)).cast("double").alias("y"), F.col(key).alias("_key")).sortWithinPartitions("_key", "y")
    blocks = _blocks(ordered, cuts, "y").checkpoint()
    tops = [_Top(n) for _ in range(trees)]

    def weighted(b, arrays):
        """Each block's rows, and for each tree their nodes and weights."""
        for raw, ys in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            bins, y = np.frombuffer(raw, np.uint16).reshape(-1, dim), np.frombuffer(ys, np.float64)
            mark = zlib.crc32(raw, zlib.crc32(ys))
            for tree, top in enumerate(arrays):
                w = np.random.default_rng([seed, tree, mark]).poisson(1.0, len(y)) if trees > 1 else np.ones(len(y), np.int64)
                rows = np.flatnonzero(w)
                yield tree, bins[rows], y[rows], w[rows].astype(float), reached(*top, bins[rows])

    _grow_tops(blocks, tops, weighted, k, max_depth, width, dim, tries, seed, local)
    arrays, depths = [t.arrays() for t in tops], [t.depth for t in tops]
    settled = [[v is not None for v in t.value] for t in tops]

    def dealt(batches):
        for b in batches:
            for tree, bins, y, w, at in weighted(b, arrays):
                parts = [(i, np.flatnonzero(at == i)) for i in np.unique(at).tolist() if not settled[tree][i]]
                yield pa.RecordBatch.from_arrays([pa.array([tree] * len(parts), pa.int32()), pa.array([i for i, _ in parts], pa.int32())] + [pa.array([x[rows].tobytes() for _, rows in parts], pa.binary()) for x in (bins, y, w.astype(np.uint8))], ["tree", "node", "bins", "y", "w"])

    def grown(key, t):
        tree, node = key[0].as_py(), key[1].as_py()
        raw = (b"".join(t.column(c).to_pylist()) for c in ("bins", "y", "w"))
        bins, y, w = (np.frombuffer(x, kind) for x, kind in zip(raw, (np.uint16, np.float64, np.uint8), strict=True))
        draw = np.random.default_rng([seed, tree, node]).integers(1 << 31)
        made = grow(bins.reshape(-1, dim), y, w.astype(float), k, max_depth - depths[tree][node], lambda first, m: _tried(seed + int(draw), tree, first + 1, m, dim, tries))
        return pa.table({"tree": pa.array([tree], pa.int32()), "node": pa.array([node], pa.int32())} | {c: pa.array([x.tobytes()]) for c, x in zip(("feature", "split", "left", "value"), made, strict=True)})

    parts = _tasks(spark, trees, len(tops[0].rows))
    nodes = blocks.mapInArrow(dealt, "tree int, node int, bins binary, y binary, w binary").repartition(parts, "tree", "node").groupBy("tree", "node").applyInArrow(grown, _NODES)
    leaf = np.array([-1], np.int32).tobytes()
    leaves = [(t, i, leaf, leaf, leaf, np.asarray(v, float).tobytes()) for t, top in enumerate(tops) for i, v in enumerate(top.value) if v is not None]
    if leaves:
        nodes = nodes.unionByName(spark.createDataFrame(leaves, _NODES))
    return Forest(tops, nodes.checkpoint(), cuts, k, shift)


def _whole_trees(sums: DataFrame, cuts: list[np.ndarray], trees: int, max_depth: int, tries: int, seed: int) -> DataFrame:
    """Each tree grown in one piece from the sums of its cells."""
    dim = len(cuts)

    def grown(key, t):
        tree = key[0].as_py()
        piece, n, mean, spread = (np.frombuffer(b"".join(t.column(c).to_pylist()), kind) for c, kind in (("piece", np.int64), ("n", float), ("mean", float), ("spread", float)))
        if not len(piece):  # all its weights are 0
            return pa.table({"tree": pa.array([], pa.int32()), "node": pa.array([], pa.int32())} | {c: pa.array([], pa.binary()) for c in ("feature", "split", "left", "value")})
        order = np.argsort(piece)
        draw = np.random.default_rng([seed, tree, 0]).integers(1 << 31)
        made = grow(bins_of(piece[order] >> _PIECE_BITS, cuts), mean[order], n[order], 0, max_depth, lambda first, m: _tried(seed + int(draw), tree, first + 1, m, dim, tries), spread[order])
        return pa.table({"tree": pa.array([tree], pa.int32()), "node": pa.array([0], pa.int32())} | {c: pa.array([x.tobytes()]) for c, x in zip(("feature", "split", "left", "value"), made, strict=True)})

    return sums.repartition(_tasks(sums.sparkSession, trees, 1), "tree").groupBy("tree").applyInArrow(grown, _NODES)


def _grow_tops(blocks: DataFrame, tops: list, weighted, k: int, max_depth: int, width: int, dim: int, tries: int, seed: int, local: int) -> None:
    """Split all nodes of more than ``local`` rows, a group of them each pass."""
    per_node = tries * width * (k or 3) * 8
    while True:
        todo = [(t, i) for t, top in enumerate(tops) for i in top.open(local)][:max(1, PASS_BYTES // per_node)]
        if not todo:
            return
        arrays = [top.arrays() for top in tops]
        may = {(t, i): np.flatnonzero(_tried(seed, t, i, 1, dim, tries)[0]) for t, i in todo}

        def histograms(batches, arrays=arrays, may=may):
            total = {}
            for b in batches:
                for tree, bins, y, w, at in weighted(b, arrays):
                    for i in [i for t, i in may if t == tree]:
                        rows = np.flatnonzero(at == i)
                        if not len(rows):
                            continue
                        for f in may[tree, i].tolist():
                            h = total.setdefault((tree, i, f), np.zeros((width, k or 3)))
                            x, v = bins[rows, f].astype(np.int64), w[rows]
                            if k:
                                h += np.bincount(x * k + y[rows].astype(np.int64), v, width * k).reshape(width, k)
                            else:
                                h += np.stack([np.bincount(x, v * y[rows] ** p, width) for p in range(3)], axis=1)
            for (t, i, f), h in total.items():
                yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([i], pa.int32()), pa.array([f], pa.int32()), pa.array([h.tobytes()])], ["tree", "node", "feature", "h"])

        def split(key, t):
            h = sum(np.frombuffer(x, np.float64) for x in t.column("h").to_pylist()).reshape(width, k or 3)
            filled = np.flatnonzero(_weight(h, k) > 0)
            _, gain, cell = best_splits(h[filled], np.zeros(len(filled), np.int64), k)
            sides = [h[filled[:cell[0] + 1]].sum(axis=0), h[filled[cell[0] + 1:]].sum(axis=0)]
            return pa.table({c: pa.array([key[j].as_py()], pa.int32()) for j, c in enumerate(("tree", "node", "feature"))} | {"gain": [float(gain[0])], "bin": pa.array([int(filled[cell[0]])], pa.int32()), "low": [sides[0]], "high": [sides[1]]})

        found = blocks.mapInArrow(histograms, "tree int, node int, feature int, h binary").groupBy("tree", "node", "feature").applyInArrow(split, "tree int, node int, feature int, gain double, bin int, low array<double>, high array<double>").collect()
        best = {}
        for r in sorted(found, key=lambda r: (-r["gain"], r["feature"])):
            best.setdefault((r["tree"], r["node"]), r)
        for t, i in todo:
            r, top = best[t, i], tops[t]
            sides = [np.array(r[c]) for c in ("low", "high")]
            if r["gain"] > 0 and top.depth[i] < max_depth:
                top.divide(i, r["feature"], r["bin"], sides, k)
            else:
                whole = sides[0] + sides[1]
                top.value[i] = whole if k else [whole[1] / whole[0]]

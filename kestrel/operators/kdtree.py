"""A k-d split tree over the points of a table, for exact neighbour searches.

The splits come from a bounded sample (medians of the widest side); every row
is then routed to its leaf, and the leaves' true boxes and counts are taken
over all rows. What is broadcast - splits, boxes, counts - is bounded by
``MAX_LEAVES`` and the dimension, not by the table. A leaf with more than
``BLOCK_ROWS`` rows is kept as several blocks.

Unlike a grid the tree has no neighbour offsets, so its cost does not grow
with ``3^d``; its searches walk node boxes and stop where a box is too far (or,
for counting, wholly near).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS = 1 << 17
MAX_LEAVES = 1 << 16
LEAF_ROWS = 64
BLOCK_ROWS = 512
QUERY_ROWS = 256


class KdTree:
    """Splits as arrays; node 0 is the root. ``left[i] < 0`` marks a leaf, whose
    number is ``first[i]``; the leaves below any node are ``first[i]:last[i]``."""

    def __init__(self, sample: np.ndarray, n_leaves: int):
        self.dim, self.cut, self.left, self.right, self.parent = [], [], [], [], []
        self.first, self.last, self.leaf_node = [], [], []
        self._split(sample, -1, max(1, len(sample) // max(1, min(n_leaves, MAX_LEAVES))))
        for name in ("dim", "cut", "left", "right", "parent", "first", "last", "leaf_node"):
            setattr(self, name, np.array(getattr(self, name)))

    @property
    def n_leaves(self) -> int:
        return len(self.leaf_node)

    def _split(self, rows: np.ndarray, parent: int, leaf_rows: int) -> int:
        node = len(self.dim)
        for name, value in (("dim", 0), ("cut", 0.0), ("left", -1), ("right", -1), ("parent", parent), ("first", len(self.leaf_node)), ("last", 0)):
            getattr(self, name).append(value)
        side = np.ptp(rows, axis=0) if len(rows) else np.zeros(1)
        if len(rows) > leaf_rows and side.max() > 0:
            d = int(side.argmax())
            v = rows[:, d]
            cut = np.median(v)
            if not (v > cut).any():  # ties up to the largest value
                cut = v[v < cut].max()
            self.dim[node], self.cut[node] = d, float(cut)
            self.left[node] = self._split(rows[v <= cut], node, leaf_rows)
            self.right[node] = self._split(rows[v > cut], node, leaf_rows)
        else:
            self.leaf_node.append(node)
        self.last[node] = len(self.leaf_node)
        return node

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        inner = np.flatnonzero(self.left[node] >= 0)
        while len(inner):
            at = node[inner]
            up = x[inner, self.dim[at]] > self.cut[at]
            node[inner] = np.where(up, self.right[at], self.left[at])
            inner = inner[self.left[node[inner]] >= 0]
        return self.first[node]

    def with_boxes(self, low: np.ndarray, high: np.ndarray, count: np.ndarray) -> KdTree:
        """Boxes and counts of all leaves; inner nodes get theirs from below."""
        n, d = len(self.dim), low.shape[1]
        self.low, self.high, self.count = np.full((n, d), np.inf), np.full((n, d), -np.inf), np.zeros(n, np.int64)
        self.low[self.leaf_node], self.high[self.leaf_node], self.count[self.leaf_node] = low, high, count
        for i in range(n - 1, 0, -1):  # children have larger numbers
            p = self.parent[i]
            self.low[p], self.high[p] = np.minimum(self.low[p], self.low[i]), np.maximum(self.high[p], self.high[i])
            self.count[p] += self.count[i]
        return self

    def nearest(self, low: np.ndarray, high: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Squared distance of boxes to node boxes, at the nearest points."""
        gap = np.maximum(np.maximum(self.low[node] - high, low - self.high[node]), 0)
        return (gap**2).sum(axis=1)

    def farthest(self, low: np.ndarray, high: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Squared distance of boxes to node boxes, at the farthest points."""
        reach = np.maximum(self.high[node] - low, high - self.low[node])
        return (reach**2).sum(axis=1)

    def at_least(self, leaf: np.ndarray, k: int) -> np.ndarray:
        """For each leaf the lowest node above it (or it) with ``k`` rows."""
        node = self.leaf_node[leaf]
        short = np.flatnonzero((self.count[node] < k) & (self.parent[node] >= 0))
        while len(short):
            node[short] = self.parent[node[short]]
            short = short[(self.count[node[short]] < k) & (self.parent[node[short]] >= 0)]
        return node

    def within(self, low: np.ndarray, high: np.ndarray, radius2: np.ndarray, inside: bool = False):
        """Walk down from the root for each box: ``(box, leaf)`` of the leaves
        within its squared radius. With ``inside``, a node whose farthest point
        is within the radius is not entered: ``(box, leaf, box, node)``."""
        box, node = np.arange(len(low)), np.zeros(len(low), np.int64)
        leaves, wholes = [], []
        while len(box):
            keep = (self.count[node] > 0) & (self.nearest(low[box], high[box], node) <= radius2[box])
            box, node = box[keep], node[keep]
            if inside:
                whole = self.farthest(low[box], high[box], node) <= radius2[box]
                wholes.append((box[whole], node[whole]))
                box, node = box[~whole], node[~whole]
            end = self.left[node] < 0
            leaves.append((box[end], self.first[node[end]]))
            box, node = box[~end], node[~end]
            box, node = np.concatenate([box, box]), np.concatenate([self.left[node], self.right[node]])
        flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for pairs in (leaves, wholes) for x in (zip(*pairs, strict=True) if pairs else ((), ()))]
        return tuple(flat) if inside else tuple(flat[:2])


def as_matrix(column, d: int) -> np.ndarray:
    """An Arrow list column of ``d`` numbers each as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


class SpatialIndex:
    """``rows`` (columns ``x`` and others) routed to the leaves of a tree.

    ``rows`` gains ``leaf``; ``blocks`` has ``leaf, block, items, xs``: the
    other columns as an array of structs and the coordinates side by side.
    """

    def __init__(self, rows: DataFrame, leaf_rows: int = LEAF_ROWS, sample_rows: int = SAMPLE_ROWS, block_rows: int = BLOCK_ROWS):
        spark = rows.sparkSession
        rows = rows.checkpoint()
        first = rows.select(F.size("x")).first()
        self.n, self.d = rows.count(), first[0] if first else 1
        every = max(1, self.n // sample_rows)
        picked = rows.where(F.pmod(F.xxhash64("x"), F.lit(every)) == 0) if every > 1 else rows
        sample = np.array([r["x"] for r in picked.orderBy(F.xxhash64("x")).limit(2 * sample_rows).select("x").collect()], float).reshape(-1, self.d)
        tree = KdTree(sample, -(-self.n // leaf_rows))
        shared, d = spark.sparkContext.broadcast(tree), self.d
        others = [c for c in rows.columns if c != "x"]
        kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select("x", *others).schema)

        def route(batches):
            for b in batches:
                leaf = shared.value.leaf_of(as_matrix(b.column(0), d)) if b.num_rows else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf.astype(np.int32))], [*b.schema.names, "leaf"])

        def boxes(batches):
            low: dict[int, np.ndarray] = {}
            for b in batches:
                x, leaf = as_matrix(b.column(0), d), b.column(1).to_numpy()
                order = np.argsort(leaf, kind="stable")
                kinds, at = np.unique(leaf[order], return_index=True)
                if not len(kinds):
                    continue
                new = np.stack([np.minimum.reduceat(x[order], at), np.maximum.reduceat(x[order], at)], axis=1)
                sizes = np.diff(np.append(at, len(order)))
                for i, k in enumerate(kinds.tolist()):
                    old = low.get(k)
                    low[k] = (new[i, 0], new[i, 1], sizes[i]) if old is None else (np.minimum(old[0], new[i, 0]), np.maximum(old[1], new[i, 1]), old[2] + sizes[i])
            if low:
                ks = np.repeat(np.array(list(low), np.int32), d)
                a, z = (np.concatenate([v[i] for v in low.values()]) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(ks), pa.array(np.tile(np.arange(d, dtype=np.int32), len(low))), pa.array(a), pa.array(z), pa.array(np.repeat([v[2] for v in low.values()], d))], ["leaf", "i", "low", "high", "n"])

        self.rows = rows.select("x", *others).mapInArrow(route, f"{kept}, leaf int").checkpoint()
        found = (self.rows.select("x", "leaf").mapInArrow(boxes, "leaf int, i int, low double, high double, n long")
                 .groupBy("leaf", "i").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).toPandas())
        low, high, count = np.full((tree.n_leaves, d), np.inf), np.full((tree.n_leaves, d), -np.inf), np.zeros(tree.n_leaves, np.int64)
        at = found["leaf"].to_numpy(np.int64), found["i"].to_numpy(np.int64)
        low[at], high[at], count[at[0]] = found["low"], found["high"], found["n"]
        self.tree = tree.with_boxes(low, high, count)
        self.block_rows = block_rows
        self.n_blocks = np.maximum(1, -(-count // block_rows))
        self.shared = spark.sparkContext.broadcast((self.tree, self.n_blocks))
        self.others = others

    def blocks(self, rows: DataFrame | None = None) -> DataFrame:
        """``leaf, block, items, xs`` of the index's rows or of some of them."""
        rows = self.rows if rows is None else rows
        spark = rows.sparkSession
        # at most MAX_LEAVES rows
        sizes = spark.createDataFrame([(int(i), int(n)) for i, n in enumerate(self.n_blocks) if n > 1], "leaf int, of_blocks int")
        block = F.coalesce(F.pmod(F.xxhash64(*self.others, "x"), F.col("of_blocks")), F.lit(0)).cast("int")
        dealt = rows.join(F.broadcast(sizes), "leaf", "left").withColumn("block", block)
        packed = dealt.groupBy("leaf", "block").agg(F.collect_list(F.struct(*self.others, "x")).alias("rows"))
        items = F.transform("rows", lambda r: F.struct(*[r[c].alias(c) for c in self.others]))
        return packed.select("leaf", "block", items.alias("items"), F.flatten(F.col("rows")["x"]).alias("xs"))


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``a`` to all rows of ``b``, summed side by side."""
    out = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        out += (a[:, j, None] - b[None, :, j]) ** 2
    return out


def query_blocks(queries: DataFrame, visits, shared, columns: list[str], d: int) -> DataFrame:
    """Rows of ``queries`` (``x`` and ``columns``) packed for the blocks they
    visit: ``q_leaf, q_block, q_items, q_xs``. ``visits(tree, x, batch)`` gives
    ``(row, leaf)`` pairs."""
    kinds = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in queries.select(*columns).schema)

    def run(batches):
        tree, n_blocks = shared.value
        for whole in batches:
            for s in range(0, whole.num_rows, QUERY_ROWS):
                b = whole.slice(s, QUERY_ROWS)
                x = as_matrix(b.column(0), d)
                row, leaf = visits(tree, x, b)
                if not len(row):
                    continue
                order = np.argsort(leaf, kind="stable")
                row, leaf = row[order], leaf[order]
                start = np.flatnonzero(np.r_[True, np.diff(leaf) != 0])
                size = np.diff(np.append(start, len(leaf)))
                times = n_blocks[leaf[start]]  # a leaf's queries go to each of its blocks
                group = np.repeat(np.arange(len(start)), times)
                block = np.arange(len(group)) - np.repeat(np.cumsum(times) - times, times)
                take = np.concatenate([row[a:a + n] for a, n in zip(start[group], size[group], strict=True)])
                ends = np.r_[0, np.cumsum(size[group])]
                items = pa.StructArray.from_arrays([c.take(pa.array(take)) for c in b.columns[1:]], b.schema.names[1:])
                xs = pa.ListArray.from_arrays(pa.array((ends * d).astype(np.int32)), pa.array(x[take].ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(leaf[start][group].astype(np.int32)), pa.array(block.astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), items), xs], ["q_leaf", "q_block", "q_items", "q_xs"])

    return queries.select("x", *columns).mapInArrow(run, f"q_leaf int, q_block int, q_items array<struct<{kinds}>>, q_xs array<double>")


def met(blocks: DataFrame, asked: DataFrame) -> DataFrame:
    """Blocks of rows beside the packed queries that visit them."""
    return blocks.join(asked, (blocks["leaf"] == asked["q_leaf"]) & (blocks["block"] == asked["q_block"]))

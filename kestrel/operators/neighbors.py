"""Neighbourhood operators without all-pairs joins (C2, K3), exact, over a
k-d tree index (``kdtree``).

* k-NN (C2): a query first visits its home leaf (or the lowest node with k
  rows), which bounds its k-th distance; then the leaves whose box is within
  that bound. Of equal points only the k smallest ids can be among the
  nearest, so larger groups of copies are cut to these in front of the shuffle.
* DBSCAN (K3): counts and links, never a table of neighbour pairs. A leaf
  takes the rows of a tree node that lies wholly within eps at once, so dense
  leaves are core unseen, and the others are compared with the leaves at the
  edge of their eps ball only, until ``min_samples`` is reached. Core points
  of one leaf and one cell of side eps/sqrt(d) are a unit (all neighbours of
  each other); units and nodes wholly within eps are joined through the nodes,
  and only leaves that lie in different components then are compared, for one
  witness link a pair of units.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, ship_package
from .graph import components
from .kdtree import LEAF_ROWS, SpatialIndex, met, query_blocks, squared

NO_BOUND = float("inf")


def _points(df: DataFrame, features: str, **names) -> DataFrame:
    """``x`` and other columns under fixed names."""
    kind = df.schema[features].dataType.typeName()
    x = F.col(features) if kind == "array" else vector_to_array(features)
    return df.select(x.cast("array<double>").alias("x"), *(F.col(c).alias(n) for n, c in names.items()))


# --- k nearest neighbours ---------------------------------------------------

def _nearest(k: int, d: int):
    """The ``k`` nearest rows of a block for each query of a query block."""

    def run(batches):
        for b in batches:
            out = []
            for i in range(b.num_rows):
                items, q_items = b.column(0)[i].values, b.column(2)[i].values
                x, q = (b.column(j)[i].values.to_numpy().reshape(-1, d) for j in (1, 3))
                dist = np.sqrt(squared(q, x))
                m = min(k, len(x))
                edge = np.partition(dist, m - 1, axis=1)[:, m - 1:m]  # all ties at the edge stay
                at_q, at_x = np.nonzero(dist <= edge)
                out.append((q_items.field("qid").take(pa.array(at_q)), items.field("tid").take(pa.array(at_x)), items.field("tlabel").take(pa.array(at_x)), pa.array(dist[at_q, at_x])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*out, strict=True)], ["qid", "tid", "tlabel", "dist"])

    return run


def _first(cand: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("qid").orderBy("dist", "tid")
    return cand.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k)


def knn_search(train: DataFrame, test: DataFrame, k: int = 5, features: str = "features", label: str = "label",
               tid: str = "tid", qid: str = "qid", leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """Exact k nearest neighbours (Euclidean; ties by train id):
    ``qid, tid, tlabel, dist, nth``."""
    ensure_checkpoint_dir(train.sparkSession)
    ship_package(train.sparkSession)
    rows = _points(train, features, tid=tid, tlabel=label)
    copies = Window.partitionBy("x").orderBy("tid")
    rows = rows.withColumn("nth", F.row_number().over(copies)).where(F.col("nth") <= k).drop("nth")
    index = SpatialIndex(rows, leaf_rows)
    queries = _points(test, features, qid=qid).checkpoint()
    kinds = {f.name: f.dataType.simpleString() for f in [*rows.schema, *queries.schema]}
    found = f"qid {kinds['qid']}, tid {kinds['tid']}, tlabel {kinds['tlabel']}, dist double"
    blocks = index.blocks().checkpoint()

    def search(asked: DataFrame) -> DataFrame:
        both = met(blocks, asked).select("items", "xs", "q_items", "q_xs")
        return _first(both.mapInArrow(_nearest(k, index.d), found), k)

    def home(tree, x, _):
        node = tree.at_least(tree.leaf_of(x), k)
        n = tree.last[node] - tree.first[node]
        row = np.repeat(np.arange(len(x)), n)
        return row, np.repeat(tree.first[node] - np.cumsum(n) + n, n) + np.arange(n.sum())

    near = search(query_blocks(queries, home, index.shared, ["qid"], index.d))
    bounds = near.where(F.col("nth") == k).select(F.col("qid").alias("of"), F.col("dist").alias("bound")).checkpoint()
    bounded = queries.join(bounds, F.col("qid") == F.col("of"), "left").select("x", "qid", F.coalesce("bound", F.lit(NO_BOUND)).alias("bound"))

    def ball(tree, x, batch):
        r = batch.column(2).to_numpy()
        return tree.within(x, x, r * r * (1 + 1e-12))

    return search(query_blocks(bounded, ball, index.shared, ["qid", "bound"], index.d))


def knn_predict(train: DataFrame, test: DataFrame, k: int = 5, features: str = "features", label: str = "label",
                tid: str = "tid", qid: str = "qid") -> DataFrame:
    """Majority vote of the k nearest (ties → smallest label): ``(qid, prediction)``."""
    nn = knn_search(train, test, k, features, label, tid, qid)
    votes = nn.groupBy("qid", "tlabel").agg(F.count(F.lit(1)).alias("cnt"))
    pred = votes.groupBy("qid").agg(F.max_by("tlabel", F.struct("cnt", -F.col("tlabel"))).alias("prediction"))
    return pred.withColumnRenamed("qid", qid)


# --- DBSCAN -----------------------------------------------------------------

def _radius2(eps: float) -> float:
    """Boxes are compared with a margin for rounding; points are compared as
    ``sqrt(squared distance) <= eps``."""
    return eps * eps


def _leaf_visits(index: SpatialIndex, eps: float):
    """``leaf, sure, other``: for each leaf with rows the number of rows in nodes
    wholly within ``eps`` of all its points, and the leaves still to compare."""
    shared, r2 = index.shared, _radius2(eps)

    def run(batches):
        tree, _ = shared.value
        for b in batches:
            leaf = b.column(0).to_numpy()
            leaf = leaf[tree.count[tree.leaf_node[leaf]] > 0]
            if not len(leaf):
                continue
            node = tree.leaf_node[leaf]
            box, other, whole_box, whole = tree.within(tree.low[node], tree.high[node], np.full(len(leaf), r2 * (1 + 1e-9)), inside=True)
            # a node at the margin is compared and not taken whole
            exact = tree.farthest(tree.low[node][whole_box], tree.high[node][whole_box], whole) <= r2 * (1 - 1e-9)
            sure = np.bincount(whole_box[exact], tree.count[whole[exact]], len(leaf)).astype(np.int64)
            edge = whole_box[~exact], whole[~exact]
            n = tree.last[edge[1]] - tree.first[edge[1]]
            more = np.repeat(tree.first[edge[1]] - np.cumsum(n) + n, n) + np.arange(n.sum())
            box, other = np.concatenate([box, np.repeat(edge[0], n)]), np.concatenate([other, more])
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(box, minlength=len(leaf)))].astype(np.int32)), pa.array(other[np.argsort(box, kind="stable")].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(leaf.astype(np.int32)), pa.array(sure), lists], ["leaf", "sure", "others"])

    spark = index.rows.sparkSession
    return spark.range(index.tree.n_leaves).select(F.col("id").cast("int").alias("leaf")).mapInArrow(run, "leaf int, sure long, others array<int>")


def neighbor_counts(index: SpatialIndex, eps: float, stop: int | None = None) -> DataFrame:
    """``pid, leaf, n``: the rows within ``eps`` of each row, itself included.
    With ``stop``, leaves that surely have as many are not compared, and their
    rows carry the count that is sure."""
    visits = _leaf_visits(index, eps).checkpoint()
    rows = index.rows.select("pid", "leaf")
    open_ = visits if stop is None else visits.where(F.col("sure") < stop)
    pairs = open_.select("leaf", F.explode("others").alias("other"))
    blocks = index.blocks().checkpoint()
    mine = blocks.join(pairs, "leaf").select(F.col("items").alias("q_items"), F.col("xs").alias("q_xs"), "other")
    both = mine.join(blocks.select(F.col("leaf").alias("other"), "xs"), "other").select("q_items", "q_xs", "xs")
    d = index.d
    kind = index.rows.schema["pid"].dataType.simpleString()

    def near(batches):
        for b in batches:
            out = []
            for i in range(b.num_rows):
                q, x = (b.column(j)[i].values.to_numpy().reshape(-1, d) for j in (1, 2))
                n = (np.sqrt(squared(q, x)) <= eps).sum(axis=1)
                hit = np.flatnonzero(n)
                out.append((b.column(0)[i].values.field("pid").take(pa.array(hit)), pa.array(n[hit])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*out, strict=True)], ["of", "k"])

    counted = both.mapInArrow(near, f"of {kind}, k long").groupBy("of").agg(F.sum("k").alias("k"))
    whole = rows.join(visits.select("leaf", "sure"), "leaf").join(counted, F.col("pid") == F.col("of"), "left")
    return whole.select("pid", "leaf", (F.col("sure") + F.coalesce("k", F.lit(0))).alias("n"))


def _unit(eps: float, d: int):
    """Leaf and grid cell: points of one unit are within ``eps`` of each other."""
    side = eps / math.sqrt(d) * (1 - 1e-9)
    cell = F.transform("x", lambda v: F.floor(v / F.lit(side)).cast("long"))
    return F.concat(F.lit("u"), F.concat_ws(",", F.col("leaf").cast("string"), F.array_join(F.transform(cell, lambda v: v.cast("string")), ",")))


def _hub_links(index: SpatialIndex, core_leaves: np.ndarray, eps: float) -> DataFrame:
    """``a, b`` links between leaves ``l…`` and nodes ``n…`` wholly within
    ``eps`` of them: all core points of the leaf and of the node's leaves are
    neighbours. Leaves without core points are left out."""
    tree, spark = index.tree, index.rows.sparkSession
    shared, r2 = index.shared, _radius2(eps) * (1 - 1e-9)
    has_core = spark.sparkContext.broadcast(core_leaves)

    def run(batches):
        tree, _ = shared.value
        below = np.concatenate([[0], np.cumsum(has_core.value)])
        for b in batches:
            leaf = b.column(0).to_numpy()
            leaf = leaf[has_core.value[leaf]]
            if not len(leaf):
                continue
            node = tree.leaf_node[leaf]
            _, _, box, whole = tree.within(tree.low[node], tree.high[node], np.full(len(leaf), r2), inside=True)
            some = below[tree.last[whole]] > below[tree.first[whole]]
            yield pa.RecordBatch.from_arrays([pa.array(leaf[box[some]]), pa.array(whole[some])], ["leaf", "node"])

    seen = spark.range(tree.n_leaves).mapInArrow(run, "leaf long, node long").checkpoint()
    name = lambda c, k: F.concat(F.lit(k), F.col(c).cast("string"))
    hubs = seen.select("node").distinct()

    def leaves_below(batches):
        tree, _ = shared.value
        for b in batches:
            node = b.column(0).to_numpy()
            n = tree.last[node] - tree.first[node]
            leaf = np.repeat(tree.first[node] - np.cumsum(n) + n, n) + np.arange(n.sum())
            keep = has_core.value[leaf]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(node, n)[keep]), pa.array(leaf[keep].astype(np.int64))], ["node", "leaf"])

    down = hubs.mapInArrow(leaves_below, "node long, leaf long")
    return seen.unionByName(down).select(name("leaf", "l").alias("a"), name("node", "n").alias("b")).distinct()


def _witnesses(index: SpatialIndex, core: DataFrame, known: DataFrame, eps: float) -> DataFrame:
    """``a, b``: units of different components that hold core points within
    ``eps`` of each other. Only pairs of leaves whose core points are not all
    of one component are compared. ``known`` has ``unit, leaf, comp``."""
    d = index.d
    spread = known.groupBy("leaf").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    visits = _leaf_visits(index, eps).select("leaf", F.explode("others").alias("other")).where("leaf <= other")
    other = spread.select(F.col("leaf").alias("other"), F.col("lo").alias("o_lo"), F.col("hi").alias("o_hi"))
    open_ = visits.join(spread, "leaf").join(other, "other").where("lo != hi OR o_lo != o_hi OR lo != o_lo").select("leaf", "other")
    rows = core.join(known.select("unit", "comp"), "unit").select("unit", "comp", "x", "leaf")
    packed = index_blocks(index, rows, ["unit", "comp"]).checkpoint()
    mine = packed.join(open_, "leaf").select(F.col("items").alias("q_items"), F.col("xs").alias("q_xs"), "other")
    both = mine.join(packed.select(F.col("leaf").alias("other"), "items", "xs"), "other").select("items", "xs", "q_items", "q_xs")

    def near(batches):
        for b in batches:
            out: set[tuple[str, str]] = set()
            for i in range(b.num_rows):
                x, q = (b.column(j)[i].values.to_numpy().reshape(-1, d) for j in (1, 3))
                (u, c), (qu, qc) = ([b.column(j)[i].values.field(f).to_numpy(zero_copy_only=False) for f in ("unit", "comp")] for j in (0, 2))
                hit = (np.sqrt(squared(q, x)) <= eps) & (qc[:, None] != c[None])
                at_q, at_x = np.nonzero(hit)
                out.update(zip(qu[at_q].tolist(), u[at_x].tolist(), strict=True))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out, strict=True)], ["a", "b"])

    return both.mapInArrow(near, "a string, b string").distinct()


def index_blocks(index: SpatialIndex, rows: DataFrame, columns: list[str]) -> DataFrame:
    """Some rows of an index (``leaf, x`` and ``columns``) packed in blocks."""
    block = F.pmod(F.xxhash64("x", *columns), F.greatest(F.lit(1), F.ceil(F.col("n_rows") / F.lit(index.block_rows)))).cast("int")
    sizes = rows.groupBy("leaf").agg(F.count("*").alias("n_rows"))
    packed = rows.join(sizes, "leaf").withColumn("block", block).groupBy("leaf", "block").agg(F.collect_list(F.struct(*columns, "x")).alias("rows"))
    items = F.transform("rows", lambda r: F.struct(*[r[c].alias(c) for c in columns]))
    return packed.select("leaf", "block", items.alias("items"), F.flatten(F.col("rows")["x"]).alias("xs"))


def _core_clusters(index: SpatialIndex, core: DataFrame, eps: float, max_iter: int) -> DataFrame:
    """``pid, comp`` of the core points (``pid, leaf, x, unit``)."""
    units = core.select("unit", "leaf").distinct().checkpoint()
    # one flag for each leaf, at most MAX_LEAVES
    flags = np.zeros(index.tree.n_leaves, bool)
    flags[[r["leaf"] for r in units.select("leaf").distinct().collect()]] = True
    hubs = _hub_links(index, flags, eps)
    # a leaf that is linked through a hub is wholly within eps of it, so its units are one
    in_hub = hubs.select(F.col("a").alias("leaf_name")).distinct()
    named = units.select("unit", F.concat(F.lit("l"), F.col("leaf").cast("string")).alias("leaf_name"))
    unit_hubs = named.join(in_hub, "leaf_name").select(F.col("unit").alias("a"), F.col("leaf_name").alias("b"))
    known = components(hubs.unionByName(unit_hubs), max_iter)
    first = units.join(known, units["unit"] == known["node"], "left").select("unit", "leaf", F.coalesce("comp", "unit").alias("comp")).checkpoint()
    links = _witnesses(index, core, first, eps).checkpoint()
    comp_of = lambda c: first.select(F.col("unit").alias(c), F.col("comp").alias(f"{c}_comp"))
    between = links.join(comp_of("a"), "a").join(comp_of("b"), "b").select(F.col("a_comp").alias("a"), F.col("b_comp").alias("b"))
    merged = components(between, max_iter).select(F.col("node").alias("comp"), F.col("comp").alias("root"))
    final = first.join(merged, "comp", "left").select("unit", F.coalesce("root", "comp").alias("comp"))
    return core.select("pid", "unit", "leaf", "x").join(final, "unit")


def dbscan(points: DataFrame, key: str, eps: float = 0.5, min_samples: int = 5, features: str = "features",
           max_iter: int = 100, whole_counts: bool = True, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """Exact DBSCAN (self counted, distance <= eps): ``(key, cluster, is_core,
    n_neighbors)``. Without ``whole_counts`` counting ends where a row is known
    to be core, and ``n_neighbors`` is left out.

    Noise is -1; clusters are numbered by their smallest core key, and a border
    point joins the first cluster that has a core point within ``eps`` of it, as
    a scan in the order of keys would do."""
    index = _indexed(points, key, features, leaf_rows)
    counts = neighbor_counts(index, eps, None if whole_counts else min_samples)
    kept = ["n_neighbors"] if whole_counts else []
    deg = counts.select("pid", (F.col("n") >= F.lit(min_samples)).alias("is_core"), F.col("n").alias("n_neighbors")).select("pid", "is_core", *kept).checkpoint()
    rows = index.rows.join(deg, "pid")
    core = rows.where("is_core").select("pid", "leaf", "x", _unit(eps, index.d).alias("unit")).checkpoint()
    if core.isEmpty():
        return deg.select(F.col("pid").alias(key), F.lit(-1).alias("cluster"), "is_core", *kept)
    clustered = _core_clusters(index, core, eps, max_iter).checkpoint()
    firsts = clustered.groupBy("comp").agg(F.min("pid").alias("first_pid"))
    numbered = clustered.join(firsts, "comp").checkpoint()
    border = _border(index, rows.where("NOT is_core").select("pid", "x", "leaf"), numbered, eps)
    labels = numbered.select("pid", "first_pid").unionByName(border)
    from .ordering import global_row_number
    numbers = global_row_number(firsts.select("first_pid"), ["first_pid"], "no").select("first_pid", (F.col("no") - 1).cast("int").alias("cluster"))
    out = deg.join(labels.join(numbers, "first_pid").select("pid", "cluster"), "pid", "left")
    return out.select(F.col("pid").alias(key), F.coalesce("cluster", F.lit(-1)).alias("cluster"), "is_core", *kept)


def _border(index: SpatialIndex, rest: DataFrame, numbered: DataFrame, eps: float) -> DataFrame:
    """``pid, first_pid``: for the points that are not core the cluster with
    the smallest first key among the core points within ``eps``."""
    d = index.d
    packed = index_blocks(index, numbered.select("leaf", "x", "first_pid"), ["first_pid"])
    kind = rest.schema["pid"].dataType.simpleString()
    cores = packed.select(F.col("leaf").alias("core_leaf"), "items", "xs")
    r2 = _radius2(eps) * (1 + 1e-9)

    def ball(tree, x, _):
        return tree.within(x, x, np.full(len(x), r2))

    asked = query_blocks(rest, ball, index.shared, ["pid"], d).where(F.col("q_block") == 0)
    both = asked.join(cores, F.col("q_leaf") == F.col("core_leaf")).select("items", "xs", "q_items", "q_xs")

    def near(batches):
        for b in batches:
            out = []
            for i in range(b.num_rows):
                x, q = (b.column(j)[i].values.to_numpy().reshape(-1, d) for j in (1, 3))
                at_q, at_x = np.nonzero(np.sqrt(squared(q, x)) <= eps)
                out.append((b.column(2)[i].values.field("pid").take(pa.array(at_q)), b.column(0)[i].values.field("first_pid").take(pa.array(at_x))))
            if out:
                t = pa.table([pa.concat_arrays(c) for c in zip(*out, strict=True)], ["pid", "first_pid"]).group_by("pid").aggregate([("first_pid", "min")])
                yield from t.rename_columns(["pid", "first_pid"]).to_batches()

    return both.mapInArrow(near, f"pid {kind}, first_pid {kind}").groupBy("pid").agg(F.min("first_pid").alias("first_pid"))


def _indexed(points: DataFrame, key: str, features: str, leaf_rows: int) -> SpatialIndex:
    ensure_checkpoint_dir(points.sparkSession)
    ship_package(points.sparkSession)
    return SpatialIndex(_points(points, features, pid=key), leaf_rows)


def eps_degrees(points: DataFrame, key: str, eps: float = 0.5, min_samples: int = 5, features: str = "features",
                leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """``(key, n_neighbors, is_core)`` with whole neighbour counts."""
    n = neighbor_counts(_indexed(points, key, features, leaf_rows), eps)
    return n.select(F.col("pid").alias(key), F.col("n").alias("n_neighbors"), (F.col("n") >= F.lit(min_samples)).alias("is_core"))


def dbscan_report(points: DataFrame, clusters: DataFrame, key: str, features: str = "features") -> DataFrame:
    """One row: ``n_clusters, n_noise, noise_share, silhouette``; the silhouette
    (squared distance) is over the clustered points, NULL below two clusters."""
    from .cluster import silhouette_squared
    counts = clusters.agg(F.countDistinct(F.when(F.col("cluster") >= 0, F.col("cluster"))).alias("n_clusters"), F.count_if(F.col("cluster") < 0).alias("n_noise"),
                          (F.count_if(F.col("cluster") < 0) / F.count(F.lit(1))).alias("noise_share"))
    placed = points.join(clusters.where("cluster >= 0").select(key, "cluster"), key)
    score = silhouette_squared(placed, features=features).first()["silhouette"]
    return counts.withColumn("silhouette", F.lit(score).cast("double"))

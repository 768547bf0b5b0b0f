"""Near-duplicate detection by min-max hashing (Ji et al., 2013).

Each permutation of a document's shingle set gives two signature values, the
minimum and the maximum, so a signature of ``2 p`` values costs ``p`` hash
evaluations a shingle. Both agree between two sets with a chance equal to
their Jaccard similarity. ``BANDS`` bands of ``ROWS`` values miss a pair of
similarity 0.75 with a chance of (1 - 0.75**ROWS)**BANDS, below 3e-7 here;
everything after the bands is exact.

Scale:

* Equal sets are one class before any candidate is looked for.
* Buckets that hold the same classes are one.
* The members of a bucket are compared with one centre, not with each other.
  Members whose bucket then falls into one component, and buckets of two, need
  nothing more; the others get one more round with another centre. The members
  of buckets that hold several components even then meet in a prefix join: with
  their shingles in one global order, rare ones first, two sets of similarity
  0.75 share a shingle of their short prefixes. Texts that share much, but less
  than that, differ in more shingles than a prefix has, so they seldom meet.
  Rows of one component never meet each other, a pair meets at its first
  shared shingle and seldom at another, and candidates are distinct pairs.
* Sizes and a 512-bit parity word of each set rule out most candidates before
  any text travels; the bound is exact, so no similar pair is lost.
* A candidate is confirmed on the full shingle sets. The node's text travels
  once to each of its centres; a popular centre's text is sent once for each
  cell of ``PER_CELL`` candidates, so a hot centre is many groups.
* Components come from joins and grouped minima (``components``).

Defined results: words are lower-cased (A-Z) runs without white space, a text
with fewer than five is its own only shingle; NULL and empty texts have no
shingles and are linked with nothing, each its own component; a component's
id is its smallest non-NULL doc_id; its kept row is the one of the smallest
(doc_id, hash of the text), NULL ids last, so rows that share an id or have none
are told apart; repeated rows are copies of each other and all carry their
class's component; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm import kernels as K
from kestrel.llm.components import components
from kestrel.llm.tables import discard, saved, texts, written

SHINGLE = 5
SIMILAR_PERCENT = 75
ROWS = 5
BANDS = 56
PER_CELL = 64
#: Buckets (as bits) that count shingles for the order of the prefix join; the
#: order only changes how many candidates there are.
COUNT_BITS = 18
#: Length of the bit words that rule out pairs before their texts travel.
BITS = 512
#: Shingles before a prefix's row that tell whether a pair has met already.
LAST = 8
#: Rounds with other centres before the prefix join.
MORE_STARS = 1

_SEEDS = np.random.default_rng(77).integers(1, 1 << 63, ROWS * BANDS // 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

_AGAIN = np.uint64(0x9E3779B97F4A7C15)


def min_max_signatures(sets: list[np.ndarray]) -> np.ndarray:
    """``(sets, 2 p)`` values: for each permutation the minimum, then the
    maximum. Sets must not be empty."""
    x = np.concatenate(sets)
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(_SEEDS) * 2, len(sets)), np.uint64)
    for p, seed in enumerate(_SEEDS):
        h = (x ^ (seed >> np.uint64(7))) * seed  # a bijection; one product alone leaves permutations correlated
        h ^= h >> np.uint64(32)
        h *= _AGAIN
        np.minimum.reduceat(h, at, out=out[2 * p])
        np.maximum.reduceat(h, at, out=out[2 * p + 1])
    return out.T


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """``(sets, BANDS)`` bucket keys."""
    v = K.mix(signatures).reshape(len(signatures), BANDS, ROWS)
    key = np.zeros(v.shape[:2], np.uint64)
    for r in range(ROWS):
        key = K.mix(key * np.uint64(31) + v[:, :, r])
    return K.mix(key + np.arange(1, BANDS + 1, dtype=np.uint64))


def set_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a whole set."""
    a = K.mix(s).sum(dtype=np.uint64) + np.uint64(len(s))
    b = K.mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))


def parity_bits(sets: list[np.ndarray]) -> np.ndarray:
    """``(sets, BITS / 64)`` words: whether an odd number of a set's shingles
    falls on a bit. Where two sets differ in d shingles, at most d bits differ."""
    at = np.repeat(np.arange(len(sets)), [len(x) for x in sets]) * BITS + (np.concatenate(sets) & np.uint64(BITS - 1)).astype(np.int64)
    odd = np.bincount(at, minlength=len(sets) * BITS).astype(np.uint8) & 1
    return np.packbits(odd.reshape(len(sets), BITS), axis=1).view(np.int64)


def _may_be_similar(n: str, bits: str, other_n: str, other_bits: str):
    """Sizes and bits allow a similarity of 0.75: of sets with s shingles together
    at most s / 7 may be in one only. No similar pair is lost."""
    sized = 100 * F.least(n, other_n) >= SIMILAR_PERCENT * F.greatest(n, other_n)
    apart = sum((F.bit_count(F.col(bits)[i].bitwiseXOR(F.col(other_bits)[i])) for i in range(BITS // 64)), F.lit(0))
    return sized & ((100 + SIMILAR_PERCENT) * apart <= (100 - SIMILAR_PERCENT) * (F.col(n) + F.col(other_n)))


def signature_rows(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, n, k1, k2, bands, bits`` of every row; ``bands`` and
    ``bits`` are NULL for an empty set."""

    def rows(batches):
        for b in batches:
            for lo, hi, data, off in K.text_slices(b.column(1)):
                sets = K.shingle_sets(data, off, SHINGLE)
                n = np.array([len(s) for s in sets], np.int64)
                keys = np.array([set_key(s) for s in sets], np.int64).reshape(-1, 2)
                full = np.flatnonzero(n)
                flat = K.signed(band_keys(min_max_signatures([sets[i] for i in full])).reshape(-1)) if len(full) else np.zeros(0, np.int64)
                ends = np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))]).astype(np.int32)
                bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat), mask=pa.array(n == 0))
                words = parity_bits([sets[i] for i in full]).ravel() if len(full) else np.zeros(0, np.int64)
                bits = pa.ListArray.from_arrays(pa.array((ends // BANDS * (BITS // 64)).astype(np.int32)), pa.array(words), mask=pa.array(n == 0))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(2).slice(lo, hi - lo), pa.array(n), pa.array(keys[:, 0]), pa.array(keys[:, 1]), bands, bits], ["doc_id", "text_hash", "n", "k1", "k2", "bands", "bits"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(rows, "doc_id long, text_hash long, n long, k1 long, k2 long, bands array<long>, bits array<long>")


def _verified(pairs: DataFrame, sources: DataFrame) -> DataFrame:
    """The ``node, centre`` pairs of ``pairs`` that are similar on their full
    sets. ``sources`` has ``node, text``."""
    cells = pairs.groupBy("centre").agg(F.ceil(F.count("*") / F.lit(PER_CELL)).alias("cells"))
    dealt = pairs.join(cells, "centre").select("node", "centre", F.pmod(F.xxhash64("node"), "cells").alias("cell"))
    members = dealt.join(sources, "node").select("centre", "cell", "node", "text")
    copies = dealt.select("centre", "cell").distinct()
    texts_of = sources.select(F.col("node").alias("centre"), F.col("text").alias("centre_text"))
    centres = copies.join(texts_of, "centre").select(F.col("centre").alias("of"), F.col("cell").alias("part"), "centre_text")

    def similar(key, left, right):
        nodes = left.column("node").combine_chunks()
        kept = []
        if left.num_rows and right.num_rows:
            (_, _, data, off), = K.text_slices(right.column("centre_text").slice(0, 1).combine_chunks())
            c = K.shingle_sets(data, off, SHINGLE)[0]
            for lo, _, data, off in K.text_slices(left.column("text").combine_chunks()):
                for i, s in enumerate(K.shingle_sets(data, off, SHINGLE)):
                    common = len(np.intersect1d(s, c, assume_unique=True))
                    if 100 * common >= SIMILAR_PERCENT * (len(s) + len(c) - common):
                        kept.append(lo + i)
        picked = nodes.take(pa.array(kept, pa.int64()))
        return pa.table({"u": picked, "v": pa.array([key[0].as_py()] * len(kept), pa.int64())})

    return members.groupBy("centre", "cell").cogroup(centres.groupBy("of", "part")).applyInArrow(similar, "u long, v long")


def _distinct_buckets(buckets: DataFrame) -> DataFrame:
    """``buckets`` with one of those that hold the same members, and none with
    one member only."""
    alike = buckets.groupBy("bucket").agg(F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("all"), F.count("*").alias("members")).where("members > 1")
    return buckets.join(alike.groupBy("all", "members").agg(F.min("bucket").alias("bucket")).select("bucket"), "bucket")


def _possible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The distinct ``node, centre`` pairs that sizes and bits do not rule out."""
    own = nodes.select("node", "n", "bits")
    other = nodes.select(F.col("node").alias("centre"), F.col("n").alias("cn"), F.col("bits").alias("cbits"))
    both = pairs.distinct().join(own, "node").join(other, "centre")
    return both.where(_may_be_similar("n", "bits", "cn", "cbits")).select("node", "centre")


def _star(met: DataFrame, nodes: DataFrame, sources: DataFrame) -> DataFrame:
    """The similar pairs of ``met`` (``node, centre``)."""
    return _verified(_possible(met, nodes), sources)


def _open_members(buckets: DataFrame, known: DataFrame) -> DataFrame:
    """``bucket, node, root, main`` of the buckets that hold several components;
    ``main`` has the most members of the bucket."""
    labelled = buckets.join(known, "node").select("bucket", "node", "root")
    by_root = labelled.groupBy("bucket", "root").agg(F.count("*").alias("k"))
    several = by_root.groupBy("bucket").agg(F.max_by("root", F.struct("k", "root")).alias("main"), F.count("*").alias("roots")).where("roots > 1").select("bucket", "main")
    return labelled.join(several, "bucket")


def shingle_counts(sets: DataFrame, bits: int = COUNT_BITS) -> np.ndarray:
    """How many sets of ``node, text`` hold a shingle of each of ``2**bits``
    buckets of hashes: a table of fixed size, whatever the corpus."""

    def counts(batches):
        total = np.zeros(1 << bits, np.int64)
        for b in batches:
            for _, _, data, off in K.text_slices(b.column(0)):
                for x in K.shingle_sets(data, off, SHINGLE):
                    np.add.at(total, _bucket(x, bits), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

    found = sets.select("text").mapInArrow(counts, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(1 << bits, np.int64)
    out[found["at"].to_numpy()] = found["n"].to_numpy()
    return out


def _bucket(shingles: np.ndarray, bits: int) -> np.ndarray:
    return (shingles >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(shingles), np.int64)


def rare_first(s: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A sorted set in the global order: by the count of a shingle's bucket,
    then by hash."""
    return s[np.argsort(counts[_bucket(s, len(counts).bit_length() - 1)], kind="stable")]


def prefix_rows(sets: DataFrame, counts) -> DataFrame:
    """``shingle, node, root, n, at, indexed, bits, last``: the prefix of each set in
    the global order, with the up to ``LAST`` shingles before each. Two sets of similarity 0.75 share a shingle that is in the
    longer prefix (n - ceil(0.75 n) + 1) of the larger and in the shorter one
    (n - ceil(1.5 n / 1.75) + 1, ``indexed``) of the smaller."""

    def run(batches):
        for b in batches:
            nodes, roots = b.column(0).to_numpy(), b.column(1).to_numpy()
            for lo, hi, data, off in K.text_slices(b.column(2)):
                sets = K.shingle_sets(data, off, SHINGLE)
                n = np.array([len(x) for x in sets], np.int64)
                long = np.where(n > 0, n + (-SIMILAR_PERCENT * n) // 100 + 1, 0)
                short = n + (-2 * SIMILAR_PERCENT * n) // (100 + SIMILAR_PERCENT) + 1
                first = [rare_first(x, counts.value)[:k] for x, k in zip(sets, long.tolist(), strict=True)]
                at = np.concatenate([np.arange(k) for k in long]) if len(long) else long
                whose = np.repeat(np.arange(hi - lo), long)
                words = parity_bits(sets)[whose]
                bits = pa.ListArray.from_arrays(pa.array(np.arange(0, words.size + 1, BITS // 64, dtype=np.int32)), pa.array(words.ravel()))
                shingles = K.signed(np.concatenate(first))
                before = np.minimum(at, LAST)
                ends = np.concatenate([[0], np.cumsum(before)])
                last = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(shingles[np.arange(ends[-1]) + np.repeat(np.arange(len(at)) - before - ends[:-1], before)]))
                yield pa.RecordBatch.from_arrays([pa.array(shingles), pa.array(nodes[lo:hi][whose]), pa.array(roots[lo:hi][whose]), pa.array(n[whose]), pa.array(at.astype(np.int32)), pa.array(at < short[whose]), bits, last], ["shingle", "node", "root", "n", "at", "indexed", "bits", "last"])

    return sets.select("node", "root", "text").mapInArrow(run, "shingle long, node long, root long, n long, at int, indexed boolean, bits array<long>, last array<long>")


def _prefix_meetings(rows: DataFrame) -> DataFrame:
    """``node, centre`` pairs of different roots that may be similar, seldom one
    more than once. Of the rows of a shingle, those outside its most frequent root meet all. A
    pair that shares one of the last shingles before has met there already: the
    conditions of a similar pair hold at every shingle of both prefixes, so it
    meets at the first one, and is not made once more for each of the others."""
    by_root = rows.groupBy("shingle", "root").agg(F.count("*").alias("k"))
    main = by_root.groupBy("shingle").agg(F.max_by("root", F.struct("k", "root")).alias("main"), F.count("*").alias("roots")).where("roots > 1").select("shingle", "main")
    open_ = rows.join(main, "shingle")
    mine = open_.where("root != main").select("shingle", *(F.col(c).alias(f"m_{c}") for c in ("node", "root", "n", "at", "indexed", "bits", "last")))
    both = mine.join(open_, "shingle").where(F.col("root") != F.col("m_root"))
    larger = (F.col("n") > F.col("m_n")) | ((F.col("n") == F.col("m_n")) & (F.col("node") > F.col("m_node")))
    # the shingles behind this one bound what else the two can share
    most = 1 + F.least(F.col("n") - F.col("at"), F.col("m_n") - F.col("m_at")) + F.least("at", "m_at") - 1
    enough = (100 + SIMILAR_PERCENT) * most >= SIMILAR_PERCENT * (F.col("n") + F.col("m_n"))
    indexed = F.when(larger, F.col("m_indexed")).otherwise(F.col("indexed"))
    return both.where(enough & indexed & _may_be_similar("n", "bits", "m_n", "m_bits") & ~F.arrays_overlap("last", "m_last")).select(F.least("node", "m_node").alias("node"), F.greatest("node", "m_node").alias("centre"))


def _prefix_pairs(rows: DataFrame) -> DataFrame:
    """The distinct pairs of ``_prefix_meetings``."""
    return _prefix_meetings(rows).distinct()


def _cross_links(open_nodes: DataFrame, sources: DataFrame) -> DataFrame:
    """Links between different roots among ``open_nodes`` (``node, root``), by
    a prefix join that loses none; ids travel first, texts for candidates only."""
    sets = written(open_nodes.join(sources, "node"))
    counts = sets.sparkSession.sparkContext.broadcast(shingle_counts(sets))
    rows = written(prefix_rows(sets, counts))
    pairs = written(_prefix_pairs(rows))
    discard(rows)
    links = written(_verified(pairs, sources))
    discard(sets, pairs)
    return links


def _merged(known: DataFrame, links: DataFrame) -> DataFrame:
    """``known`` (``node, root``) with the roots that ``links`` join as one."""
    root_of = lambda end: known.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root"))
    between = links.join(root_of("u"), "u").join(root_of("v"), "v").select(F.col("u_root").alias("u"), F.col("v_root").alias("v"))
    new = components(between).select(F.col("node").alias("old"), F.col("root").alias("new"))
    after = written(known.join(new, F.col("root") == F.col("old"), "left").select("node", F.coalesce("new", "root").alias("root")))
    discard(known, links)
    return after


def _roots(buckets: DataFrame, nodes: DataFrame, sources: DataFrame) -> DataFrame:
    """``node, root`` of all nodes from the buckets with two members at least."""
    centres = buckets.groupBy("bucket").agg(F.min("node").alias("centre"))
    links = written(_star(buckets.join(centres, "bucket").where("node != centre").select("node", "centre"), nodes, sources))
    known = _merged(written(nodes.select("node", F.col("node").alias("root"))), links)
    for turn in range(MORE_STARS):
        open_ = written(_open_members(buckets, known))
        if open_.isEmpty():
            discard(open_)
            return known
        outside = open_.where("root != main").select("bucket", "node", "root")
        centres = outside.groupBy("bucket").agg(F.min_by(F.struct("node", "root"), F.xxhash64("node", F.lit(turn))).alias("c")).select("bucket", F.col("c.node").alias("centre"), F.col("c.root").alias("centre_root"))
        met = open_.join(centres, "bucket").where("root != centre_root").select("node", "centre")
        links = written(_star(met, nodes, sources))
        discard(open_)
        known = _merged(known, links)
    open_nodes = written(_open_members(buckets, known).select("node", "root").distinct())
    if not open_nodes.isEmpty():
        known = _merged(known, _cross_links(open_nodes, sources))
    discard(open_nodes)
    return known


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``df``."""
    return _marked(texts(df, id_col, text_col)).select("doc_id", "n_shingles", "component_id", "kept")


def _marked(docs: DataFrame) -> DataFrame:
    """``near_duplicates`` of ``doc_id, text`` with ``text_hash``."""
    signed = written(signature_rows(docs))
    full = signed.where(F.col("n") > 0)
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")  # NULL ids last
    node = F.xxhash64("k1", "k2", "n")
    nodes = written(full.groupBy("k1", "k2", "n").agg(F.min(row).alias("rep"), F.first("bands").alias("bands"), F.first("bits").alias("bits")).select(node.alias("node"), "n", "rep", "bands", "bits"))
    rows = saved(signed.select("doc_id", "text_hash", "n", node.alias("node")))
    discard(signed)
    buckets = written(_distinct_buckets(nodes.select("node", F.explode("bands").alias("bucket"))))
    slim = written(nodes.select("node", "n", "rep", "bits"))
    discard(nodes)
    wanted = slim.join(buckets.select("node").distinct(), "node").select("node", F.col("rep.doc_id").alias("id"), F.col("rep.text_hash").alias("hash"))
    sources = written(_sources(docs, wanted))
    roots = _roots(buckets, slim.select("node", "n", "bits"), sources)
    rooted = slim.select("node", "rep").join(roots, "node")
    labels = rooted.join(rooted.groupBy("root").agg(F.min("rep").alias("first")), "root")
    labels = saved(labels.select(F.col("node").alias("of"), "first"))
    discard(buckets, slim, sources, roots)
    out = rows.withColumn("node", F.when(F.col("n") > 0, F.col("node"))).join(labels, F.col("node") == F.col("of"), "left")
    some = F.col("n") > 0
    component = F.when(some, F.col("first.doc_id")).otherwise(F.col("doc_id"))
    kept = ~some | (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & F.col("text_hash").eqNullSafe(F.col("first.text_hash")))
    return out.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), component.alias("component_id"), kept.alias("kept"))


def _sources(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``node, text``: one text for each wanted class, read from the documents.
    ``wanted`` has ``node, id, hash``."""

    def checked(batches):
        for b in batches:
            keep = []
            nodes = b.column(0).to_numpy(zero_copy_only=False)
            for lo, _, data, off in K.text_slices(b.column(1)):
                keep += [(lo + i, *set_key(s), len(s)) for i, s in enumerate(K.shingle_sets(data, off, SHINGLE)) if len(s)]
            at, k1, k2, n = (np.array(x, np.int64) for x in zip(*keep, strict=True)) if keep else (np.zeros(0, np.int64),) * 4
            yield pa.RecordBatch.from_arrays([pa.array(nodes[at]), pa.array(k1), pa.array(k2), pa.array(n), b.column(1).take(pa.array(at))], ["node", "k1", "k2", "n", "text"])

    same_row = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("id")) & (F.xxhash64("text") == F.col("hash"))).select("node", "text")
    found = same_row.mapInArrow(checked, "node long, k1 long, k2 long, n long, text string")
    return found.where(F.xxhash64("k1", "k2", "n") == F.col("node")).groupBy("node").agg(F.min("text").alias("text"))


def one_of_each(df: DataFrame) -> DataFrame:
    """``df`` (with ``doc_id, text``) without the documents that are not their
    component's first, nor repeats of a row's id and text; all columns kept."""
    gone = _marked(texts(df)).where(~F.col("kept")).select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).distinct()
    same = df["doc_id"].cast("long").eqNullSafe(gone["gone_id"]) & (F.xxhash64(df["text"].cast("string")) == gone["gone_hash"])
    return df.join(gone, same, "left_anti").dropDuplicates(["doc_id", "text"])

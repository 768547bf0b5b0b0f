"""Benchmark decontamination by greedy string tiling (Wise, 1993).

A document is contaminated by a benchmark item if tiles - maximal,
non-overlapping runs of equal words, the longest marked first - cover enough
of the item. Tiles may stand in any order, so reordered passages are caught.

1. Seeds: Karp-Rabin hashes of all windows of ``min_match`` words. A Bloom
   filter of the benchmark's seeds (its size is capped, whatever the
   benchmark holds; beyond the cap it only lets more rows through) thins the
   documents' windows in the map task; a join on the hash finds the true
   shared seeds.
2. Documents without enough distinct seeds for the threshold are dropped: all
   tiles consist of seeds, so the words that seeds cover bound the coverage.
3. Tiling, per (document, item): seeds that follow each other on a diagonal
   are one match of Karp-Rabin; the longest unmarked match is marked again
   and again, what a mark cuts is offered again with its rest.

An item shorter than ``min_match`` words is its own only seed and tile.

Defined results: words are lower-cased (A-Z) runs without white space; NULL
and empty texts match nothing; NULL or repeated item ids count as items of
their own by text (equal texts are one item); repeated document rows are
judged one by one; of matches of one length the one first in the document,
then first in the item, is marked first; an empty benchmark contaminates
nothing; extra columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm import kernels as K
from kestrel.llm.tables import saved, texts

MIN_MATCH = 5
THRESHOLD = 0.5
MAX_BLOOM_BITS = 1 << 23
_PROBES = 3


def _bloom_at(h: np.ndarray, bits: int) -> list[np.ndarray]:
    x = np.asarray(h).view(np.uint64)
    step = (x >> np.uint64(32)) | np.uint64(1)
    return [((x + np.uint64(i) * step) & np.uint64(bits - 1)).astype(np.int64) for i in range(_PROBES)]


def bloom_filter(hashes: DataFrame, max_bits: int = MAX_BLOOM_BITS) -> np.ndarray:
    """Bloom filter (one byte per place) of the long column ``seed``. Tasks
    send the distinct places they set; there are at most ``max_bits``."""
    n = hashes.count()
    bits = 1 << 10
    while bits < min(max_bits, 16 * n):
        bits *= 2

    def places(batches):
        for b in batches:
            h = b.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(_bloom_at(h, bits))))], ["place"])

    out = np.zeros(bits, bool)
    found = hashes.select("seed").mapInArrow(places, "place long").distinct().toPandas()
    out[found["place"].to_numpy(np.int64)] = True
    return out


def item_seeds(items: DataFrame, min_match: int) -> DataFrame:
    """``item, at, seed, words, n``: the seeds of each distinct item text;
    ``item`` is a hash of the text, ``words`` the seed's length, ``n`` the
    item's number of words."""

    def seeds(batches):
        for b in batches:
            for lo, hi, data, off in K.text_slices(b.column(1)):
                h, _, _, first = K.words(K.lower(data), off)
                win, at, wfirst = K.windows(h, first, min_match)
                n = np.diff(first)
                row = np.repeat(np.arange(hi - lo), np.diff(wfirst))
                small = np.flatnonzero((n > 0) & (n < min_match))
                for i in small:
                    win = np.append(win, K.windows(h[first[i]:first[i + 1]], np.array([0, n[i]]), int(n[i]))[0])
                row = np.concatenate([row, small])
                at = np.concatenate([at - first[row[:len(at)]], np.zeros(len(small), np.int64)])
                item = b.column(0).to_numpy(zero_copy_only=False)[lo:hi][row]
                yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(at.astype(np.int32)), pa.array(K.signed(win)), pa.array(np.minimum(n[row], min_match).astype(np.int32)), pa.array(n[row].astype(np.int32))], ["item", "at", "seed", "words", "n"])

    distinct = items.select(F.xxhash64("text").alias("item"), "text").distinct()
    return distinct.mapInArrow(seeds, "item long, at int, seed long, words int, n int")


def document_seeds(docs: DataFrame, lengths: list[int], filtered) -> DataFrame:
    """``row, doc_id, at, seed`` for the windows that pass the filter.
    ``row`` tells rows with one doc_id apart."""

    def seeds(batches):
        keep = filtered.value
        for b in batches:
            rows, ids = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            ids = b.column(1)
            for lo, hi, data, off in K.text_slices(b.column(2)):
                h, _, _, first = K.words(K.lower(data), off)
                for k in lengths:
                    win, at, wfirst = K.windows(h, first, k)
                    hit = np.ones(len(win), bool)
                    for p in _bloom_at(win, len(keep)):
                        hit &= keep[p]
                    row = np.repeat(np.arange(hi - lo), np.diff(wfirst))[hit]
                    if len(row):
                        yield pa.RecordBatch.from_arrays([pa.array(rows[lo:hi][row]), ids.slice(lo, hi - lo).take(pa.array(row)), pa.array((at[hit] - first[row]).astype(np.int32)), pa.array(K.signed(win[hit]))], ["row", "doc_id", "at", "seed"])

    return docs.mapInArrow(seeds, "row long, doc_id long, at int, seed long")


def tile(doc_at: np.ndarray, item_at: np.ndarray, seed_words: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling from shared seeds: ``(doc start, item start,
    length)`` of the tiles, the longest first. Seeds are windows of
    ``seed_words`` equal words at ``doc_at`` and ``item_at``."""
    both = np.unique(np.stack([doc_at - item_at, doc_at]), axis=1)  # by diagonal, then place
    d, t = both[1], both[1] - both[0]
    new = np.ones(len(d), bool)
    new[1:] = (np.diff(d - t) != 0) | (np.diff(d) != 1)
    at = np.flatnonzero(new)
    length = np.diff(np.append(at, len(d))) + seed_words - 1
    heap = [(-int(n), int(a), int(b)) for n, a, b in zip(length, d[at], t[at], strict=True)]
    heapq.heapify(heap)
    used_d, used_t, tiles = set(), set(), []
    while heap:
        n, a, b = heapq.heappop(heap)
        free = [i for i in range(-n) if a + i not in used_d and b + i not in used_t]
        if len(free) == -n:
            tiles.append((a, b, -n))
            used_d.update(range(a, a - n))
            used_t.update(range(b, b - n))
            continue
        start = 0
        for i in range(1, len(free) + 1):  # the unmarked rests are matches of their own
            if i == len(free) or free[i] != free[i - 1] + 1:
                if i - start >= seed_words:
                    heapq.heappush(heap, (start - i, a + free[start], b + free[start]))
                start = i
    return tiles


def _tiled(key, rows):
    w, n = int(rows["words"].iloc[0]), int(rows["n"].iloc[0])
    tiles = tile(rows["at"].to_numpy(np.int64), rows["item_at"].to_numpy(np.int64), w)
    covered = sum(x[2] for x in tiles)
    return pd.DataFrame({"row": [key[0]], "item": [key[1]], "doc_id": rows["doc_id"].iloc[:1].to_numpy(), "n_words": [n], "tiled_words": [covered], "n_tiles": [len(tiles)]})


def contaminations(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, threshold: float = THRESHOLD, item_id: str = "item_id") -> DataFrame:
    """Pairs of a document row and a benchmark text whose tiles cover at least
    ``threshold`` of the text's words: ``row, doc_id, item, n_words,
    tiled_words, n_tiles``. ``docs`` has ``row, doc_id, text``."""
    seeds = saved(item_seeds(texts(benchmark, item_id).where(F.col("text").isNotNull()), min_match))
    spark = docs.sparkSession
    filtered = spark.sparkContext.broadcast(bloom_filter(seeds))
    lengths = sorted(r[0] for r in seeds.select("words").distinct().collect())
    hits = document_seeds(docs, lengths, filtered)
    pairs = saved(hits.join(seeds.withColumnRenamed("at", "item_at"), "seed").select("row", "doc_id", "at", "item", "item_at", "words", "n"))
    bound = (pairs.groupBy("row", "item").agg(F.countDistinct("item_at").alias("seeds"), F.max("words").alias("w"), F.max("n").alias("total"))
             .where(F.least(F.col("seeds") * F.col("w"), F.col("total")) >= F.lit(threshold) * F.col("total")).select("row", "item"))
    tiled = pairs.join(bound, ["row", "item"]).groupBy("row", "item").applyInPandas(_tiled, "row long, item long, doc_id long, n_words long, tiled_words long, n_tiles long")
    return tiled.where(F.col("tiled_words") >= F.lit(threshold) * F.col("n_words"))


def leaks(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id") -> DataFrame:
    """``doc_id, item_id, n_words, tiled_words, n_tiles, coverage``: one row per
    leak. Equal document rows give one leak, equal item texts one for each id."""
    slim = texts(docs, doc_id, text).select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", "text")
    found = contaminations(slim, benchmark, min_match, threshold, item_id).drop("row")
    names = texts(benchmark, item_id).where(F.col("text").isNotNull()).select(F.col("doc_id").alias("item_id"), F.xxhash64("text").alias("item")).distinct()
    return found.join(names, "item").select("doc_id", "item_id", "n_words", "tiled_words", "n_tiles", (F.col("tiled_words") / F.col("n_words")).alias("coverage"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without contaminated rows, all columns kept."""
    slim = texts(docs).select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", "text")
    bad = contaminations(slim, benchmark, min_match, threshold).select(F.col("row").alias("leaked_row")).distinct()
    return docs.join(bad, F.xxhash64(docs["doc_id"].cast("long"), docs["text"].cast("string")) == bad["leaked_row"], "left_anti")

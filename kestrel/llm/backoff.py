"""Stupid-backoff language-model scores (Brants et al., 2007), relationally.

The model is the corpus itself, leaving out the scored document: counts of a
document's n-grams are those of all documents less its own. A word's score is
c(context word) / c(context) at the longest context with a count, times
``ALPHA`` for each step back; the last step is c(word) / N.

* Documents are dealt into blocks by a hash, about ``block_bytes`` of text
  each. A task explodes a block's n-grams and counts them, so a word that is
  in every document costs one entry a block.
* The count table is partitioned by the n-gram's hash: each block sends each
  partition an array of its n-grams and one of their counts. A partition adds
  them up and sends each block the totals of its n-grams, in their order; 0
  says that no other block has the n-gram.
* Each block's documents meet the block's totals and sum up their words.

Partitions hold the n-grams of about ``part_bytes`` of text. There is a row for
each block and partition, so ``block_bytes`` and ``part_bytes`` should grow with
the executors' memory on very large corpora.

What is gathered grows with the corpus; no table is broadcast.

Defined results: words are lower-cased (A-Z) runs without white space; NULL and
empty texts have no words and a NULL score; a word that no other document has
counts ``UNSEEN``; equal texts under different ids are different documents,
rows equal in id and text count once for the model and are each scored; NULL
ids pass; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm import kernels as K
from kestrel.llm.tables import texts

ORDER = 2
ALPHA = 0.4
UNSEEN = 0.5
BLOCK_BYTES = 8 << 20
PART_BYTES = 16 << 20


def gram_hashes(h: np.ndarray, first: np.ndarray, order: int) -> np.ndarray:
    """Hashes of the n-grams that end at each word; 0 where a row's words do
    not reach back so far."""
    if order == 1:
        return h | np.uint64(1)
    out = np.zeros(len(h), np.uint64)
    win, at, _ = K.windows(h, first, order)
    out[at + order - 1] = (win << np.uint64(1)) | np.uint64(1)
    return out


def _grams(col: pa.Array, order: int):
    """``(rows, gram hashes [order, words])`` of a column of texts."""
    row, grams, base = [np.zeros(0, np.int64)], [np.zeros((order, 0), np.uint64)], 0
    for lo, hi, data, off in K.text_slices(col):
        h, _, _, first = K.words(K.lower(data), off)
        row.append(np.repeat(np.arange(lo, hi), np.diff(first)))
        grams.append(np.stack([gram_hashes(h, first, n) for n in range(1, order + 1)]))
    return np.concatenate(row), np.concatenate(grams, axis=1)


def _own(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A block's n-grams, ascending, and their counts; the first one, 0, counts
    the words."""
    keys, n = np.unique(grams, return_counts=True)
    some = keys > 0
    return np.concatenate([[np.uint64(0)], keys[some]]), np.concatenate([[grams.shape[1]], n[some]]).astype(np.int64)


def score(df: DataFrame, order: int = ORDER, block_bytes: int = BLOCK_BYTES, part_bytes: int = PART_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_backoff, log_score, mean_log_score`` of every row:
    the sum of its words' log scores and the words that stepped back at all."""
    docs = texts(df, id_col, text_col)
    size = int(docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])
    dealt = docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 + size // block_bytes)).alias("block"))
    bits = np.uint64(64 - max(1, (size // part_bytes).bit_length()))

    def count(key, block):
        _, g = _grams(_distinct(block).column("text"), order)
        keys, n = _own(g)
        part, at = np.unique(keys >> bits, return_index=True)
        ends = np.append(at, len(keys)).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(values)) for values in (K.signed(keys), n)]
        return pa.table({"block": np.full(len(part), key[0].as_py()), "part": part.astype(np.int64), "grams": lists[0], "n": lists[1]})

    def add(key, part):
        grams, n = (part.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("grams", "n"))
        _, back, blocks = np.unique(grams, return_inverse=True, return_counts=True)
        total = np.bincount(back, weights=n).astype(np.int64)
        others = np.where(blocks > 1, total, 0)[back]
        ends = np.concatenate([[0], np.cumsum(part.column("grams").combine_chunks().value_lengths().to_numpy())]).astype(np.int32)
        return pa.table({"to": part.column("block"), "part": part.column("part"), "totals": pa.ListArray.from_arrays(pa.array(ends), pa.array(others))})

    counted = dealt.groupBy("block").applyInArrow(count, "block long, part long, grams array<long>, n array<long>")
    totals = counted.groupBy("part").applyInArrow(add, "to long, part long, totals array<long>")

    def summed(key, block, totals):
        _, g = _grams(_distinct(block).column("text"), order)
        keys, n = _own(g)
        in_order = totals.take(pc.sort_indices(totals.column("part")))
        total = in_order.column("totals").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        n = np.where(total > 0, total, n)
        row, g = _grams(block.column("text"), order)
        return _scores(block.column("doc_id"), row, g, keys, n, int(n[0]), order)

    return dealt.groupBy("block").cogroup(totals.groupBy("to")).applyInArrow(summed, "doc_id long, n_words long, n_backoff long, log_score double, mean_log_score double")


def _distinct(block: pa.Table) -> pa.Table:
    """A block's rows without repeats of id and text."""
    return block.select(["doc_id", "text"]).group_by(["doc_id", "text"]).aggregate([])


def _scores(ids, row: np.ndarray, g: np.ndarray, keys: np.ndarray, total: np.ndarray, corpus: int, order: int) -> pa.Table:
    """Scores of a block's rows from the corpus counts of its n-grams."""
    n_rows = len(ids)
    n_words = np.bincount(row, minlength=n_rows)
    others = corpus - n_words[row]  # the corpus without the document
    counts, contexts = [], []
    for k in range(order):
        c = np.zeros(g.shape[1], np.int64)
        some = np.flatnonzero(g[k])
        c[some] = total[np.searchsorted(keys, g[k][some])]
        own = K.mix(g[k] + K.mix(row.astype(np.uint64)))
        _, back, n = np.unique(own, return_inverse=True, return_counts=True)
        c[some] -= n[back][some]
        counts.append(c)
    found = np.full(g.shape[1], -1)
    for k in range(order):
        found[(counts[k] > 0) & (g[k] != 0)] = k
    log_score = np.log(UNSEEN) - np.log(np.maximum(others, 1)) + (order - 1) * np.log(ALPHA)
    steps = order - 1
    for k in range(order):
        at = np.flatnonzero(found == k)
        context = np.maximum(others[at], 1) if k == 0 else counts[k - 1][at - 1]
        log_score[at] = np.log(counts[k][at]) - np.log(context) + (steps - k) * np.log(ALPHA)
    total_score = np.bincount(row, weights=log_score, minlength=n_rows)
    mean = np.where(n_words > 0, total_score / np.maximum(n_words, 1), np.nan)
    return pa.table({"doc_id": ids, "n_words": n_words.astype(np.int64), "n_backoff": np.bincount(row, weights=found < steps, minlength=n_rows).astype(np.int64),
                     "log_score": pa.array(np.where(n_words > 0, total_score, np.nan), from_pandas=True), "mean_log_score": pa.array(mean, from_pandas=True)})

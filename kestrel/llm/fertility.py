"""Quality rules from tokeniser fertility.

Public vocabularies were learnt from ordinary text, so text that they cut
oddly is odd: few characters a token, many byte-fallback tokens, a token
distribution far from usual. For each document the words are encoded on
their own by a SentencePiece vocabulary with byte fallback and by a
byte-level BPE, and give

* ``piece_chars``, ``bpe_chars``: characters a token of each vocabulary;
* ``byte_share``: share of byte-fallback tokens;
* ``entropy``: entropy of the document's pieces over its largest possible
  value for as many pieces.

A language's bands are around its medians over all documents that pass the
base rules. Characters a token are means over a document's tokens, so their
deviation times the root of the number of tokens is what is compared with the
language's interquartile range of it: ``WIDTH`` ranges are allowed. The other two
are compared as they are, and ``SLACK`` is allowed at least. A document out of a
band of its language is rejected. Languages
that are no two- or three-letter code are one group, so there are at most
18,279 groups.

Defined results: words are runs without white space; NULL and empty texts have
no words and fail the base rules; measures without words are NULL and reject
nothing; a language without a document that passes the base rules has no
bands and rejects nothing; repeated rows and NULL ids are judged one by one; an
empty table gives an empty result; extra columns are ignored or, in
``keep_good``, carried along.
"""

from __future__ import annotations

import base64

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm import kernels as K
from kestrel.llm.pieces import model_path, pieces
from kestrel.llm.tables import saved, texts

MIN_WORDS = 50
REPEAT_PERCENT = 50
WIDTH = 4.0
MEASURES = ("piece_chars", "bpe_chars", "byte_share", "entropy")
#: The least deviation that is allowed, whatever the language's spread.
SLACK = {"piece_chars": 1.0, "bpe_chars": 1.0, "byte_share": 0.02, "entropy": 0.1}
RANKS = "byte_bpe_50k.tiktoken"
CACHED = 100_000
SCHEMA = ("doc_id long, lang string, text_hash long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "n_pieces long, n_bpe long, n_byte_pieces long, entropy double")

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_WORDS: dict[tuple[str, str], "WordTokens"] = {}


class WordTokens:
    """Words to their piece ids (two bytes each) and number of BPE tokens."""

    def __init__(self, model: str, ranks: str):
        v = pieces(model)
        self.model = v.model
        self.is_byte = np.zeros(1 << 16, bool)
        self.is_byte[v.byte_ids] = True
        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.known: dict[bytes, tuple[bytes, int]] = {}

    def of(self, words: list[bytes]) -> list[tuple[bytes, int]]:
        if len(self.known) > CACHED:
            self.known.clear()
        new = [w for w in dict.fromkeys(words) if w not in self.known]
        if new:
            strings = [w.decode("utf-8", "replace") for w in new]
            ids = self.model.encode(strings, num_threads=1)
            counts = [len(self.bpe.encode_ordinary(" " + s)) for s in strings]
            self.known.update((w, (np.array(i, np.uint16).tobytes(), n)) for w, i, n in zip(new, ids, counts, strict=True))
        return [self.known[w] for w in words]


def word_tokens(model: str, ranks: str) -> WordTokens:
    if (model, ranks) not in _WORDS:
        _WORDS[model, ranks] = WordTokens(model, ranks)
    return _WORDS[model, ranks]


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]


def _row(first: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(first) - 1, dtype=np.uint64), np.diff(first))


def _again(keys: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: how often it occurs in its row, and whether it is the first."""
    both = K.mix(keys + K.mix(row + np.uint64(1)))
    _, at, back, n = np.unique(both, return_index=True, return_inverse=True, return_counts=True)
    is_first = np.zeros(len(both), bool)
    is_first[at] = True
    return n[back], is_first


def measure_slice(data: np.ndarray, off: np.ndarray, tokens: WordTokens) -> list[np.ndarray]:
    """The columns of ``SCHEMA`` from ``n_words`` on, for the rows of a slice."""
    h, starts, ends, first = K.words(data, off)
    n_rows = len(off) - 1
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    word_chars = _sums(chars[ends] - chars[starts], first)
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[data])])
    n_symbols = symbols[off[1:]] - symbols[off[:-1]]

    is_break = np.ones(256, bool)
    is_break[0x0A] = False
    l_starts, l_ends, l_first = K.spans(data, off, is_break)  # empty lines hold no word
    has_word = np.searchsorted(starts, l_ends) > np.searchsorted(starts, l_starts)
    lh = K.hash_spans(data, l_starts, l_ends)
    _, new = _again(lh, _row(l_first)) if len(lh) else (lh, np.zeros(0, bool))
    n_dup = _sums(has_word & ~new, l_first)

    win, at, w_first = K.windows(h, first, 3)
    covered = np.zeros(len(h) + 3, np.int64)
    if len(win):
        n, _ = _again(win, _row(w_first))
        np.add.at(covered, at[n > 1], 1)
        np.add.at(covered, at[n > 1] + 3, -1)
    n_repeat = _sums(np.cumsum(covered)[:len(h)] > 0, first)

    some, one, back = np.unique(h, return_index=True, return_inverse=True)
    raw = data.tobytes()
    got = tokens.of([raw[starts[i]:ends[i]] for i in one])
    ids = np.frombuffer(b"".join(g[0] for g in got), np.uint16)
    size = np.array([len(g[0]) // 2 for g in got], np.int64)
    place = np.cumsum(size) - size
    bpe = np.array([g[1] for g in got], np.int64)
    n_of = size[back]
    all_ids = ids[np.repeat(place[back] - (np.cumsum(n_of) - n_of), n_of) + np.arange(int(n_of.sum()))].astype(np.int64) if len(some) else np.zeros(0, np.int64)
    t_first = np.concatenate([[0], np.cumsum(n_of)])[first]
    n_pieces = np.diff(t_first)
    n_byte = _sums(tokens.is_byte[all_ids], t_first)
    pairs, n = np.unique((_row(t_first).astype(np.int64) << 16) | all_ids, return_counts=True)
    p_first = np.searchsorted(pairs >> 16, np.arange(n_rows + 1))
    total = np.maximum(n_pieces, 1).astype(float)
    plogp = _sums(n * np.log(n), p_first)
    entropy = np.where(n_pieces > 1, (np.log(total) - plogp / total) / np.log(np.minimum(np.maximum(total, 2.0), 32000.0)), np.nan)
    return [np.diff(first), word_chars, n_symbols, n_dup, n_repeat, n_pieces, _sums(bpe[back], first) if len(h) else np.zeros(n_rows, np.int64), n_byte, entropy]


def measures(df: DataFrame, model: str | None = None, ranks: str | None = None) -> DataFrame:
    """The base counts and the measures of each row of ``doc_id, text, lang``."""
    model, ranks = model or model_path(), ranks or public_tokenizers.path(RANKS)

    def rows(batches):
        tokens = word_tokens(model, ranks)
        for b in batches:
            for lo, hi, data, off in K.text_slices(b.column(3)):
                *counts, entropy = measure_slice(data, off, tokens)
                columns = [pa.array(c.astype(np.int64)) for c in counts]
                yield pa.RecordBatch.from_arrays([*(b.column(i).slice(lo, hi - lo) for i in range(3)), *columns, pa.array(entropy, from_pandas=True)], [x.split()[0] for x in SCHEMA.split(", ")])
        tokens.known.clear()  # the worker goes on to other work

    lang = F.lower(F.trim(F.col("lang").cast("string")))
    slim = texts(df.select("doc_id", "text")).select("doc_id", "text") if "lang" not in df.columns else df.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), lang.alias("lang"))
    if "lang" not in slim.columns:
        slim = slim.withColumn("lang", F.lit(None).cast("string"))
    group = F.when(F.col("lang").rlike("^[a-z]{2,3}$"), F.col("lang")).otherwise(F.lit("other"))
    out = slim.select("doc_id", group.alias("lang"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(rows, SCHEMA)
    chars = F.col("word_chars").cast("double")
    some = lambda n: F.when(F.col(n) > 0, F.col(n))
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return out.select("*", (chars / some("n_pieces")).alias("piece_chars"), (chars / some("n_bpe")).alias("bpe_chars"), (F.col("n_byte_pieces") / some("n_pieces")).alias("byte_share"), base_failed.alias("base_failed"))


def bands(measured: DataFrame) -> DataFrame:
    """A language's limits: ``band_lang`` and, for each measure, ``<measure>_mid``
    and ``<measure>_reach``."""
    good = measured.where(~F.col("base_failed"))
    mid = good.groupBy(F.col("lang").alias("band_lang")).agg(*[F.percentile_approx(m, 0.5, 10000).alias(f"{m}_mid") for m in MEASURES])
    near = good.join(F.broadcast(mid), F.col("lang") == F.col("band_lang"))
    spread = near.groupBy("band_lang").agg(*[F.percentile_approx(_deviation(m), [0.25, 0.75], 10000).alias(m) for m in MEASURES])
    reach = [F.greatest(F.lit(WIDTH) * (F.col(m)[1] - F.col(m)[0]), F.lit(SLACK[m])).alias(f"{m}_reach") for m in MEASURES]
    return mid.join(F.broadcast(spread.select("band_lang", *reach)), "band_lang")


def _deviation(measure: str):
    """A document's signed distance from its language's median."""
    tokens = {"piece_chars": "n_pieces", "bpe_chars": "n_bpe"}.get(measure)
    apart = F.col(measure) - F.col(f"{measure}_mid")
    return apart * F.sqrt(tokens) if tokens else apart


def judged(df: DataFrame, model: str | None = None, ranks: str | None = None) -> DataFrame:
    """``measures`` plus ``in_bands`` and ``kept``. The bands are broadcast:
    one row a language, at most 18,279 rows."""
    measured = saved(measures(df, model, ranks))
    both = measured.join(F.broadcast(saved(bands(measured))), F.col("lang") == F.col("band_lang"), "left")
    inside = F.lit(True)
    for m in MEASURES:
        inside = inside & F.coalesce(F.abs(_deviation(m)) <= F.col(f"{m}_reach"), F.lit(True))
    return both.withColumn("in_bands", inside).select(*measured.columns, "in_bands", (~F.col("base_failed") & F.col("in_bands")).alias("kept"))


def keep_good(df: DataFrame) -> DataFrame:
    """The rows of ``df`` that pass, all columns kept."""
    bad = judged(df).where(~F.col("kept")).select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash")).distinct()
    return df.join(bad, df["doc_id"].cast("long").eqNullSafe(bad["bad_id"]) & (F.xxhash64(df["text"].cast("string")) == bad["bad_hash"]), "left_anti")

"""Toxicity scores behind a noisy-channel decoder for disguised words.

1. A character trigram model counts all documents (27 symbols: a-z and the
   word's edge, so 19,683 counts whatever the corpus).
2. A token that looks disguised - symbols or digits among letters, a letter
   three times in a row, single letters set apart - is decoded: its characters
   span a lattice (each symbol may stand for some letters or for nothing, a
   repeated letter may be one), and Viterbi search finds the reading with the
   best sum of channel and language-model scores. Other tokens stay. Symbols
   at a token's ends may be letters or punctuation, so such a token has both
   readings. Single letters set apart are read as one word, as the words that
   their wider gaps leave, and with word edges wherever the model sees them;
   all of these words count. Neither tokens nor runs have a longest length.
3. Evidence is learnt from labels: of a restored word and its first four,
   five and six letters, the number of toxic and other labelled documents with
   it. A feature's strength is the lower end of its precision's confidence
   interval (Wilson, ``Z``), so a rare word proves nothing; a feature that is
   right less often than ``PRECISION`` stays below one half. Documents that
   share the smallest hash of their three-word windows (texts under three
   words: of the whole text) are taken for copies and weigh one document
   together, so that a copied text's own words prove no more than one text does.
4. A document's score is the largest strength of its restored words'
   features, a plain text's is the smallest value. 0.5 and more is toxic.

Learning takes at most ``MAX_LABELLED`` labelled documents, those with the
smallest hashes of their id and text; the model keeps the ``MAX_FEATURES``
strongest features. Both are parameters. Scores depend on the text alone.

Defined results: NULL and empty texts score 0; labels are joined by doc_id and
a document with any toxic label is toxic; labels that are NULL, without a
document, or held out teach nothing; without toxic labels all scores are 0;
repeated rows and NULL ids are scored one by one; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm import kernels as K
from kestrel.llm.tables import saved, texts

MAX_LABELLED = 20_000
MAX_FEATURES = 50_000
Z = 2.24  # a 97.5 % interval
PRECISION = 0.9
FOLDS = 5
CACHED = 100_000
CACHED_CHARS = 64
LETTERS = "abcdefghijklmnopqrstuvwxyz"
EDGE = 26
#: Letters of a word's beginnings that are features of their own.
BEGINNINGS = (4, 5, 6)

# Letters that a symbol may stand for in disguised words.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "*": "aeiou", "#": "aeiou", "%": "aeiou", "&": "aeiou"}
SAME, AS_LETTER, AS_VOWEL, DROPPED, KEPT_REPEAT = 0.0, -1.5, -3.0, -2.0, -1.0

_TOKEN = re.compile(r"\S+")
_TRIM = re.compile(r"^[^\w@$]+|[^\w]+$")
_MARKS = re.escape("".join(c for c in LEET if not c.isdigit()))
_DISGUISED = re.compile(rf"[^\W\d_][\d{_MARKS}]+[^\W\d_]|^[\d@$]+[^\W\d_]|[^\W\d_][0-9]$|([a-z])\1\1")
_BARE = re.compile(rf"^[^\w{_MARKS}]+|[^\w{_MARKS}]+$")
_SPACED = re.compile(r"(?<![^\s])[a-z0-9@$!](?:[\s.\-_*]+[a-z0-9@$!](?![^\s.\-_*])){3,}(?![^\s.,;:?!])")
_GAP = re.compile(r"[\s.\-_*]+")
_SEPARATED = re.compile(r"^(?:[a-z0-9@$!][.\-_*]){2,}[a-z0-9@$!]$")
_LETTER_LIKE = re.compile(r"[a-z@$]")

# Bytes that may stand alone in a run of single letters, and between them.
_SINGLE_BYTES, _GAP_BYTES = np.zeros(256, bool), np.zeros(256, bool)
_SINGLE_BYTES[list(b"abcdefghijklmnopqrstuvwxyz0123456789@$!")] = True
_GAP_BYTES[[*b" \t\n\v\f\r.-_*", *range(0x1C, 0x20), *range(0x80, 0x100)]] = True
#: Marks that end a word and stand for no letter.
_STOP_BYTES = np.zeros(256, bool)
_STOP_BYTES[list(b".,;:?")] = True
#: Characters below U+10000 that are letters and their own lower case.
_LOWER_LETTER = np.array([chr(c).isalpha() and chr(c).lower() == chr(c) for c in range(1 << 16)])
#: Letters beyond ASCII whose lower case holds an ASCII letter.
_LOWER_TO_ASCII = ("\u212a".encode(), "\u0130".encode())

# What a character may stand for; a letter after the same letter may be one with it.
_NOTHING = [("", SAME)]
_CHOICES = {c: [(c, SAME)] for c in LETTERS} | {c: [(x, AS_VOWEL if len(to) > 2 else AS_LETTER) for x in to] + [("", DROPPED)] for c, to in LEET.items()}
_REPEATED = {c: [(c, KEPT_REPEAT), ("", SAME)] for c in LETTERS}


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Counts ``[27, 27, 27]`` of letter trigrams over all texts; a word is a
    run of a-z (A-Z lower-cased) with two edges before and one after."""
    letter = np.full(256, EDGE, np.int64)
    letter[ord("a"):ord("z") + 1] = np.arange(26)

    def counts(batches):
        total = np.zeros(27**3, np.int64)
        for b in batches:
            for _, _, data, _ in K.text_slices(b.column(1)):
                c = letter[K.lower(data)]
                c = np.concatenate([[EDGE, EDGE], c, [EDGE]])
                first = c[:-2] * 729 + c[1:-1] * 27 + c[2:]
                total += np.bincount(first, minlength=27**3)
                start = (c[1:-1] == EDGE) & (c[2:] != EDGE)  # two edges before a word
                total += np.bincount(EDGE * 729 + EDGE * 27 + c[2:][start & (c[:-2] != EDGE)], minlength=27**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["gram", "n"])

    found = docs.select("doc_id", "text").mapInArrow(counts, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(27**3)
    out[found["gram"].to_numpy(np.int64)] = found["n"].to_numpy(float)
    return out.reshape(27, 27, 27)


class Decoder:
    """Viterbi search for the plain reading of a disguised token."""

    def __init__(self, counts: np.ndarray):
        smooth = counts + 0.05
        tri = smooth / smooth.sum(axis=2, keepdims=True)
        pair = counts.sum(axis=0) + 0.5
        bi = pair / pair.sum(axis=1, keepdims=True)
        self.log = np.log(0.8 * tri + 0.2 * bi[None, :, :]).tolist()
        self.rests: dict[tuple[int, int, str, str], str] = {}

    def options(self, token: str, before: str = ""):
        """For each character the letters (or nothing) it may stand for."""
        for c in token:
            yield _REPEATED[c] if c == before and c in _REPEATED else _CHOICES.get(c, _NOTHING)
            before = c

    def read(self, token: str, edges: bool = False) -> str:
        """The best reading; with ``edges``, words may end anywhere and are set
        apart by spaces. What a token begins with can often be read in one way
        only; the rest then depends on the last two letters, and is kept."""
        if edges:
            return self._search(EDGE, EDGE, "", token, edges)
        a, b, at, letters = EDGE, EDGE, 0, []
        for choices in self.options(token):
            if len(choices) > 1:
                break
            if choices[0][0]:
                letters.append(choices[0][0])
                a, b = b, ord(letters[-1]) - 97
            at += 1
        if at == len(token):
            return "".join(letters)
        key = (a, b, token[max(at - 1, 0):at], token[at:])
        found = self.rests.get(key)
        if found is None:
            found = self._search(*key)
            if len(key[3]) <= CACHED_CHARS:
                if len(self.rests) >= CACHED:
                    self.rests.clear()
                self.rests[key] = found
        return "".join(letters) + found

    def _search(self, a: int, b: int, before: str, token: str, edges: bool = False) -> str:
        """The best reading of what follows the letters ``a``, ``b``, the last
        character being ``before``. A state's reading is a chain of back-pointers."""
        start = self.log[EDGE][EDGE]
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(a, b): (0.0, None)}
        for choices in self.options(token, before):
            after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (score, node) in states.items():
                row = self.log[a][b]
                for letter, cost in choices:
                    if letter:
                        x = ord(letter) - 97
                        key, value = (b, x), score + cost + row[x]
                        if key not in after or value > after[key][0]:
                            after[key] = (value, (node, letter))
                        if edges and b != EDGE:
                            key, value = (EDGE, x), score + cost + row[EDGE] + start[x]
                            if key not in after or value > after[key][0]:
                                after[key] = (value, (node, " " + letter))
                    else:
                        key, value = (a, b), score + cost
                        if key not in after or value > after[key][0]:
                            after[key] = (value, node)
            states = after
        node = max(((score + self.log[a][b][EDGE], node) for (a, b), (score, node) in states.items()), key=lambda x: x[0])[1]
        letters = []
        while node:
            node, letter = node
            letters.append(letter)
        return "".join(reversed(letters))


class Restorer:
    """Texts to restored words; readings of disguised tokens are kept."""

    def __init__(self, counts: np.ndarray):
        self.decoder = Decoder(counts)
        self.known: dict[str, tuple[str, ...]] = {}

    def readings(self, token: str) -> tuple[str, ...]:
        """A token's word and, where symbols at its ends may be letters, the
        word with them."""
        found = self.known.get(token)
        if found is None:
            core, bare = _TRIM.sub("", token), _BARE.sub("", token)
            word = core
            if _DISGUISED.search(core) or _SEPARATED.match(core):
                word = self.decoder.read(core) or core
            found = (word,)
            if bare != core and _LETTER_LIKE.search(bare):
                ended = self.decoder.read(bare)
                if ended and ended != word:
                    found = (word, ended)
            if len(token) <= CACHED_CHARS:
                if len(self.known) >= CACHED:
                    self.known.clear()
                self.known[token] = found
        return found

    def spaced(self, text: str):
        """For each run of single letters set apart, the words it may be."""
        for m in _SPACED.finditer(text):
            gaps = [len(g) for g in _GAP.findall(m[0])]
            letters = _GAP.split(m[0])
            joined, least = "".join(letters), min(gaps)
            parts = "".join(c + " " * (n > least) for c, n in zip(letters, [*gaps, 0], strict=True)).split()
            yield {w for w in (self.decoder.read(joined), *map(self.decoder.read, parts if len(parts) > 1 else ()), *self.decoder.read(joined, edges=True).split(), *re.findall(r"[a-z]+", joined)) if w}

    def words(self, text: str) -> set[str]:
        """Distinct restored words of a lower-cased text."""
        words = {w for token in set(_TOKEN.findall(text)) for w in self.readings(token)}
        words.update(*self.spaced(text))
        words.discard("")
        return words


def features(word: str) -> list[str]:
    """A word and its beginnings."""
    return [word, *(word[:n] + "-" for n in BEGINNINGS if len(word) >= n)]


def strength(toxic: float, other: float, z: float = Z) -> float:
    """Lower end of the confidence interval of toxic / (toxic + other)."""
    n = toxic + other
    if not n:
        return 0.0
    p = toxic / n
    low = max(0.0, (p + z * z / (2 * n) - z * np.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n))
    return low if p >= PRECISION else min(low, 0.5 * p)


def held_out(doc_id):
    """Whether a row's labels may not be learnt from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0


def learn(docs: DataFrame, labels: DataFrame, counts: np.ndarray, max_labelled: int = MAX_LABELLED, max_features: int = MAX_FEATURES) -> dict[str, float]:
    """Feature to strength, from labelled rows that are not held out."""
    marks = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("of")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    marks = marks.where(~held_out(F.col("of"))).orderBy(F.xxhash64("of"), "of").limit(max_labelled)
    rows = docs.join(marks, docs["doc_id"] == marks["of"]).select("text", "toxic")

    def sketched(batches):
        for b in batches:
            for lo, hi, data, off in K.text_slices(b.column(0)):
                h, _, _, first = K.words(K.lower(data), off)
                win, _, w_first = K.windows(h, first, 3)
                least = np.array([win[a:z].min() if z > a else 0 for a, z in zip(w_first[:-1], w_first[1:], strict=True)], np.uint64)
                short = np.flatnonzero(np.diff(w_first) == 0)
                least[short] = K.hash_spans(K.lower(data), off[:-1][short], off[1:][short])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(K.signed(least))], ["text", "toxic", "copy"])

    rows = saved(rows.mapInArrow(sketched, "text string, toxic int, copy long"))
    weights = rows.groupBy("copy").agg((1 / F.count("*")).alias("weight"))  # at most max_labelled rows
    rows = rows.join(F.broadcast(weights), "copy").select("text", "toxic", "weight")

    def seen(batches):
        restore = Restorer(counts)
        for b in batches:
            total: dict[str, list[float]] = {}
            for text, toxic, weight in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for f in {f for w in restore.words((text or "").lower()) for f in features(w)}:
                    total.setdefault(f, [0.0, 0.0])[toxic > 0] += weight
            yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array([n[1] for n in total.values()], pa.float64()), pa.array([n[0] for n in total.values()], pa.float64())], ["feature", "toxic", "other"])

    found = rows.mapInArrow(seen, "feature string, toxic double, other double").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    p, n = F.col("toxic") / (F.col("toxic") + F.col("other")), F.col("toxic") + F.col("other")
    kept = found.where((F.col("toxic") >= 3) & (p >= 0.2)).orderBy(F.desc(p * n / (n + Z * Z)), "feature").limit(max_features)
    return {r["feature"]: float(strength(r["toxic"], r["other"])) for r in kept.collect()}


def may_be_spaced(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows of a slice that may hold a run of single letters set apart: a
    superset of those where ``_SPACED`` finds one, read off the bytes (bytes
    beyond ASCII may be white space, and some are letters once lower-cased)."""
    n = len(offsets) - 1
    if any(odd in data.tobytes() for odd in _LOWER_TO_ASCII):
        return np.ones(n, bool)
    low = K.lower(data)
    gap = _GAP_BYTES[low]
    before, after = np.ones(len(low), bool), np.ones(len(low), bool)
    before[1:], after[:-1] = gap[:-1], gap[1:]
    inner = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(low))]
    before[inner], after[inner - 1] = True, True
    at = np.flatnonzero(_SINGLE_BYTES[low] & before & after)
    row = np.searchsorted(offsets, at, "right") - 1
    solid = np.cumsum(~gap)
    linked = (solid[at[1:]] - solid[at[:-1]] == 1) & (row[1:] == row[:-1])  # only gaps between them
    out = np.zeros(n, bool)
    out[row[:-3][linked[:-2] & linked[1:-1] & linked[2:]] if len(at) > 3 else []] = True
    return out


def letter_bytes(low: np.ndarray) -> np.ndarray:
    """Bytes of a-z and, in whole UTF-8 characters of up to three bytes, of letters
    beyond ASCII that lower-casing leaves as they are."""
    letter = (low >= ord("a")) & (low <= ord("z"))
    padded = np.concatenate([low, np.zeros(2, np.uint8)]).astype(np.int32)
    follows = (padded & 0xC0) == 0x80
    for size, at in ((2, np.flatnonzero((low >= 0xC2) & (low < 0xE0))), (3, np.flatnonzero((low >= 0xE0) & (low < 0xF0)))):
        point, whole = padded[at] & (0xFF >> (size + 1)), np.ones(len(at), bool)
        for i in range(1, size):
            point, whole = point << 6 | padded[at + i] & 0x3F, whole & follows[at + i]
        at = at[whole & _LOWER_LETTER[point] & (point >= (0x80, 0x800)[size - 2])]
        for i in range(size):
            letter[at + i] = True
    return letter


def known_features(strengths: dict[str, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first four bytes, as a number, of all features, and the sorted hashes
    of words and of beginnings."""
    head = np.unique(np.array([int.from_bytes(f.encode()[:4].ljust(4, b"\0"), "little") for f in strengths], np.uint32))
    return head, _hashes([f for f in strengths if not f.endswith("-")]), _hashes([f[:-1] for f in strengths if f.endswith("-")])


def _hashes(names: list[str]) -> np.ndarray:
    raw = [n.encode() for n in names]
    ends = np.cumsum([0, *map(len, raw)])
    return np.sort(K.hash_spans(np.frombuffer(b"".join(raw), np.uint8), ends[:-1], ends[1:]))


def _among(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes if len(known) else np.zeros(len(hashes), bool)


def without_evidence(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, known: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Which tokens are plain words (letters of ``letter_bytes``, none three times
    in a row, one mark of ``_STOP_BYTES`` may follow), so that they are read as
    they stand, and have no feature: they add nothing to a score. Features are
    found by hashes, so a word taken for one that has a feature is only read in vain."""
    heads, whole, beginnings = known
    letter = letter_bytes(low)
    bare = ends - (_STOP_BYTES[low[ends - 1]] & (ends - starts > 1))
    odd = ~letter
    odd[2:] |= (low[2:] == low[1:-1]) & (low[1:-1] == low[:-2])
    seen = np.concatenate([[0], np.cumsum(odd)])
    padded = np.concatenate([low, np.zeros(4, np.uint8)])
    follows = (padded & 0xC0) == 0x80
    # the first two letters' runs may begin in front of the token, where white space or a row ends
    begins = np.minimum(starts + 2, bare)
    plain = (seen[bare] == seen[begins]) & letter[starts] & letter[np.minimum(starts + 1, bare - 1)]
    plain &= ~follows[starts] & ~follows[bare]  # no character reaches over the end of a row
    head = np.zeros(len(starts), np.uint32)
    for i in range(4):
        head |= np.where(starts + i < bare, padded[starts + i], 0).astype(np.uint32) << np.uint32(8 * i)
    near = np.flatnonzero(plain & np.isin(head, heads))
    s, e = starts[near], bare[near]
    found = _among(K.hash_spans(low, s, e), whole)
    chars = np.flatnonzero(~follows[:len(low) + 1])  # where characters begin, and the end
    first, last = np.searchsorted(chars, s), np.searchsorted(chars, e)
    for n in BEGINNINGS:
        long = np.flatnonzero(~found & (last - first >= n))
        found[long] = _among(K.hash_spans(low, s[long], chars[first[long] + n]), beginnings)
    plain[near[found]] = False
    return plain


def _slice_scores(low: np.ndarray, offsets: np.ndarray, restore: Restorer, strengths: dict[str, float], best: dict[int, tuple[float, int]], known: tuple | None = None):
    """``(score, decoded tokens)`` of the rows of a slice, runs of single letters
    left out. A token's reading is made once for all rows that hold it; plain
    words without a feature need none."""
    hashes, starts, ends, first = K.words(low, offsets)
    wanted = np.flatnonzero(~without_evidence(low, starts, ends, known_features(strengths) if known is None else known))
    hashes, starts, ends, first = hashes[wanted], starts[wanted], ends[wanted], np.searchsorted(wanted, first)
    kinds, at, of = np.unique(hashes, return_index=True, return_inverse=True)
    strongest, changed = np.zeros(len(kinds)), np.zeros(len(kinds), np.int64)
    for i, (h, s, e) in enumerate(zip(kinds.tolist(), starts[at].tolist(), ends[at].tolist(), strict=True)):
        found = best.get(h)
        if found is None:
            found = (0.0, 0)
            for token in _TOKEN.findall(low[s:e].tobytes().decode("utf-8", "replace").lower()):
                words = restore.readings(token)
                found = (max(found[0], *(strengths.get(f, 0.0) for w in words for f in features(w))), found[1] + (words != (_TRIM.sub("", token),)))
            if len(best) >= CACHED:
                best.clear()
            best[h] = found
        strongest[i], changed[i] = found
    n = len(offsets) - 1
    row = np.repeat(np.arange(n), np.diff(first))
    top = np.zeros(n)
    np.maximum.at(top, row[strongest[of] > 0], strongest[of][strongest[of] > 0])
    odd = np.unique(np.stack([row, of])[:, changed[of] > 0], axis=1)
    return top, np.bincount(odd[0], weights=changed[odd[1]], minlength=n).astype(np.int64)


def score(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", labelled: DataFrame | None = None) -> DataFrame:
    """``doc_id, text_hash, held_out, score, predicted, n_restored`` of every row;
    ``n_restored`` counts distinct words that the decoder changed. Labels teach
    on ``labelled`` (by default the rows themselves)."""
    docs = texts(df, id_col, text_col)
    counts = trigram_counts(docs)
    model = docs.sparkSession.sparkContext.broadcast((counts, learn(texts(labelled) if labelled is not None else docs, labels, counts)))

    def rows(batches):
        counts, strengths = model.value
        restore, best, known = Restorer(counts), {}, known_features(strengths)
        for b in batches:
            for lo, hi, data, off in K.text_slices(b.column(2)):
                top, n = _slice_scores(K.lower(data), off, restore, strengths, best, known)
                for i in np.flatnonzero(may_be_spaced(data, off)).tolist():
                    for words in restore.spaced((b.column(2)[lo + i].as_py() or "").lower()):
                        top[i] = max([top[i], *(strengths.get(f, 0.0) for w in words for f in features(w))])
                        n[i] += 1
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(top), pa.array((top >= 0.5).astype(np.int32)), pa.array(n)], ["doc_id", "text_hash", "score", "predicted", "n_restored"])

    scored = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(rows, "doc_id long, text_hash long, score double, predicted int, n_restored long")
    return scored.select("doc_id", "text_hash", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted", "n_restored")


def is_held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % FOLDS == 0


def keep_clean(df: DataFrame, labels: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """The rows of ``df`` that are not predicted toxic, all columns kept."""
    bad = score(df, labels, labelled=labelled).where("predicted = 1").select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash")).distinct()
    return df.join(bad, df["doc_id"].cast("long").eqNullSafe(bad["bad_id"]) & (F.xxhash64(df["text"].cast("string")) == bad["bad_hash"]), "left_anti")

"""Exact token counts at every prefix of a text, by dynamic programming.

The BPE encoding of a prefix ends in exactly one token ``t`` that may follow
the encoding of the prefix without ``t``: a sequence of tokens is an encoding
if and only if every neighbouring pair encodes to itself. So the count at a
place is the count before its last token plus one, found from the place's
own few candidates, and no prefix is encoded again. Truncation and budget
questions are then look-ups in the stored table.

The table is one signed byte a character: the change of the count there. No
token holds a space after another character, so a text is a row of units
(spaces and what follows them) with independent counts; a task computes a
unit's changes once and keeps the last ones, about ``CACHED``.

Defined results: NULL and empty texts have no tokens and an empty table;
special strings are ordinary text, as the library has it; characters that no
piece holds count one token a UTF-8 byte; long texts and units take time and
memory in proportion to their length; repeated rows and NULL ids pass; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kestrel.llm.pieces import SPACE, codes, marked, matcher, model_path, pieces
from kestrel.llm.tables import texts

CACHED = 400_000
MAX_PAIRS = 500_000
NONE = float("-inf")
_COUNTERS: dict[str, "UnitCounts"] = {}


class UnitCounts:
    """Units to the bytes of their count changes, computed at first use."""

    SLOTS = 1 << 20

    def __init__(self, path: str):
        v = pieces(path)
        self.scores, self.names, self.matcher = v.scores, {i: p for p, i in v.ids.items()}, matcher(path)
        self.known: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}
        self.slot_key, self.slot_ok = np.full(self.SLOTS, -1, np.int64), np.zeros(self.SLOTS, bool)
        #: Characters of no piece: they stand alone.
        alone = "".join(c for c in "\n\t\r" if not any(c in p for p in self.scores))
        self.split = re.compile(f"{SPACE}+[^{SPACE}{alone}]*|[{alone}]|[^{SPACE}{alone}]+" if alone else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")

    def merged(self, s: str) -> list[str]:
        """Byte-pair encoding of a short string of known characters."""
        parts, scores = list(s), self.scores
        ranks = [scores.get(a + b, NONE) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks:
            best = max(ranks)
            if best == NONE:
                break
            at = ranks.index(best)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = scores.get(parts[at - 1] + parts[at], NONE)
            if at < len(ranks):
                ranks[at] = scores.get(parts[at] + parts[at + 1], NONE)
        return parts

    def follows(self, before: np.ndarray, then: np.ndarray) -> np.ndarray:
        """Whether each pair of pieces encodes to itself; ``before`` is -1 where
        nothing that could merge stands before."""
        key = (before.astype(np.int64) + 1) << 32 | then
        slot = (key * 0x9E3779B1 >> 7) & (self.SLOTS - 1)
        new = np.flatnonzero(self.slot_key[slot] != key)
        ok = self.slot_ok[slot]
        if len(new):
            some, back = np.unique(key[new], return_inverse=True)
            found = np.zeros(len(some), bool)
            for i, k in enumerate(some.tolist()):
                known = self.pairs.get(k)
                if known is None:
                    if len(self.pairs) > MAX_PAIRS:
                        self.pairs.clear()
                    parts = [self.names[(k >> 32) - 1]] if k >> 32 else []
                    parts.append(self.names[k & 0xFFFFFFFF])
                    known = self.pairs[k] = self.merged("".join(parts)) == parts
                found[i] = known
            ok[new] = found[back]
            self.slot_ok[slot[new]], self.slot_key[slot[new]] = ok[new], key[new]
        return ok

    def changes(self, units: list[str]) -> list[bytes]:
        """Count changes at each character of the units, which are computed
        side by side, a character of each at a time."""
        c = codes("".join(units))
        size = np.array([len(u) for u in units])
        first = np.concatenate([[0], np.cumsum(size)])
        ends = np.repeat(first[1:], size)
        start, length, piece = self.matcher.edges(c, ends)
        place = np.arange(len(c)) - np.repeat(first[:-1], size)  # in the unit
        last_char = start + length - 1
        order = np.lexsort((-length, last_char, place[last_char]))
        start, length, piece, last_char = start[order], length[order], piece[order], last_char[order]
        steps = np.searchsorted(place[last_char], np.arange(size.max() + 1))
        utf8 = 1 + (c >= 0x80).astype(np.int64) + (c >= 0x800) + (c >= 0x10000)
        count, last = np.zeros(len(c), np.int64), np.full(len(c), -1, np.int64)
        by_size = np.argsort(-size, kind="stable")
        longer = np.searchsorted(-size[by_size], -np.arange(size.max()), "left")  # units of more than t characters
        for t in range(size.max()):
            here = first[by_size[:longer[t]]] + t
            count[here] = utf8[here] + (count[here - 1] if t else 0)
            e = slice(steps[t], steps[t + 1])
            s, at = start[e], last_char[e]
            ok = np.flatnonzero(self.follows(np.where(place[s] > 0, last[s - 1], -1), piece[e]))
            at, one = np.unique(at[ok], return_index=True)  # the longest that fits
            s = s[ok[one]]
            count[at] = 1 + np.where(place[s] > 0, count[s - 1], 0)
            last[at] = piece[e][ok[one]]
        count[1:] -= np.where(place[1:] > 0, count[:-1], 0)
        flat = count.astype(np.int8).tobytes()
        return [flat[a:b] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]

    def tables(self, texts: list[str]) -> list[bytes]:
        """Changes of the count at each character of each text."""
        split = [self.split.findall(marked(t)) if t else [] for t in texts]
        if len(self.known) > CACHED:
            self.known.clear()
        new = {u for units in split for u in units}.difference(self.known)
        if new:
            new = list(new)
            self.known.update(zip(new, self.changes(new), strict=True))
        out = []
        for units in split:
            with_mark = b"".join(map(self.known.__getitem__, units))
            first = np.frombuffer(with_mark[:2], np.int8).sum(dtype=np.int8)  # the mark before the text is no prefix
            out.append(first.tobytes() + with_mark[2:] if units else b"")
        return out


def parts_of(values: list[str], most: int = 1 << 20):
    """Ranges of the list of about ``most`` characters, one value at least."""
    lo, total = 0, 0
    for i, v in enumerate(values):
        if total and total + len(v) > most:
            yield lo, i
            lo, total = i, 0
        total += len(v)
    if lo < len(values):
        yield lo, len(values)


def unit_counts(path: str) -> UnitCounts:
    if path not in _COUNTERS:
        _COUNTERS[path] = UnitCounts(path)
    return _COUNTERS[path]


def prefix_table(df: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, changes`` for each row."""
    path = model or model_path()

    def rows(batches):
        counts = unit_counts(path)
        for b in batches:
            values = [t or "" for t in b.column(2).to_pylist()]
            for lo, hi in parts_of(values):
                part = b.slice(lo, hi - lo)
                found = counts.tables(values[lo:hi])
                total = [int(np.frombuffer(x, np.int8).sum(dtype=np.int64)) for x in found]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(total, pa.int64()), pa.array(found, pa.binary())], ["doc_id", "n_bytes", "n_tokens", "changes"])
        counts.known.clear()  # the worker goes on to other work

    slim = texts(df, id_col, text_col).select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), "text")
    return slim.mapInArrow(rows, "doc_id long, n_bytes long, n_tokens long, changes binary")


@F.pandas_udf(T.LongType())
def tokens_at(changes: pd.Series, n_chars: pd.Series) -> pd.Series:
    """Tokens of the first ``n_chars`` characters."""
    return pd.Series([int(np.frombuffer(c, np.int8, min(len(c), max(0, int(n)))).sum(dtype=np.int64)) for c, n in zip(changes, n_chars, strict=True)])


def longest_prefix(changes, budget: int):
    """Characters of the longest prefix with at most ``budget`` tokens."""

    @F.pandas_udf(T.LongType())
    def longest(column: pd.Series) -> pd.Series:
        def one(c: bytes) -> int:
            fits = np.flatnonzero(np.cumsum(np.frombuffer(c, np.int8), dtype=np.int64) <= budget)
            return int(fits[-1]) + 1 if len(fits) else 0

        return pd.Series([one(c) for c in column], dtype="int64")

    return longest(changes)

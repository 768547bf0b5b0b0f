"""Vectorised text kernels used inside Arrow map tasks.

Every kernel works on one slice of an Arrow string column: the UTF-8 bytes of
some rows side by side plus the row offsets. A slice holds about ``max_bytes``
of text (a longer text is a slice of its own), so a task's memory follows the
slice and not the batch, and nothing loops over words in Python.

Words are compared by 64-bit hashes: a polynomial over random byte values,
finished by a bit mixer. Two different words of a corpus agree with a chance
of about 2**-64 per pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_CHUNK = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = np.random.default_rng(20240608).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Bytes of a word: anything but white space.
WORD_BYTES = np.ones(256, bool)
WORD_BYTES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Bytes of a word of digits, letters a-z and characters beyond ASCII.
ALNUM_BYTES = np.zeros(256, bool)
ALNUM_BYTES[0x30:0x3A] = ALNUM_BYTES[0x61:0x7B] = ALNUM_BYTES[0x80:] = True


def text_slices(col: pa.Array, max_bytes: int = SLICE_BYTES):
    """Yield ``(lo, hi, bytes, offsets)`` of rows ``lo:hi``; NULL is empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    n = len(col)
    if not n:
        return
    off = np.frombuffer(col.buffers()[1], kind)[col.offset:col.offset + n + 1].astype(np.int64)
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + max_bytes, "right")) - 1)
        yield lo, hi, data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
        lo = hi


def mix(x: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash (a bijection with full avalanche)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z on UTF-8 bytes."""
    return _LOWER[data]


def _powers(n: int, of: np.uint64) -> np.ndarray:
    p = np.full(n, of, np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


_POW = _powers(_CHUNK, _BASE)
_POW_INV = _powers(_CHUNK, _INV)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of non-overlapping ascending byte spans."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _CHUNK - 1, "right")))
        a, b = int(starts[i]), int(ends[j - 1])
        pw, inv = (_POW, _POW_INV) if b - a < _CHUNK else (_powers(b - a + 1, _BASE), _powers(b - a + 1, _INV))
        total = np.zeros(b - a + 1, np.uint64)
        np.cumsum(_BYTES[data[a:b]] * pw[:b - a], out=total[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        out[i:j] = mix((total[e] - total[s]) * inv[s] + (e - s).astype(np.uint64))
        i = j
    return out


def spans(data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray):
    """``(starts, ends, first)``: byte spans of the words and, for each row,
    the index of its first word (one more entry than rows)."""
    inside = word_bytes[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty_like(inside)
    after = np.empty_like(inside)
    if len(data):
        before[0], before[1:] = False, inside[:-1]
        after[-1], after[:-1] = False, inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def words(data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray = WORD_BYTES):
    """``(hashes, starts, ends, first)`` of all words of a slice."""
    starts, ends, first = spans(data, offsets, word_bytes)
    return hash_spans(data, starts, ends), starts, ends, first


def windows(hashes: np.ndarray, first: np.ndarray, k: int):
    """Hashes of all k-word windows inside rows: ``(hashes, at, first)``.
    ``at`` is the word where a window starts, ``first`` the rows' first window."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(first), np.int64)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total += hashes[j:j + n] * _ODD[j % 64] + (np.uint64(j) << np.uint64(7))
    ok = np.ones(n, bool)
    for e in np.unique(first[1:-1]):
        ok[max(0, e - k + 1):e] = False
    at = np.flatnonzero(ok)
    return mix(total[at]), at, np.searchsorted(at, first)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = 5):
    """Distinct k-word shingles of each row as a list of sorted uint64 arrays.
    A row with fewer than k words has its whole sequence as its only shingle;
    a row without words has none."""
    h, _, _, first = words(lower(data), offsets)
    win, _, wfirst = windows(h, first, k)
    out = []
    for i in range(len(offsets) - 1):
        a, b = first[i], first[i + 1]
        if b - a >= k:
            out.append(np.unique(win[wfirst[i]:wfirst[i + 1]]))
        elif b > a:
            seq = h[a:b] * _ODD[:b - a]
            out.append(mix(np.array([seq.sum(dtype=np.uint64) + np.uint64(b - a)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signed(x) -> np.ndarray:
    """uint64 values as the int64 of the same bits (Spark's long)."""
    return np.asarray(x, np.uint64).view(np.int64)

"""Exact order statistics of many columns without a sort: radix selection.

A double's bits, rearranged so that they order like the number, are fixed from
the top, twelve at a time. A pass counts, for every column and wanted rank, the
values that share the bits fixed so far by their next twelve; the counts say
which twelve the rank has. Six passes give the exact value whatever the
distribution is, and a task holds only the counts."""

from __future__ import annotations

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .passes import summed

_DIGITS = [(52, 12), (40, 12), (28, 12), (16, 12), (4, 12), (0, 4)]  # shift, bits
_SIGN = np.uint64(1) << np.uint64(63)


def sort_keys(x: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of the (non-NaN) numbers."""
    bits = (x + 0.0).view(np.uint64)  # -0.0 is 0.0
    return np.where(bits & _SIGN, ~bits, bits | _SIGN)


def _number(key: np.uint64) -> float:
    bits = key ^ _SIGN if key & _SIGN else ~key
    return float(np.array([bits], np.uint64).view(np.float64)[0])


def exact_medians(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    """The median of each column's values (NULL and NaN left out; the mean of the
    two middle ones if even in number), None for a column without values."""
    quoted = ["`" + c.replace("`", "``") + "`" for c in columns]
    rows = df.select(*[F.col(q).cast("double").alias(f"c{i}") for i, q in enumerate(quoted)]).persist(StorageLevel.MEMORY_AND_DISK)
    k = len(columns)
    prefix, rank = np.zeros((k, 2), np.uint64), np.zeros((k, 2), np.int64)
    n = None
    for shift, bits in _DIGITS:

        def counts(batches, shift=shift, bits=bits, prefix=prefix.copy()):
            out = np.zeros((k, 2, 1 << bits))
            for b in batches:
                for i in range(k):
                    x = b.column(i).to_numpy(zero_copy_only=False).astype(np.float64)
                    key = sort_keys(x[~np.isnan(x)])
                    for t in range(2):
                        own = key if shift + bits == 64 else key[key >> np.uint64(shift + bits) == prefix[i, t]]
                        digit = (own >> np.uint64(shift)) & np.uint64((1 << bits) - 1)
                        out[i, t] += np.bincount(digit.astype(np.int64), minlength=1 << bits)
            return out.ravel()

        got = summed(rows, counts, k * 2 << bits).reshape(k, 2, 1 << bits).astype(np.int64)
        if n is None:
            n = got[:, 0].sum(axis=1)
            rank = np.column_stack([np.maximum(n - 1, 0) // 2, n // 2])
        below = np.cumsum(got, axis=2)
        for i, t in np.ndindex(k, 2):
            digit = int(np.searchsorted(below[i, t], rank[i, t], "right")) if n[i] else 0
            rank[i, t] -= below[i, t, digit - 1] if digit else 0
            prefix[i, t] = (prefix[i, t] << np.uint64(bits)) | np.uint64(min(digit, (1 << bits) - 1))
    rows.unpersist()
    return {c: 0.5 * _number(prefix[i, 0]) + 0.5 * _number(prefix[i, 1]) if n[i] else None for i, c in enumerate(columns)}

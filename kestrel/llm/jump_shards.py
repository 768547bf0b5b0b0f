"""Sharding by jump consistent hashing (Lamping and Veach, 2014).

A stable key alone decides the shard: the key seeds a linear congruential
generator and the generator's draws say at which shard counts the key would
have jumped. No ring table is kept, and growing from ``n`` to ``n + 1`` shards
moves a key only if it moves into shard ``n``.

Rows get a gapless ``slot`` in their shard without sorting a shard in one
task: rows are dealt into small cells by a hash, equal rows are counted
before the shuffle, cells are numbered by prefix sums of a table of
(shard, cell) counts, and only the rows of one cell are ordered together.

Defined results: a NULL key is its own key value (all NULL keys share a
shard); a NULL text has no bytes and the CRC 0, an empty text likewise;
repeated rows each get a slot; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kestrel.llm.tables import saved

NULL_KEY = -(1 << 63)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key; all keys step together until none can jump."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    state = np.asarray(keys, np.int64).view(np.uint64).copy()
    at = np.zeros(len(state), np.int64)
    live = np.arange(len(state))
    while len(live):
        state[live] = state[live] * np.uint64(2862933555777941757) + np.uint64(1)
        draw = ((state[live] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
        to = ((at[live] + 1) * (float(1 << 31) / draw)).astype(np.int64)
        inside = to < shards
        live = live[inside]
        at[live] = to[inside]
    return at


def jump_column(key, shards: int):
    """``key`` (a long column) to its shard as an int column."""

    @F.pandas_udf(T.IntegerType())
    def shard(k: pd.Series) -> pd.Series:
        return pd.Series(jump(k.to_numpy(np.int64, na_value=NULL_KEY), shards).astype(np.int32))

    return shard(key)


def assign_shards(df: DataFrame, shards: int, key: str = "doc_id", text: str = "text", rows_per_cell: int = 100_000) -> DataFrame:
    """One row per input row: ``key, size, text_crc32, shard, slot,
    grown_shard`` where ``grown_shard`` is the shard with one shard more."""
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    slim = df.select(F.col(f"`{key}`").cast("long").alias("key"), (F.octet_length(t) + F.lit(1)).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"))
    n_cells = F.lit(max(1, -(-df.count() // (rows_per_cell * shards))) * 4)
    placed = saved(slim.withColumn("cell", F.pmod(F.xxhash64("key", "size", "text_crc32"), n_cells))
                   .groupBy("cell", "key", "size", "text_crc32").agg(F.count("*").alias("n"))
                   .withColumn("shard", jump_column(F.col("key"), shards))
                   .withColumn("grown_shard", jump_column(F.col("key"), shards + 1)))
    cells = placed.groupBy("shard", "cell").agg(F.sum("n").alias("rows"))
    before = F.coalesce(F.sum("rows").over(Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = cells.select("shard", "cell", before.alias("start"))
    order = Window.partitionBy("shard", "cell").orderBy("key", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    ranked = placed.withColumn("within", F.coalesce(F.sum("n").over(order), F.lit(0))).join(starts, ["shard", "cell"])
    copy = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))
    return ranked.select("key", "size", "text_crc32", "shard", "grown_shard", (F.col("start") + F.col("within")).alias("at"), copy.alias("copy")).select(
        "key", "size", "text_crc32", "shard", (F.col("at") + F.col("copy")).alias("slot"), "grown_shard")

"""Cumulative-snapshot collapse of logged conversations, and chat rendering.

A logger that stores a conversation after each answer leaves every earlier
state as a conversation of its own. Each conversation gets rolling hashes of
its turn prefixes; a conversation whose last hash is a proper prefix of a
longer one is a snapshot of it and goes, and of equal conversations the one
with the smallest id stays. Only the maximal ones are rendered.

The prefix hash is a running sum of position-salted turn hashes (two 64-bit
ones, summed exactly as decimals), so a prefix of a long conversation is the
sum of its blocks of turns plus a running sum in one block: no conversation
has to fit one task. Prefixes are made distinct before the anti-join, so a
first turn that very many conversations share is one row.

Defined results: rows that agree in all four columns count once (a turn
logged twice); turns are ordered by number, then by role and text, NULL
first; NULL roles and texts are values of their own and render as empty;
rows with a NULL id form one conversation; a NULL turn number sorts first;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kestrel.llm.tables import saved

BLOCK = 1024
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def turn_rows(df: DataFrame) -> DataFrame:
    """Distinct turns with their place ``pos`` (from 1) and block."""
    turns = df.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string")).distinct()
    block = F.coalesce(F.floor(F.col("turn") / F.lit(BLOCK)).cast("long"), F.lit(-(1 << 62)))
    turns = turns.withColumn("block", block)
    sizes = turns.groupBy("conv_id", "block").agg(F.count("*").alias("rows"))
    before = F.sum("rows").over(Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), F.coalesce(before, F.lit(0)).alias("start"),
                          F.sum("rows").over(Window.partitionBy("conv_id")).alias("n_turns"))
    order = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    ranked = turns.withColumn("within", F.row_number().over(order))
    same = ranked["conv_id"].eqNullSafe(starts["c"]) & (ranked["block"] == starts["b"])
    return ranked.join(starts, same).select("conv_id", "block", "turn", "role", "text", (F.col("start") + F.col("within")).alias("pos"), "n_turns")


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """``conv_id, pos, n_turns, h1, h2``: the hash pair of every turn prefix."""
    parts = [F.coalesce(F.col(c), F.lit("")) for c in ("role", "text")] + [F.col("role").isNull(), F.col("text").isNull()]
    slim = turns.select("conv_id", "block", "pos", "n_turns", F.xxhash64("pos", *parts).cast("decimal(20,0)").alias("a"),
                        F.xxhash64(*reversed(parts), F.col("pos")).cast("decimal(20,0)").alias("b"))
    sums = slim.groupBy("conv_id", "block").agg(F.sum("a").alias("sa"), F.sum("b").alias("sb"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("decimal(38,0)")
    starts = sums.select(F.col("conv_id").alias("c"), F.col("block").alias("k"), F.coalesce(F.sum("sa").over(earlier), zero).alias("a0"),
                         F.coalesce(F.sum("sb").over(earlier), zero).alias("b0"))
    run = Window.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = slim.select("conv_id", "block", "pos", "n_turns", F.sum("a").over(run).alias("a"), F.sum("b").over(run).alias("b"))
    both = rows.join(starts, rows["conv_id"].eqNullSafe(starts["c"]) & (rows["block"] == starts["k"]))
    return both.select("conv_id", "pos", "n_turns", (F.col("a") + F.col("a0")).cast("decimal(38,0)").alias("h1"),
                       (F.col("b") + F.col("b0")).cast("decimal(38,0)").alias("h2"))


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """``conv_id, n_turns, copies`` of the conversations that stay; ``copies``
    counts the equal ones each stands for."""
    hashes = prefix_hashes(turns)
    whole = (hashes.where(F.col("pos") == F.col("n_turns")).groupBy("n_turns", "h1", "h2")
             .agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies")))
    prefixes = hashes.where(F.col("pos") < F.col("n_turns")).select(F.col("pos").alias("n_turns"), "h1", "h2").distinct()
    return whole.join(prefixes, ["n_turns", "h1", "h2"], "left_anti").select("conv_id", "n_turns", "copies")


def collapse_and_render(df: DataFrame) -> DataFrame:
    """The maximal conversations, one row per turn in its rendered form:
    ``conv_id, pos, n_turns, copies, role, rendered``. The segments of a
    conversation in the order of ``pos`` are its chat text."""
    turns = saved(turn_rows(df))
    kept = maximal_conversations(turns).select(F.col("conv_id").alias("c"), "copies")
    rows = turns.join(kept, turns["conv_id"].eqNullSafe(kept["c"]))
    segment = F.concat(F.lit(OPEN), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(CLOSE + "\n"))
    return rows.select("conv_id", "pos", "n_turns", "copies", "role", segment.alias("rendered"))

"""Connected components of a link table by alternating large-star and
small-star steps (Kiveris et al., 2014): joins and grouped minima only, the
links stay on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.tables import discard, saved, written

MAX_STEPS = 200


def _minima(both: DataFrame) -> DataFrame:
    return both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.where(F.col("v") > F.col("u")).join(_minima(both), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u")
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where(F.col("u") != F.col("v"))


def components(links: DataFrame) -> DataFrame:
    """``u, v`` links of long ids to ``node, root``: every linked node and the
    smallest id of its component. Self-links and repeats do no harm. A round's
    links go once the next round's are written."""
    links = written(links.where(F.col("u") != F.col("v")).distinct())
    seen = None
    for _ in range(MAX_STEPS):
        after = written(_small_star(_large_star(links).where(F.col("u") != F.col("v")).distinct()).distinct())
        discard(links)
        links = after
        now = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            roots = saved(links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct())
            discard(links)
            return roots
        seen = now
    raise RuntimeError(f"components did not settle in {MAX_STEPS} steps")

"""Connected components by joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import discard, written


def components(links: DataFrame, max_iter: int = 100) -> DataFrame:
    """``a, b`` links to ``node, comp``: the smallest node of each linked node's
    component, by minima over neighbours and pointer jumping. A round's labels
    go once the next round's are written."""
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = written(both.select(F.col("a").alias("node"), F.col("a").alias("comp")).distinct())
    for _ in range(max_iter):
        nb = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("comp").alias("m"))
        new = labels.join(nb.withColumnRenamed("a", "node"), "node", "left").select("node", F.least("comp", F.coalesce("m", "comp")).alias("comp"), F.col("comp").alias("old"))
        new = new.join(new.select(F.col("node").alias("comp"), F.col("comp").alias("up")), "comp", "left").select("node", F.least("comp", F.coalesce("up", "comp")).alias("comp"), "old")
        after = written(new)
        discard(labels)
        settled = after.where("comp != old").isEmpty()
        if settled:
            done = after.select("node", "comp").checkpoint()
            discard(both, after)
            return done
        labels = after.select("node", "comp")
        labels._written_at = after._written_at
    discard(both, labels)
    raise RuntimeError(f"clusters did not settle in {max_iter} rounds; raise max_iter")

"""Scan profile (S1): per column rows, missing and distinct counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def profile(df: DataFrame, columns=None) -> DataFrame:
    """One aggregate pass → long ``(column, n_rows, n_missing, n_distinct)``.

    Spark plans the distinct counts as one expand + two-level aggregate, so
    every column is read once from the scan."""
    cols = columns or df.columns
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for i, c in enumerate(cols):
        aggs.append(F.count_if(F.col(f"`{c}`").isNull()).alias(f"m{i}"))
        aggs.append(F.countDistinct(F.col(f"`{c}`")).alias(f"d{i}"))
    wide = df.agg(*aggs)
    pairs = ", ".join(f"'{c}', n_rows, m{i}, d{i}" for i, c in enumerate(cols))
    return wide.selectExpr(f"stack({len(cols)}, {pairs}) AS (column, n_rows, n_missing, n_distinct)")

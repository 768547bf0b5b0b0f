"""Join helpers: broadcast only behind a size check (J5 and friends)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows below which a dimension side is broadcast explicitly. Above it the
# join is left to Spark (sort-merge, or AQE's runtime broadcast when the
# shuffled side turns out small).
BROADCAST_MAX_ROWS = 2_000_000


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> bool:
    """True when ``df`` has at most ``max_rows`` rows; counts at most
    ``max_rows + 1`` rows (a bounded job)."""
    return df.limit(max_rows + 1).count() <= max_rows


def bounded_broadcast(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    return F.broadcast(df) if fits_broadcast(df, max_rows) else df


def semi_join(facts: DataFrame, dim: DataFrame, on, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Rows of ``facts`` with a match in ``dim`` (``isin`` semantics)."""
    return facts.join(bounded_broadcast(dim, max_rows), on, "left_semi")


def anti_join(facts: DataFrame, dim: DataFrame, on, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    return facts.join(bounded_broadcast(dim, max_rows), on, "left_anti")

"""Global order without a single-partition window.

``Window.orderBy`` with no partition key makes Spark move every row to one
task. Here the rows are range partitioned on the whole order tuple (any
orderable types; Spark samples the cuts) and sorted within their ranges, so a
value that very many rows share is split by the columns behind it, and by a
hash of the row behind those. The ranges are written once to the checkpoint
folder with each row's place in its range; what crosses range borders (row
offsets, the last non-missing value, totals) is one small row a range, combined
by a window over that small table and broadcast back.

Writing the ranges once matters twice: the source is read once however many
branches use them, and a lost executor reads the same ranges again instead of
sampling others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

RANGE_COL = "_kr_range"
PLACE_COL = "_kr_place"
_PLACE_BITS = 33  # of monotonically_increasing_id


def _order_cols(order_by):
    return [F.col(c) if isinstance(c, str) else c for c in order_by]


def in_ranges(df: DataFrame, order_by, n_ranges: int | None = None) -> DataFrame:
    """``df`` with ``_kr_range`` and ``_kr_place``: rows in the order of
    ``order_by`` have ascending ranges, and ascending places from 0 inside one."""
    ensure_checkpoint_dir(df.sparkSession)
    order = _order_cols(order_by)
    split = [F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema if not f.dataType.simpleString().startswith(("map", "variant"))])]
    cut = df.repartitionByRange(n_ranges, *order, *split) if n_ranges else df.repartitionByRange(*order, *split)
    at = F.monotonically_increasing_id()
    placed = cut.sortWithinPartitions(*order, *split).withColumn("_kr_at", at)
    placed = placed.withColumn(RANGE_COL, F.shiftright("_kr_at", _PLACE_BITS).cast("int")).withColumn(PLACE_COL, F.col("_kr_at").bitwiseAND((1 << _PLACE_BITS) - 1))
    return placed.drop("_kr_at").checkpoint()


def _earlier(ranged: DataFrame, aggs: dict[str, Column]) -> DataFrame:
    """Per range the sums of ``aggs`` over all earlier ranges (one row a range)."""
    totals = ranged.groupBy(RANGE_COL).agg(*[a.alias(n) for n, a in aggs.items()])
    before = Window.orderBy(RANGE_COL).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(RANGE_COL, *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in aggs])


def global_row_number(df: DataFrame, order_by: list, name: str = "row_no",
                      n_ranges: int | None = None) -> DataFrame:
    """1-based row number over the whole table in ``order_by`` order: a row's
    place plus the rows of the ranges before it."""
    ranged = in_ranges(df, order_by, n_ranges)
    offsets = _earlier(ranged, {"_kr_off": F.count(F.lit(1))})
    return (ranged.join(F.broadcast(offsets), RANGE_COL)
            .withColumn(name, F.col("_kr_off") + F.col(PLACE_COL) + 1)
            .drop("_kr_off", RANGE_COL, PLACE_COL))


def global_fill(df: DataFrame, columns: list[str], order_by: list, backward: bool = False,
                n_ranges: int | None = None) -> DataFrame:
    """Forward (or backward) fill of ``columns`` in the global ``order_by``
    order. Within a range: ``last(ignorenulls)`` over a running frame;
    across ranges: the last (first) non-missing value of each range, carried
    by a window over the per-range table."""
    ranged = in_ranges(df, order_by, n_ranges)
    # a backward fill runs down the places: a frame that ends at the last row
    # would be read anew for every row
    w = Window.partitionBy(RANGE_COL).orderBy(F.col(PLACE_COL).desc() if backward else F.col(PLACE_COL))
    frame = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge_aggs, locals_ = [], {}
    for c in columns:
        locals_[c] = F.last(c, ignorenulls=True).over(frame)
        pick = F.min_by if backward else F.max_by
        edge_aggs.append(pick(F.col(c), F.when(F.col(c).isNotNull(), F.col(PLACE_COL))).alias(f"_kr_edge_{c}"))
    edges = ranged.groupBy(RANGE_COL).agg(*edge_aggs)
    wr = Window.orderBy(F.col(RANGE_COL).desc() if backward else F.col(RANGE_COL))
    carry_cols = [RANGE_COL]
    for c in columns:
        carry = F.last(f"_kr_edge_{c}", ignorenulls=True).over(
            wr.rowsBetween(Window.unboundedPreceding, -1))
        carry_cols.append(carry.alias(f"_kr_carry_{c}"))
    carries = edges.select(*carry_cols)
    out = ranged.select("*", *[locals_[c].alias(f"_kr_loc_{c}") for c in columns])
    out = out.join(F.broadcast(carries), RANGE_COL)
    for c in columns:
        out = out.withColumn(c, F.coalesce(F.col(f"_kr_loc_{c}"), F.col(f"_kr_carry_{c}")))
    return out.drop(RANGE_COL, PLACE_COL, *[f"_kr_loc_{c}" for c in columns], *[f"_kr_carry_{c}" for c in columns])


def global_cumsum(df: DataFrame, order_by: str, columns: list[str], descending: bool = False,
                  n_ranges: int | None = None) -> DataFrame:
    """Running sums (inclusive) of ``columns`` in ``order_by`` order over
    the whole table: per-range running sums plus the totals of the earlier
    ranges."""
    ranged = in_ranges(df, [F.col(order_by).desc() if descending else F.col(order_by)], n_ranges)
    prev = _earlier(ranged, {f"_kr_p_{c}": F.sum(c) for c in columns})
    w = Window.partitionBy(RANGE_COL).orderBy(PLACE_COL).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = ranged.select("*", *[F.sum(c).over(w).alias(f"_kr_l_{c}") for c in columns])
    out = out.join(F.broadcast(prev), RANGE_COL)
    for c in columns:
        out = out.withColumn(f"cum_{c}", F.col(f"_kr_l_{c}") + F.col(f"_kr_p_{c}"))
    return out.drop(RANGE_COL, PLACE_COL, *[f"_kr_l_{c}" for c in columns], *[f"_kr_p_{c}" for c in columns])

"""Cleaning operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from . import ordering
from .selection import exact_medians

_FLOAT_TYPES = (T.DoubleType, T.FloatType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def nan_to_null(df: DataFrame, columns=None) -> DataFrame:
    """Spark has NULL and NaN; the reference has one 'missing'. NaN → NULL."""
    cols = columns or [f.name for f in df.schema.fields if isinstance(f.dataType, _FLOAT_TYPES)]
    out = df
    for c in cols:
        out = out.withColumn(c, F.nanvl(F.col(_q(c)), F.lit(None).cast(df.schema[c].dataType)))
    return out


def count_na(df: DataFrame, columns=None) -> DataFrame:
    """Missing values per column in one aggregate pass → long
    ``(column, n_missing)``; NaN counts as missing for float columns."""
    cols = columns or df.columns
    aggs = []
    for c in cols:
        cond = F.col(_q(c)).isNull()
        if isinstance(df.schema[c].dataType, _FLOAT_TYPES):
            cond = cond | F.isnan(F.col(_q(c)))
        aggs.append(F.count_if(cond).alias(f"n{len(aggs)}"))
    wide = df.agg(*aggs)
    pairs = ", ".join(f"'{c.replace(chr(39), chr(39) * 2)}', n{i}" for i, c in enumerate(cols))
    return wide.selectExpr(f"stack({len(cols)}, {pairs}) AS (column, n_missing)")


def clean_strings(df: DataFrame, columns=None, rename: bool = True) -> DataFrame:
    """Clean column names and string values (see ``functions.text``)."""
    cols = columns if columns is not None else string_columns(df)
    exprs = []
    for c in df.columns:
        e = tx.clean_value(F.col(_q(c))) if c in cols else F.col(_q(c))
        exprs.append(e.alias(c))
    out = df.select(*exprs)
    if rename:
        out = out.toDF(*tx.clean_names(out.columns))
    return out


def convert_types(df: DataFrame, columns=None, mode: str = "coerce_all") -> DataFrame:
    """Coerce columns to double; unparseable values → NULL.

    ``coerce_all`` converts every listed column (text columns become all
    missing, as the reference does); ``numeric_only`` converts a string
    column only when none of its non-missing values fails to parse, decided
    by one aggregate pass."""
    cols = columns if columns is not None else df.columns
    if mode not in ("coerce_all", "numeric_only"):
        raise ValueError("mode must be 'coerce_all' or 'numeric_only'")
    cols = [c for c in cols if c in df.columns]
    if mode == "numeric_only":
        str_cols = [c for c in cols if isinstance(df.schema[c].dataType, T.StringType)]
        if str_cols:
            fails = df.agg(*[
                F.count_if(F.col(_q(c)).isNotNull() & tx.to_number(F.col(_q(c))).isNull()).alias(c)
                for c in str_cols]).first()
            cols = [c for c in cols if c not in str_cols or fails[c] == 0]
    exprs = []
    for c in df.columns:
        if c in cols:
            dt = df.schema[c].dataType
            if isinstance(dt, T.NumericType):
                e = F.nanvl(F.col(_q(c)).cast("double"), F.lit(None).cast("double"))
            else:
                e = tx.to_number(F.col(_q(c)))
            exprs.append(e.alias(c))
        else:
            exprs.append(F.col(_q(c)))
    return df.select(*exprs)


def drop_na(df: DataFrame, columns=None) -> DataFrame:
    """Drop rows with a missing value in any column / one column / a list."""
    if columns is None:
        return df.dropna(how="any")
    if isinstance(columns, str):
        return df.dropna(how="any", subset=[columns])
    if isinstance(columns, (list, tuple)):
        return df.dropna(how="any", subset=list(columns))
    raise ValueError("columns must be None, a column name or a list of names")


def fill_na(df: DataFrame, columns=None, method: str = "mean", value=0,
            order_by=None, partition_by=None) -> DataFrame:
    """Fill missing values.

    * ``mean`` / ``median``: numeric columns; means from one aggregate pass,
      exact medians by radix selection (no reducer holds a column).
    * ``value``: constant for numeric and string columns alike.
    * ``ffill`` / ``bfill``: in ``order_by`` order, per ``partition_by``
      group (window) or over the whole table (range-partitioned global
      fill, no single-partition exchange)."""
    if method in ("mean", "median"):
        cols = [c for c in (columns or numeric_columns(df)) if c in numeric_columns(df)]
        if not cols:
            return df
        if method == "median":
            stats = exact_medians(df, cols)
        else:
            stats = df.agg(*[F.avg(F.nanvl(F.col(_q(c)).cast("double"), F.lit(None).cast("double"))).alias(c)
                             for c in cols]).first().asDict()
        fills = {c: v for c, v in stats.items() if v is not None}
        out = nan_to_null(df, [c for c in cols if isinstance(df.schema[c].dataType, _FLOAT_TYPES)])
        exprs = [F.coalesce(F.col(_q(c)), F.lit(fills[c]).cast(df.schema[c].dataType)).alias(c)
                 if c in fills else F.col(_q(c)) for c in df.columns]
        return out.select(*exprs)
    if method == "value":
        cols = columns or df.columns
        out = nan_to_null(df, [c for c in cols if isinstance(df.schema[c].dataType, _FLOAT_TYPES)])
        exprs = []
        for c in df.columns:
            dt = df.schema[c].dataType
            if c in cols and isinstance(dt, T.NumericType):
                exprs.append(F.coalesce(F.col(_q(c)), F.lit(value).cast(dt)).alias(c))
            elif c in cols and isinstance(dt, T.StringType):
                exprs.append(F.coalesce(F.col(_q(c)), F.lit(str(value))).alias(c))
            else:
                exprs.append(F.col(_q(c)))
        return out.select(*exprs)
    if method in ("ffill", "bfill"):
        if not order_by:
            raise ValueError("ffill/bfill need order_by: a DataFrame has no row order")
        order_by = [order_by] if isinstance(order_by, str) else list(order_by)
        cols = columns or [c for c in df.columns if c not in order_by and c not in (partition_by or [])]
        out = nan_to_null(df, [c for c in cols if isinstance(df.schema[c].dataType, _FLOAT_TYPES)])
        if partition_by:
            # bfill is the same running frame, down the order
            order = [F.col(_q(c)).desc() for c in order_by] if method == "bfill" else order_by
            w = Window.partitionBy(*partition_by).orderBy(*order)
            frame = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
            fills = {c: F.last(F.col(_q(c)), ignorenulls=True).over(frame) for c in cols}
            return out.select(*[fills[c].alias(c) if c in fills else F.col(_q(c)) for c in df.columns])
        return ordering.global_fill(out, cols, order_by, backward=(method == "bfill"))
    raise ValueError("method must be 'mean', 'median', 'value', 'ffill' or 'bfill'")


def dedup_keep_first(df: DataFrame, keys: list[str], order_by: list[str]) -> DataFrame:
    """Keep the first row (in ``order_by`` order) of every key group.

    Written as ``min_by(row, order)`` aggregate rather than ``row_number``:
    the hash aggregate combines map-side, so a key holding a third of all
    rows is reduced before the shuffle instead of sorted in one task."""
    others = [c for c in df.columns if c not in keys]
    if not others:
        return df.dropDuplicates(keys)
    row = F.struct(*[F.col(_q(c)) for c in others])
    order = F.struct(*[F.col(_q(c)) for c in order_by])
    agg = df.groupBy(*keys).agg(F.min_by(row, order).alias("_kr_first"))
    return agg.select(*keys, "_kr_first.*").select(*df.columns)


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    """Union all by column name; columns absent from a frame → NULL."""
    if not frames:
        raise ValueError("nothing to union")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def clean_store_days(raw: DataFrame, order_by: list[str], min_revenue: float = 10.0,
                     keys=("store", "business_day")) -> DataFrame:
    """L1 store-day cleaning: coerce the six metric columns, keep revenue
    >= ``min_revenue`` (missing revenue dropped), first row per (store, day)."""
    metrics = ["revenue", "tickets", "rev_per_ticket", "member_sales", "member_tickets",
               "member_rev_per_ticket"]
    present = [c for c in metrics if c in raw.columns]
    typed = convert_types(raw, present)
    kept = typed.filter(F.col("revenue") >= F.lit(min_revenue))
    return dedup_keep_first(kept, list(keys), order_by)

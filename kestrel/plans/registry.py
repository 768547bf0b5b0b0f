"""Registry of named queries (each a Spark plan over the given tables) and
their independent DuckDB SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kestrel.session import ship_package

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
ROUND_COLS: dict[str, tuple] = {}

# Result doubles are rounded to this many significant digits on both sides
# of the oracle comparison so that summation order cannot change the hash.
SIG_DIGITS = 11


def round_expr(c, sig: int = SIG_DIGITS):
    """Round to ``sig`` significant digits with exact powers of ten:
    ``round(x * 10^k) / 10^k`` for k >= 0, ``round(x / 10^-k) * 10^-k``
    otherwise; Spark and DuckDB run the same IEEE steps."""
    e = F.floor(F.log10(F.abs(c)))
    k = (F.lit(sig - 1) - e).cast("double")
    up = F.round(c * F.pow(F.lit(10.0), k)) / F.pow(F.lit(10.0), k)
    down = F.round(c / F.pow(F.lit(10.0), -k)) * F.pow(F.lit(10.0), -k)
    return (F.when(c.isNull() | (c == 0) | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), c)
            .when(k >= 0, up).otherwise(down))


def finish(df: DataFrame, sig: int = SIG_DIGITS) -> DataFrame:
    """Round every double/float column (NaN becomes NULL first)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.col(f"`{f.name}`").cast("double")
            cols.append(round_expr(F.nanvl(c, F.lit(None).cast("double")), sig).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


def _round_sql(c: str, sig: int) -> str:
    x = f"CAST({c} AS DOUBLE)"
    k = f"({sig - 1} - floor(log10(abs({x}))))"
    return (f"CASE WHEN {x} IS NULL OR {x} = 0 OR isnan({x}) OR isinf({x}) THEN {x} "
            f"WHEN {k} >= 0 THEN round({x} * pow(10.0, {k})) / pow(10.0, {k}) "
            f"ELSE round({x} / pow(10.0, -{k})) * pow(10.0, -{k}) END")


def rounded_sql(sql: str, cols, sig: int = SIG_DIGITS) -> str:
    if not cols:
        return sql
    repl = ", ".join(f"{_round_sql(c, sig)} AS {c}" for c in cols)
    return f"SELECT * REPLACE ({repl}) FROM ({sql}) AS q"


def register(name: str, sql: str | None = None, round_cols=()):
    """Decorator: register ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""

    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark, sf_dir, _fn=fn, _check=sql is not None):
            ship_package(spark)
            # rounding only matters where an oracle compares values
            out = _fn(spark, sf_dir)
            return finish(out) if _check else out

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = rounded_sql(sql, round_cols)
            ROUND_COLS[name] = tuple(round_cols)
        return fn

    return deco

"""Scalar text, number and date expressions.

All are built-in Column expressions (JVM side, inside whole-stage codegen).
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's cleaning rules.
# Characters kept in column names: word characters, CJK, '-', '_', '%';
# every other run becomes '_' and '_' is stripped at both ends.
# Characters kept in string values: word characters, CJK, whitespace and
# the punctuation  . , ; ! ? ， 。 ； ！ ？ ( ) （ ） 【 】 [ ] ' " - /
# Python's Unicode \w is written as \p{L}\p{N}_ so Java, RE2 and Python
# agree; whitespace is \s plus Unicode separators.
# ---------------------------------------------------------------------------
NAME_DROP_PATTERN = r"[^\p{L}\p{N}_一-鿿\-%]+"
VALUE_DROP_PATTERN = r"""[^\p{L}\p{N}_一-鿿\s\p{Z}.,;!?，。；！？()（）【】\[\]'"\-/]+"""
# Python-side equivalent of NAME_DROP_PATTERN for column names (driver-side
# schema work only; no row data passes through it).
_PY_NAME_DROP = re.compile(r"[^\w一-鿿\-%]+")

# A string is numeric when it is a decimal or scientific literal (optionally
# signed and space padded) or an infinity literal. Spark's cast alone also
# accepts '5d' / '5f' (Java suffixes) which must stay missing.
NUMERIC_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
INF_PATTERN = r"^\s*[+-]?(?i)(inf|infinity)\s*$"
_EDGE_SPACE = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def clean_name(name: str) -> str:
    return _PY_NAME_DROP.sub("_", str(name)).strip("_")


def clean_names(names) -> list[str]:
    """Clean column names; names that collide get _2, _3, ... appended."""
    out, seen = [], {}
    for n in names:
        c = clean_name(n) or "col"
        if c in seen:
            seen[c] += 1
            c = f"{c}_{seen[c]}"
        else:
            seen[c] = 1
        out.append(c)
    return out


def clean_value(col: Column) -> Column:
    """Delete characters outside the kept class; the literal 'nan' → NULL."""
    cleaned = F.regexp_replace(col, VALUE_DROP_PATTERN, "")
    return F.when(cleaned == F.lit("nan"), F.lit(None).cast("string")).otherwise(cleaned)


def strip_text(col: Column) -> Column:
    """Python ``str.strip()``: remove leading/trailing Unicode whitespace."""
    return F.regexp_replace(col, _EDGE_SPACE, "")


def to_number(col: Column) -> Column:
    """``pd.to_numeric(errors='coerce')`` on a string column → double.

    Unparseable text → NULL; NaN never survives (it becomes NULL)."""
    s = col.cast("string")
    num = F.when(s.rlike(NUMERIC_PATTERN) | s.rlike(INF_PATTERN), s.try_cast("double"))
    return F.nanvl(num, F.lit(None).cast("double"))


def parse_yyyymmdd(col: Column) -> Column:
    """Business-day text → date: strip, drop a '.0…' suffix of an 8-digit
    value, remove every non-digit, parse yyyyMMdd; invalid → NULL."""
    s = strip_text(col.cast("string"))
    s = F.regexp_replace(s, r"^(\d{8})\.0*$", "$1")
    s = F.regexp_replace(s, r"[^\d]", "")
    return F.when(s.rlike(r"^\d{8}$"), F.to_date(F.try_to_timestamp(s, F.lit("yyyyMMdd"))))


DATE_FORMATS = ("yyyy-MM-dd", "yyyy/MM/dd", "yyyyMMdd", "yyyy-MM-dd HH:mm:ss",
                "yyyy/MM/dd HH:mm:ss", "yyyy.MM.dd", "MM/dd/yyyy")


def parse_date_any(col: Column, formats=DATE_FORMATS) -> Column:
    """Free-format date text → date; first format that parses wins."""
    s = strip_text(col.cast("string"))
    return F.to_date(F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in formats]))


def safe_ratio(num: Column, den: Column, otherwise=0.0) -> Column:
    """``num / den if den > 0 else otherwise`` (missing den → otherwise)."""
    return F.when(den > 0, num / den).otherwise(F.lit(otherwise))


def fmt_percent(col: Column, decimals: int = 1) -> Column:
    """Python ``f"{x:.1%}"`` with half-even rounding; missing → 'NA'."""
    v = F.bround(col.cast("double") * 100.0, decimals)
    return F.when(col.isNull(), F.lit("NA")).otherwise(
        F.concat(F.format_string(f"%.{decimals}f", v), F.lit("%")))


def fmt_fixed(col: Column, decimals: int) -> Column:
    """Python ``f"{x:.Nf}"`` with half-even rounding; missing → 'NA'."""
    return F.when(col.isNull(), F.lit("NA")).otherwise(
        F.format_string(f"%.{decimals}f", F.bround(col.cast("double"), decimals)))

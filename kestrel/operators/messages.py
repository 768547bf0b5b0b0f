"""Message-table operators (M1-M3): the batch forms of the chat history
semantics; ``kestrel.streaming.messages`` runs the same functions as
Structured Streaming jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from . import ordering

DEFAULT_USER = "anonymous"
RETAIN = 500


def clean_messages(df: DataFrame, user: str = "username", text: str = "text", stamp: bool = False) -> DataFrame:
    """M1: missing user → 'anonymous', text stripped (Unicode whitespace),
    empty text rejected; optionally stamped with the arrival time (a full
    timestamp, plus the reference's HH:mm:ss display form)."""
    out = (df.withColumn(user, F.coalesce(F.col(user), F.lit(DEFAULT_USER)))
           .withColumn(text, tx.strip_text(F.col(text)))
           .filter(F.col(text).isNotNull() & (F.length(text) > 0)))
    if stamp:
        out = out.withColumn("arrived_at", F.current_timestamp()).withColumn(
            "timestamp", F.date_format("arrived_at", "HH:mm:ss"))
    return out


def with_sequence(df: DataFrame, order_by: list[str], name: str = "seq") -> DataFrame:
    """Monotone message sequence (1-based) in ``order_by`` order, without a
    single-partition window."""
    return ordering.global_row_number(df, order_by, name)


def last_messages(df: DataFrame, order_by: list[str], n: int = RETAIN) -> DataFrame:
    """M2: the most recent ``n`` messages (the retention cap is the
    feature); planned as a per-partition top-n merged once."""
    return df.orderBy(*[F.col(c).desc() for c in order_by]).limit(n)


def messages_since(df: DataFrame, seq: str, last_seen: int) -> DataFrame:
    """M3: messages after the reader's cursor (a monotone sequence, not a
    list length, so the cursor keeps advancing under retention)."""
    return df.filter(F.col(seq) > F.lit(last_seen))

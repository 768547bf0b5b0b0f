"""Message-table queries over ``conversations`` (role as user name,
(conv_id, turn) as arrival order)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import messages as msg
from ..sources.tables import load_table
from .registry import register

_STRIP = "regexp_replace(text, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')"
_CLEAN = f"""(SELECT conv_id, turn, coalesce(role, 'anonymous') AS username, {_STRIP} AS text FROM conversations
             WHERE {_STRIP} IS NOT NULL AND length({_STRIP}) > 0)"""
# Fixed value: the reader cursor of the checked incremental read.
LAST_SEEN = 100


def _clean(spark, sf_dir):
    conv = load_table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.col("role").alias("username"), "text")
    return msg.clean_messages(conv)


@register("message_clean", sql=f"SELECT * FROM {_CLEAN}")
def message_clean(spark, sf_dir):
    """M1: default user, stripped text, empty text rejected."""
    return _clean(spark, sf_dir)


@register("last_500_messages", sql=f"SELECT * FROM {_CLEAN} ORDER BY conv_id DESC, turn DESC LIMIT 500")
def last_500_messages(spark, sf_dir):
    """M2: the 500 most recent messages."""
    return msg.last_messages(_clean(spark, sf_dir), ["conv_id", "turn"], 500)


@register("messages_since", sql=f"""
  SELECT * FROM (SELECT row_number() OVER (ORDER BY conv_id, turn) AS seq, * FROM {_CLEAN}) WHERE seq > {LAST_SEEN}
""")
def messages_since(spark, sf_dir):
    """M3: messages after a reader's cursor on a monotone sequence."""
    seq = msg.with_sequence(_clean(spark, sf_dir), ["conv_id", "turn"], "seq")
    return msg.messages_since(seq, "seq", LAST_SEEN).select("seq", "conv_id", "turn", "username", "text")

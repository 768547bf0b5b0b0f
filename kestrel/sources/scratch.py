"""Working tables of iterative jobs in the shared checkpoint folder.

Unlike ``checkpoint()`` a written table is compressed, read by column, has the
size Spark's planner sees (a checkpoint keeps the estimate of its plan, which
multiplies from round to round), and is deleted as soon as nothing needs it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from ..session import ensure_checkpoint_dir
from .files import delete_folder


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` to a folder of its own and read it back."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for t in tables:
        delete_folder(t.sparkSession, t._written_at)

"""Sums of vectors over the rows of a table, for iterative fits."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Partitions whose vectors go to the driver directly, and how many bytes of them.
DIRECT, DIRECT_BYTES = 16, 1 << 20
#: Smallest piece of a table that is worth a task of its own in a pass.
TASK_BYTES = 4 << 20


def packed(rows: DataFrame, n: int, row_bytes: int) -> DataFrame:
    """``rows`` kept in memory and on disk, in no more tasks than they fill."""
    tasks = max(1, min(rows.rdd.getNumPartitions(), n * row_bytes // TASK_BYTES))
    return rows.coalesce(tasks).persist(StorageLevel.MEMORY_AND_DISK)


def summed(rows: DataFrame, partial, length: int, add=np.add, start: float = 0.0) -> np.ndarray:
    """Add up (or combine by ``add``, from ``start``) the vectors of ``length``
    numbers that ``partial(batches)`` makes of each partition's Arrow batches.
    Beyond ``DIRECT`` partitions about sqrt(partitions) groups are combined in
    Spark first, and vectors of more than ``DIRECT_BYTES`` together become one
    there, so that the driver gets no more of them however many tasks there are."""
    parts = rows.rdd.getNumPartitions()
    groups = max(1, int(np.sqrt(parts)))

    def run(batches):
        from pyspark import TaskContext

        total = np.asarray(partial(b for b in batches if b.num_rows), "<f8")
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % groups], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "v"])

    def combined(vectors) -> np.ndarray:
        total = np.full(length, start)
        for v in vectors:
            add(total, np.frombuffer(v, "<f8"), out=total)
        return total

    def group(t: pa.Table) -> pa.Table:
        return pa.table({"v": pa.array([combined(v.as_buffer() for v in t.column("v")).tobytes()], pa.binary())})

    vectors, left = rows.mapInArrow(run, "part int, v binary"), parts
    if parts > DIRECT:
        vectors, left = vectors.groupBy("part").applyInArrow(group, "v binary"), groups
    if left > 1 and left * length * 8 > DIRECT_BYTES:
        vectors = vectors.select(F.lit(0).alias("part"), "v").groupBy("part").applyInArrow(group, "v binary")
    found = vectors.collect()
    return combined(bytes(r["v"]) for r in found)


def matrices(batches):
    """The first column's arrays of equal length, a matrix for each batch."""
    for b in batches:
        yield b.column(0).flatten().to_numpy().reshape(b.num_rows, -1)

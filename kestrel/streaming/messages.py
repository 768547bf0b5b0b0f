"""Structured Streaming forms of the message and drop-folder jobs
(M1-M5, S12).

* ``ingest_messages``: JSON message files → clean (M1) → append to a
  Parquet table; exactly-once through the checkpoint.
* ``retain_last``: ``foreachBatch`` merge of each micro-batch into a table
  holding only the last N messages (bounded state, M2).
* ``read_new_messages``: an incremental reader (M3) — the source offsets
  in the checkpoint are the cursor; each batch is a folder by its id.
* ``ingest_drop_folder``: drop-folder ingest (S12) with
  ``trigger(availableNow=True)``; processed files are archived, never
  deleted. ``ingest_changing_folder`` takes files whose headers differ.

A batch that is replayed after a crash writes the same folder again, or finds
that the pointer has passed it, so it never counts twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import messages as msg
from ..operators.clean import clean_strings
from ..sources import files

MESSAGE_SCHEMA = T.StructType([
    T.StructField("username", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("timestamp", T.StringType()),
])


def ingest_messages(spark: SparkSession, src_dir: str, table_dir: str, checkpoint: str,
                    available_now: bool = True):
    """Stream new message files into an append-only Parquet table."""
    stream = (spark.readStream.schema(MESSAGE_SCHEMA).option("multiLine", True).json(src_dir))
    cleaned = msg.clean_messages(stream.drop("timestamp"), stamp=True)
    w = (cleaned.writeStream.format("parquet").option("path", table_dir)
         .option("checkpointLocation", checkpoint).outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="5 seconds")
    return w.start()


ARRIVAL = ["epoch", "file_time", "file_path", "place"]
_POINTER = "_current"


def read_retained(spark: SparkSession, table_dir: str) -> DataFrame | None:
    """The retained table's current version, None before the first batch."""
    version = files.read_pointer(spark, f"{table_dir}/{_POINTER}")
    return None if version is None else spark.read.parquet(f"{table_dir}/version={version}")


def merge_retained(batch: DataFrame, epoch_id: int, table_dir: str, n: int) -> None:
    """Current version ∪ batch, the last ``n`` in the order of arrival, as a new
    version; then the pointer moves and the version before goes.

    A message's arrival is its batch, its file's time and name, and its place in
    the file, so the kept rows do not depend on how a batch was split. A crash
    before the pointer moves leaves the old version in force, and the replay
    writes the new folder again; one after it finds its own version and ends."""
    spark = batch.sparkSession
    current = files.read_pointer(spark, f"{table_dir}/{_POINTER}")
    if current is not None and int(current) >= epoch_id:
        return
    placed = batch.drop("timestamp").withColumn("place", F.monotonically_increasing_id())
    stamped = msg.clean_messages(placed, stamp=True).withColumn("epoch", F.lit(epoch_id).cast("long"))
    before = read_retained(spark, table_dir)
    everything = stamped if before is None else before.unionByName(stamped, allowMissingColumns=True)
    msg.last_messages(everything, ARRIVAL, n).write.mode("overwrite").parquet(f"{table_dir}/version={epoch_id}")
    files.write_pointer(spark, f"{table_dir}/{_POINTER}", str(epoch_id))
    if current is not None:
        files.delete_folder(spark, f"{table_dir}/version={current}")


def retain_last(spark: SparkSession, src_dir: str, table_dir: str, checkpoint: str, n: int = msg.RETAIN):
    """Keep only the last ``n`` messages in ``table_dir``."""
    stream = (spark.readStream.schema(MESSAGE_SCHEMA).option("multiLine", True).json(src_dir)
              .withColumns({"file_time": F.col("_metadata.file_modification_time"), "file_path": F.col("_metadata.file_path")}))
    return (stream.writeStream.foreachBatch(lambda batch, epoch: merge_retained(batch, epoch, table_dir, n))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def read_new_messages(spark: SparkSession, table_dir: str, checkpoint: str, sink_dir: str):
    """Incremental reader: each run delivers only rows not yet seen, a batch as
    the folder ``batch=<id>`` of ``sink_dir`` (written over by a replay)."""
    schema = spark.read.parquet(table_dir).schema
    stream = spark.readStream.schema(schema).parquet(table_dir)
    return (stream.writeStream.foreachBatch(lambda batch, i: batch.write.mode("overwrite").parquet(f"{sink_dir}/batch={i}"))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def delivered(spark: SparkSession, sink_dir: str, after: int = -1) -> DataFrame:
    """The messages of all batches later than ``after``, with their ``batch``."""
    return spark.read.parquet(sink_dir).where(F.col("batch") > after)


def ingest_drop_folder(spark: SparkSession, src_dir: str, schema: T.StructType, table_dir: str,
                       checkpoint: str, archive_dir: str):
    """CSV files dropped into ``src_dir`` → clean strings → one merged
    Parquet table; processed files move to ``archive_dir``."""
    stream = (spark.readStream.schema(schema).option("header", True)
              .option("cleanSource", "archive").option("sourceArchiveDir", archive_dir).csv(src_dir)
              .withColumn("source_file", F.col("_metadata.file_name")))
    cleaned = clean_strings(stream, rename=False)
    return (cleaned.writeStream.format("parquet").option("path", table_dir)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def merge_dropped(batch: DataFrame, epoch_id: int, table_dir: str, archive_dir: str) -> None:
    """One batch of dropped CSV files, whatever their headers: read by header,
    names and values cleaned, united by cleaned name (columns of one file that
    clean to one name are numbered), written as ``batch=<id>``; then the files
    move to ``archive_dir``. A replay finds moved files there. Files that cannot
    be read stay where they are and are listed in ``_failed/<id>``."""
    spark = batch.sparkSession
    paths = [r["path"] for r in batch.select("path").distinct().collect()]  # at most max_files
    there = [p if files.exists(spark, p) else f"{archive_dir}/{p.rsplit('/', 1)[1]}" for p in paths]
    rows, failed = files.read_csv_files(spark, sorted(there))
    if rows is not None:
        clean_strings(rows).write.mode("overwrite").parquet(f"{table_dir}/batch={epoch_id}")
    if failed:
        spark.createDataFrame(failed, "file string, error string").write.mode("overwrite").json(f"{table_dir}/_failed/{epoch_id}")
    bad = {f for f, _ in failed}
    for p in there:
        if p not in bad and not p.startswith(f"{archive_dir}/"):
            files.move_file(spark, p, archive_dir)


def ingest_changing_folder(spark: SparkSession, src_dir: str, table_dir: str, checkpoint: str, archive_dir: str, max_files: int = 1000):
    """CSV files dropped into ``src_dir``, headers may differ. The stream
    lists files (their contents are not read by it), ``max_files`` a batch."""
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()),
                           T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])
    stream = (spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.csv")
              .option("maxFilesPerTrigger", max_files).load(src_dir).select("path"))
    return (stream.writeStream.foreachBatch(lambda batch, i: merge_dropped(batch, i, table_dir, archive_dir))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def read_dropped(spark: SparkSession, table_dir: str) -> DataFrame:
    """The whole table under the schema of all batches so far."""
    return spark.read.option("mergeSchema", True).parquet(table_dir)

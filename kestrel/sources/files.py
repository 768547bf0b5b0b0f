"""File sources and sinks.

Folders of CSV files are read as one scan per distinct header (files with
another column order are never aligned by position), each file tagged
with its name from ``_metadata``, and the scans are unioned by column
name. Only the first line of each file is read on the driver to group
the headers (file metadata, not rows)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.clean import union_by_name


def read_csv(spark: SparkSession, path, schema: T.StructType | None = None, all_strings: bool = True,
             encoding: str = "UTF-8", multi_line: bool = False) -> DataFrame:
    """CSV with header; all columns as text unless a schema is given (no
    type inference). A UTF-8 BOM in the header is dropped by the reader.
    Doubled quotes stand for a quote. ``multi_line`` reads quoted line breaks;
    such files cannot be split, so it is off by default."""
    r = spark.read.option("header", True).option("encoding", encoding).option("quote", '"').option("escape", '"').option("multiLine", multi_line)
    if schema is not None:
        r = r.schema(schema)
    elif not all_strings:
        r = r.option("inferSchema", True)
    return r.csv(path)


def _list_files(spark: SparkSession, path: str, suffix: str) -> list[str]:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(conf)
    out = []
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        if st.isFile() and name.lower().endswith(suffix):
            out.append(st.getPath().toString())
    return sorted(out)


def _first_line(spark: SparkSession, file: str) -> str:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(file)
    stream = p.getFileSystem(conf).open(p)
    try:
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8"))
        line = reader.readLine() or ""
    finally:
        stream.close()
    return line.lstrip("﻿")


def read_csv_folder(spark: SparkSession, path: str, tag: str = "source_file") -> tuple[DataFrame | None, list]:
    """Every ``*.csv`` of a folder, grouped by header, tagged with
    its file name, unioned by name. Unreadable files are reported and
    skipped. Returns (table or None, [(file, error)])."""
    return read_csv_files(spark, _list_files(spark, path, ".csv"), tag)


def read_csv_files(spark: SparkSession, paths: list[str], tag: str = "source_file") -> tuple[DataFrame | None, list]:
    """``read_csv_folder`` over the given files."""
    groups: dict[str, list[str]] = {}
    failed = []
    for f in paths:
        try:
            groups.setdefault(_first_line(spark, f), []).append(f)
        except Exception as e:  # noqa: BLE001
            failed.append((f, str(e)))
    frames = []
    for header, files in groups.items():
        try:
            df = read_csv(spark, files).withColumn(tag, F.col("_metadata.file_name"))
            df.schema  # noqa: B018 - resolve now so a broken group is reported here
            frames.append(df)
        except Exception as e:  # noqa: BLE001
            failed += [(f, str(e)) for f in files]
    return (union_by_name(frames) if frames else None), failed


def read_json_array(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A JSON file holding one array of objects (multi-line); input that
    is not an array ends up in ``_corrupt_record``."""
    r = spark.read.option("multiLine", True).option("mode", "PERMISSIVE")
    if schema is not None:
        r = r.schema(schema)
    return r.json(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by=None, mode: str = "overwrite"):
    """S9/S10/S13 sink: Parquet by default; CSV with header (plain UTF-8:
    Spark writes no BOM); ``partition_by`` e.g. the report parameters."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


# --- small files and folders in whatever store a path names -------------------

def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def delete_folder(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def move_file(spark: SparkSession, path: str, folder: str) -> None:
    """Move one file into ``folder``, keeping its name; a file that is gone is no error."""
    fs, p = _fs(spark, path)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(folder)
    fs.mkdirs(target)
    if fs.exists(p) and not fs.rename(p, jvm.org.apache.hadoop.fs.Path(target, p.getName())):
        raise OSError(f"could not move {path} to {folder}")


def read_pointer(spark: SparkSession, path: str) -> str | None:
    """The one line of a pointer file, None where there is none."""
    return _first_line(spark, path) if exists(spark, path) else None


def write_pointer(spark: SparkSession, path: str, line: str) -> None:
    """Set a pointer file by a rename over the old one, so a reader sees the old
    line or the new one and nothing else."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    fs, draft = _fs(spark, f"{path}.draft")
    out = fs.create(draft, True)
    out.write(bytearray(line.encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri() if draft.toUri().getScheme() else fs.getUri(), conf)
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    rename = spark.sparkContext._gateway.new_array(kind, 1)
    rename[0] = kind.OVERWRITE
    context.rename(fs.makeQualified(draft), fs.makeQualified(jvm.org.apache.hadoop.fs.Path(path)), rename)

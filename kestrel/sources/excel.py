"""Excel (.xlsx) source as a Spark job.

``binaryFile`` lists and reads the workbooks; ``mapInPandas`` decodes one
workbook per task and emits long rows ``(source_file, row_no, cells)`` of
the first sheet, all values as text. The decode itself is a small codec
(an xlsx file is a zip of XML parts); no workbook passes through the
driver. Only the header rows (one per file) are collected to build the
column lists."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main",
       "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships",
       "pr": "http://schemas.openxmlformats.org/package/2006/relationships"}
_COL = re.compile(r"([A-Z]+)(\d+)")
LONG_SCHEMA = "source_file string, row_no long, cells array<string>, error string"


def _col_index(ref: str) -> int:
    letters = _COL.match(ref).group(1)
    n = 0
    for ch in letters:
        n = n * 26 + (ord(ch) - 64)
    return n - 1


def decode_first_sheet(data: bytes) -> list[list[str | None]]:
    """Rows of the first worksheet as lists of text (None for blanks)."""
    z = zipfile.ZipFile(io.BytesIO(data))
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        root = ET.fromstring(z.read("xl/sharedStrings.xml"))
        for si in root.findall("m:si", _NS):
            shared.append("".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")))
    wb = ET.fromstring(z.read("xl/workbook.xml"))
    first = wb.find("m:sheets/m:sheet", _NS)
    rid = first.get(f"{{{_NS['r']}}}id")
    rels = ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))
    target = next(r.get("Target") for r in rels.findall("pr:Relationship", _NS) if r.get("Id") == rid)
    path = target.lstrip("/") if target.startswith("/") else "xl/" + target
    sheet = ET.fromstring(z.read(path))
    rows = []
    for row in sheet.iter(f"{{{_NS['m']}}}row"):
        vals = {}
        for c in row.findall("m:c", _NS):
            t = c.get("t")
            v = c.find("m:v", _NS)
            if t == "s" and v is not None:
                val = shared[int(v.text)]
            elif t == "inlineStr":
                val = "".join(x.text or "" for x in c.iter(f"{{{_NS['m']}}}t"))
            else:
                val = v.text if v is not None else None
            vals[_col_index(c.get("r"))] = val
        width = max(vals) + 1 if vals else 0
        rows.append([vals.get(i) for i in range(width)])
    return rows


def _decode_batches(batches):
    for pdf in batches:
        out = []
        for path, content in zip(pdf["path"], pdf["content"]):
            name = path.rsplit("/", 1)[-1]
            try:
                for i, r in enumerate(decode_first_sheet(bytes(content))):
                    out.append((name, i, r, None))
            except Exception as e:  # noqa: BLE001 - unreadable workbook is reported, not fatal
                out.append((name, -1, None, f"{type(e).__name__}: {e}"))
        yield pd.DataFrame(out, columns=["source_file", "row_no", "cells", "error"])


def read_excel_long(spark: SparkSession, path: str, glob: str = "*.xlsx") -> DataFrame:
    """Long form of every workbook's first sheet (one task per file)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select("path", "content").mapInPandas(_decode_batches, LONG_SCHEMA)


def _unique(names: list[str]) -> list[str]:
    """Repeated names get ``_1``, ``_2`` ... in their order."""
    out: list[str] = []
    for n in names:
        k, name = 0, n
        while name in out:
            k += 1
            name = f"{n}_{k}"
        out.append(name)
    return out


def read_excel(spark: SparkSession, path: str, skiprows: int = 0, glob: str = "*.xlsx") -> tuple[DataFrame, list]:
    """Workbooks → one table (string columns, union by name); the first
    row after ``skiprows`` is the header. Rows shorter than the header are
    filled with NULL, cells beyond it become ``col<i>`` columns. Returns (table, failed files)."""
    long = read_excel_long(spark, path, glob).cache()
    failed = [(r["source_file"], r["error"]) for r in long.filter(F.col("error").isNotNull()).collect()]
    ok = long.filter(F.col("error").isNull() & (F.col("row_no") >= skiprows))
    headers = {r["source_file"]: r["cells"] for r in ok.filter(F.col("row_no") == skiprows).collect()}
    frames = []
    widths = {r["source_file"]: r["w"] for r in ok.groupBy("source_file").agg(F.max(F.size("cells")).alias("w")).collect()}
    by_header: dict[tuple, list] = {}
    for f, h in headers.items():
        wide = list(h) + [None] * (widths[f] - len(h))
        by_header.setdefault(tuple(wide), []).append(f)
    for h, files in by_header.items():
        names = _unique([str(x) if x is not None else f"col{i}" for i, x in enumerate(h)])
        part = ok.filter(F.col("source_file").isin(files) & (F.col("row_no") > skiprows))
        frames.append(part.select(*[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)], "source_file"))
    if not frames:
        return spark.createDataFrame([], "source_file string"), failed
    out = frames[0]
    for fr in frames[1:]:
        out = out.unionByName(fr, allowMissingColumns=True)
    return out, failed


def load_base_tables(spark: SparkSession, path: str, register: bool = True) -> dict[str, DataFrame]:
    """Every workbook of a folder as a named table (key = file name up
    to the first '.'); two files with the same key are an error."""
    long = read_excel_long(spark, path)
    names = sorted({r[0] for r in long.select("source_file").distinct().collect()})
    keys: dict[str, str] = {}
    for n in names:
        k = n.split(".")[0]
        if k in keys:
            raise ValueError(f"{n!r} and {keys[k]!r} both map to table {k!r}")
        keys[k] = n
    out = {}
    for k, n in keys.items():
        df, _ = read_excel(spark, f"{path.rstrip('/')}/{n}", glob=n)
        out[k] = df.drop("source_file")
        if register:
            out[k].createOrReplaceTempView(k.replace(" ", "_"))
    return out


def excel_to_csv(spark: SparkSession, src: str, dst: str) -> list:
    """Convert a folder of workbooks to CSV, one folder per source
    file (``partitionBy``); sources are never deleted."""
    df, failed = read_excel(spark, src)
    df.write.mode("overwrite").option("header", True).partitionBy("source_file").csv(dst)
    return failed

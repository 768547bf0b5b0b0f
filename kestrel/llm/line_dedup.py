"""Line de-duplication by sorted key ranges, with keep bitmaps as the result.

A line's key is the line without white space at its ends, ASCII letters in
lower case. Each document sends one row per distinct key: the 128-bit hash,
who it is, the first place and the further places. The rows are range
partitioned on (hash, document, position) and sorted so within a partition; a
stream over the sorted rows sees each key's documents in order, counts them
and decides. As the document is part of the range key, the rows of a key that
very many documents hold are spread over as many partitions as they need.

Only the first and the last key of a partition can go on in a neighbour. For
those a partition reports its count and the rows it cannot decide alone: fewer
than ``min_docs`` of them, as with more it knows the outcome. The reports are
summed (two keys a partition, so they are broadcast) and settle the rest.

Decisions go back as a bitmap per document, not as text: one bit a line, set
where the line stays, zlib-compressed; lines beyond its end stay, and a
document that loses no line has no bitmap. ``apply_bitmaps`` joins them to the
texts.

Defined results: NULL text is one empty line; empty keys and keys shorter
than ``min_chars`` code points are never dropped; rows that agree in id and
text are one document and count once; rows with a NULL id are documents told
apart by their text; a text of any length is one row, and its lines are read
one by one; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.tables import saved, texts

MIN_DOCS = 10
MIN_CHARS = 1
FLUSH_ROWS = 20_000
#: Documents a task remembers so as not to send repeats of one row again.
RECENT = 1 << 16

_KEYS = "h1 long, h2 long, doc_id long, th long, pos int, more binary"
_DROP, _PENDING, _COUNT, _HEAD = 0, 1, 2, 3
_DECIDED = "kind int, part int, n long, h1 long, h2 long, doc_id long, th long, pos int, more binary"


def key_rows(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row for each distinct line key of a document: its hash, the document
    (``doc_id`` and the hash ``th`` of its text), the first position and, as
    packed 32-bit numbers, the further ones."""

    def split(batches):
        recent: dict = {}
        digests, rows = [], []

        def flush():
            h = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            cols = list(zip(*rows, strict=True))
            out = [pa.array(h[:, 0]), pa.array(h[:, 1]), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True))]
            digests.clear()
            rows.clear()
            return pa.RecordBatch.from_arrays(out, ["h1", "h2", "doc_id", "th", "pos", "more"])

        for b in batches:
            for doc, th, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()), strict=True):
                if (doc, th) in recent or not raw.is_valid:
                    continue
                if len(recent) >= RECENT:
                    recent.pop(next(iter(recent)))
                recent[doc, th] = None
                found: dict = {}
                for i, line in enumerate(raw.as_py().lower().split(b"\n")):
                    if key := line.strip():
                        found.setdefault(key, []).append(i)
                for key, at in found.items():
                    if min_chars > 1 and len(key.decode("utf-8", "replace")) < min_chars:
                        continue
                    digests.append(xxhash.xxh3_128_digest(key))
                    rows.append((doc, th, at[0], np.array(at[1:], "<i4").tobytes() if len(at) > 1 else None))
                    if len(rows) >= FLUSH_ROWS:
                        yield flush()
        if rows:
            yield flush()

    return docs.mapInArrow(split, _KEYS)


def _stream(min_docs: int, keep_first: bool):
    """The pass over one partition's sorted key rows."""

    def decide(batches):
        part = TaskContext.get().partitionId()
        out: list[tuple] = []
        run: dict = {"key": None}
        first_run = True

        def close(last: bool):
            nonlocal first_run
            if run["key"] is None:
                return
            n, key = run["n"], run["key"]
            if first_run or last:
                out.append((_COUNT, part, n, *key, None, None, None, None))
                if n < min_docs:
                    out.extend((_HEAD if keep_first and i == 0 else _PENDING, part, n, *key, *row) for i, row in enumerate(run["held"]))
            first_run = False

        def add(row):
            """One more document of the open run."""
            run["n"] += 1
            if run["n"] < min_docs:
                run["held"].append(row)
                return
            for i, r in enumerate([*run["held"], row] if run["n"] == min_docs else [row]):
                head = keep_first and run["n"] == min_docs and i == 0
                if head and first_run:
                    out.append((_HEAD, part, run["n"], *run["key"], *r))
                elif not head:
                    out.append((_DROP, part, 0, None, None, *r))
                elif r[3] is not None:
                    out.append((_DROP, part, 0, None, None, r[0], r[1], None, r[3]))
            run["held"] = []

        def flush():
            cols = zip(*out, strict=True)
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["kind", "part", "n", "h1", "h2", "doc_id", "th", "pos", "more"])
            out.clear()
            return batch

        for b in batches:
            if not b.num_rows:
                continue
            h1, h2 = (b.column(i).to_numpy() for i in (0, 1))
            start = np.flatnonzero(np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
            end = np.append(start[1:], len(h1))
            wide = end - start >= min_docs
            wide[[0, -1]] = True  # the edges of a batch may go on in the next one
            # a run inside one batch with fewer rows than min_docs keeps its lines
            for s, e in zip(start[wide].tolist(), end[wide].tolist(), strict=True):
                key = (int(h1[s]), int(h2[s]))
                if key != run["key"]:
                    close(False)
                    run = {"key": key, "n": 0, "held": [], "last": None}
                rows = zip(*(b.column(i).slice(s, e - s).to_pylist() for i in range(2, 6)), strict=True)
                for row in rows:
                    if run["last"] != row[:2]:  # repeats of a row are one document
                        run["last"] = row[:2]
                        add(row)
                if len(out) >= FLUSH_ROWS:
                    yield flush()
        close(True)
        if out:
            yield flush()

    return decide


def dropped_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, keep_first: bool = False) -> DataFrame:
    """``doc_id, th, pos, more``: the lines whose key stands in at least
    ``min_docs`` documents; with ``keep_first`` without the key's first line in
    the order of document and position."""
    if min_docs < 1:
        raise ValueError("min_docs must be at least 1")
    ranges = key_rows(docs, min_chars).repartitionByRange("h1", "h2", "doc_id", "th", "pos").sortWithinPartitions("h1", "h2", "doc_id", "th", "pos")
    found = saved(ranges.mapInArrow(_stream(min_docs, keep_first), _DECIDED))
    totals = found.where(F.col("kind") == _COUNT).groupBy("h1", "h2").agg(F.sum("n").alias("total"), F.min("part").alias("start"))
    open_rows = found.where(F.col("kind").isin(_PENDING, _HEAD)).join(F.broadcast(totals), ["h1", "h2"]).where(F.col("total") >= min_docs)
    very_first = (F.col("kind") == _HEAD) & (F.col("start") == F.col("part"))
    settled = open_rows.select("doc_id", "th", F.when(~very_first, F.col("pos")).alias("pos"), "more")
    return found.where(F.col("kind") == _DROP).select("doc_id", "th", "pos", "more").unionByName(settled).where(F.col("pos").isNotNull() | F.col("more").isNotNull())


def _packed(batches):
    for b in batches:
        maps, counts = [], []
        for group in b.column(2).to_pylist():
            at = np.concatenate([np.array([x["pos"] for x in group if x["pos"] is not None], np.int64), *(np.frombuffer(x["more"], "<i4") for x in group if x["more"])])
            keep = np.ones(int(at.max()) // 8 * 8 + 8, np.uint8)  # whole bytes
            keep[at] = 0
            counts.append(len(at))
            maps.append(zlib.compress(np.packbits(keep).tobytes()))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(counts, pa.int64()), pa.array(maps, pa.binary())], ["doc_id", "th", "n_dropped", "keep"])


def _named(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    return texts(df, doc_id, text).select("doc_id", F.xxhash64("text").alias("th"), "text")


def keep_bitmaps(df: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, keep_first: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, th, n_dropped, keep`` of the documents that lose lines; ``th``
    is ``xxhash64(text)``."""
    lines = dropped_lines(_named(df, doc_id, text), min_docs, min_chars, keep_first)
    return lines.groupBy("doc_id", "th").agg(F.collect_list(F.struct("pos", "more")).alias("lines")).mapInArrow(_packed, "doc_id long, th long, n_dropped long, keep binary")


def kept_lines(raw: bytes, keep: bytes | None) -> bytes:
    """The text of a document under its bitmap."""
    if keep is None:
        return raw
    lines = raw.split(b"\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8))
    return b"\n".join(x for i, x in enumerate(lines) if i >= len(bits) or bits[i])


def _applied(batches):
    for b in batches:
        raws = (x.as_py() or b"" for x in b.column(1).cast(pa.binary()))
        done = [(raw.count(b"\n") + 1, kept_lines(raw, keep.as_py())) for raw, keep in zip(raws, b.column(3), strict=True)]
        kept = pa.array([x[1] for x in done], pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in done], pa.int64()), b.column(2), kept], ["doc_id", "n_lines", "n_dropped", "text"])


def apply_bitmaps(df: DataFrame, bitmaps: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_lines, n_dropped, text`` of all rows of ``df``: the texts
    without the lines that the bitmaps drop."""
    docs = _named(df, doc_id, text)
    maps = bitmaps.select(F.col("doc_id").alias("map_id"), F.col("th").alias("map_th"), F.col("n_dropped"), "keep")
    both = docs.join(maps, docs["doc_id"].eqNullSafe(maps["map_id"]) & (docs["th"] == maps["map_th"]), "left")
    return both.select("doc_id", "text", F.coalesce("n_dropped", F.lit(0).cast("long")).alias("n_dropped"), "keep").mapInArrow(_applied, "doc_id long, n_lines long, n_dropped long, text string")


def drop_common_lines(df: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, keep_first: bool = False) -> DataFrame:
    """Every document without its common lines: ``doc_id, n_lines, n_dropped, text``."""
    return apply_bitmaps(df, keep_bitmaps(df, min_docs, min_chars, keep_first))

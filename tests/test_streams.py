"""The streams' exactness: arrival order, replays, crashes, second runs."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from kestrel.sources import files
from kestrel.streaming import messages as sm


def _folders(*names):
    base = tempfile.mkdtemp(prefix="kestrel-stream-")
    return [os.path.join(base, n) for n in names]


def _drop(folder, name, texts, when=None):
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, name)
    with open(path, "w") as f:
        json.dump([{"username": "u", "text": t} for t in texts], f)
    if when:
        os.utime(path, (when, when))


def _texts(df):
    return [r.text for r in df.orderBy(*sm.ARRIVAL).collect()]


def test_reader_delivers_only_what_is_new(spark):
    src, table, ck, ck2, sink = _folders("src", "table", "ck", "ck2", "sink")
    seen = -1
    for i in range(3):
        _drop(src, f"m{i}.json", [f"{i}-a", f"{i}-b"])
        sm.ingest_messages(spark, src, table, ck).awaitTermination()
        sm.read_new_messages(spark, table, ck2, sink).awaitTermination()
        new = sm.delivered(spark, sink, seen).collect()
        assert sorted(r.text for r in new) == [f"{i}-a", f"{i}-b"]
        seen = max(r.batch for r in new)
    sm.read_new_messages(spark, table, ck2, sink).awaitTermination()  # nothing new: nothing delivered
    assert sm.delivered(spark, sink, seen).count() == 0 and sm.delivered(spark, sink).count() == 6


def test_retention_order_inside_a_batch_larger_than_n(spark):
    src, table, ck = _folders("src", "table", "ck")
    _drop(src, "late.json", [f"late-{i}" for i in range(4)], 2_000_000_000)
    _drop(src, "early.json", [f"early-{i}" for i in range(9)], 1_000_000_000)
    sm.retain_last(spark, src, table, ck, n=6).awaitTermination()
    assert _texts(sm.read_retained(spark, table)) == ["early-7", "early-8", "late-0", "late-1", "late-2", "late-3"]
    _drop(src, "next.json", ["next"], 1_999_999_000)  # a later batch arrives later, whatever its file's time
    sm.retain_last(spark, src, table, ck, n=6).awaitTermination()
    assert _texts(sm.read_retained(spark, table)) == ["early-8", "late-0", "late-1", "late-2", "late-3", "next"]
    assert sorted(x for x in os.listdir(table) if x.startswith("version")) == ["version=1"]


def _batch(spark, texts, when):
    rows = [("u", t, None) for t in texts]
    return spark.createDataFrame(rows, sm.MESSAGE_SCHEMA).coalesce(1).withColumns({"file_time": F.lit(when).cast("timestamp"), "file_path": F.lit("f")})


def test_retention_survives_replays_and_crashes(spark, monkeypatch):
    (table,) = _folders("table")
    first, second = _batch(spark, ["a", "b", "c"], 1), _batch(spark, ["d", "e"], 2)
    sm.merge_retained(first, 0, table, 4)
    sm.merge_retained(first, 0, table, 4)  # replay after the pointer has moved
    assert _texts(sm.read_retained(spark, table)) == ["a", "b", "c"]

    def crash(*_):
        raise OSError("crash between folder and pointer")

    with monkeypatch.context() as m:
        m.setattr(files, "write_pointer", crash)
        with pytest.raises(OSError):
            sm.merge_retained(second, 1, table, 4)
    assert _texts(sm.read_retained(spark, table)) == ["a", "b", "c"]  # the old version is in force
    sm.merge_retained(second, 1, table, 4)
    assert _texts(sm.read_retained(spark, table)) == ["b", "c", "d", "e"]


def test_drop_folder_with_changing_headers(spark):
    src, table, ck, archive = _folders("src", "table", "ck", "archive")
    os.makedirs(src)
    for name, text in (("a.csv", "store,item\ns1,ab+c\n"), ("b.csv", "item,store,price \nxy,s2,3\n")):
        with open(os.path.join(src, name), "w") as f:
            f.write(text)
    sm.ingest_changing_folder(spark, src, table, ck, archive).awaitTermination()
    assert sorted(os.listdir(archive)) == ["a.csv", "b.csv"] and not os.listdir(src)
    with open(os.path.join(src, "c.csv"), "w") as f:
        f.write("region,store\nnorth,s3\n")
    sm.ingest_changing_folder(spark, src, table, ck, archive).awaitTermination()
    rows = sorted((r.store, r.item, r.price, r.region, r.source_file) for r in sm.read_dropped(spark, table).collect())
    assert rows == [("s1", "abc", None, None, "a.csv"), ("s2", "xy", "3", None, "b.csv"), ("s3", None, None, "north", "c.csv")]
    # a replay of the last batch, its file in the archive by now, changes nothing
    batch = spark.createDataFrame([(os.path.join(src, "c.csv"),)], "path string")
    sm.merge_dropped(batch, 1, table, archive)
    assert sm.read_dropped(spark, table).count() == 3

import io
import os
import tempfile
import zipfile

from kestrel.sources import excel, files
from kestrel.streaming import messages as sm


def _xlsx(path, rows):
    ss = sorted({c for r in rows for c in r})
    idx = {s: i for i, s in enumerate(ss)}
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    sheet = "".join(f'<row r="{i + 1}">' + "".join(
        f'<c r="{chr(65 + j)}{i + 1}" t="s"><v>{idx[c]}</v></c>' for j, c in enumerate(r)) + "</row>"
        for i, r in enumerate(rows))
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} {rel}><sheets><sheet name="S" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                   '<Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si><t>{s}</t></si>" for s in ss) + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{sheet}</sheetData></worksheet>")


def test_csv_folder_groups_headers_and_tags_files(spark):
    d = tempfile.mkdtemp(prefix="kestrel-io-")
    with open(os.path.join(d, "a.csv"), "w", encoding="utf-8-sig") as f:
        f.write("store,v\ns1,1\n")
    with open(os.path.join(d, "b.csv"), "w") as f:
        f.write("v,store,z\n2,s2,x\n")
    df, failed = files.read_csv_folder(spark, d)
    rows = sorted((r.store, r.v, r.z, r.source_file) for r in df.collect())
    assert rows == [("s1", "1", None, "a.csv"), ("s2", "2", "x", "b.csv")] and not failed


def test_excel_source(spark):
    d = tempfile.mkdtemp(prefix="kestrel-xl-")
    _xlsx(os.path.join(d, "shops.xlsx"), [["store", "city"], ["s1", "x"], ["s2", "y"]])
    with open(os.path.join(d, "bad.xlsx"), "wb") as f:
        f.write(b"not a zip")
    df, failed = excel.read_excel(spark, d)
    assert sorted((r.store, r.city) for r in df.collect()) == [("s1", "x"), ("s2", "y")]
    assert [f for f, _ in failed] == ["bad.xlsx"]


def test_message_stream_restart_has_no_duplicates(spark):
    base = tempfile.mkdtemp(prefix="kestrel-msg-")
    src, out, ck = (os.path.join(base, x) for x in ("src", "out", "ck"))
    os.makedirs(src)
    with open(os.path.join(src, "m1.json"), "w") as f:
        f.write('[{"username": null, "text": "  hi  "}, {"username": "u", "text": "   "}]')
    sm.ingest_messages(spark, src, out, ck).awaitTermination()
    with open(os.path.join(src, "m2.json"), "w") as f:
        f.write('[{"username": "u", "text": "second"}]')
    sm.ingest_messages(spark, src, out, ck).awaitTermination()
    rows = sorted((r.username, r.text) for r in spark.read.parquet(out).collect())
    assert rows == [("anonymous", "hi"), ("u", "second")]


def test_retention_keeps_last_n(spark):
    base = tempfile.mkdtemp(prefix="kestrel-ret-")
    src, out, ck = (os.path.join(base, x) for x in ("src", "out", "ck"))
    os.makedirs(src)
    for b in range(3):
        with open(os.path.join(src, f"m{b}.json"), "w") as f:
            f.write("[" + ", ".join(f'{{"username": "u", "text": "b{b}-{i}"}}' for i in range(4)) + "]")
        sm.retain_last(spark, src, out, ck, n=5).awaitTermination()
    texts = sorted(r.text for r in spark.read.parquet(out).collect())
    assert len(texts) == 5 and all(t.startswith(("b1", "b2")) for t in texts)
    assert sum(t.startswith("b2") for t in texts) == 4


def test_drop_folder_ingest_archives_sources(spark):
    from pyspark.sql import types as T
    base = tempfile.mkdtemp(prefix="kestrel-drop-")
    src, out, ck, arc = (os.path.join(base, x) for x in ("src", "out", "ck", "arc"))
    os.makedirs(src)
    with open(os.path.join(src, "a.csv"), "w") as f:
        f.write("store,item\ns1,ab+c*\ns2,nan\n")
    schema = T.StructType([T.StructField("store", T.StringType()), T.StructField("item", T.StringType())])
    sm.ingest_drop_folder(spark, src, schema, out, ck, arc).awaitTermination()
    rows = sorted((r.store, r.item, r.source_file) for r in spark.read.parquet(out).collect())
    assert rows == [("s1", "abc", "a.csv"), ("s2", None, "a.csv")]


def test_json_array_and_base_tables(spark):
    d = tempfile.mkdtemp(prefix="kestrel-js-")
    p = os.path.join(d, "m.json")
    with open(p, "w") as f:
        f.write('[{"username": "a", "text": "x", "timestamp": "10:00:00"}, {"text": "y"}]')
    df = files.read_json_array(spark, p, sm.MESSAGE_SCHEMA)
    assert sorted(((r.text, r.username) for r in df.collect()), key=lambda t: t[0]) == [("x", "a"), ("y", None)]
    x = tempfile.mkdtemp(prefix="kestrel-base-")
    _xlsx(os.path.join(x, "shopInfo.xlsx"), [["store", "region"], ["s1", "n"]])
    tables = excel.load_base_tables(spark, x)
    assert list(tables) == ["shopInfo"] and tables["shopInfo"].first().store == "s1"

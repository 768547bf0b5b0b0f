"""The registered queries: SQL oracles and the pipeline's stages."""

from __future__ import annotations

import duckdb
import pytest

import corpus_pipeline
from kestrel.llm import minmax_dedup
from kestrel.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def plain(rows):
    return sorted(map(repr, rows))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(ORACLES[name])
    got = QUERIES[name](spark, SF).select(*want.columns)
    assert plain(tuple(r) for r in got.collect()) == plain(want.fetchall())


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF).cache()
        assert out.columns == docs.columns, name
        ids = {r.doc_id for r in out.select("doc_id").collect()}
        assert ids <= {r.doc_id for r in docs.select("doc_id").collect()} and len(ids) == out.count()
        if name == "near_dedup":
            kept = {r.doc_id for r in minmax_dedup.near_duplicates(docs).where("kept").collect()}
            assert ids == kept
        docs = out
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in last} == ids and all(r.round_trip for r in last)
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == ids

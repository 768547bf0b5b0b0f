"""The corpus pipeline: stages over ``documents``, each on what the one before
has kept. ``run`` writes each stage's rows to the session's shared checkpoint
folder and reads them back, so a lost executor repeats one stage at most."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kestrel.llm import decontaminate, fertility, minmax_dedup, piece_sampling, toxicity
from kestrel.llm.tables import saved, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score does not reject."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base and fertility rules."""
    return fertility.keep_good(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component."""
    return minmax_dedup.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without tiled benchmark passages."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def segment(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of each document, with what they decode to checked."""
    return piece_sampling.checked_digest(docs)


STAGES = [("toxicity", drop_toxic), ("quality", drop_poor), ("near_dedup", drop_near_copies), ("decontamination", drop_leaks), ("sentencepiece", segment)]

#: Trained scores, vocabularies and sampling are beyond SQL; tests hold the
#: stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

"""The training-corpus pipeline: language ID, near-dedup, benchmark decontamination, mixing and sharding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes what a stage returns as Parquet and
gives what it reads back to the next. All but the last return the columns of documents:

* language: rows whose language is unknown, or known with too low a score, go;
* near_dedup: one document of each class of near-duplicates stays, the one with the smallest doc_id;
* decontaminate: documents that hold a benchmark passage go;
* mix: each document stands as often as shards of the mix draw it, or not at all, laid out by shard in the local order;
* shard: documents columns plus virtual_slot and shard, by the slot map stored for sf_dir.

Defined cases: an empty table passes through all stages as an empty table. Null texts and texts without a letter go in the language
stage, whatever the other columns hold. From then on rows with a null id or source are rows like others: near_dedup keeps one
of equal texts (that with an id, if there is one), mix treats a null source as a source, shard hashes a null id with the text.
Repeated rows are copies until near_dedup, and are made again by mix, which gives them one shard. Very long texts are read whole in every stage.
Equal keys are kept apart by their texts, equal texts by their smallest id. Extra columns of any name are kept in every stage; shard replaces columns named shard or
virtual_slot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tilmark.llm import decontaminate as dc
from tilmark.llm import language_id as li
from tilmark.llm import mixing as mx
from tilmark.llm import near_dedup as nd
from tilmark.llm import sharding as sh
from tilmark.llm.runtime import owned, table, tables, written

#: Stages train models and align sequences; no SQL gives these rows. Tests hold them against brute force.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return li.identified(docs, li.train_tagger(docs))


@owned
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return nd.without_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dc.without_leaks(docs, table(spark, sf_dir, "benchmark"))


@owned
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mx.mix_documents(docs, named=False)


@owned
def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sh.with_shards(docs, store=sh.map_store(spark, f"pipeline:{sf_dir}"))


STAGES = [("language", language), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix), ("shard", shard)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with tables() as own:
        for name, stage in STAGES[:-1]:
            docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
            own.keep(docs)
        return STAGES[-1][1](spark, docs, sf_dir)

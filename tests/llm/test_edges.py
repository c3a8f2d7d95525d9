"""Nulls, empty and very long texts, ties, repeated rows, empty tables and extra columns, for every operator and stage."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tilmark.llm import decontaminate as dc
from tilmark.llm import embedding_dedup as ed
from tilmark.llm import language_id as li
from tilmark.llm import license_scan as ls
from tilmark.llm import mixing as mx
from tilmark.llm import near_dedup as nd
from tilmark.llm import quality as qu
from tilmark.llm import secret_scan as ss
from tilmark.llm import sharding as sh
from tilmark.llm import token_scan as ts

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ["id", "node", "size", "score", "label", "shard", "slot", "taken", "target", "words", "component", "key", "w", "places", "bag", "draw", "part", "copies", "virtual_slot", "mix_shard", "edge"]
LONG = " ".join(f"word{i % 9973}x" for i in range(150_000))


def documents(spark, rows=None):
    rng = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "under", "house", "river", "stone"]
    some = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 40))), rng.choice(["xx", "yy"]), f"s{i % 3}", i) for i in range(30)]
    odd = [(100, None, None, None, None), (None, "an id is missing here today", "xx", "s1", 3), (101, "", "yy", None, 0), (102, LONG, "xx", "s0", 1), (0, *some[0][1:]), (0, *some[0][1:]), (None, None, None, None, None), (103, " \t\n", "xx", "s2", 3), (104, "!!! ???", None, "s2", 7)]
    frame = spark.createDataFrame(some + odd if rows is None else rows, DOCS)
    for c in CLASHES:
        frame = frame.withColumn(c, F.lit("clash"))
    return frame


def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(20)] + [(None, 1, 0), (5, None, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")


def items(spark):
    return spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (2, None), (3, ""), (None, "short item")], "item_id long, text string")


OPERATORS = {
    "license": lambda s, d: ls.license_scan(d),
    "tokens": lambda s, d: ts.count_tokens(d),
    "near": lambda s, d: nd.near_duplicates(d),
    "quality": lambda s, d: qu.score_texts(d, qu.train_on(d, labels(s))),
    "mix": lambda s, d: mx.mix_words(d),
    "secrets": lambda s, d: ss.secret_scan(d),
    "shards": lambda s, d: sh.place_records(d),
    "language": lambda s, d: li.identify(d, li.train_tagger(d)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_per_row(spark, name):
    docs = documents(spark)
    got = OPERATORS[name](spark, docs).collect()
    assert len(got) == docs.count()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r["doc_id"]) for r in docs.select("doc_id").collect())


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, documents(spark, [])).collect() == []


def test_leaks_on_odd_rows(spark):
    text = "before one two three four five six seven eight nine ten after"
    docs = documents(spark).unionByName(documents(spark, [(7, text, "xx", "s", 1), (7, text, "xx", "s", 1), (None, text, None, None, None)]))
    got = dc.find_leaks(docs, items(spark)).collect()
    assert sorted((str(r["doc_id"]), r["item_id"], r["doc_start"], r["score"]) for r in got) == [("7", 1, 1, 1.0), ("7", 1, 1, 1.0), ("None", 1, 1, 1.0)]
    assert dc.find_leaks(documents(spark, []), items(spark)).collect() == []
    assert dc.find_leaks(docs, items(spark).limit(0)).collect() == []


@pytest.mark.parametrize("stage", range(5))
def test_stages(spark, tmp_path, stage):
    items(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = documents(spark)
    name, run = corpus_pipeline.STAGES[stage]
    got = run(spark, docs, str(tmp_path))
    before, after = (Counter((r["doc_id"], r["text"], r["source"], r["n_chars"]) for r in f.collect()) for f in (docs, got))
    worded = {k for k in before if k[1] and any(c.isalpha() for c in k[1])}
    if name == "language":
        assert set(after) <= worded
    elif name == "near_dedup":
        texts = {k[1] for k in before}
        assert {k[1] for k in after} == texts
        assert max(after.values()) == 1
        assert sorted(str(k[0]) for k in after if k[1] is not None) == sorted(str(k) for k in [*range(30), None, 101, 102, 103, 104])
    elif name == "decontaminate":
        assert after == before
    elif name == "mix":
        assert set(after) <= worded | {k for k in before if k[1] and k[1].split()}
        assert all(n <= 3 * before[k] for k, n in after.items())
    else:
        assert after == before
    if stage < 4:
        assert got.columns == docs.columns
        assert dict(got.dtypes) == dict(docs.dtypes)
    rows = got.collect()
    assert rows or name == "language"
    empty = run(spark, documents(spark, []), str(tmp_path))
    assert empty.collect() == []


def test_near_dedup_keeps_one_of_each_class(spark):
    kept = nd.without_near_duplicates(documents(spark))
    texts = [r["text"] for r in kept.collect()]
    worded = [t for t in texts if t and any(c.isalnum() for c in t)]
    assert len(worded) == len(set(worded))
    assert LONG in worded
    assert texts.count(None) == 2  # one with an id, one without


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [0.99, 0.01], 1), (4, [1.0, 0.0], 2), (5, [0.0, 0.0], 1), (6, None, 1), (7, [], 1), (8, [1.0, None], 1), (9, [nan, 1.0], 1), (10, [inf, 1.0], 1), (11, [1.0, 0.0], None), (None, [1.0, 0.0], 1), (12, [1.0, 0.0, 0.0], 1), (13, [1e-30, 0.0], 1), (14, [1e30, 1e28], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    for c in CLASHES:
        frame = frame.withColumn(c, F.lit("clash")) if c != "label" else frame
    got = sorted(tuple(r) for r in ed.near_embeddings(frame).collect() if r["vec_id"] is not None)
    linked = {1, 2, 3, 13, 14}
    for vec, n, component, kept in got:
        assert (n, component, kept) == ((5, 1, vec == 1) if vec in linked else (0, vec, True))
    alone = [tuple(r) for r in ed.near_embeddings(frame).filter("vec_id is null").collect()]
    assert alone == [(None, 0, None, False)]
    assert ed.near_embeddings(frame.limit(0)).collect() == []

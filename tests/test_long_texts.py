"""Alignment and error rates of long texts."""

from __future__ import annotations

import os
import random
import time
import tracemalloc

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tilmark import queries as q
from tilmark.functions import metrics
from tilmark.functions.similarity import STATUSES, align_words, best_moves, edit_distance

TINY = "/root/testdata/sf0.001"


def whole_table(hyp, ref):
    """Moves by the table of all distances, from its end: equal words, substitution, deletion, insertion."""
    far = [[0] * (len(hyp) + 1) for _ in range(len(ref) + 1)]
    for i in range(len(ref) + 1):
        for j in range(len(hyp) + 1):
            if not i or not j:
                far[i][j] = i + j
            else:
                far[i][j] = min(far[i - 1][j] + 1, far[i][j - 1] + 1, far[i - 1][j - 1] + (ref[i - 1] != hyp[j - 1]))
    i, j, out = len(ref), len(hyp), []
    while i or j:
        if i and j and ref[i - 1] == hyp[j - 1]:
            move = 0
        elif i and j and far[i][j] == far[i - 1][j - 1] + 1:
            move = 1
        elif i and far[i][j] == far[i - 1][j] + 1:
            move = 2
        else:
            move = 3
        out.append(move)
        i, j = i - (move != 3), j - (move != 2)
    return out[::-1], far[-1][-1]


WORDS = st.lists(st.sampled_from("abc"), max_size=18)


@settings(max_examples=300, deadline=None)
@given(WORDS, WORDS)
def test_divided_tables_give_the_moves_of_the_whole(hyp, ref):
    """Few words, so that ties are everywhere; tables of any size are divided."""
    moves, far = whole_table(hyp, ref)
    assert edit_distance(hyp, ref) == far
    for cells in (1, 7, 40, 1 << 20):
        assert best_moves(hyp, ref, cells) == moves


def heard(words, rng):
    return [w if rng.random() > 0.05 else f"{w}x" for w in words if rng.random() > 0.1 for _ in range(1 + (rng.random() < 0.1))]


def test_twenty_thousand_words_in_little_memory():
    rng = random.Random(3)
    ref = [str(rng.randrange(3000)) for _ in range(20_000)]
    hyp = heard(ref, rng)
    tracemalloc.start()
    rows = align_words(hyp, ref, ref)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6
    assert [r[1] for r in rows if r[3] != "insertion"] == ref
    assert [r[0] for r in rows if r[3] != "deletion"] == hyp
    assert sum(r[3] != "correct" for r in rows) == edit_distance(hyp, ref)


def test_word_distance_of_long_and_odd_arrays(spark):
    rng = random.Random(4)
    long = [str(rng.randrange(9000)) for _ in range(20_000)]
    pairs = [(0, [], []), (1, ["a"], []), (2, [], ["a", "b"]), (3, ["b", "a", "b"], ["a", "b"]), (4, None, ["a"]), (5, heard(long, rng), long), (6, ["é", "e", "😀"], ["e", "é", "😀", ""])]
    frame = spark.createDataFrame(pairs, "k int, h array<string>, r array<string>")
    began = time.perf_counter()
    got = {r["k"]: r["far"] for r in frame.select("k", metrics.word_distance(F.col("h"), F.col("r")).alias("far")).collect()}
    assert time.perf_counter() - began < 60
    assert got == {k: None if h is None else edit_distance(h, r) for k, h, r in pairs}


@pytest.mark.skipif(not os.path.isdir(TINY), reason="no test tables")
def test_documents_against_whole_tables(spark):
    rows = q._documents_said(spark, TINY).collect()
    aligned = {r["doc_id"]: r for r in q.align_documents(spark, TINY).collect()}
    rates = {r["doc_id"]: r["wer"] for r in q.wer_documents(spark, TINY).collect()}
    assert set(aligned) == set(rates) == {r["doc_id"] for r in rows}
    for r in rows:
        h, ref = r["h"], r["ref"].split()
        far = edit_distance(h, ref)
        assert rates[r["doc_id"]] == (far / len(ref) if ref else float(len(h) > 0))
        assert far == sum(aligned[r["doc_id"]][f"n_{s}"] for s in STATUSES[1:])
        if len(ref) < 150:
            moves, _ = whole_table(h, ref)
            assert [aligned[r["doc_id"]][f"n_{s}"] for s in STATUSES] == [moves.count(k) for k in range(4)]

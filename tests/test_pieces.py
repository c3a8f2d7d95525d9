"""Segmentation of streams in pieces gives the segments of whole streams."""

from __future__ import annotations

import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tilmark.operators.segment import Segmenter, segment
from tilmark.operators.segment_pieces import Moves, cut_pieces, segment_pieces, starts
from tilmark.plans import store

FRAMES = "stream_id long, seq long, payload binary, is_speech boolean"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.booleans(), max_size=40), st.lists(st.booleans(), max_size=40), st.integers(1, 6))
def test_functions_of_pieces_compose_to_that_of_the_whole(first, then, limit):
    whole, a, b = (Moves(np.array(x, bool), limit).table() for x in (first + then, first, then))
    assert whole[0] == [b[0][s] for s in a[0]]
    assert whole[1] == [n + b[1][s] for s, n in zip(*a, strict=True)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.booleans(), max_size=60), st.integers(1, 6), st.data())
def test_functions_are_those_of_the_segmenter(speech, limit, data):
    start = data.draw(st.integers(0, limit))
    machine = Segmenter(limit, 0)
    if start:
        machine.start, machine.silent = -1, start - 1
    closed = sum(machine.push(i, b"x", s) is not None for i, s in enumerate(speech))
    go, ends = Moves(np.array(speech, bool), limit).table()
    assert (go[start], ends[start]) == (0 if machine.start is None else 1 + machine.silent, closed)
    spans, last = Moves(np.array(speech, bool), limit).spans(start)
    assert (last, sum(c for *_, c in spans)) == (go[start], ends[start])


def streams(seed):
    rng, rows = random.Random(seed), []
    for s in range(5):
        seq, loud = -20, False
        for _ in range(rng.choice([1, 3, 30, 300, 900])):
            loud = loud != (rng.random() < 0.1)
            seq += rng.randint(1, 3)
            rows.append((s, seq, None if rng.random() < 0.05 else bytes([rng.randrange(256)]) * 2, None if rng.random() < 0.03 else rng.random() < (0.8 if loud else 0.1)))
    rng.shuffle(rows)
    return rows


def found(frame):
    return sorted((*r[:4], tuple(r["seqs"]), bytes(r["raw"])) for r in frame.collect())


@pytest.mark.parametrize(("seed", "limit", "keep", "size", "flush"), [(1, 20, 10, 7, False), (2, 3, 4, 2, True), (3, 1, 0, 5, False), (4, 2, 30, 3, True), (5, 20, 10, 4096, True)])
def test_pieces_give_the_segments_of_streams(spark, seed, limit, keep, size, flush):
    frames = spark.createDataFrame(streams(seed), FRAMES).repartition(4).withColumn("clash", F.lit(1))
    assert found(segment_pieces(frames, limit, keep, flush, size, parts=5)) == found(segment(frames, limit, keep, flush))


def test_a_stream_is_many_parts_and_silence_may_be_far_back(spark):
    """Ten frames of silence, then speech in which silent frames never are idle ones: the pre-roll of later segments comes from pieces long before."""
    rows = [(7, i, bytes([i % 256]), i >= 10 and i % 3 > 0) for i in range(3000)]
    frames = spark.createDataFrame(rows, FRAMES)
    pieces = cut_pieces(frames, limit=5, size=50, parts=6)
    parts = pieces.select("part").distinct().count()
    assert parts > 1
    assert starts(pieces).count() == parts - 1
    assert max(r["n"] for r in pieces.select(F.size("frames").alias("n")).collect()) == 50
    got = found(segment_pieces(frames, limit=5, keep=10, size=50, parts=6))
    assert got == found(segment(frames, limit=5, keep=10))
    assert len(got) > 100


def test_nothing_and_bad_sizes(spark):
    assert segment_pieces(spark.createDataFrame([], FRAMES)).collect() == []
    for bad in ({"limit": 0}, {"keep": -1}, {"size": 0}):
        with pytest.raises(ValueError, match="positive"):
            segment_pieces(spark.createDataFrame([], FRAMES), **bad)


def test_what_a_step_writes_is_gone_but_its_result(spark):
    with store.step():
        gone = store.written(spark.range(3), "gone")
        kept = store.result(spark.range(4), "kept")
    assert kept.count() == 4
    (file,) = {f.rsplit("/", 1)[0] for f in gone.inputFiles()} or {None}
    assert not os.path.exists(str(file).removeprefix("file://"))

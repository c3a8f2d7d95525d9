"""Batches that are repeated after a crash, and streams that fall silent."""

from __future__ import annotations

import time
from functools import partial

import numpy as np
import pytest

from tilmark.operators.transcribe import WordStub
from tilmark.plans import store
from tilmark.streaming import live
from tilmark.streaming.once import Once, stored

stub = partial(WordStub, ["praise", "be", "to", "all"], 2)
KIND = "stream_id long, segment_no int, raw binary"


def pcm(*values):
    return np.repeat(np.array(values) * 32767, 2).astype("<i2").tobytes()


@pytest.fixture
def segments(spark, tmp_path):
    rows = [(1, 0, pcm(0, 0.3, 0.6, 0.95)), (2, 0, pcm(0.95))]
    spark.createDataFrame(rows, KIND).coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(KIND).parquet(str(tmp_path / "in"))


def corpus_of(spark):
    return spark.createDataFrame([(0, 1, 1, "praise be to nobody", "praise be to nobody")], "idx long, surah int, ayah int, plain string, original string")


def run(segments, spark, tmp_path, good, dead, corpus=None):
    live.start(segments, corpus or corpus_of(spark), stub, good, str(tmp_path / "cp"), on_dead=dead, drain=True, least=1, sink=str(tmp_path / "sink")).awaitTermination()


def test_a_batch_killed_between_its_callbacks(spark, tmp_path, segments, monkeypatch):
    got, dead = [], []

    def killed(frame, number):
        raise RuntimeError("killed")

    take = lambda out: lambda frame, _: out.extend(r["hypothesis"] for r in frame.collect())
    with pytest.raises(Exception, match="killed"):
        run(segments, spark, tmp_path, take(got), killed)
    assert got == ["praise be to all"]
    run(segments, spark, tmp_path, take(got), take(dead))
    run(segments, spark, tmp_path, take(got), take(dead))
    assert (got, dead) == (["praise be to all"], ["all"])
    assert [r["hypothesis"] for r in stored(spark, str(tmp_path / "sink")).collect()] == got
    assert [r["hypothesis"] for r in stored(spark, str(tmp_path / "sink"), "dead").collect()] == dead


def test_a_batch_killed_before_its_commit(spark, tmp_path, segments, monkeypatch):
    got = []
    take = lambda frame, _: got.extend(r["hypothesis"] for r in frame.collect())
    none = lambda frame, _: None
    commit = store.commit_once

    def killed(*args):
        raise RuntimeError("killed")

    monkeypatch.setattr(store, "commit_once", killed)
    with pytest.raises(Exception, match="killed"):
        run(segments, spark, tmp_path, take, none)
    assert got == []
    monkeypatch.setattr(store, "commit_once", commit)
    run(segments, spark, tmp_path, take, none)
    assert got == ["praise be to all"]
    assert len(list((tmp_path / "sink/results").glob("part=*"))) == 2  # the broken-off try, and the one that counts
    assert stored(spark, str(tmp_path / "sink")).count() == 1


def test_one_batch_is_made_and_committed_once(spark, tmp_path):
    once = Once(spark, str(tmp_path / "sink"), "q", 3)
    frame = spark.createDataFrame([(1,)], "k int")
    assert once.write(lambda: (frame, frame.limit(0)))
    assert not once.write(lambda: pytest.fail("made again"))
    assert (once.rows("results").count(), once.rows("dead").count()) == (1, 0)
    assert store.commit_once(spark, str(tmp_path / "m"), "a") is True
    assert store.commit_once(spark, str(tmp_path / "m"), "b") is False
    assert store.committed(spark, str(tmp_path / "m")) == "a"
    assert [p.name for p in tmp_path.iterdir() if p.name.startswith("m.")] == []


def test_silent_streams_are_flushed_over_a_restart(spark, tmp_path):
    live.rocksdb(spark)
    rows = [(1, i, bytes([i]), i > 5) for i in range(12)] + [(2, i, bytes([i]), 5 < i < 8) for i in range(60)]
    spark.createDataFrame(rows, live.FRAMES).coalesce(1).write.parquet(str(tmp_path / "in"))
    frames = live.read_frames(spark, str(tmp_path / "in"))

    def started(flush):
        found = live.live_segments(frames, flush_after=flush, expire_after=3600)
        return found.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="0 seconds").start(str(tmp_path / "out"))

    query = started(6.0)
    end = time.time() + 60
    while time.time() < end and not any(p.numInputRows for p in query.recentProgress):
        query.awaitTermination(0.1)
    query.stop()
    out = lambda: sorted((r["stream_id"], r["segment_no"], r["start_seq"], r["end_seq"], len(r["seqs"])) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert out() == [(2, 0, 6, 27, 28)]  # stream 1 is open
    live.drain(started(6.0), 6.0)
    assert out() == [(1, 0, 6, 11, 12), (2, 0, 6, 27, 28)]
    spark.createDataFrame([(1, 12 + i, bytes([i]), i == 0) for i in range(25)], live.FRAMES).write.mode("append").parquet(str(tmp_path / "in"))
    live.drain(started(6.0), 6.0)
    assert out()[:2] == [(1, 0, 6, 11, 12), (1, 1, 12, 32, 27)]  # the pre-roll is the silence that was seen while idle: frames 0 to 5


def test_forgotten_streams_begin_anew(spark, tmp_path):
    live.rocksdb(spark)
    put = lambda first: spark.createDataFrame([(1, first + i, bytes([i]), i == 0) for i in range(30)], live.FRAMES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    put(0)
    found = live.live_segments(live.read_frames(spark, str(tmp_path / "in")), expire_after=0.001)

    def once():
        query = found.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="0 seconds").start(str(tmp_path / "out"))
        live.drain(query)

    once()
    put(100)
    once()
    assert sorted((r["segment_no"], r["start_seq"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(0, 0), (0, 100)]

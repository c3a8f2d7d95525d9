"""Segmentation and alignment of live frame streams with Structured Streaming.

Frames are rows (stream_id, seq, payload, is_speech). State per stream is small values and two lists: the frames of the open
segment and the last silent ones. Within a micro-batch frames are taken by seq; between batches arrival is the only order,
so a frame that comes late is taken when it comes.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from datetime import datetime

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tilmark.operators.match import verse_index
from tilmark.operators.segment import PRE_ROLL, SEGMENTS, SILENCE_LIMIT, ArraySegmenter
from tilmark.operators.transcribe import Transcriber
from tilmark.plans.pipeline import Config, run_segments
from tilmark.plans.report import dead_letters, with_report
from tilmark.streaming.once import Once

FRAMES = "stream_id long, seq long, payload binary, is_speech boolean"


class SegmentProcessor(StatefulProcessor):
    """flush_after: after so many milliseconds without a frame of the stream, its open segment ends. expire_after: after so many without a change, what is kept of a
    stream is forgotten; its segments then count from 0 again."""

    def __init__(self, limit: int = SILENCE_LIMIT, keep: int = PRE_ROLL, flush_after: int | None = None, expire_after: int | None = None):
        self.limit, self.keep, self.flush_after, self.expire_after = limit, keep, flush_after, expire_after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "number int, silent int, start long", self.expire_after)
        self.held = handle.getListState("held", "seq long, payload binary", self.expire_after)
        self.before = handle.getListState("before", "seq long, payload binary", self.expire_after)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        machine, stored = ArraySegmenter(self.limit, self.keep), False
        if self.state.exists():
            machine.number, machine.silent, machine.start = self.state.get()
            stored = machine.start is not None  # its frames so far stay in the state until it ends
            machine.before = _slices(self.before.get())
        frames = pd.concat(list(rows)).sort_values("seq", kind="stable")
        seqs, payloads = frames["seq"].to_numpy(np.int64), pa.array(frames["payload"].map(lambda p: b"" if p is None else bytes(p)), pa.binary())
        done = []
        for ended in machine.push(seqs, payloads, frames["is_speech"].fillna(False).to_numpy(bool)):
            if stored:
                ended = self._after_held(ended)
                stored = False
            done.append(ended)
        self.state.update((machine.number, machine.silent, machine.start))
        if machine.start is None:
            self.held.clear()
        elif stored:
            self.held.appendList(_rows(machine.held))
        else:
            self.held.put(_rows(machine.held))
        self.before.put(kept) if (kept := _rows(machine.before)) else self.before.clear()
        if self.flush_after is not None:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            if machine.start is not None:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.flush_after)
        if done:
            yield _segments(key, done)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        if not self.state.exists():
            return
        number, silent, start = self.state.get()
        if start is None:
            return
        first = [(s, bytes(p)) for s, p in self.held.get()]
        self.held.clear()
        self.state.update((number + 1, 0, None))
        if first:
            yield _segments(key, [(number, start, first[-1][0], [s for s, _ in first], b"".join(p for _, p in first))])

    def _after_held(self, ended: tuple) -> tuple:
        first = [(s, bytes(p)) for s, p in self.held.get()]
        return (*ended[:3], [s for s, _ in first] + list(ended[3]), b"".join(p for _, p in first) + ended[4])

    def close(self) -> None:
        pass


def _slices(rows: Iterator[tuple]) -> list[tuple[np.ndarray, pa.Array]]:
    """Stored frames as the segmenter keeps them."""
    held = [(s, bytes(p)) for s, p in rows]
    return [(np.array([s for s, _ in held], np.int64), pa.array([p for _, p in held], pa.binary()))] if held else []


def _rows(slices: list[tuple[np.ndarray, pa.Array]]) -> list[tuple[int, bytes]]:
    return [(int(s), p) for seqs, payloads in slices for s, p in zip(seqs, payloads.to_pylist(), strict=True)]


def _segments(key: tuple, done: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame([(key[0], *x) for x in done], columns=[f.split()[0] for f in SEGMENTS.split(", ")])


def read_frames(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A stream of frame files (Parquet). files_per_batch holds back how much a micro-batch takes."""
    reader = spark.readStream.schema(FRAMES)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)


def live_segments(frames: DataFrame, limit: int = SILENCE_LIMIT, keep: int = PRE_ROLL, flush_after: float | None = None, expire_after: float | None = None) -> DataFrame:
    """SEGMENTS as they end. Needs the RocksDB state store (see rocksdb). flush_after, expire_after: seconds, see SegmentProcessor; without them a stream that falls
    silent keeps its open segment for ever, and nothing is forgotten."""
    ms = lambda seconds: None if seconds is None else round(seconds * 1000)
    timed = flush_after is not None or expire_after is not None
    processor = SegmentProcessor(limit, keep, ms(flush_after), ms(expire_after))
    return frames.groupBy("stream_id").transformWithStateInPandas(processor, outputStructType=SEGMENTS, outputMode="Append", timeMode="ProcessingTime" if timed else "None")


def rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def drain(query: StreamingQuery, flush_after: float = 0.0, patience: float = 600.0) -> None:
    """Take what is there, wait until open segments have been flushed, and stop. For a query of live_segments with flush_after and a trigger by processing time, which goes on
    with empty batches: the first that begins flush_after seconds after the last batch with frames has ended them, and a second one has looked for new frames (after a restart the first may be
    a batch that was planned before)."""
    begun = lambda p: datetime.fromisoformat(p.timestamp.replace("Z", "+00:00")).timestamp()
    busy, end = time.time(), time.time() + patience
    while time.time() < end:
        done = list(query.recentProgress)
        busy = max([busy, *[begun(p) + p.batchDuration / 1000 for p in done if p.numInputRows]])
        empty = [p for p in done[-2:] if not p.numInputRows and begun(p) > busy + flush_after]
        if len(empty) == 2 or query.awaitTermination(0.2):
            break
    query.stop()


def start(segments: DataFrame, corpus: DataFrame, make: Callable[[], Transcriber], on_results: Callable[[DataFrame, int], None], checkpoint: str, config: Config | None = None, on_dead: Callable[[DataFrame, int], None] | None = None, drain: bool = False, least: int | None = None, sink: str | None = None) -> StreamingQuery:
    """Align every micro-batch of segments; on_results gets rows with a report, on_dead those without a verse or with a model error. A batch is transcribed
    once, and a corpus that is sent to the workers is indexed once. drain: take what is there and stop. sink: a folder in which every batch is stored once before the callbacks get it, also if it
    is repeated after a restart (see tilmark.streaming.once); without it a repeated batch calls back again."""
    limits = {} if least is None else {"least": least}
    index = verse_index(corpus)

    def results(batch: DataFrame) -> DataFrame:
        named = batch.select(F.xxhash64("stream_id", "segment_no").alias("hyp_id"), "raw")
        return with_report(run_segments(named, corpus, make, config, index=index, **limits)).persist(StorageLevel.DISK_ONLY)

    good = lambda out: out.filter(F.col("match_status").isin("exact", "matched"))

    def each(batch: DataFrame, number: int) -> None:
        out = results(batch)
        try:
            on_results(good(out), number)
            if on_dead:
                on_dead(dead_letters(out), number)
        finally:
            out.unpersist()

    def each_once(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        once = Once(spark, sink, spark.sparkContext.getLocalProperty("sql.streaming.queryId"), number)
        made: list[DataFrame] = []

        def both() -> tuple[DataFrame, DataFrame]:
            made.append(results(batch))
            return good(made[0]), dead_letters(made[0])

        try:
            once.write(both)
            once.call("results", on_results, number)
            once.call("dead", on_dead, number)
        finally:
            for out in made:
                out.unpersist()

    writer = segments.writeStream.outputMode("append").foreachBatch(each_once if sink else each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if drain else writer).start()

"""Long PCM WAV files as rows of chunks: a task reads the bytes of its chunk and some around them, never a whole file.

A first pass reads headers only. A chunk is then a range of output samples; the groups of output samples it lies in, from a multiple of GROUPS on, say which input
samples are needed, with as many before and after them as the resampling kernel reaches; outside the file they are zeros. So every chunk has the bits that the
whole file's waveform has at its place. The peak that scales a file is the largest of its chunks' peaks, by one aggregation.

Rows: path, chunk, start (output samples), samples, sample_rate and error. A file that cannot be read has one row with an error and null samples; one without
samples has none.
"""

from __future__ import annotations

import contextlib
import math
import struct
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilmark.functions.audio import PEAK, RATE
from tilmark.plans import one_file, store
from tilmark.plans.one_file import opened
from tilmark.sources.audio_files import GROUPS, kernel, pcm, resample_groups

#: Peaks of so many files are broadcast at most.
BROADCAST_FILES = 10_000
#: Output samples of a task at least, if that leaves every core its share.
TASK_SAMPLES = 1 << 22
_HEADS = "path string, rate int, width int, channels int, begin long, frames long, error string"


def head(file: BinaryIO, size: int) -> tuple[int, int, int, int, int]:
    """(rate, bytes of a sample, channels, first byte of samples, frames) of a PCM WAV file of `size` bytes. A data chunk that says more than there is ends with the file."""
    riff = file.read(12)
    if len(riff) < 12 or riff[:4] != b"RIFF" or riff[8:] != b"WAVE":
        raise ValueError("no RIFF WAVE file")
    at, form = 12, None
    while at + 8 <= size:
        file.seek(at)
        name, length = struct.unpack("<4sI", file.read(8))
        if name == b"fmt ":
            body = file.read(min(length, 40))
            if len(body) < 16:
                raise ValueError("the format chunk breaks off")
            tag, channels, rate, _, align, bits = struct.unpack("<HHIIHH", body[:16])
            if tag == 0xFFFE and len(body) >= 26:
                tag = struct.unpack("<H", body[24:26])[0]
            if tag != 1 or bits not in (8, 16, 24, 32) or not channels or not rate or align != channels * bits // 8:
                raise ValueError(f"format {tag} of {bits} bits is not read")
            form = rate, bits // 8, channels
        elif name == b"data":
            if form is None:
                raise ValueError("no format chunk before the samples")
            rate, width, channels = form
            return rate, width, channels, at + 8, min(length, size - at - 8) // (width * channels)
        at += 8 + length + length % 2
    raise ValueError("no data chunk")


def heads(files: DataFrame) -> DataFrame:
    """files (path, length) with what their headers say."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    with opened(path) as f:
                        rows.append((path, *head(f, length), None))
                except (ValueError, OSError, struct.error) as error:
                    rows.append((path, None, None, None, None, None, str(error) or type(error).__name__))
            names, kinds = [c.split()[0] for c in _HEADS.split(", ")], [pa.string(), *[pa.int32()] * 3, *[pa.int64()] * 2, pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    return store.written(files.select("path", "length").mapInArrow(run, _HEADS), "heads")


def part(file: BinaryIO, rate: int, width: int, channels: int, begin: int, frames: int, start: int, count: int, target: int) -> np.ndarray:
    """Output samples from `start` on, `count` of them, of a file's mono waveform."""

    def mono(a: int, b: int) -> np.ndarray:
        """Input samples a to b, zeros outside the file."""
        lo, hi = max(0, a), min(frames, b)
        step = width * channels
        if lo >= hi:
            return np.zeros(b - a, np.float32)
        file.seek(begin + lo * step)
        return np.pad(pcm(file.read((hi - lo) * step), width, channels).mean(axis=0), (lo - a, b - hi))

    if rate == target:
        return mono(start, start + count)
    down, up, reach, _ = kernel(rate, target)
    first = start // up // GROUPS * GROUPS
    last = min(-(-(start + count) // (up * GROUPS)) * GROUPS, -(-frames // down))  # groups; only whole blocks of them, but at the end
    made = resample_groups(mono(first * down - reach, last * down + reach), rate, target)
    return made[start - first * up :][:count]


def read_chunks(spark: SparkSession, path: str, size: int, overlap: int = 0, target: int = RATE, normalise: bool = True) -> DataFrame:
    """The files of a path as chunks of `size` samples that begin every size - overlap, up to the first that reaches the end; mono at the target rate, scaled by
    the file's peak if `normalise`. Written, so that no file is read again."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("chunk size must be positive and larger than the overlap")
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    step = size - overlap

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, file = None, contextlib.ExitStack()
        with file:
            for batch in batches:
                for row in batch.to_pylist():
                    if row["path"] != at:  # neighbouring chunks read one open file
                        file.close()
                        at, f = row["path"], file.enter_context(opened(row["path"]))
                    yield made_of(f, row)

    def made_of(f: BinaryIO, row: dict) -> pa.RecordBatch:
        made = part(f, row["rate"], row["width"], row["channels"], row["begin"], row["frames"], row["start"], row["count"], target)
        top = float(np.abs(made).max()) if len(made) else 0.0
        return pa.RecordBatch.from_arrays([pa.array([row["path"]]), pa.array([row["chunk"]], pa.int64()), pa.array([row["start"]], pa.int64()), pa.array([made], pa.list_(pa.float32())), pa.array([top], pa.float32())], names=["path", "chunk", "start", "samples", "top"])

    with store.step():
        known = heads(files)
        total = F.ceil(F.col("frames") * F.lit(target) / F.col("rate")).cast("long")
        chunks = F.when(F.col("total") > size, F.ceil((F.col("total") - size) / step)).otherwise(0).cast("long")
        each = known.filter("frames > 0").withColumn("total", total).select("*", F.explode(F.sequence(F.lit(0).cast("long"), chunks)).alias("chunk")).withColumn("start", F.col("chunk") * step)
        each = each.withColumn("count", F.least(F.lit(size).cast("long"), F.col("total") - F.col("start")))
        many, asked = each.agg(F.count("*"), F.sum("count")).head()
        tasks = max(1, min(many, max(spark.sparkContext.defaultParallelism, -(-(asked or 0) // TASK_SAMPLES))))
        dealt = each.repartitionByRange(tasks, "path", "chunk").sortWithinPartitions("path", "chunk")
        made = store.written(dealt.mapInArrow(run, "path string, chunk long, start long, samples array<float>, top float"), "chunks")
        tops = made.groupBy(F.col("path").alias("of")).agg(F.max("top").alias("peak"))
        tops = F.broadcast(tops) if known.count() <= BROADCAST_FILES else tops
        scaled = F.transform("samples", lambda x: (x * (F.lit(PEAK).cast("float") / F.col("peak")).cast("float")).cast("float"))
        shaped = F.when(F.col("peak") > 0, scaled).otherwise(F.col("samples")) if normalise else F.col("samples")
        whole = made.join(tops, F.col("path") == F.col("of")).select("path", "chunk", "start", shaped.alias("samples"), F.lit(target).alias("sample_rate"), F.lit(None).cast("string").alias("error"))
        empty = lambda kind: F.lit(None).cast(kind)
        failed = known.filter("error is not null").select("path", empty("long").alias("chunk"), empty("long").alias("start"), empty("array<float>").alias("samples"), F.lit(target).alias("sample_rate"), "error")
        return store.result(whole.unionByName(failed), "audio")


def write_wav(samples: DataFrame, folder: str, rate: int = RATE) -> str:
    """samples (i, sample: an int of 16 bits) in the order of i as a mono WAV file in a folder; its path."""
    spark = samples.sparkSession
    name = f"{folder.rstrip('/')}/{uuid.uuid4().hex}"
    with store.step():
        parts = one_file.sorted_bytes(samples.select("i", F.col("sample").cast("int").alias("sample")), f"{name}.parts", lambda values: np.asarray(values).astype("<i2").tobytes())
        n = parts.agg(F.sum("n")).head()[0] or 0
        start = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", min(36 + 2 * n, (1 << 32) - 1), b"WAVE", b"fmt ", 16, 1, 1, rate, 2 * rate, 2, 16, b"data", min(2 * n, (1 << 32) - 1))
        made = one_file.joined(parts, name, start, suffix=".wav")
    store.delete(spark, f"{name}.parts")
    return made

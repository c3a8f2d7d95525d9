"""Audio files as rows: PCM WAV through binaryFile, resampled where needed."""

from __future__ import annotations

import functools
import io
import math
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilmark.functions.audio import RATE, duration, peak_normalise

WIDTH, ROLLOFF = 6, 0.99


#: Groups of output samples (one of each phase) that are made at a time.
GROUPS = 256


@functools.lru_cache(maxsize=8)
def kernel(rate: int, target: int) -> tuple[int, int, int, np.ndarray]:
    """(down, up, reach, taps by phase): a group of `up` output samples comes of the input samples from `reach` before its place on."""
    g = math.gcd(rate, target)
    down, up = rate // g, target // g
    base = min(down, up) * ROLLOFF
    reach = math.ceil(WIDTH * down / base)
    offsets = np.arange(-reach, reach + down) / down
    phase = -np.arange(up)[:, None] / up + offsets[None, :]
    t = np.clip(phase * base, -WIDTH, WIDTH)
    return down, up, reach, np.sinc(t) * np.cos(t * np.pi / WIDTH / 2) ** 2 * (base / down)


def resample_groups(padded: np.ndarray, rate: int, target: int) -> np.ndarray:
    """The output samples of all groups whose input is in `padded`, which begins `reach` samples before the first group's place. Groups are made GROUPS at a time
    from the first on, so that pieces that begin at multiples of GROUPS give the bits of the whole."""
    down, _, _, taps = kernel(rate, target)
    frames = np.lib.stride_tricks.sliding_window_view(padded.astype(np.float64), taps.shape[1])[::down]
    return np.concatenate([(frames[at : at + GROUPS] @ taps.T).reshape(-1) for at in range(0, len(frames), GROUPS)] or [np.empty(0)]).astype(np.float32)


def resample(samples: np.ndarray, rate: int, target: int = RATE) -> np.ndarray:
    """Windowed-sinc resampling; the identity where rates are equal. The result has ceil(n * target / rate) samples."""
    samples = np.asarray(samples, np.float32)
    if rate == target or not len(samples):
        return samples
    down, up, reach, _ = kernel(rate, target)
    groups = -(-len(samples) // down)
    padded = np.pad(samples, (reach, groups * down + reach - len(samples)))
    return resample_groups(padded, rate, target)[: math.ceil(len(samples) * up / down)]


def pcm(raw: bytes, width: int, channels: int) -> np.ndarray:
    """Channels (channel, sample) as floats in [-1, 1) of PCM of 8, 16, 24 or 32 bits."""
    if width == 1:
        values = np.frombuffer(raw, np.uint8).astype(np.float32) / 128 - 1
    elif width == 3:
        parts = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        values = ((parts[:, 0] << 8 | parts[:, 1] << 16 | parts[:, 2] << 24) >> 8).astype(np.float32) / (1 << 23)
    else:
        values = np.frombuffer(raw, f"<i{width}").astype(np.float32) / np.float32(1 << (8 * width - 1))
    return values.reshape(-1, channels).T


def decode_wav(content: bytes) -> tuple[np.ndarray, int]:
    """Channels as floats, and the rate, of a WAV file."""
    with wave.open(io.BytesIO(content)) as w:
        width, channels, rate, raw = w.getsampwidth(), w.getnchannels(), w.getframerate(), w.readframes(w.getnframes())
    return pcm(raw, width, channels), rate


def read_wav(spark: SparkSession, path: str, target: int = RATE, normalise: bool = True) -> DataFrame:
    """(path, samples, sample_rate, duration_s, error) of WAV files: mono at the target rate, peak scaled if `normalise`.
    A file that cannot be decoded has an error and null samples. A path without files is an error of Spark's reader."""
    return decoded(spark.read.format("binaryFile").load(path), target, normalise)


def decoded(files: DataFrame, target: int = RATE, normalise: bool = True) -> DataFrame:
    """The same of rows (path, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            samples, errors = [], []
            for content in batch.column(1).to_pylist():
                try:
                    channels, rate = decode_wav(content)
                    samples.append(resample(channels.mean(axis=0), rate, target))
                    errors.append(None)
                except (wave.Error, EOFError, ValueError) as error:
                    samples.append(None)
                    errors.append(str(error) or type(error).__name__)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(samples, pa.list_(pa.float32())), pa.array(errors, pa.string())], names=["path", "samples", "error"])

    read = files.select("path", "content").mapInArrow(run, "path string, samples array<float>, error string")
    shaped = peak_normalise("samples") if normalise else F.col("samples")
    return read.select("path", shaped.alias("samples"), F.lit(target).alias("sample_rate"), duration("samples", target).alias("duration_s"), "error")


def resampled(column: Column | str, rate: int, target: int = RATE) -> Column:
    """A waveform column at another rate."""

    @F.pandas_udf("array<float>")
    def convert(series):  # noqa: ANN001, ANN202
        return series.map(lambda x: None if x is None else resample(np.asarray(x), rate, target))

    return convert(column)

"""Waveform arrays: downmix, peak scaling, chunking, PCM decoding, as column expressions on array<float>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RATE = 16_000
PEAK = 0.95
MIN_SAMPLES = 4_800
_EMPTY = "array<float>"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def downmix(channels: Column | str) -> Column:
    """Mean of the channels (array of arrays of equal length)."""
    c = _col(channels)
    total = F.aggregate(F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0))), F.transform(F.element_at(c, 1), lambda x: x.cast("double")), lambda s, x: F.zip_with(s, x, lambda p, q: p + q.cast("double")))
    mean = F.transform(total, lambda x: (x / F.size(c)).cast("float"))
    return F.when(F.size(c) == 0, F.array().cast(_EMPTY)).otherwise(mean)


def peak(samples: Column | str) -> Column:
    return F.array_max(F.transform(_col(samples), lambda x: F.abs(x)))


def peak_normalise(samples: Column | str, target: float = PEAK) -> Column:
    """Scale so that the largest magnitude is target; silence and empty arrays stay."""
    c = _col(samples).cast(_EMPTY)
    top = peak(c)
    return F.when(top > 0, F.transform(c, lambda x: (x * (F.lit(target).cast("float") / top).cast("float")).cast("float"))).otherwise(c)


def duration(samples: Column | str, rate: int = RATE) -> Column:
    return F.size(_col(samples)) / F.lit(float(rate))


def long_enough(samples: Column | str, least: int = MIN_SAMPLES) -> Column:
    return F.size(_col(samples)) >= least


def tumbling_chunks(samples: Column | str, size: int) -> Column:
    """Consecutive chunks of `size` samples, the last one shorter; none of an empty array."""
    if size <= 0:
        raise ValueError("chunk size must be positive")
    c = _col(samples)
    cut = F.transform(F.sequence(F.lit(0), F.size(c) - 1, F.lit(size)), lambda i: F.slice(c, i + 1, size))
    return F.when(F.size(c) > 0, cut)


def overlapping_chunks(samples: Column | str, size: int, overlap: int) -> Column:
    """Chunks of `size` samples that begin every size - overlap, up to the first that reaches the end."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("chunk size must be positive and larger than the overlap")
    c, step = _col(samples), size - overlap
    last = F.when(F.size(c) > size, F.ceil((F.size(c) - size) / step)).otherwise(0).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(c, k * step + 1, size))
    return F.when(F.size(c) > 0, cut)


def pcm16_to_float(raw: Column | str) -> Column:
    """Little-endian 16-bit samples over 32768, by Arrow batches. A trailing odd byte is ignored."""

    @F.pandas_udf(_EMPTY)
    def decode(series):  # noqa: ANN001, ANN202
        import numpy as np

        return series.map(lambda b: None if b is None else np.frombuffer(b, "<i2", len(b) // 2).astype(np.float32) / np.float32(32768))

    return decode(raw)

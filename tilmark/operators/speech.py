"""Marking frames as speech by a pluggable detector that every worker loads once per task."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

RATE, FRAME_SAMPLES = 16_000, 480


class Detector(Protocol):
    def is_speech(self, frame: bytes, rate: int) -> bool: ...


class EnergyDetector:
    """Speech where the root mean square of 16-bit samples reaches a level that rises with aggressiveness (0 to 3)."""

    LEVELS = (100.0, 200.0, 400.0, 800.0)

    def __init__(self, aggressiveness: int = 2):
        self.level = self.LEVELS[aggressiveness]

    def is_speech(self, frame: bytes, rate: int = RATE) -> bool:
        samples = np.frombuffer(frame, "<i2", len(frame) // 2).astype(np.float64)
        return bool(len(samples)) and float(np.sqrt(np.mean(samples**2))) >= self.level


def model_detector(aggressiveness: int = 2) -> Detector:
    """The detector of the webrtcvad package, which the workers need."""
    try:
        import webrtcvad
    except ImportError as error:
        raise ImportError("speech detection by model needs webrtcvad on the workers") from error
    return webrtcvad.Vad(aggressiveness)


def with_speech(frames: DataFrame, make: Callable[[], Detector], rate: int = RATE) -> DataFrame:
    """frames (with payload, 16-bit samples) plus is_speech; batch or streaming. A null frame is silent."""
    place, names = frames.columns.index("payload"), [*frames.columns, "is_speech"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        detector = make()
        for batch in batches:
            marks = [p is not None and detector.is_speech(p, rate) for p in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(marks, pa.bool_())], names=names)

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in frames.schema.fields] + ["is_speech boolean"])
    return frames.mapInArrow(run, schema)

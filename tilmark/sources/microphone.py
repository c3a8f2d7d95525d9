"""A live frame source for Structured Streaming: format ``frames``, one row per frame of 480 samples.

Options: device, a ``module:function`` that gives an endless iterator of frames (bytes); the default reads the microphone with
pyaudio, which the driver's machine needs. stream_id numbers the stream, frames_per_batch bounds a micro-batch. Frames of
uncommitted batches are kept, so a batch can be read again.
"""

from __future__ import annotations

import importlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from tilmark.operators.speech import FRAME_SAMPLES, RATE


def microphone() -> Iterator[bytes]:
    try:
        import pyaudio
    except ImportError as error:
        raise ImportError("the microphone needs pyaudio") from error
    device = pyaudio.PyAudio()
    stream = device.open(format=pyaudio.paInt16, channels=1, rate=RATE, input=True, frames_per_buffer=FRAME_SAMPLES)
    try:
        while True:
            yield stream.read(FRAME_SAMPLES, exception_on_overflow=False)
    finally:
        stream.close()
        device.terminate()


def tone() -> Iterator[bytes]:
    """A dry run without a device: half a second of tone, then a second of silence, again and again."""
    samples = (8000 * np.sin(2 * np.pi * 440 * np.arange(FRAME_SAMPLES) / RATE)).astype("<i2").tobytes()
    number = 0
    while True:
        yield samples if number % 50 < 17 else bytes(2 * FRAME_SAMPLES)
        number += 1


class FrameReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.device = options.get("device", f"{__name__}:microphone")
        self.frames: Iterator[bytes] | None = None
        self.stream = int(options.get("stream_id", 0))
        self.most = int(options.get("frames_per_batch", 100))
        self.kept: dict[int, bytes] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"frames": None}

    def _next(self) -> bytes:
        if self.frames is None:
            module, _, name = self.device.partition(":")
            self.frames = getattr(importlib.import_module(module), name)()
        return next(self.frames)

    def initialOffset(self) -> dict:  # noqa: N802
        return {"seq": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        end = start["seq"] + self.most
        return self.readBetweenOffsets(start, {"seq": end}), {"seq": end}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        for seq in range(start["seq"], end["seq"]):
            if seq not in self.kept:
                self.kept[seq] = self._next()
        return iter([(self.stream, seq, self.kept[seq]) for seq in range(start["seq"], end["seq"])])

    def commit(self, end: dict) -> None:
        self.kept = {seq: frame for seq, frame in self.kept.items() if seq >= end["seq"]}


class FrameSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return "stream_id long, seq long, payload binary"

    def simpleStreamReader(self, schema) -> FrameReader:  # noqa: ANN001, N802
        return FrameReader(self.options)

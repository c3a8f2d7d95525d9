"""Segmentation of frame streams by voice activity.

A segment begins with the first speech frame while idle and ends with the frame that brings the count of its silent frames
to the limit (the count runs on through speech). It is preceded by the last frames of silence seen while idle, however
long ago. A segment without an end is not emitted unless a flush is asked for.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

SILENCE_LIMIT, PRE_ROLL = 20, 10
SEGMENTS = "stream_id long, segment_no int, start_seq long, end_seq long, seqs array<long>, raw binary"


@dataclass
class Segmenter:
    """The running state of one stream."""

    limit: int = SILENCE_LIMIT
    keep: int = PRE_ROLL
    number: int = 0
    silent: int = 0
    start: int | None = None
    held: list[tuple[int, bytes]] = field(default_factory=list)
    before: list[tuple[int, bytes]] = field(default_factory=list)

    def push(self, seq: int, payload: bytes, speech: bool) -> tuple | None:
        """A finished segment (segment_no, start_seq, end_seq, seqs, raw), if this frame ends one."""
        frame = (seq, payload or b"")
        if self.start is None and not speech:
            self.before = [*self.before, frame][-self.keep :] if self.keep else []
            return None
        if self.start is None:
            self.start, self.silent, self.held = seq, 0, list(self.before)
        self.held.append(frame)
        self.silent += not speech
        return self.close() if self.silent >= self.limit else None

    def close(self) -> tuple | None:
        if self.start is None:
            return None
        out = (self.number, self.start, self.held[-1][0], [s for s, _ in self.held], b"".join(p for _, p in self.held))
        self.number, self.start, self.silent, self.held = self.number + 1, None, 0, []
        return out


@dataclass
class ArraySegmenter:
    """The same for arrays of one stream's frames: work in Python is per segment, not per frame. Frames are kept as slices of the arrays they came in."""

    limit: int = SILENCE_LIMIT
    keep: int = PRE_ROLL
    number: int = 0
    silent: int = 0
    start: int | None = None
    held: list[tuple[np.ndarray, pa.Array]] = field(default_factory=list)
    before: list[tuple[np.ndarray, pa.Array]] = field(default_factory=list)

    def push(self, seq: np.ndarray, payload: pa.Array, speech: np.ndarray) -> Iterator[tuple]:
        """Segments that the frames end."""
        loud, quiet = np.flatnonzero(speech), np.flatnonzero(~speech)
        at, n = 0, len(seq)
        while at < n:
            if self.start is None:
                k = np.searchsorted(loud, at)
                begin = int(loud[k]) if k < len(loud) else n
                self._idle(seq[max(at, begin - self.keep) : begin], payload.slice(max(at, begin - self.keep), min(self.keep, begin - at)))
                if begin == n:
                    return
                self.start, self.silent, self.held, at = int(seq[begin]), 0, list(self.before), begin
            k = int(np.searchsorted(quiet, at))
            missing = self.limit - self.silent
            last = at if missing <= 0 else int(quiet[k + missing - 1]) if k + missing <= len(quiet) else None
            end = n if last is None else last + 1
            self.held.append((seq[at:end], payload.slice(at, end - at)))
            self.silent += int(np.searchsorted(quiet, end)) - k
            at = end
            if last is not None:
                yield self.close()

    def _idle(self, seq: np.ndarray, payload: pa.Array) -> None:
        """The last silent frames: those kept so far and new ones, at most `keep` of them."""
        own, spare = [(seq, payload)] if len(seq) else [], self.keep - len(seq)
        for s, p in reversed(self.before):
            if spare <= 0:
                break
            take = min(spare, len(s))
            own.insert(0, (s[len(s) - take :], p.slice(len(s) - take)))
            spare -= take
        self.before = own

    def close(self) -> tuple | None:
        if self.start is None:
            return None
        seqs = np.concatenate([s for s, _ in self.held])
        raw = b"".join(x or b"" for _, p in self.held for x in p.to_pylist())
        out = (self.number, self.start, int(seqs[-1]), seqs, raw)
        self.number, self.start, self.silent, self.held = self.number + 1, None, 0, []
        return out


def segment_rows(batches: Iterable[pa.RecordBatch], limit: int, keep: int, flush: bool) -> Iterator[tuple]:
    """Segments of frames (stream, seq, payload, speech), ordered by stream and seq. A null speech mark is silence."""
    stream, state = None, None
    for batch in batches:
        streams, seq = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        speech = np.asarray(pc.fill_null(batch.column(3), False))
        cuts = [0, *(np.flatnonzero(np.diff(streams)) + 1).tolist(), len(streams)] if len(streams) else [0]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if state is None or int(streams[a]) != stream:
                if flush and state and (last := state.close()):
                    yield (stream, *last)
                stream, state = int(streams[a]), ArraySegmenter(limit, keep)
            for done in state.push(seq[a:b], batch.column(2).slice(a, b - a), speech[a:b]):
                yield (stream, *done)
    if flush and state and (last := state.close()):
        yield (stream, *last)


def segment(frames: DataFrame, limit: int = SILENCE_LIMIT, keep: int = PRE_ROLL, flush_on_end: bool = False) -> DataFrame:
    """frames (stream_id, seq, payload, is_speech) -> SEGMENTS. A task reads its streams as arrays, a batch at a time, and holds one open
    segment, however long a stream is. stream_id and seq are not null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for stream, number, start, end, seqs, raw in segment_rows(batches, limit, keep, flush_on_end):
            kinds = pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((stream, number, start, end, seqs, raw), kinds, strict=True)], names=[f.split()[0] for f in SEGMENTS.split(", ")])

    dealt = frames.selectExpr("cast(stream_id as long) stream_id", "cast(seq as long) seq", "payload", "is_speech").repartition("stream_id").sortWithinPartitions("stream_id", "seq")
    return dealt.mapInArrow(run, SEGMENTS)

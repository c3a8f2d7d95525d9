"""Segmentation of frame streams of any length by many tasks, with the segments of tilmark.operators.segment.

Frames are dealt by ranges of (stream, seq), so a stream may lie in many parts, and a part is cut into pieces of a bounded number of frames. What a piece does to
the segmenter is a function of the state it starts in: idle, or in speech with 0 to limit - 1 silent frames. It is tabled for every start, as the state at the
end and the number of segments that end within. Functions are composed, in a part as its task goes along, over the parts of a stream by a prefix scan of doubling steps; then
every piece knows its start and is cut by itself.

A segment inside one piece is a row at once. One that lies in several is sent as fragments, which meet by segment. The silent frames before a segment may
come from an earlier piece, however far back: the last of each piece are scanned the same way, pieces that have enough of their own take no part in it.

Broadcast are the starts of parts that a stream enters from the part before: at most one a part. What is held at a time is a piece, or one segment.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilmark.operators.segment import PRE_ROLL, SEGMENTS, SILENCE_LIMIT
from tilmark.plans import store

PIECE = 4096
_FRAME = "struct<seq:bigint,payload:binary>"
_PIECES = f"stream_id long, part long, k long, frames array<{_FRAME}>, speech array<boolean>, start_go array<int>, start_ends array<int>, go array<int>, ends array<int>"
_CUT = f"stream_id long, i long, number int, begun boolean, closed boolean, start_seq long, end_seq long, missing int, seqs array<long>, raw binary, idle array<{_FRAME}>"


class Moves:
    """How the segmenter goes through a piece."""

    def __init__(self, speech: np.ndarray, limit: int):
        self.limit, self.n = limit, len(speech)
        self.loud, self.quiet = np.flatnonzero(speech), np.flatnonzero(~speech)

    def spans(self, state: int) -> tuple[list[tuple[int, int, bool, bool]], int]:
        """Spans (from, to, begun here, closed here) of segments, to exclusive, and the state at the end, from a start state: 0 idle, else 1 and the silent frames."""
        out, at = [], 0
        while True:
            if state == 0:
                k = np.searchsorted(self.loud, at)
                if k == len(self.loud):
                    return out, 0
                begin, silent, begun = int(self.loud[k]), 0, True
            else:
                begin, silent, begun = at, state - 1, False
            q = int(np.searchsorted(self.quiet, begin))
            if q + self.limit - silent > len(self.quiet):
                out.append((begin, self.n, begun, False))
                return out, 1 + silent + len(self.quiet) - q
            at, state = int(self.quiet[q + self.limit - silent - 1]) + 1, 0
            out.append((begin, at, begun, True))

    def table(self) -> tuple[list[int], list[int]]:
        """For every start state: the state at the end and how many segments close."""
        go, ends, known = [], [], {}
        for state in range(self.limit + 1):
            after = self._first_close(state)
            if after is None:
                spans, last = self.spans(state)
                go.append(last)
                ends.append(sum(c for *_, c in spans))
                continue
            if after not in known:
                rest = Moves.__new__(Moves)
                rest.limit, rest.n = self.limit, self.n - after
                rest.loud, rest.quiet = (x[np.searchsorted(x, after) :] - after for x in (self.loud, self.quiet))
                spans, last = rest.spans(0)
                known[after] = last, sum(c for *_, c in spans)
            go.append(known[after][0])
            ends.append(known[after][1] + 1)
        return go, ends

    def _first_close(self, state: int) -> int | None:
        """Where the segment that is open at the start has closed; None if it has not, or none is open."""
        missing = self.limit - state + 1
        return int(self.quiet[missing - 1]) + 1 if state and missing <= len(self.quiet) else None


def cut_pieces(frames: DataFrame, limit: int = SILENCE_LIMIT, size: int = PIECE, parts: int | None = None) -> DataFrame:
    """frames (stream_id, seq, payload, is_speech) as written pieces. start_go, start_ends: from the start of the stream's part to the piece; go, ends: to its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        stream, k, held, n = None, 0, [], 0
        same = (list(range(limit + 1)), [0] * (limit + 1))
        so_far = same

        def row() -> pa.RecordBatch:
            nonlocal k, held, n, so_far
            seqs, payloads, speech = (pa.concat_arrays([h[x] for h in held]) for x in range(3))
            go, ends = Moves(np.asarray(speech), limit).table()
            after = [go[s] for s in so_far[0]], [e + ends[s] for s, e in zip(*so_far, strict=True)]
            frames_ = pa.StructArray.from_arrays([seqs, payloads], ["seq", "payload"])
            whole = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            ints = lambda x: pa.array([x], pa.list_(pa.int32()))
            columns = [pa.array([stream]), pa.array([part]), pa.array([k]), whole(frames_), whole(speech), *map(ints, (*so_far, *after))]
            k, held, n, so_far = k + 1, [], 0, after
            return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _PIECES.split(", ")])

        for batch in batches:
            streams = np.asarray(batch.column(0))
            edges = [0, *(np.flatnonzero(np.diff(streams)) + 1).tolist(), len(streams)] if len(streams) else []
            values = [batch.column(1), batch.column(2), pc.fill_null(batch.column(3), False)]
            for a, b in zip(edges, edges[1:], strict=False):
                if int(streams[a]) != stream:
                    if n:
                        yield row()
                    stream, k, so_far = int(streams[a]), 0, same
                while a < b:
                    take = min(b - a, size - n)
                    held.append([v.slice(a, take) for v in values])
                    a, n = a + take, n + take
                    if n == size:
                        yield row()
        if n:
            yield row()

    plain = frames.selectExpr("cast(stream_id as long) stream_id", "cast(seq as long) seq", "coalesce(payload, X'') payload", "is_speech")
    ranges = ["stream_id", "seq"] if parts is None else [parts, "stream_id", "seq"]
    return store.written(plain.repartitionByRange(*ranges).sortWithinPartitions("stream_id", "seq").mapInArrow(run, _PIECES), "pieces")


def composed(first: Column, then: Column) -> Column:
    """A function (struct of go and ends) after another."""
    go = F.transform(first["go"], lambda s: F.get(then["go"], s))
    ends = F.zip_with(first["ends"], first["go"], lambda e, s: e + F.get(then["ends"], s))
    return F.struct(go.alias("go"), ends.alias("ends"))


def scanned(rows: DataFrame, value: str, combine, most: int, open_rows: Column | None = None) -> DataFrame:  # noqa: ANN001
    """rows (stream_id, i from 0 without gaps, value, ...) with value replaced by that of all rows up to it, in doubling steps: after the k-th a row has 2^k rows' worth.
    combine(earlier, later) is associative. open_rows: which rows still gain by earlier ones."""
    done, reach = rows, 1
    while reach <= most:
        takes = (F.col("i") >= reach) & (open_rows if open_rows is not None else F.lit(True))
        if open_rows is not None and done.filter(takes).isEmpty():
            break
        before = done.select("stream_id", (F.col("i") + reach).alias("i"), F.col(value).alias("earlier"))
        gained = done.filter(takes).join(before, ["stream_id", "i"]).withColumn(value, combine(F.col("earlier"), F.col(value))).select(*done.columns)
        done = store.written(done.filter(~takes).unionByName(gained), "scan")
        reach *= 2
    return done


def starts(pieces: DataFrame) -> DataFrame:
    """(stream_id, part, state, number, offset) at the beginning of every part that a stream enters from an earlier one: its state, how many segments and how many pieces were before."""
    last = F.max_by(F.struct("go", "ends"), "k").alias("f")
    parts = pieces.groupBy("stream_id", "part").agg(last, F.count("*").alias("pieces"))
    own = Window.partitionBy("stream_id")
    in_order = own.orderBy("part")
    listed = parts.withColumns({"parts": F.count("*").over(own), "i": F.row_number().over(in_order).cast("long") - 1, "offset": F.sum("pieces").over(in_order) - F.col("pieces")}).filter("parts > 1")
    crossing = store.written(listed.select("stream_id", "i", "part", "offset", "f"), "parts")
    most = crossing.agg(F.max("i")).head()[0] or 0
    upto = scanned(crossing, "f", composed, most)
    before = upto.select("stream_id", (F.col("i") + 1).alias("i"), F.get("f.go", F.lit(0)).alias("state"), F.get("f.ends", F.lit(0)).alias("number"))
    return crossing.join(before, ["stream_id", "i"]).select("stream_id", "part", "state", "number", "offset")


def cut_segments(pieces: DataFrame, begins: DataFrame, limit: int, keep: int) -> DataFrame:
    """Pieces as rows of _CUT: segments whole and in fragments, and (number null) the piece's last idle frames. missing: how many frames of silence to take from earlier pieces."""
    at_start = begins.select(F.col("stream_id").alias("of"), F.col("part").alias("of_part"), "state", "number", "offset")
    known = pieces.join(F.broadcast(at_start), (F.col("stream_id") == F.col("of")) & (F.col("part") == F.col("of_part")), "left")
    enter = F.coalesce("state", F.lit(0))
    named = known.select(
        "stream_id", (F.coalesce("offset", F.lit(0)) + F.col("k")).cast("long").alias("i"), F.get("start_go", enter).cast("int").alias("state"),
        (F.coalesce("number", F.lit(0)) + F.get("start_ends", enter)).cast("int").alias("number"), "frames", "speech",
    )
    kinds = pa.schema([("stream_id", pa.int64()), ("i", pa.int64()), ("number", pa.int32()), ("begun", pa.bool_()), ("closed", pa.bool_()), ("start_seq", pa.int64()), ("end_seq", pa.int64()), ("missing", pa.int32()), ("seqs", pa.list_(pa.int64())), ("raw", pa.binary()), ("idle", pa.list_(pa.struct([("seq", pa.int64()), ("payload", pa.binary())])))])

    def rows_of(stream: int, i: int, state: int, number: int, frames: pa.StructArray, speech: np.ndarray) -> Iterator[dict]:
        seqs, payloads = np.asarray(frames.field("seq")), frames.field("payload")
        raw = lambda at: b"".join(payloads.take(pa.array(at)).to_pylist())
        spans, _ = Moves(speech, limit).spans(state)
        busy = np.zeros(len(seqs) + 1, np.int64)
        for a, b, _, _ in spans:
            busy[a] += 1
            busy[b] -= 1
        idle = np.flatnonzero(np.cumsum(busy)[:-1] == 0)
        for a, b, begun, closed in spans:
            own = idle[max(0, (upto := int(np.searchsorted(idle, a))) - keep) : upto] if begun and keep else idle[:0]
            at = np.concatenate((own, np.arange(a, b)))
            yield {"stream_id": stream, "i": i, "number": number, "begun": begun, "closed": closed, "start_seq": int(seqs[a]) if begun else None, "end_seq": int(seqs[b - 1]), "missing": keep - len(own) if begun else 0, "seqs": seqs[at], "raw": raw(at), "idle": None}
            number += closed
        tail = idle[len(idle) - min(keep, len(idle)) :]
        yield {"stream_id": stream, "i": i, "idle": frames.take(pa.array(tail)).to_pylist()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(len(batch)):
                stream, i, state, number = (batch.column(c)[r].as_py() for c in range(4))
                rows = list(rows_of(stream, i, state, number, batch.column(4)[r].values, np.asarray(batch.column(5)[r].values)))
                yield pa.RecordBatch.from_pylist([{n: row.get(n) for n in kinds.names} for row in rows], kinds)

    return store.written(named.mapInArrow(run, _CUT), "cut")


def segment_pieces(frames: DataFrame, limit: int = SILENCE_LIMIT, keep: int = PRE_ROLL, flush_on_end: bool = False, size: int = PIECE, parts: int | None = None) -> DataFrame:
    """frames (stream_id, seq, payload, is_speech) -> SEGMENTS, as tilmark.operators.segment.segment. stream_id and seq are not null. parts: into how many ranges
    to deal the frames; as many as Spark's partitions if it is not given."""
    if limit < 1 or keep < 0 or size < 1:
        raise ValueError("limit and size must be positive, keep not negative")
    with store.step():
        pieces = cut_pieces(frames, limit, size, parts)
        cut = cut_segments(pieces, starts(pieces), limit, keep)
        tails = cut.filter("idle is not null").select("stream_id", "i", "idle")
        last = lambda earlier, later: F.slice(F.concat(earlier, later), F.greatest(F.size(earlier) + F.size(later) - keep, F.lit(0)) + 1, keep)
        spans = cut.filter("number is not null")
        whole = F.col("begun") & F.col("closed") & ((F.col("missing") == 0) | (F.col("i") == 0))
        direct = spans.filter(whole).select("stream_id", F.col("number").alias("segment_no"), "start_seq", "end_seq", "seqs", "raw")
        parts = spans.filter(~whole)
        most = tails.agg(F.max("i")).head()[0] or 0
        if keep and most:
            idle = scanned(tails, "idle", last, most, F.size("idle") < keep)
            before = idle.select("stream_id", (F.col("i") + 1).alias("i"), F.col("idle").alias("earlier"))
            needy = parts.filter("missing > 0").join(before, ["stream_id", "i"], "left")
            taken = F.when(F.col("earlier").isNull(), F.array().cast(f"array<{_FRAME}>")).otherwise(F.slice("earlier", F.greatest(F.size("earlier") - F.col("missing"), F.lit(0)) + 1, F.col("missing")))
            raw = F.concat(F.aggregate("taken", F.lit(b""), lambda made, x: F.concat(made, x["payload"])), F.col("raw"))
            filled = needy.withColumn("taken", taken).withColumns({"seqs": F.concat(F.transform("taken", lambda x: x["seq"]), "seqs"), "raw": raw}).select(*parts.columns)
            parts = parts.filter("missing = 0").unionByName(filled)
        each = F.array_sort(F.collect_list(F.struct("i", "seqs", "raw")))
        met = parts.groupBy("stream_id", F.col("number").alias("segment_no")).agg(F.max("start_seq").alias("start_seq"), F.max_by("end_seq", "i").alias("end_seq"), F.bool_or("closed").alias("closed"), each.alias("parts"))
        joined = met.filter("closed" if not flush_on_end else "true").select(
            "stream_id", "segment_no", "start_seq", "end_seq", F.flatten(F.transform("parts", lambda p: p["seqs"])).alias("seqs"), F.aggregate("parts", F.lit(b""), lambda made, p: F.concat(made, p["raw"])).alias("raw")
        )
        return store.result(direct.unionByName(joined), "segments").selectExpr(*[c.split()[0] for c in SEGMENTS.split(", ")])

from __future__ import annotations

import random
from functools import partial

from tilmark.operators.segment import segment
from tilmark.operators.transcribe import WordStub
from tilmark.streaming import live

FRAMES = live.FRAMES


def frames_of(flags: str, stream: int = 1):
    return [(stream, i, bytearray([i % 256]), f == "1") for i, f in enumerate(flags)]


def test_by_hand(spark):
    rows = frames_of("00010100100")
    got = segment(spark.createDataFrame(rows, FRAMES), 2, 2).orderBy("segment_no").collect()
    assert [(r["start_seq"], r["end_seq"], r["seqs"]) for r in got] == [(3, 6, [1, 2, 3, 4, 5, 6]), (8, 10, [2, 7, 8, 9, 10])]
    assert bytes(got[0]["raw"]) == bytes([1, 2, 3, 4, 5, 6])
    cut = spark.createDataFrame(rows[:-1], FRAMES)
    assert segment(cut, 2, 2).count() == 1
    assert segment(cut, 2, 2, flush_on_end=True).count() == 2
    assert segment(spark.createDataFrame([], FRAMES)).count() == 0


def brute(flags: list[bool], limit: int, keep: int):
    """Starts and ends from running counts of silence, then frames by set."""
    silence, total = [], 0
    for f in flags:
        total += not f
        silence.append(total)
    spans, at = [], 0
    while (start := next((i for i in range(at, len(flags)) if flags[i]), None)) is not None:
        end = next((j for j in range(start, len(flags)) if not flags[j] and silence[j] == silence[start] + limit), None)
        if end is None:
            break
        spans.append((start, end))
        at = end + 1
    inside = {i for a, b in spans for i in range(a, b + 1)}
    return [(a, b, [i for i in range(a) if not flags[i] and i not in inside][-keep:] + list(range(a, b + 1))) for a, b in spans]


def many():
    rng = random.Random(5)
    return {s: [rng.random() < 0.3 for _ in range(rng.randrange(200))] for s in range(12)}


def test_many_streams(spark):
    streams = many()
    rows = [(s, i, bytearray(b"x"), f) for s, flags in streams.items() for i, f in enumerate(flags)]
    random.Random(1).shuffle(rows)
    got = {}
    for r in segment(spark.createDataFrame(rows, FRAMES), 5, 3).orderBy("stream_id", "segment_no").collect():
        got.setdefault(r["stream_id"], []).append((r["start_seq"], r["end_seq"], r["seqs"]))
    assert got == {s: b for s, flags in streams.items() if (b := brute(flags, 5, 3))}


make_stub = partial(WordStub, ["praise", "be", "to", "all"], 2)


def test_stream_equals_batch_across_batches_and_restart(spark, tmp_path):
    streams = many()
    rows = sorted((s, i, bytearray(b"\x00\x10" * 3), f) for s, flags in streams.items() for i, f in enumerate(flags))
    live.rocksdb(spark)
    corpus = spark.createDataFrame([(0, 1, 1, "praise be to all", "praise be to all")], "idx long, surah int, ayah int, plain string, original string")
    seen, dead = [], []

    def run():
        found = live.live_segments(live.read_frames(spark, str(tmp_path / "in"), files_per_batch=1), 5, 3)
        query = live.start(found, corpus, make_stub, lambda df, n: seen.extend(r["hyp_id"] for r in df.collect()), str(tmp_path / "cp"), on_dead=lambda df, n: dead.extend(r["hyp_id"] for r in df.collect()), drain=True, least=1)
        query.awaitTermination()

    for lo, hi in ((0, 40), (40, 90), (90, 200)):
        spark.createDataFrame([r for r in rows if lo <= r[1] < hi], FRAMES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if lo != 40:
            run()
    wanted = segment(spark.createDataFrame(rows, FRAMES), 5, 3).count()
    assert len(set(seen) | set(dead)) == len(seen) + len(dead) == wanted


def test_arrays_like_single_frames():
    import numpy as np
    import pyarrow as pa

    from tilmark.operators.segment import ArraySegmenter, Segmenter

    rng = np.random.default_rng(2)
    for _ in range(300):
        limit, keep, n = int(rng.integers(0, 5)), int(rng.integers(0, 5)), int(rng.integers(0, 60))
        speech = rng.random(n) < rng.choice([0.1, 0.5, 0.9])
        payload = [None if rng.random() < 0.1 else bytes([i % 250]) for i in range(n)]
        one, many = Segmenter(limit, keep), ArraySegmenter(limit, keep)
        want = [x for i in range(n) if (x := one.push(i, payload[i], bool(speech[i])))]
        cuts = sorted({0, n, *rng.integers(0, n + 1, 3).tolist()})
        got = [x for a, b in zip(cuts, cuts[1:], strict=False) for x in many.push(np.arange(a, b), pa.array(payload[a:b], pa.binary()), speech[a:b])]
        both = [(x, y) for x, y in ((one.close(), many.close()),) if x or y]
        assert [(*x[:3], list(x[3]), x[4]) for x in got] == want
        assert all((*y[:3], list(y[3]), y[4]) == x for x, y in both)

from __future__ import annotations

import json
from functools import partial

import pytest
from pyspark.sql import functions as F

from tilmark import cli
from tilmark.operators.align import align
from tilmark.operators.speech import EnergyDetector, model_detector, with_speech
from tilmark.operators.transcribe import SpeechModel, WordStub
from tilmark.plans.monitor import observed
from tilmark.plans.pipeline import run_files, run_waves
from tilmark.sources.microphone import FrameReader, FrameSource, microphone
from tilmark.streaming import live

stub = partial(WordStub, ["praise", "be", "to", "all"], 2)


def corpus_of(spark):
    return spark.createDataFrame([(0, 1, 1, "praise be to all", "praise be to all")], "idx long, surah int, ayah int, plain string, original string")


def counting(calls):
    """A maker of stubs that note every call in a file, and fail on waves that begin loud."""

    class Counting(WordStub):
        def transcribe(self, chunks):
            with open(calls, "a") as f:
                f.write("x")
            if any(c[0] >= 0.9 for c in chunks):
                raise ValueError("too loud")
            return super().transcribe(chunks)

    return lambda: Counting(["praise", "be", "to", "all"], 2)


def test_model_errors_are_set_aside_and_batches_transcribed_once(spark, tmp_path):
    import numpy as np

    wave = lambda *v: (np.repeat(np.array(v) * 32767, 2).astype("<i2")).tobytes()
    rows = [(1, 0, wave(0, 0.3, 0.6, 0.95)), (1, 1, wave(0.95, 0.3)), (2, 0, wave(0.8, 0.8, 0.8, 0.8))]
    kind = "stream_id long, segment_no int, raw binary"
    spark.createDataFrame(rows, kind).coalesce(1).write.parquet(str(tmp_path / "in"))
    good, dead = [], []
    calls = tmp_path / "calls"
    segments = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
    take = lambda out: lambda frame, _: out.extend(frame.select("match_status", "hypothesis", "error").collect())
    live.start(segments, corpus_of(spark), counting(str(calls)), take(good), str(tmp_path / "cp"), on_dead=take(dead), drain=True, least=1).awaitTermination()
    assert sorted(tuple(r) for r in good) == [("matched", "all all all all", None), ("matched", "praise be to all", None)]
    assert [tuple(r) for r in dead] == [("failed", None, "ValueError: too loud")]
    assert len(calls.read_text()) == 4  # the batch, and after its failure each chunk alone


def test_scopes_as_columns_read_the_input_once(spark, tmp_path):
    waves = spark.createDataFrame([(k, [0.0, 0.0, 0.3, 0.3, 0.6, 0.6, 0.8, 0.8], 1 if k % 3 else None, 1 if k == 1 else None) for k in range(6)], "hyp_id long, samples array<float>, surah int, ayah int").coalesce(1)
    from tilmark.operators.transcribe import transcribe

    heard = transcribe(waves, counting(str(tmp_path / "calls"))).select("hyp_id", F.col("transcript.text").alias("text"), "surah", "ayah")
    got = {r["hyp_id"]: r["match_status"] for r in align(heard, corpus_of(spark)).collect()}
    assert got == {k: "exact" if k == 1 else "matched" for k in range(6)}
    assert len((tmp_path / "calls").read_text()) == 1


def test_reader_gives_a_batch_again():
    reader = FrameReader({"device": "tilmark.sources.microphone:tone", "stream_id": "4", "frames_per_batch": "30"})
    rows, end = reader.read(reader.initialOffset())
    rows = list(rows)
    assert (len(rows), end) == (30, {"seq": 30})
    assert list(reader.readBetweenOffsets({"seq": 0}, {"seq": 30})) == rows
    reader.commit({"seq": 30})
    again, _ = reader.read(end)
    assert [r[:2] for r in again] == [(4, s) for s in range(30, 60)]


def test_tone_becomes_segments(spark, tmp_path):
    live.rocksdb(spark)
    spark.dataSource.register(FrameSource)
    frames = spark.readStream.format("frames").option("device", "tilmark.sources.microphone:tone").option("frames_per_batch", 60).load()
    found = live.live_segments(with_speech(frames, partial(EnergyDetector, 2)))
    query = found.writeStream.format("memory").queryName("tone_segments").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="0 seconds").start()
    try:
        for _ in range(120):
            query.awaitTermination(0.5)
            if spark.table("tone_segments").count() >= 3:
                break
    finally:
        query.stop()
    rows = spark.table("tone_segments").orderBy("segment_no").limit(3).collect()
    assert [(r["start_seq"], r["end_seq"]) for r in rows] == [(0, 36), (50, 86), (100, 136)]
    assert rows[1]["seqs"][:10] == list(range(40, 50))


def test_detectors_and_models_need_their_packages():
    for make in (model_detector, partial(SpeechModel, "some-model"), lambda: next(microphone())):
        with pytest.raises(ImportError):
            make()
    quiet = EnergyDetector(0)
    assert not quiet.is_speech(bytes(960))
    assert not quiet.is_speech(b"")


def test_waves_and_observed_counts(spark):
    waves = spark.createDataFrame([(1, [0.0, 0.0, 0.3, 0.3, 0.6, 0.6, 0.8, 0.8]), (2, [])], "hyp_id long, samples array<float>")
    rows, seen = observed(run_waves(waves, corpus_of(spark), stub))
    got = {r["hyp_id"]: r for r in rows.collect()}
    assert (got[1]["hypothesis"], got[1]["match_status"], got[1]["wer"]) == ("praise be to all", "matched", 0.0)
    assert got[2]["match_status"] == "below_threshold"
    assert (seen.get["rows"], seen.get["matched"], seen.get["below_threshold"], seen.get["mean_wer"]) == (2, 1, 1, 0.0)


def test_files_end_to_end(spark, tmp_path, capsys):
    import wave

    import numpy as np

    samples = np.repeat(np.array([0, 0.3, 0.6, 0.95]) * 32767, 2).astype("<i2")
    (tmp_path / "wav").mkdir()
    with wave.open(str(tmp_path / "wav/a.wav"), "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(16000)
        w.writeframes(samples.tobytes())
    (tmp_path / "wav/b.wav").write_bytes(b"no")
    found = run_files(spark, str(tmp_path / "wav"), corpus_of(spark), counting(str(tmp_path / "calls"))).select("path", "match_status", "hypothesis", F.round("wer", 3), "error").orderBy("path").collect()
    assert [(r[0].rsplit("/", 1)[1], *r[1:4]) for r in found] == [("a.wav", "matched", "praise be to all", 0.0), ("b.wav", "failed", None, None)]
    assert found[0]["error"] is None
    assert found[1]["error"]
    assert len((tmp_path / "calls").read_text()) == 1
    (tmp_path / "c.json").write_text(json.dumps({"1": {"1": {"text": "praise be to all"}}}))
    args = ["file", str(tmp_path / "wav"), "--corpus", str(tmp_path / "table"), "--document", str(tmp_path / "c.json"), "--model", "stub"]
    assert cli.main(args, make=stub) == 1
    said = capsys.readouterr()
    assert "[praise]  [be]  [to]  [all]" in said.out
    assert "b.wav: failed" in said.err
    (tmp_path / "wav/b.wav").unlink()
    assert cli.main(args, make=stub) == 0
    assert cli.main(["file", str(tmp_path / "missing.wav"), *args[2:]], make=stub) == 1
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["realtime", "--corpus", "c", "--model", "m", "--checkpoint", "p", "--vad", "4"])


def test_same_plan_for_empty_input(spark):
    none = spark.createDataFrame([], "hyp_id long, text string, surah int, ayah int")
    assert align(none, corpus_of(spark)).collect() == []
    assert align(none, corpus_of(spark).limit(0)).collect() == []

from __future__ import annotations

import io
import json
import wave
from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilmark.functions import audio
from tilmark.operators.transcribe import WordStub, transcribe
from tilmark.sources import audio_files
from tilmark.sources import corpus as corpora


def test_nested_document(spark, tmp_path):
    raw = '{"2": {"1": {"text": "b\\u064e"}}, "1": {"1": {"text": "a"}, "2": {"text": "c"}, "1": {"text": "d"}}}'
    (tmp_path / "c.json").write_text(raw)
    got = corpora.index(corpora.flatten_nested(corpora.read_json(spark, str(tmp_path / "c.json")))).collect()
    assert [tuple(r) for r in sorted(got)] == [(0, 2, 1, "b", "bَ"), (1, 1, 1, "d", "d"), (2, 1, 2, "c", "c")]


def test_nested_lookup(spark):
    raw = json.dumps({"1": {"1": {"text": "a"}, "2": {"text": "b"}}})
    frame = spark.createDataFrame([(raw, 1, 2), (raw, 1, 3), (raw, 2, 1), ("{}", 1, 1), (None, 1, 1)], "d string, s int, a int")
    assert [r[0] for r in frame.select(corpora.nested_text("d", F.col("s"), F.col("a"))).collect()] == ["b", None, None, None, None]


def test_service_document(spark):
    ayah = lambda n, t: {"numberInSurah": n, "text": t}
    raw = {"data": {"surahs": [{"number": 1, "ayahs": [ayah(9, "old")]}, {"number": 2}, {"number": 1, "ayahs": [ayah(1, "a ۝"), ayah(2, "x"), ayah(1, "b ")]}]}}
    docs = spark.createDataFrame([(json.dumps(raw),), ("{}",)], "document string")
    got = corpora.parse_service(docs).orderBy("surah_pos", "ayah_pos").collect()
    assert [(r["surah"], r["ayah"], r["original"]) for r in got] == [(1, 1, "b"), (1, 2, "x")]
    assert corpora.service_surahs(docs).count() == 2
    assert tuple(corpora.service_counts(docs).first()) == (2, 2)
    nested = spark.createDataFrame([('{"1": {"1": {"text": "a"}, "1": {"text": "b"}}, "2": {}}',)], "document string")
    assert tuple(corpora.nested_counts(nested).first()) == (2, 1)
    with pytest.raises(Exception, match="surah without number"):
        corpora.parse_service(spark.createDataFrame([('{"data": {"surahs": [{"ayahs": []}]}}',)], "document string")).collect()


def test_store_round_trip(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"1": {"1": {"text": "a b"}, "2": {"text": "c"}}, "7": {"3": {"text": "d"}}}))
    with pytest.raises(FileNotFoundError):
        corpora.load_corpus(spark, str(tmp_path / "none"))
    stored = corpora.load_corpus(spark, str(tmp_path / "t"), str(tmp_path / "c.json"))
    assert [tuple(r) for r in corpora.load_corpus(spark, str(tmp_path / "t")).orderBy("idx").collect()] == [tuple(r) for r in stored.orderBy("idx").collect()]
    corpora.write_json(stored, str(tmp_path / "out"))
    again = corpora.index(corpora.flatten_nested(corpora.read_json(spark, str(tmp_path / "out/*.txt"))))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, stored.collect()))
    assert corpora.verse(stored, 1, 2) == "c"
    assert corpora.verse(stored, 9, 9) is None
    assert [tuple(r) for r in corpora.surah_verses(stored, 7).collect()] == [(3, "d")]
    with pytest.raises(ValueError, match="surah 4"):
        corpora.surah_verses(stored, 4)
    assert tuple(corpora.corpus_counts(stored).first()) == (2, 3)


def test_download_failure():
    with pytest.raises(ConnectionError):
        corpora.download("http://127.0.0.1:9/none", seconds=1)


def test_arrays(spark):
    rows = [(1, [float(i) for i in range(50)]), (2, []), (3, [0.0, 0.0]), (4, [-2.0, 1.0])]
    frame = spark.createDataFrame(rows, "k long, a array<float>")
    size = lambda c: F.transform(F.coalesce(c, F.array().cast("array<array<float>>")), lambda x: F.size(x))
    got = {r["k"]: r for r in frame.select("k", size(audio.tumbling_chunks("a", 24)).alias("t"), size(audio.overlapping_chunks("a", 24, 4)).alias("o"), audio.peak_normalise("a").alias("p"), audio.duration("a").alias("s")).collect()}
    assert (got[1]["t"], got[1]["o"]) == ([24, 24, 2], [24, 24, 10])
    assert (got[2]["t"], got[2]["o"], got[2]["p"]) == ([], [], [])
    assert got[3]["p"] == [0.0, 0.0]
    assert got[4]["p"] == [float(np.float32(-2) * (np.float32(0.95) / np.float32(2))), float(np.float32(0.95) / np.float32(2))]
    assert got[1]["s"] == 50 / 16000
    for bad in ((0, 0), (4, 4)):
        with pytest.raises(ValueError, match="chunk"):
            audio.overlapping_chunks("a", *bad)
    with pytest.raises(ValueError, match="chunk"):
        audio.tumbling_chunks("a", 0)


def test_pcm_and_downmix(spark):
    raw = np.array([-32768, 0, 16384], "<i2").tobytes()
    frame = spark.createDataFrame([(bytearray(raw), [[1.0, 3.0], [3.0, 5.0]]), (bytearray(b""), [])], "raw binary, c array<array<float>>")
    rows = frame.select(audio.pcm16_to_float("raw").alias("x"), audio.downmix("c").alias("m")).collect()
    assert [(r["x"], r["m"]) for r in rows] == [([-1.0, 0.0, 0.5], [2.0, 4.0]), ([], [])]


def wav(samples: np.ndarray, rate: int) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(samples.shape[1])
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(samples.astype("<i2").tobytes())
    return out.getvalue()


def test_files_and_resampling(spark, tmp_path):
    t = np.arange(8000) / 8000
    tone = np.sin(2 * np.pi * 440 * t)
    (tmp_path / "a.wav").write_bytes(wav(np.stack((tone, tone), 1) * 12000, 8000))
    (tmp_path / "b.wav").write_bytes(b"not audio")
    rows = {r["path"].rsplit("/", 1)[1]: r for r in audio_files.read_wav(spark, str(tmp_path)).collect()}
    assert rows["b.wav"]["samples"] is None
    assert rows["b.wav"]["error"]
    got = np.array(rows["a.wav"]["samples"])
    assert len(got) == 16000
    assert rows["a.wav"]["duration_s"] == 1.0
    assert np.abs(got).max() == pytest.approx(0.95, abs=1e-6)
    wanted = 0.95 * np.sin(2 * np.pi * 440 * np.arange(16000) / 16000)
    assert np.abs(got - wanted)[200:-200].max() < 0.02
    assert audio_files.resample(tone, 16000) is not None
    assert np.array_equal(audio_files.resample(tone, 16000), tone.astype(np.float32))


make_stub = partial(WordStub, ["one", " ", "two"], 4)


def test_transcripts(spark):
    frame = spark.createDataFrame([(1, [0.0] * 8 + [0.4] * 8 + [0.8] * 3), (2, []), (3, None)], "k long, samples array<float>")
    got = {r["k"]: r["transcript"] for r in transcribe(frame, make_stub, chunk_seconds=8 / 16000, timestamps=True, unknown=1).collect()}
    assert got[1]["text"] == "one one two"
    assert [c["text"] for c in got[1]["chunks"]] == ["one one", "   ", "two"]
    assert all(c["timestamp"] is None for c in got[1]["chunks"])
    assert (got[2]["text"], got[2]["duration_s"], got[2]["chunks"], got[3]["text"]) == ("", 0.0, [], "")
    with pytest.raises(ValueError, match="sample"):
        transcribe(frame, make_stub, chunk_seconds=0)

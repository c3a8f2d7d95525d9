"""Chunks of WAV files, read by byte ranges, have the bits of the whole waveforms."""

from __future__ import annotations

import struct
import wave

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tilmark.functions.audio import PEAK
from tilmark.sources.audio_blocks import head, opened, part, read_chunks, write_wav
from tilmark.sources.audio_files import GROUPS, decode_wav, read_wav, resample


def wav(path, n, rate, width, channels, seed=0):
    rng = np.random.default_rng(seed)
    with wave.open(str(path), "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(rate)
        w.writeframes(rng.integers(0, 256, n * width * channels, np.uint8).tobytes())


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 60_000), st.sampled_from([8000, 11025, 16000, 44100]), st.sampled_from([1, 2, 3, 4]), st.integers(1, 3), st.data())
def test_parts_have_the_bits_of_the_whole(tmp_path_factory, n, rate, width, channels, data):
    file = tmp_path_factory.mktemp("wav") / "a.wav"
    wav(file, n, rate, width, channels, n)
    channels_, _ = decode_wav(file.read_bytes())
    whole = resample(channels_.mean(axis=0), rate)
    start = data.draw(st.integers(0, len(whole) - 1))
    count = data.draw(st.integers(1, min(len(whole) - start, 20_000)))
    with opened(str(file)) as f:
        form = head(f, file.stat().st_size)
        assert form[:3] == (rate, width, channels)
        assert form[4] == n
        got = part(f, *form, start, count, 16_000)
    assert np.array_equal(got, whole[start : start + count])


def test_blocks_of_groups_are_the_plain_sum():
    samples = np.random.default_rng(1).normal(size=5 * GROUPS).astype(np.float32)
    parts = resample(samples, 11025)
    assert len(parts) == -(-len(samples) * 16000 // 11025)
    assert np.allclose(resample(samples, 16000), samples)


@pytest.mark.parametrize("normalise", [True, False])
def test_files_in_chunks(spark, tmp_path, normalise):
    for name, n, rate, width, channels in (("a", 30_000, 44_100, 2, 2), ("b", 5000, 8000, 1, 1), ("c", 700, 16_000, 3, 1), ("e", 0, 16_000, 2, 1), ("f", 1000, 16_000, 2, 1)):
        wav(tmp_path / f"{name}.wav", n, rate, width, channels)
    (tmp_path / "bad.wav").write_bytes(b"no audio")
    (tmp_path / "float.wav").write_bytes(b"RIFF\0\0\0\0WAVEfmt " + struct.pack("<IHHIIHH", 16, 3, 1, 8000, 32000, 4, 32) + b"data\0\0\0\0")
    got: dict[str, list] = {}
    failed = {}
    for r in read_chunks(spark, str(tmp_path), 1000, 100, normalise=normalise).collect():
        name = r["path"].rsplit("/", 1)[1]
        if r["error"] is not None:
            failed[name] = r["error"], r["samples"]
        else:
            got.setdefault(name, []).append((r["chunk"], r["start"], r["samples"]))
    assert failed == {"bad.wav": ("no RIFF WAVE file", None), "float.wav": ("format 3 of 32 bits is not read", None)}
    whole = {r["path"].rsplit("/", 1)[1]: r["samples"] for r in read_wav(spark, f"{tmp_path}/[abcef].wav", normalise=normalise).collect()}
    assert set(got) == {"a.wav", "b.wav", "c.wav", "f.wav"}
    for name, chunks in got.items():
        wanted, start = [], 0
        while True:
            wanted.append((len(wanted), start, whole[name][start : start + 1000]))
            if start + 1000 >= len(whole[name]):
                break
            start += 900
        assert sorted(chunks) == wanted
        if normalise:
            assert max(abs(x) for _, _, c in chunks for x in c) == pytest.approx(PEAK)


def test_headers(tmp_path):
    body = struct.pack("<HHIIHH", 1, 1, 8000, 16000, 2, 16)
    head_of = lambda raw: head(__import__("io").BytesIO(raw), len(raw))
    extensible = struct.pack("<HHIIHHHHIH14s", 0xFFFE, 1, 8000, 16000, 2, 16, 22, 16, 4, 1, b"")
    for form in (body, extensible):
        raw = b"RIFF\0\0\0\0WAVEjunk\3\0\0\0abc\0fmt " + struct.pack("<I", len(form)) + form + b"data\xff\xff\xff\xff" + b"ab" * 5 + b"c"
        assert head_of(raw) == (8000, 2, 1, len(raw) - 11, 5)
    for raw in (b"RIFF", b"RIFF\0\0\0\0WAVE", b"RIFF\0\0\0\0WAVEdata\0\0\0\0", b"RIFF\0\0\0\0WAVEfmt \2\0\0\0ab"):
        with pytest.raises(ValueError, match="no|breaks"):
            head_of(raw)


def test_written_waves(spark, tmp_path):
    frame = spark.range(3000).select(F.col("id").alias("i"), (F.col("id") * 17 % 65536 - 32768).cast("int").alias("sample")).repartition(4)
    channels, rate = decode_wav(open(write_wav(frame, str(tmp_path), 8000).removeprefix("file://"), "rb").read())
    assert rate == 8000
    assert (channels[0] * 32768).astype(int).tolist() == [i * 17 % 65536 - 32768 for i in range(3000)]


def test_words_as_rows_by_sql(spark):
    from tilmark.functions.register import register

    register(spark)
    spark.createDataFrame([(1, "a x c", "a b c", "á b ć"), (2, None, "a", None), (3, "", "a", None), (4, "a", "", "")], "k int, h string, r string, d string").createOrReplaceTempView("said_pairs")
    rows = spark.sql("SELECT k, w.* FROM said_pairs, LATERAL aligned_words(h, r, d) w ORDER BY k, place").collect()
    assert [tuple(r)[:6] for r in rows] == [(1, 0, "a", "a", "á", "correct"), (1, 1, "x", "b", "b", "substitution"), (1, 2, "c", "c", "ć", "correct"), (3, 0, "", "a", "a", "deletion"), (4, 0, "a", "", "", "insertion")]
    assert spark.sql("SELECT count(*) FROM said_pairs, LATERAL aligned_words(h, r)").head()[0] == 5
    with pytest.raises(Exception, match="must be a text"):
        spark.sql("SELECT * FROM aligned_words(1, 'a')").collect()


def test_chunks_are_many_to_a_task_and_files_are_made_by_ranges(spark, tmp_path, monkeypatch):
    """a task for each chunk, and all samples sorted in one task."""
    from tilmark.plans import one_file
    from tilmark.sources import audio_blocks

    monkeypatch.setattr(one_file, "COPIED", 1000)
    frame = spark.range(40_000).select(F.col("id").alias("i"), (F.col("id") * 7919 % 60_000 - 30_000).cast("int").alias("sample")).repartition(7)
    tasks = []
    was = audio_blocks.store.written

    def written(df, name):
        out = was(df, name)
        tasks.append((name, len(out.inputFiles()), out.count()))
        return out

    monkeypatch.setattr(audio_blocks.store, "written", written)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small ranges are put together
    try:
        path = write_wav(frame, str(tmp_path), 8000)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    found = read_chunks(spark, path, 1000, 100).select("chunk").collect()
    assert sorted(r["chunk"] for r in found) == list(range(89))
    by_name = {name: (files, rows) for name, files, rows in tasks}
    assert by_name["parts"][1] > 1  # sorted by several tasks
    assert by_name["chunks"][0] <= spark.sparkContext.defaultParallelism and by_name["chunks"][1] == 89
    channels, _ = decode_wav(open(path.removeprefix("file://"), "rb").read())
    assert (channels[0] * 32768).astype(int).tolist() == [i * 7919 % 60_000 - 30_000 for i in range(40_000)]
    empty = write_wav(frame.limit(0), str(tmp_path), 8000)
    assert read_chunks(spark, empty, 1000, 100).collect() == []
    assert [p.name for p in tmp_path.iterdir() if not p.name.endswith(".wav")] == []

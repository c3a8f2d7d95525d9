"""One JSON document in many splits."""

from __future__ import annotations

import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tilmark.sources import corpus
from tilmark.sources.corpus_scan import depths, events, scan_nested

TEXT = st.lists(st.deferred(lambda: st.sampled_from(ODD)), max_size=6).map("".join)
ODD = ["a", "b", '"', "\\", "{", "}", "[", "]", ":", ",", "é", "\n", " } {", "😀", "\t"]


def document(rng, surahs):
    """Keys repeat, texts hold every structural sign, values are of any kind."""
    word = lambda: "".join(rng.choice(ODD) for _ in range(rng.randrange(12)))
    value = lambda: rng.choice([{"text": word()}, {"text": word(), "x": {"y": [1, {"z": word()}]}}, {"x": word()}, {"text": None}, None, {}])
    ayah = lambda: f"{json.dumps(str(rng.randrange(8)))} :{json.dumps(value(), ensure_ascii=rng.random() < 0.5)}"
    made = [f'"{rng.randrange(surahs)}":{{{", ".join(ayah() for _ in range(rng.randrange(6)))}}}' for _ in range(surahs)]
    return rng.choice(["", "\n"]) + "{" + ",\n".join(made) + "}" + rng.choice(["", "\n", " \n"])


def verses(frame):
    return [(r["surah"], r["ayah"], r["original"]) for r in frame.orderBy("surah_pos", "ayah_pos").collect()]


@pytest.mark.parametrize(("seed", "surahs", "split"), [(1, 3, 37), (2, 40, 150)])
def test_splits_give_the_verses_of_the_whole(spark, tmp_path, seed, surahs, split):
    file = tmp_path / "corpus.json"
    file.write_text(document(random.Random(seed), surahs))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    assert verses(scan_nested(spark, str(file), split)) == verses(corpus.flatten_nested(corpus.read_json(spark, str(file))))
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == size


@pytest.mark.parametrize("text", ['{"1":{"1":{"text":"a"}} ', '{"1":{"1":{"text":"a}}}'])
def test_what_is_no_document_is_an_error(spark, tmp_path, text):
    file = tmp_path / "corpus.json"
    file.write_text(text)
    with pytest.raises(ValueError, match="not one JSON object"):
        scan_nested(spark, str(file), 8)


def test_no_surahs(spark, tmp_path):
    file = tmp_path / "corpus.json"
    file.write_text("{}")
    assert verses(scan_nested(spark, str(file))) == []


def test_written_documents_are_read_back(spark, tmp_path):
    rows = [(2, 1, 'a "quoted" } text'), (10, 2, "x"), (10, 1, "{\\"), (10, 1, "y"), (3, 7, None)]
    corpus.write_nested(spark.createDataFrame(rows, "surah int, ayah int, text string"), str(tmp_path / "d"))
    assert verses(scan_nested(spark, str(tmp_path / "d"), 16)) == [(2, 1, 'a "quoted" } text'), (3, 7, None), (10, 1, "{\\" if "{\\" > "y" else "y"), (10, 2, "x")]
    (part,) = (tmp_path / "d").glob("part-*")
    assert json.loads(part.read_text())["10"] == {"1": {"text": "{\\" if "{\\" > "y" else "y"}, "2": {"text": "x"}}


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(TEXT, st.dictionaries(TEXT, st.fixed_dictionaries({"text": TEXT}), max_size=4), max_size=4), st.data())
def test_sums_over_splits_and_events(made, data):
    text = json.dumps(made, ensure_ascii=False)
    found = [(s, None, None) if s is not None else (None, a, json.loads(v)) for s, a, v in events(text, 0)]
    assert found == [e for s, ayahs in made.items() for e in [(s, None, None), *[(None, a, v) for a, v in ayahs.items()]]]
    ends = [i + 1 for i, c in enumerate(text) if c == "}"]  # splits end behind braces
    cut = data.draw(st.sampled_from(ends))
    whole, a, b = depths(text), depths(text[:cut]), depths(text[cut:])
    assert whole == (0, 0, whole[2])
    assert (a[0] ^ b[0], a[1] + b[1 + a[0]]) == (0, 0)


def test_small_splits_share_tasks_and_the_document_is_made_by_ranges(spark, tmp_path, monkeypatch):
    """a task for each split, and the whole document sorted and written by one task."""
    from tilmark.plans import store

    rows = [(s, a, f"text {{ {s} }} \" {a}") for s in range(120) for a in range(3)]
    made, was = {}, store.written

    def written(df, name):
        out = was(df, name)
        made[name] = len(out.inputFiles())
        return out

    monkeypatch.setattr(store, "written", written)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small ranges are put together
    try:
        corpus.write_nested(spark.createDataFrame(rows, "surah int, ayah int, text string"), str(tmp_path / "d"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    found = scan_nested(spark, str(tmp_path / "d"), 64)
    assert sorted((r["surah"], r["ayah"], r["original"]) for r in found.collect()) == rows
    assert made["parts"] > 1
    assert made["splits"] <= spark.sparkContext.defaultParallelism
    assert sorted(p.name for p in (tmp_path / "d").iterdir() if not p.name.startswith(".")) == ["part-00000.txt"]

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tilmark.functions import similarity
from tilmark.operators import match
from tilmark.operators.align import align, word_alignments
from tilmark.plans.report import dead_letters, with_report

VERSES = [(0, 1, 1, "in the name", "ín the name"), (1, 1, 2, "praise be to all", "praise be to all"), (2, 2, 1, "in the name", "in the náme"), (3, 2, 2, "", ""), (4, 3, 1, "that is the book", "that is the book")]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(VERSES, "idx long, surah int, ayah int, plain string, original string").cache()


def test_statuses(spark, corpus):
    rows = [(1, "the name", None, None), (2, "in the name", 2, None), (3, "zzz qqq", None, None), (4, "zzz", 1, 2), (5, "zzz", 9, 9), (6, "praise be to all", None, 1), (7, "x", 0, None), (8, None, None, None), (9, "", 2, 2)]
    got = {r["hyp_id"]: r for r in align(spark.createDataFrame(rows, "hyp_id long, text string, surah int, ayah int"), corpus).collect()}
    assert [(got[k]["match_status"], got[k]["surah"], got[k]["ayah"]) for k in (1, 2, 3, 4, 5, 6, 7, 8)] == [
        ("matched", 1, 1), ("matched", 2, 1), ("below_threshold", None, None), ("exact", 1, 2), ("not_found", 9, 9), ("matched", 1, 2), ("below_threshold", None, None), ("below_threshold", None, None),
    ]
    assert got[1]["wer"] == pytest.approx(1 / 3)
    assert got[1]["correctly_recited_words"] == ["the", "name"]
    assert got[1]["error_words"] == [""]
    assert (got[9]["wer"], got[9]["cer"], got[9]["match_score"], got[9]["word_alignments"]) == (0.0, 0.0, 0.0, [])
    assert got[4]["match_score"] < 40
    dead = dead_letters(align(spark.createDataFrame(rows, "hyp_id long, text string, surah int, ayah int"), corpus))
    assert sorted(r["hyp_id"] for r in dead.collect()) == [3, 5, 7, 8]
    with pytest.raises(Exception, match="not_found"):
        align(spark.createDataFrame([(5, "zzz", 9, 9)], "hyp_id long, text string, surah int, ayah int"), corpus, strict=True).collect()


def test_best_of_all_pairs(spark, monkeypatch):
    rng = random.Random(3)
    pool = ["ab", "abc", "bca", "cad", "dd", "ea", "fgh", "xyz"]
    sentence = lambda most: " ".join(rng.choice(pool) for _ in range(rng.randrange(most)))
    verses = [(i, i % 4, i, sentence(12), "") for i in range(120)]
    hyps = [(i, sentence(10), rng.choice([None, 0, 1, 2, 3, 7])) for i in range(150)]
    table = spark.createDataFrame(verses, "idx long, surah int, ayah int, plain string, original string")
    frame = spark.createDataFrame(hyps, "hyp_id long, hypothesis string, scope int")
    wanted = {}
    for k, h, scope in hyps:
        scored = [(similarity.token_set_ratio(h, v[3]), -v[0]) for v in verses if scope is None or v[1] == scope]
        best = max(scored, default=(0.0, 0))
        wanted[k] = (-best[1], best[0]) if best[0] >= 40 else (None, None)
    assert {r["hyp_id"]: (r["idx"], r["match_score"]) for r in match.best_verses(frame, table).collect()} == wanted
    for size, slot_rows in ((1, 200), (13, 7), (1000, 40)):
        blocked = match.best_verses_by_blocks(frame.withColumn("clash", F.lit("x")), table.repartition(3), size=size, slot_rows=slot_rows)
        assert blocked.columns == ["hyp_id", "hypothesis", "clash", "idx", "match_score"]
        assert {r["hyp_id"]: (r["idx"], r["match_score"]) for r in blocked.collect()} == wanted
    monkeypatch.setattr(match, "MAX_BLOCK", 25)
    assert match.verse_index(table) is None
    assert {r["hyp_id"]: (r["idx"], r["match_score"]) for r in match.best_verses(frame, table).collect()} == wanted
    assert match.best_verses(frame.limit(0), table).collect() == []
    monkeypatch.setattr(match, "verse_index", lambda corpus: None)
    assert {r["idx"] for r in match.best_verses(frame, table.limit(0)).collect()} == {None}
    nothing = spark.createDataFrame([(1, None, None), (1, None, None)], "hyp_id long, hypothesis string, scope int")
    assert [tuple(r) for r in match.best_verses(nothing, table).collect()] == [(1, None, None, None)] * 2


def test_marks_by_position_or_joined(spark):
    rows = [(1, "a b", "a b", "á ۖ b")]
    frame = spark.createDataFrame(rows, "hyp_id long, hypothesis string, reference_plain string, reference_with_diacritics string")
    shown = lambda corrected: [w["ref_word_with_diac"] for w in word_alignments(frame, corrected=corrected).first()["word_alignments"]]
    assert shown(False) == ["á", "ۖ"]
    assert shown(True) == ["á ۖ", "b"]


def test_report(spark, corpus):
    hyps = spark.createDataFrame([(1, "praise he to be all", 1, 2)], "hyp_id long, text string, surah int, ayah int")
    lines = with_report(align(hyps, corpus)).select("report").first()[0].split("\n")
    assert lines[1] == "=" * 60
    assert lines[4] == "  Surah 1, Ayah 2"
    assert "  Word Accuracy: 50.0%" in lines
    assert "  Correct Words: 3 / 5" in lines
    assert lines[-3] == "  [praise]  (he->be)  [to]  {be}  [all]"


def test_verse_scores_are_one_plan(spark, corpus):
    hyps = spark.createDataFrame([(1, "the name", None, None)], "hyp_id long, text string, surah int, ayah int")
    plan = align(hyps, corpus).filter(F.col("wer") < 1)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan

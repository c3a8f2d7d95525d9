from __future__ import annotations

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from tilmark.functions import metrics, similarity, text
from tilmark.functions.register import register

SEED = 20


def py_normalise(t: str) -> str:
    t = "".join(c for c in t if c not in text.MARKS and c != text.TATWEEL)
    t = t.translate(str.maketrans({**dict.fromkeys(text.ALEF_VARIANTS, text.ALEF), text.WAW_HAMZA: text.WAW, text.ALEF_MAQSURA: text.YA}))
    return re.sub(r"\s+", " ", t).strip()


def strings(n: int, longest: int = 40) -> list[str]:
    rng = random.Random(SEED)
    pool = [chr(c) for a, b in ((0x600, 0x6FF), (0x1C, 0x7E), (0x2000, 0x202F), (9, 13)) for c in range(a, b + 1)] + ["\x85", "\xa0", "\u1680", "\u205f", " ", "　", "​", "﻿", "\U00010000"]
    return ["".join(rng.choice(pool) for _ in range(rng.randrange(longest))) for _ in range(n)]


@pytest.mark.parametrize(
    ("given", "wanted"),
    [
        ("بِسْمِ اللَّهِ الرَّحْمَٰنِ الرَّحِيمِ", "بسم الله الرحمن الرحيم"),
        ("ٱلـٰه", "اله"),
        ("ؤىئة", "ويئة"),
        ("aۖ \x1cb۞", "a b۞"),
        ("", ""),
        ("  \t ", ""),
    ],
)
def test_normal_form_by_hand(spark, given, wanted):
    assert spark.createDataFrame([(given,)], "t string").select(text.normalise("t")).first()[0] == wanted


def test_normal_form_and_words_like_python(spark):
    given = strings(3000)
    rows = spark.createDataFrame([(t,) for t in given], "t string").select("t", text.normalise("t"), text.tokenise("t"), text.py_strip("t")).collect()
    for t, plain, words, stripped in rows:
        assert plain == py_normalise(t)
        assert words == t.split()
        assert stripped == t.strip()
    again = spark.createDataFrame([(r[1],) for r in rows], "t string").select("t", text.normalise("t")).collect()
    assert all(a == b for a, b in again)


def test_no_unicode_normal_form(spark):
    parts = "e\u0301"
    assert unicodedata.normalize("NFC", parts) != parts
    assert spark.createDataFrame([(parts,)], "t string").select(text.normalise("t")).first()[0] == parts


def py_distance(a, b) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def sentences(n: int) -> list[tuple[str, str]]:
    rng = random.Random(SEED)
    pool = ["ab", "abc", "b", "cad", "dé", "e", "fgh"]
    make = lambda: " ".join(rng.choice(pool) for _ in range(rng.randrange(9)))
    return [(make(), make()) for _ in range(n)]


def test_rates_and_scores(spark):
    pairs = sentences(300)
    frame = spark.createDataFrame(pairs, "h string, r string")
    register(spark)
    rows = frame.select("h", "r", metrics.wer(text.tokenise("h"), text.tokenise("r")), metrics.cer("h", "r"), metrics.ratio("h", "r"), metrics.token_set_ratio("h", "r"), F.expr("wer(h, r)"), F.expr("cer(h, r)"), F.expr("indel_ratio(h, r)"), F.expr("token_set_ratio(h, r)"), F.expr("normalise(h)")).collect()
    for h, r, wer, cer, ratio, score, *same in rows:
        hw, rw, hc, rc = h.split(), r.split(), h.replace(" ", ""), r.replace(" ", "")
        assert wer == pytest.approx(py_distance(hw, rw) / len(rw) if rw else float(bool(hw)))
        assert cer == pytest.approx(py_distance(hc, rc) / len(rc) if rc else float(bool(hc)))
        assert ratio == pytest.approx(similarity.ratio(h, r))
        assert score == pytest.approx(similarity.token_set_ratio(h, r))
        assert same[:4] == [pytest.approx(x) for x in (wer, cer, ratio, score)]
        assert same[4] == py_normalise(h)


@pytest.mark.parametrize(("a", "b", "score"), [("a b", "a b c", 100), ("abc", "abd", 66.66666666666667), ("ab cd", "ab ce", 80), ("", "a", 0)])
def test_scores_by_hand(a, b, score):
    assert similarity.token_set_ratio(a, b) == pytest.approx(score)


@pytest.mark.parametrize(
    ("ref", "hyp", "rows"),
    [
        ("a b c d", "a x c", [("correct", "a", "a"), ("substitution", "b", "x"), ("correct", "c", "c"), ("deletion", "d", "")]),
        ("a b", "b", [("deletion", "a", ""), ("correct", "b", "b")]),
        ("a b", "c", [("deletion", "a", ""), ("substitution", "b", "c")]),
        ("x", "a b", [("insertion", "", "a"), ("substitution", "x", "b")]),
        ("", "a", [("insertion", "", "a")]),
        ("a", "", [("deletion", "a", "")]),
        ("", "", []),
    ],
)
def test_alignments_by_hand(ref, hyp, rows):
    words = ref.split()
    assert [(s, r, h) for h, r, _, s, _ in similarity.align_words(hyp.split(), words, words)] == rows


def test_alignment_cost_is_the_distance():
    for h, r in sentences(400):
        hw, rw = h.split(), r.split()
        out = similarity.align_words(hw, rw, rw)
        assert sum(s != "correct" for *_, s, _ in out) == py_distance(hw, rw)
        assert [a for a, *_ in out if a] == hw
        assert [b for _, b, *_ in out if b] == rw


def test_lcs_is_symmetric_and_right():
    def slow(a: str, b: str) -> int:
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b, 1):
                new.append(row[j - 1] + 1 if x == y else max(row[j], new[-1]))
            row = new
        return row[-1]

    for a, b in sentences(300):
        assert similarity.lcs(a, b) == similarity.lcs(b, a) == slow(a, b)


def test_fixed_decimals_like_python(spark):
    rng = random.Random(SEED)
    values = [6.25, 6.35, 6.15, 62.5, 63.5, 0.05, 0.15, 100.0, -12.25, -0.04, 0.0] + [rng.uniform(-200, 300) for _ in range(500)] + [k / 40 for k in range(-400, 400)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", metrics.fixed("v", 1), metrics.fixed("v", 0)).collect()
    for v, one, none in rows:
        assert (one, none) == (f"{v:.1f}", f"{v:.0f}")

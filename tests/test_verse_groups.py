"""Scores of many verses at once."""

from __future__ import annotations

import random
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from tilmark.functions.similarity import token_set_ratio
from tilmark.operators import match
from tilmark.operators.match import VerseGroup, VerseIndex

TEXTS = st.lists(st.sampled_from(["a", "b", "ab", "ba", "abc", "é", "😀a", "cab", "bb", "bab"]), max_size=9).map(" ".join)


@settings(max_examples=400, deadline=None)
@given(TEXTS, st.lists(TEXTS, max_size=12))
def test_scores_of_a_group_are_those_of_pairs(text, verses):
    assert VerseGroup([set(v.split()) for v in verses]).scores(set(text.split())).tolist() == [token_set_ratio(text, v) for v in verses]


def sentences(rng, n, words, pool):
    return [" ".join(rng.choice(pool) for _ in range(rng.randrange(1, words))) for _ in range(n)]


def test_best_of_many_groups(monkeypatch):
    """Verses one by one, by groups, and groups that are not kept give the winner of all pairs, with any threshold and scope."""
    rng = random.Random(8)
    pool = ["".join(rng.choice("abcdefg") for _ in range(rng.randrange(1, 6))) for _ in range(60)]
    plain = sentences(rng, 90, 14, pool)
    for group, few, held in ((256, 8, 1 << 20), (7, 2, 1 << 20), (7, 0, 100), (90, 3, 0), (1, 1, 1 << 20)):
        monkeypatch.setattr(match, "GROUP", group)
        monkeypatch.setattr(match, "FEW", few)
        monkeypatch.setattr(match, "HELD", held)
        index = VerseIndex([(i, i % 5, p) for i, p in enumerate(plain)])
        for text in [*sentences(rng, 25, 20, pool), plain[4], "", "zzz"]:
            for scope, threshold in ((None, 40.0), (2, 40.0), (None, 0.0), (None, 75.0)):
                score, at = max((token_set_ratio(text, p), -i) for i, p in enumerate(plain) if scope is None or i % 5 == scope)
                assert index.best(text, scope, threshold) == ((-at, score) if score >= threshold else None)


def test_long_hypotheses_are_scored_at_once():
    """each verse that a bound did not rule out was scored by itself."""
    rng = random.Random(9)
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "it"]
    pool = ["".join(rng.choice(syllables) for _ in range(rng.randrange(1, 5))) for _ in range(20_000)]
    index = VerseIndex([(i, 1, p) for i, p in enumerate(sentences(rng, 200, 50, pool))])
    texts = sentences(rng, 100, 200, pool)
    began = time.perf_counter()
    found = [index.best(t, None, 40.0) for t in texts]
    spent = time.perf_counter() - began
    began = time.perf_counter()
    wanted = [max((token_set_ratio(t, p), -i) for i, p in enumerate(index.plain)) for t in texts]
    assert [(w, -i) for i, w in found] == wanted
    assert spent * 4 < time.perf_counter() - began


def test_carries_of_characters_that_no_verse_has_stay_in_their_lane():
    rng = random.Random(10)
    for _ in range(60):
        text = " ".join("".join(rng.choice("aaab#") for _ in range(rng.randrange(1, 40))) for _ in range(6))
        verses = [" ".join("".join(rng.choice("aaab") for _ in range(rng.randrange(1, 30))) for _ in range(3)) for _ in range(9)]
        assert VerseGroup([set(v.split()) for v in verses]).scores(set(text.split())).tolist() == [token_set_ratio(text, v) for v in verses]

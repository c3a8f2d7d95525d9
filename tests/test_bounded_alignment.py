"""Alignments of many long texts in bounded memory, and by bits."""

from __future__ import annotations

import random
import time
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tilmark.functions import metrics, similarity, text
from tilmark.functions.similarity import align_words, best_moves, edit_distance
from tilmark.operators.align import FIELDS, SLICE, word_alignments, word_error_rates


class Pairs:
    """Pairs whose mapInArrow gives the function of a task."""

    columns = ["k", "hypothesis", "reference_plain", "reference_with_diacritics"]

    def __init__(self):
        self.schema = type("Schema", (), {"fields": []})()

    def mapInArrow(self, run, schema):  # noqa: N802
        return run


def batch(n, words):
    rng = random.Random(5)
    refs = [" ".join(f"w{rng.randrange(900)}" for _ in range(words)) for _ in range(n)]
    hyps = [" ".join(w for w in r.split() if rng.random() > 0.2) for r in refs]
    return pa.RecordBatch.from_pydict({"k": list(range(n)), "hypothesis": hyps, "reference_plain": refs, "reference_with_diacritics": refs})


def test_a_batch_of_long_texts_is_aligned_in_slices():
    """a batch was made whole, as one dict for each aligned word."""
    whole = batch(400, 600)
    tracemalloc.start()
    held = before = pa.total_allocated_bytes()
    rows = 0
    for made in word_alignments(Pairs())(iter([whole])):
        held = max(held, pa.total_allocated_bytes())
        assert len(made.column(4).values) < SLICE + 1200
        rows += len(made)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 400
    assert peak < 40e6 and held - before < 40e6


@pytest.mark.parametrize("fields", [FIELDS, ("status", "similarity")])
def test_columns_are_those_of_align_words(spark, fields):
    rows = [(0, "a bc d d", "a bd d e f", "A BD"), (1, "", "", ""), (2, None, "a", "a"), (3, "x y", "", "u v"), (4, "", "x y", "u v w"), (5, "é 😀 a", "😀 a é", "1 2 3"), (6, "a", None, None)]
    frame = spark.createDataFrame(rows, "k int, hypothesis string, reference_plain string, reference_with_diacritics string")
    got = {r["k"]: r["word_alignments"] for r in word_alignments(frame, fields=fields).collect()}
    assert set(got) == set(range(7)) and got[2] is None and got[6] is None
    for k, h, r, d in rows:
        if got[k] is not None:
            words = r.split()
            wanted = align_words(h.split(), words, (d.split() + [""] * 9)[: len(words)])
            assert [tuple(w) for w in got[k]] == [tuple(x[FIELDS.index(f)] for f in fields) for x in wanted]


def test_forty_thousand_words_are_aligned_by_bits():
    """F2: time of a row was that of all its cells, one by one (48 seconds, now 2.4)."""
    rng = random.Random(6)
    ref = [str(rng.randrange(5000)) for _ in range(40_000)]
    hyp = [w[::-1] if i % 5 == 2 else w for i, w in enumerate(ref) if i % 7 != 3]
    began = time.perf_counter()
    moves = best_moves(hyp, ref)
    far = edit_distance(hyp, ref)
    assert time.perf_counter() - began < 20
    assert sum(m > 0 for m in moves) == far == edit_distance(ref, hyp)


def test_places_of_words_beyond_what_is_held(monkeypatch):
    rng = random.Random(7)
    ref = [str(rng.randrange(300)) for _ in range(900)]
    hyp = [str(rng.randrange(300)) for _ in range(1000)]
    wanted = best_moves(hyp, ref)
    monkeypatch.setattr(similarity, "HELD", 500)
    assert best_moves(hyp, ref) == best_moves(hyp, ref, 50) == wanted


def test_word_error_rates_are_those_of_the_expression(spark):
    rows = [(0, "a b c", "a c"), (1, "", ""), (2, "x", ""), (3, "", "x y"), (4, None, "a"), (5, "a", None), (6, "é 😀 a b", "😀 a é")]
    frame = spark.createDataFrame(rows, "k int, hypothesis string, reference_plain string")
    got = word_error_rates(frame).withColumn("by_expression", metrics.wer(text.tokenise("hypothesis"), text.tokenise("reference_plain"))).filter(F.col("hypothesis").isNotNull() & F.col("reference_plain").isNotNull()).collect()
    assert len(got) == 5 and all(r["wer"] == r["by_expression"] for r in got)
    assert word_error_rates(frame).filter("wer is null").count() == 2

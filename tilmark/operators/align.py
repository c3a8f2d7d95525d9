"""Aligning hypotheses with verses: match, word alignment, error rates, as one DataFrame plan."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilmark.functions import metrics
from tilmark.functions.similarity import CORRECT, DELETION, INSERTION, STATUSES, SUBSTITUTION, best_moves, edit_distance, token_set_ratio, word_similarity
from tilmark.functions.text import normalise
from tilmark.operators.match import BELOW, EXACT, MATCHED, NOT_FOUND, THRESHOLD, VerseIndex, best_verses, with_verse

FIELDS = ("hyp_word", "ref_word", "ref_word_with_diac", "status", "similarity")


#: Aligned words that a task makes at a time.
SLICE = 1 << 16


def word_alignments(pairs: DataFrame, hyp: str = "hypothesis", ref: str = "reference_plain", shown: str = "reference_with_diacritics", out: str = "word_alignments", corrected: bool = False, fields: Sequence[str] = FIELDS) -> DataFrame:
    """pairs plus an array of aligned words. Shown words stand by position in the raw text; with corrected=True, tokens
    that the normal form empties (lone marks) are joined to the word before, so that later words keep their place. fields: those of an aligned word that are made. A task holds the words of one pair, and about SLICE aligned ones as columns."""
    names = [*pairs.columns, out]
    where = [pairs.columns.index(c) for c in (hyp, ref, shown)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin, made = 0, _Aligned(fields)
            for i in range(len(batch)):
                h, r, d = (batch.column(k)[i].as_py() for k in where)
                if h is None or r is None:
                    made.skip()
                else:
                    words = r.split()
                    made.add(h.split(), words, (_joined if corrected else _padded)((d or "").split(), len(words)))
                if made.size >= SLICE or i + 1 == len(batch):
                    yield pa.RecordBatch.from_arrays([*batch.slice(begin, i + 1 - begin).columns, made.array()], names=names)
                    begin, made = i + 1, _Aligned(fields)

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields] + [f"`{out}` array<struct<{', '.join(f'{f}: {_sql(f)}' for f in fields)}>>"])
    return pairs.mapInArrow(run, schema)


def _sql(field: str) -> str:
    return "double" if field == "similarity" else "string"


class _Aligned:
    """Alignments of some pairs as one Arrow array of lists."""

    def __init__(self, fields: Sequence[str] = FIELDS):
        self.fields, self.size, self.ends, self.parts = fields, 0, [0], []
        self.missing: list[bool] = []

    def skip(self) -> None:
        self.missing.append(True)
        self.ends.append(self.size)

    def add(self, hyp: list[str], ref: list[str], shown: list[str]) -> None:
        kind = np.array(best_moves(hyp, ref), np.int64)
        has_h, has_r = kind != STATUSES.index(DELETION), kind != STATUSES.index(INSERTION)
        j, i = np.where(has_h, np.cumsum(has_h) - 1, len(hyp)), np.where(has_r, np.cumsum(has_r) - 1, len(ref))
        texts = {"hyp_word": (hyp, j), "ref_word": (ref, i), "ref_word_with_diac": (shown[: len(ref)], i), "status": (STATUSES, kind)}

        def column(field: str) -> pa.Array:
            if field in texts:
                own, place = texts[field]
                return pa.array([*own, ""], pa.string()).take(pa.array(place))
            alike = (kind == STATUSES.index(CORRECT)).astype(np.float64)
            at = np.flatnonzero(kind == STATUSES.index(SUBSTITUTION))
            alike[at] = [word_similarity(hyp[x], ref[y]) for x, y in zip(j[at].tolist(), i[at].tolist(), strict=True)]
            return pa.array(alike)

        self.parts.append(pa.StructArray.from_arrays([column(f) for f in self.fields], names=list(self.fields)))
        self.missing.append(False)
        self.size += len(kind)
        self.ends.append(self.size)

    def array(self) -> pa.Array:
        kind = pa.struct([(f, pa.float64() if f == "similarity" else pa.string()) for f in self.fields])
        values = pa.concat_arrays(self.parts) if self.parts else pa.array([], kind)
        return pa.ListArray.from_arrays(pa.array(self.ends, pa.int32()), values, mask=pa.array(self.missing, pa.bool_()))


def word_error_rates(pairs: DataFrame, hyp: str = "hypothesis", ref: str = "reference_plain", out: str = "wer") -> DataFrame:
    """pairs plus the word error rate, as metrics.wer, for texts of any length. A task holds the words of one pair."""
    names = [*pairs.columns, out]
    where = [pairs.columns.index(c) for c in (hyp, ref)]

    def rate(h: str | None, r: str | None) -> float | None:
        if h is None or r is None:
            return None
        said, words = h.split(), r.split()
        return edit_distance(said, words) / len(words) if words else float(len(said) > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rates = [rate(*(batch.column(k)[i].as_py() for k in where)) for i in range(len(batch))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rates, pa.float64())], names=names)

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields] + [f"`{out}` double"])
    return pairs.mapInArrow(run, schema)


def _padded(shown: list[str], n: int) -> list[str]:
    return shown + [""] * (n - len(shown))


def _joined(shown: list[str], n: int) -> list[str]:
    from tilmark.functions.text import MARKS, TATWEEL

    empty = str.maketrans("", "", MARKS + TATWEEL)
    out: list[str] = []
    for w in shown:
        if out and not w.translate(empty):
            out[-1] += " " + w
        else:
            out.append(w)
    return _padded(out, n)


def correct_words(alignments: Column | str) -> Column:
    return F.transform(F.filter(alignments, lambda w: w["status"] == CORRECT), lambda w: w["ref_word_with_diac"])


def error_words(alignments: Column | str) -> Column:
    return F.transform(F.filter(alignments, lambda w: w["status"] != CORRECT), lambda w: w["hyp_word"])


def alignment_wer(alignments: Column | str) -> Column:
    """The word error rate, from the alignment: words that are not correct over reference words."""
    wrong = F.size(F.filter(alignments, lambda w: w["status"] != CORRECT))
    words = F.size(F.filter(alignments, lambda w: w["status"] != "insertion"))
    return F.when(words == 0, F.when(wrong == 0, 0.0).otherwise(1.0)).otherwise(wrong / words)


def token_set_scores(a: Column | str, b: Column | str) -> Column:
    """token_set_ratio by Arrow batches, for texts of any length."""
    import pandas as pd

    @F.pandas_udf(T.DoubleType())
    def score(x, y):  # noqa: ANN001, ANN202
        return pd.Series([None if p is None or q is None else token_set_ratio(p, q) for p, q in zip(x, y, strict=True)], dtype="float64")

    return score(a, b)


def align(hyps: DataFrame, corpus: DataFrame, threshold: float = THRESHOLD, strict: bool = False, corrected: bool = False, keep: Sequence[str] = (), index: VerseIndex | None = None) -> DataFrame:
    """hyps (hyp_id, text, surah, ayah) with their results, and the columns to keep. With surah and ayah the verse is looked up, whatever its score;
    with surah only, the best verse of the surah counts; else the best of all (an ayah without surah is not used). hyps are read once.

    match_status is exact, matched, not_found or below_threshold; with strict=True the last two are errors. A null text matches nothing."""
    keyed = F.col("surah").isNotNull() & F.col("ayah").isNotNull()
    named = hyps.select("hyp_id", normalise("text").alias("said"), "surah", "ayah", keyed.alias("keyed"), *keep)
    asked = named.withColumns({"hypothesis": F.when(~F.col("keyed"), F.col("said")), "scope": F.col("surah")})
    searched = best_verses(asked, corpus, threshold, index=index).drop("hypothesis")
    verses = corpus.select("idx", F.col("surah").alias("surah_found"), F.col("ayah").alias("ayah_found"), "plain", "original")
    looked = with_verse(searched.withColumnRenamed("idx", "best"), corpus).withColumnsRenamed({"idx": "own", "plain": "own_plain", "original": "own_original"})
    both = looked.join(verses, looked["best"] == verses["idx"], "left")
    own = F.col("keyed")
    status = F.when(own, F.when(F.col("own").isNull(), NOT_FOUND).otherwise(EXACT)).otherwise(F.when(F.col("best").isNull(), BELOW).otherwise(MATCHED))
    if strict:
        missing = F.concat(F.lit("no verse for hypothesis "), F.col("hyp_id").cast("string"), F.lit(": "), status)
        status = F.when(status.isin(EXACT, MATCHED), status).otherwise(F.raise_error(missing).cast("string"))
    pick = lambda a, b: F.when(own, F.col(a)).otherwise(F.col(b))
    pairs = both.select(
        "hyp_id", F.col("said").alias("hypothesis"), pick("surah", "surah_found").alias("surah"), pick("ayah", "ayah_found").alias("ayah"),
        pick("own_plain", "plain").alias("reference_plain"), pick("own_original", "original").alias("reference_with_diacritics"),
        F.when(own, token_set_scores("said", "own_plain")).otherwise(F.col("match_score")).alias("match_score"), status.alias("match_status"), *keep,
    )
    return results(pairs, corrected, keep)


def results(pairs: DataFrame, corrected: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """Pairs of a hypothesis and its verse as full results."""
    out = word_alignments(pairs, corrected=corrected)
    known = F.col("word_alignments").isNotNull()
    return out.select(
        "hyp_id", "match_status", "surah", "ayah", "hypothesis", "reference_plain", "reference_with_diacritics", "word_alignments",
        F.when(known, alignment_wer("word_alignments")).alias("wer"),
        F.when(known, metrics.cer("hypothesis", "reference_plain")).alias("cer"),
        "match_score",
        correct_words("word_alignments").alias("correctly_recited_words"),
        error_words("word_alignments").alias("error_words"),
        *keep,
    )

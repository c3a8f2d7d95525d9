"""The text report of results, as a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilmark.functions.metrics import fixed, word_accuracy

WIDTH = 60


def annotated(alignments: Column | str) -> Column:
    """One mark per aligned word, two spaces between."""

    def mark(w: Column) -> Column:
        shown, said, status = w["ref_word_with_diac"], w["hyp_word"], w["status"]
        return (
            F.when(status == "correct", F.concat(F.lit("["), shown, F.lit("]")))
            .when(status == "substitution", F.concat(F.lit("("), said, F.lit("->"), shown, F.lit(")")))
            .when(status == "deletion", F.concat(F.lit("<"), shown, F.lit(">")))
            .otherwise(F.concat(F.lit("{"), said, F.lit("}")))
        )

    return F.concat(F.lit("  "), F.array_join(F.transform(alignments, mark), "  "))


def report() -> Column:
    """The report of a result row, over the columns of tilmark.operators.align.results. Labels are fixed values."""
    double, single = F.lit("=" * WIDTH), F.lit("-" * WIDTH)
    line = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    text = lambda name: F.col(name).cast("string")
    return F.concat_ws(
        "\n",
        F.lit(""), double, F.lit("  ALIGNMENT RESULT"), double,
        line("  Surah ", text("surah"), ", Ayah ", text("ayah")), single,
        F.lit("  Ground truth (with tashkeel):"), line("    ", text("reference_with_diacritics")), F.lit(""),
        F.lit("  Your recitation (transcribed):"), line("    ", text("hypothesis")), single,
        line("  Match Score  : ", fixed("match_score", 0), " / 100"),
        line("  Word Accuracy: ", fixed(word_accuracy("wer"), 1), "%"),
        line("  WER          : ", fixed(F.col("wer") * 100, 1), "%"),
        line("  CER          : ", fixed(F.col("cer") * 100, 1), "%"),
        line("  Correct Words: ", F.size("correctly_recited_words").cast("string"), " / ", F.size("word_alignments").cast("string")), single,
        F.lit("  Word alignment:  [correct]  (substitution)  <deletion>  {insertion}"), F.lit(""),
        annotated("word_alignments"), double, F.lit(""),
    )


def with_report(results: DataFrame) -> DataFrame:
    return results.withColumn("report", report())


def dead_letters(results: DataFrame) -> DataFrame:
    """Results without a verse, and those on which the model failed: what a stream sets aside instead of losing it."""
    return results.filter(F.col("match_status").isin("not_found", "below_threshold", "failed"))

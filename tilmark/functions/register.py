"""The text functions by name in SQL."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from tilmark.functions import similarity, text


class AlignedWords:
    """The rows of a word alignment: place, hyp_word, ref_word, ref_word_with_diac, status, similarity. A null hyp or ref has none; without shown, the words of ref are shown."""

    @staticmethod
    def analyze(hyp: AnalyzeArgument, ref: AnalyzeArgument, shown: AnalyzeArgument | None = None) -> AnalyzeResult:
        for name, given in (("hyp", hyp), ("ref", ref), ("shown", shown)):
            if given is not None and (given.isTable or not isinstance(given.dataType, (T.StringType, T.NullType))):
                raise ValueError(f"aligned_words: {name} must be a text")
        kinds = {"place": T.IntegerType(), "hyp_word": T.StringType(), "ref_word": T.StringType(), "ref_word_with_diac": T.StringType(), "status": T.StringType(), "similarity": T.DoubleType()}
        return AnalyzeResult(T.StructType([T.StructField(name, kind) for name, kind in kinds.items()]))

    def eval(self, hyp: str | None, ref: str | None, shown: str | None = None) -> Iterator[tuple]:
        if hyp is None or ref is None:
            return
        words = ref.split()
        marked = (ref if shown is None else shown).split()
        for place, row in enumerate(similarity.align_words(hyp.split(), words, marked + [""] * (len(words) - len(marked)))):
            yield (place, *row)


def register(spark: SparkSession) -> None:
    """normalise(t), wer(hyp, ref), cer(hyp, ref), indel_ratio(a, b), token_set_ratio(a, b), align_words(hyp, ref, shown), and the table function
    aligned_words(hyp, ref, shown) for lateral joins. normalise is SQL inside the plan; the others work on Arrow batches. A null argument gives null."""
    spark.udtf.register("aligned_words", udtf(AlignedWords))
    quoted = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION normalise(t STRING) RETURNS STRING RETURN trim(regexp_replace(translate(t, {quoted(text._FROM)}, {quoted(text._TO)}), {quoted(text.SPACE + '+')}, ' '))")

    def pairwise(score):  # noqa: ANN001, ANN202
        return lambda a, b: pd.Series([None if x is None or y is None else float(score(x, y)) for x, y in zip(a, b, strict=True)], dtype="float64")

    def rate(h: list[str] | str, r: list[str] | str) -> float:
        return similarity.edit_distance(h, r) / len(r) if len(r) else float(len(h) > 0)

    named = {
        "wer": lambda h, r: rate(h.split(), r.split()),
        "cer": lambda h, r: rate(h.replace(" ", ""), r.replace(" ", "")),
        "indel_ratio": similarity.ratio,
        "token_set_ratio": similarity.token_set_ratio,
    }
    for name, score in named.items():
        spark.udf.register(name, F.pandas_udf(pairwise(score), "double"))

    def aligned(h: pd.Series, r: pd.Series, d: pd.Series) -> pd.Series:
        fields = ("hyp_word", "ref_word", "ref_word_with_diac", "status", "similarity")

        def one(x: str | None, y: str | None, z: str | None) -> list[dict] | None:
            if x is None or y is None:
                return None
            words, shown = y.split(), (z or "").split()
            return [dict(zip(fields, row, strict=True)) for row in similarity.align_words(x.split(), words, shown + [""] * (len(words) - len(shown)))]

        return pd.Series([one(*row) for row in zip(h, r, d, strict=True)])

    spark.udf.register("align_words", F.pandas_udf(aligned, "array<struct<hyp_word:string,ref_word:string,ref_word_with_diac:string,status:string,similarity:double>>"))

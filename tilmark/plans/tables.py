"""How the engine's inputs are drawn from the test tables: whole tables, whole texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilmark.functions.text import normalise, tokenise

#: Latin vowels become letters that the normal form folds (a, e, i) or drops (o, u).
VOWELS, DRESS = "aeiou", "أىؤـَ"
SPEECH_ABOVE = 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dressed(c: Column | str) -> Column:
    return F.translate(c, VOWELS, DRESS)


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """benchmark as verses, ten to a surah."""
    items = table(spark, sf_dir, "benchmark")
    original = dressed("text")
    return items.select(F.col("item_id").alias("idx"), F.floor(F.col("item_id") / 10 + 1).cast("int").alias("surah"), (F.col("item_id") % 10 + 1).cast("int").alias("ayah"), normalise(original).alias("plain"), original.alias("original"))


def said(words: Column) -> Column:
    """Words as they might be heard: some left out (places 3 of 7), spelt backwards (2 of 5) or said twice (6 of 11)."""
    return F.flatten(
        F.transform(
            words,
            lambda w, i: F.when((i + 1) % 7 == 3, F.array().cast("array<string>"))
            .when((i + 1) % 5 == 2, F.array(F.reverse(w)))
            .when((i + 1) % 11 == 6, F.array(w, w))
            .otherwise(F.array(w)),
        )
    )


def hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(hyp_id, text, surah, ayah): verses as they might be heard."""
    return corpus(spark, sf_dir).select(F.col("idx").alias("hyp_id"), F.array_join(said(tokenise("plain")), " ").alias("text"), "surah", "ayah")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as frames of one stream per user."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("stream_id"), F.row_number().over(order).cast("long").alias("seq"), F.col("event_id").cast("string").cast("binary").alias("payload"), (F.col("value") > SPEECH_ABOVE).alias("is_speech"))

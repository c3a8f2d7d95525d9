"""From audio to aligned results, in batch."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilmark.functions.audio import MIN_SAMPLES, long_enough, pcm16_to_float
from tilmark.operators.align import align
from tilmark.operators.match import THRESHOLD, VerseIndex
from tilmark.operators.transcribe import Transcriber, transcribe
from tilmark.sources.audio_files import read_wav


FAILED = "failed"


@dataclass(frozen=True)
class Config:
    """Parameters of a run. surah and ayah scope every row; rows can have scopes of their own in align()."""

    model: str | None = None
    device: str | None = None
    threshold: float = THRESHOLD
    surah: int | None = None
    ayah: int | None = None
    timestamps: bool = False
    vad: int = 2


def run_files(spark: SparkSession, path: str, corpus: DataFrame, make: Callable[[], Transcriber], config: Config | None = None) -> DataFrame:
    """Results of WAV files, with path and error. A file that cannot be read, or on which the model fails, has the status failed and an error. Every
    file is read and transcribed once."""
    config = config or Config()
    waves = read_wav(spark, path).select(F.xxhash64("path").alias("hyp_id"), "path", "samples", F.col("error").alias("read_error"))
    heard = transcribe(waves, make, timestamps=config.timestamps, guard=True)
    return _scoped(heard.select("hyp_id", "path", F.when(F.col("read_error").isNull(), F.col("transcript.text")).alias("text"), F.coalesce("read_error", "model_error").alias("error")), corpus, config, ("path", "error"))


def run_segments(segments: DataFrame, corpus: DataFrame, make: Callable[[], Transcriber], config: Config | None = None, least: int = MIN_SAMPLES, index: VerseIndex | None = None) -> DataFrame:
    """Results of PCM segments (hyp_id, raw); those shorter than `least` samples are left out."""
    waves = segments.select("hyp_id", pcm16_to_float("raw").alias("samples")).filter(long_enough("samples", least))
    return run_waves(waves, corpus, make, config, index)


def run_waves(waves: DataFrame, corpus: DataFrame, make: Callable[[], Transcriber], config: Config | None = None, index: VerseIndex | None = None) -> DataFrame:
    """Results of waveforms (hyp_id, samples), which are taken as they are, with error: where the model fails, the status is failed."""
    heard = transcribe(waves, make, guard=True).select("hyp_id", F.col("transcript.text").alias("text"), F.col("model_error").alias("error"))
    return _scoped(heard, corpus, config or Config(), ("error",), index)


def _scoped(heard: DataFrame, corpus: DataFrame, config: Config, keep: tuple[str, ...], index: VerseIndex | None = None) -> DataFrame:
    hyps = heard.withColumns({"surah": F.lit(config.surah).cast("int"), "ayah": F.lit(config.ayah).cast("int")})
    found = align(hyps, corpus, config.threshold, keep=keep, index=index)
    return found.withColumn("match_status", F.when(F.col("error").isNotNull(), FAILED).otherwise(F.col("match_status")))

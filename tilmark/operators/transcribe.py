"""Transcription of waveforms by a pluggable model that every worker loads once."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

CHUNK_SECONDS, RATE = 30.0, 16_000
MAX_NEW_TOKENS = 447
TRANSCRIPT = "struct<text:string,duration_s:double,chunks:array<struct<text:string,timestamp:double>>>"


class Transcriber(Protocol):
    def transcribe(self, chunks: list[np.ndarray]) -> list[str]: ...


class WordStub:
    """A deterministic stand-in: every `step` samples give the word numbered by their mean magnitude."""

    def __init__(self, words: list[str], step: int = 1600):
        self.words, self.step = words, step

    def transcribe(self, chunks: list[np.ndarray]) -> list[str]:
        return [" ".join(self.words[int(np.abs(c[i : i + self.step].astype(np.float64)).mean() * len(self.words)) % len(self.words)] for i in range(0, len(c), self.step)) for c in chunks]


class SpeechModel:
    """A sequence-to-sequence speech model; its libraries are needed on the workers only. The device is cuda, mps or cpu, the
    first there is; half precision on cuda."""

    def __init__(self, model: str, device: str | None = None, language: str = "ar"):
        try:
            import torch
            from transformers import AutoModelForSpeechSeq2Seq, AutoProcessor
        except ImportError as error:
            raise ImportError("speech models need torch and transformers on the workers") from error
        self.torch = torch
        self.device = device or ("cuda" if torch.cuda.is_available() else "mps" if torch.backends.mps.is_available() else "cpu")
        self.kind = torch.float16 if self.device == "cuda" else torch.float32
        self.processor = AutoProcessor.from_pretrained(model)
        self.model = AutoModelForSpeechSeq2Seq.from_pretrained(model, torch_dtype=self.kind, low_cpu_mem_usage=True).to(self.device).eval()
        self.prompt = self.processor.get_decoder_prompt_ids(language=language, task="transcribe")

    def transcribe(self, chunks: list[np.ndarray]) -> list[str]:
        with self.torch.no_grad():
            given = self.processor(chunks, sampling_rate=RATE, return_tensors="pt").input_features.to(self.device, self.kind)
            ids = self.model.generate(given, forced_decoder_ids=self.prompt, max_new_tokens=MAX_NEW_TOKENS)
        return self.processor.batch_decode(ids, skip_special_tokens=True)


_loaded: dict[str, Transcriber] = {}


def transcribe(waves: DataFrame, make: Callable[[], Transcriber], samples: str = "samples", chunk_seconds: float = CHUNK_SECONDS, timestamps: bool = False, batch: int = 16, guard: bool = False, **_ignored) -> DataFrame:
    """waves plus transcript (TRANSCRIPT). Null samples have an empty one. guard: a wave on which the model fails has a null one too, and its error
    in a column model_error, and the others go on. Samples are cut into hard chunks; texts that are not blank are joined in order.
    chunks are given with timestamps=True, each without a time, as the models give none. A chunk size below one sample is an
    error; other keywords are ignored."""
    size = int(chunk_seconds * RATE)
    if size <= 0:
        raise ValueError("a chunk needs at least one sample")
    tag = hashlib.sha256(cloudpickle.dumps(make)).hexdigest()
    place, names = waves.columns.index(samples), [*waves.columns, "transcript", *(["model_error"] if guard else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tag not in _loaded:
            _loaded[tag] = make()
        model = _loaded[tag]
        for rows in batches:
            given = [np.asarray([] if x is None else x, np.float32) for x in rows.column(place).to_pylist()]
            pieces = [(i, x[a : a + size]) for i, x in enumerate(given) for a in range(0, len(x), size)]
            texts: list[list[str]] = [[] for _ in given]
            errors: list[str | None] = [None for _ in given]
            for a in range(0, len(pieces), batch):
                part = pieces[a : a + batch]
                for (i, _), text, error in zip(part, *spoken(model, [p for _, p in part]), strict=True):
                    texts[i].append(text)
                    errors[i] = errors[i] or error
            out = [
                None if error else {"text": " ".join(t.strip() for t in own if t.strip()), "duration_s": len(x) / RATE, "chunks": [{"text": t, "timestamp": None} for t in own] if timestamps else None}
                for x, own, error in zip(given, texts, errors, strict=True)
            ]
            kind = pa.struct([("text", pa.string()), ("duration_s", pa.float64()), ("chunks", pa.list_(pa.struct([("text", pa.string()), ("timestamp", pa.float64())])))])
            columns = [*rows.columns, pa.array(out, kind), *([pa.array(errors, pa.string())] if guard else [])]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    def spoken(model: Transcriber, chunks: list[np.ndarray]) -> tuple[list[str], list[str | None]]:
        """Texts and errors of chunks. Where a batch fails, each of its chunks is tried alone."""
        try:
            return model.transcribe(chunks), [None] * len(chunks)
        except Exception as error:
            if not guard:
                raise
            if len(chunks) == 1:
                return [""], [f"{type(error).__name__}: {error}"]
        alone = [spoken(model, [c]) for c in chunks]
        return [t[0] for t, _ in alone], [e[0] for _, e in alone]

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in waves.schema.fields] + [f"transcript {TRANSCRIPT}", *(["model_error string"] if guard else [])])
    return waves.mapInArrow(run, schema)

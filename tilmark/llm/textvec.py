"""Vectorised word and shingle hashes over batches of whole texts.

A word is a run of ``[0-9a-z]`` and non-ASCII characters after ``str.lower``; ``WORD`` finds the same words
one text at a time. Hashes are 64-bit: a polynomial over a word's bytes, scrambled. Texts of any length
are handled in pieces of PIECE bytes, cut between words, so memory is bounded by a piece and the hashes. Arrow batches are
worked through in slices of about CHUNK bytes of text.
"""

from __future__ import annotations

import contextlib
import ctypes
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PIECE = 1 << 20
CHUNK = 1 << 20
SHINGLE = 5

U = np.uint64
_P = U(0x9E3779B97F4A7C15)
_IS_WORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> U(29))) * U(0xC4CEB9FE1A85EC53)
        return x ^ (x >> U(32))


_BYTES = mix(np.arange(1, 257, dtype=U) * _P)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2^64, at least n of each."""
    if len(_powers[0]) < n:
        inverse = U(pow(int(_P), -1, 1 << 64))
        with np.errstate(over="ignore"):
            for k, base in enumerate((_P, inverse)):
                steps = np.full(n, base, U)
                steps[0] = 1
                _powers[k] = np.cumprod(steps)
    return _powers[0], _powers[1]


def _piece_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start offsets and hashes of the words in one piece."""
    flags = np.zeros(len(data) + 2, np.int8)
    flags[1:-1] = _IS_WORD[data]
    turns = np.diff(flags)
    starts, ends = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)
    if not len(starts):
        return starts, np.empty(0, U)
    up, down = _power_tables(max(len(data) + 1, PIECE + 1))
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, U)
        np.cumsum(_BYTES[data] * up[: len(data)], out=total[1:])
        return starts, mix((total[ends] - total[starts]) * down[starts])


def _cut(raw: bytes) -> Iterator[bytes]:
    """Pieces of one long text, cut at blanks."""
    at = 0
    while len(raw) - at > PIECE:
        end = at + PIECE
        while end > at and _IS_WORD[raw[end - 1]]:
            end -= 1
        if end == at:  # one word longer than a piece
            end = at + PIECE
            while end < len(raw) and _IS_WORD[raw[end]]:
                end += 1
        yield raw[at:end]
        at = end
    yield raw[at:]


def word_hashes(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and offsets: text i has words[offsets[i]:offsets[i+1]]. Null: none."""
    hashes, counts = [], np.zeros(len(texts), np.int64)
    group: list[bytes] = []
    owners: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if group:
            lengths = np.fromiter((len(b) + 1 for b in group), np.int64, len(group))
            starts, h = _piece_hashes(np.frombuffer(b"\n".join(group), np.uint8))
            bounds = np.searchsorted(starts, np.concatenate(([0], np.cumsum(lengths))))
            np.add.at(counts, owners, np.diff(bounds))
            hashes.append(h)
        group.clear()
        owners.clear()
        size = 0

    for i, text in enumerate(texts):
        raw = (text or "").lower().encode("utf-8", "replace")
        for part in _cut(raw) if len(raw) > PIECE else (raw,):
            if size + len(part) > PIECE:
                flush()
            group.append(part)
            owners.append(i)
            size += len(part) + 1
    flush()
    return np.concatenate(hashes) if hashes else np.empty(0, U), np.concatenate(([0], np.cumsum(counts)))


def shingles(words: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """Hashes of all runs of n words of one text; a text of fewer words has one shingle of all of them."""
    k = min(n, len(words))
    if k == 0:
        return np.empty(0, U)
    with np.errstate(over="ignore"):
        h = words[: len(words) - k + 1] * U(1)
        for j in range(1, k):
            h = h * _P + words[j : len(words) - k + 1 + j]
        return mix(h + U(k))


def fingerprint(words: np.ndarray) -> int:
    """A signed 64-bit hash of one text's sequence of words."""
    with np.errstate(over="ignore"):
        up = _power_tables(len(words) + 1)[0] if len(words) >= len(_powers[0]) else _powers[0]
        total = mix(np.array([np.sum(mix(words) * up[: len(words)], dtype=U) + U(len(words))], U))
    return int(total.view(np.int64)[0])


def give_back() -> None:
    """Return freed memory to the system: idle workers would keep it while other stages run."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Slices of Arrow batches with at most about `most` bytes of text each (one row at least)."""
    try:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0), np.int64)
            at, total = 0, 0
            for i, size in enumerate(sizes):
                if i > at and total + size > most:
                    yield batch.slice(at, i - at), column.slice(at, i - at).to_pylist()
                    at, total = i, 0
                total += size
            if len(sizes) > at:
                yield batch.slice(at), column.slice(at).to_pylist()
    finally:
        give_back()

"""Benchmark decontamination: n-gram seeds join texts to test items, Smith-Waterman alignment scores them.

1. Test items are read in blocks of at most BLOCK_BYTES of text (one block unless the benchmark is larger), a
   stated query set that is held against all texts block by block.
2. Seeds are all of an item's n-grams of LENGTHS words, however often they stand in the texts: how many texts copy an item
   changes nothing.
3. One pass finds seeds in every text. Hits of an item on neighbouring diagonals make a window, if together they
   cover at least COVER words of the item: one long seed, or two short ones apart, which an edited copy still
   has when every fourth word is changed. The window is aligned with the whole item, word by word: MATCH,
   MISMATCH, GAP. A window that holds the item word for word needs no alignment, nor one that has too few of
   the item's words for any alignment to pass, as around most stock phrases. A window longer than PIECE words and six
   items is aligned in pieces that overlap by the longest alignment there can be.
4. score is the alignment's score over that of the whole item. A text holds the item when score is at least
   MIN_SCORE, or when at least MIN_RUN words are aligned as equal and make MIN_IDENTITY of the aligned part. Every window is
   tested, and in a window one alignment after the other, best first, without the equal pairs of those before, until none
   can pass. Of an alignment that does not pass as a whole, the longest part that does counts. A table of over CELLS scores is
   never kept: memory grows with the words of the window times the root of those of the item.

Nothing is shuffled. Defined cases: null and empty texts hold nothing; null and empty items
are held by nothing; an item of fewer words than a seed has one of all its words; equal items each give
a row; rows with a null id and repeated rows are handled one by one; an item that stands several times in a text gives
one row, for its best place that passes, of equal ones the first; a very long text is searched whole, and long windows are aligned in pieces; ids may have any type; extra columns are ignored or, where rows are filtered, kept.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tilmark.llm import textvec as tv

BLOCK_BYTES = 4_000_000
MATCH, MISMATCH, GAP = 2, -1, -1
MIN_SCORE, MIN_RUN, MIN_IDENTITY = 0.5, 13, 0.75
PAD = 16
PIECE = 1024
CELLS = 1 << 20
LENGTHS, COVER = (3, 5), 5
COLUMNS = "n_seeds long, score double, matches long, doc_start long, doc_end long, item_start long, item_end long"


def ngrams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of exactly n words."""
    return tv.shingles(words, n) if len(words) >= n else np.empty(0, tv.U)


@dataclass
class Seeds:
    """n-grams of a block of items: for each length n, sorted hashes with the item and place of each."""

    ids: list
    words: list[np.ndarray]
    by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, ids: list, texts: list[str | None]) -> Seeds:
        hashes, at = tv.word_hashes(texts)
        words = [hashes[at[i] : at[i + 1]] for i in range(len(texts))]
        parts: dict[int, list] = {}
        for i, w in enumerate(words):
            for n in {min(n, len(w)) for n in LENGTHS} - {0}:
                g = ngrams(w, n)
                parts.setdefault(n, []).append((g, np.full(len(g), i), np.arange(len(g))))
        by_length = {}
        for n, found in parts.items():
            g, item, place = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(g, kind="stable")
            by_length[n] = (g[order], item[order], place[order])
        return cls(ids, words, by_length)

    def hits(self, words: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each n-gram length: places in words (within one text) and ranges of equal seeds."""
        for n, (g, _, _) in self.by_length.items():
            if len(words) < n or not len(g):
                continue
            own = ngrams(words, n)
            bits = np.zeros(1 << 20, bool)
            bits[(g & tv.U((1 << 20) - 1)).astype(np.int64)] = True
            maybe = np.flatnonzero(bits[(own & tv.U((1 << 20) - 1)).astype(np.int64)])
            lo, hi = np.searchsorted(g, own[maybe], "left"), np.searchsorted(g, own[maybe], "right")
            text = np.searchsorted(at, maybe, "right") - 1
            there = (hi > lo) & (maybe + n <= at[np.minimum(text + 1, len(at) - 1)])
            yield n, maybe[there], text[there], lo[there], hi[there]


class _Pair:
    """An item and a window, with the pairs of equal words that no alignment may use any more. Neither the table of
    equal words nor that of scores is kept whole."""

    def __init__(self, item: np.ndarray, window: np.ndarray):
        self.item, self.window = item, window
        self.used = np.empty(0, np.int64)  # item place * words of the window + window place, sorted
        self.gone: set[int] = set()  # the same

    def equal(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether the words at places i of the item and j of the window may be aligned as equal."""
        return (self.item[i] == self.window[j]) & ~np.isin(i * len(self.window) + j, self.used)

    def use(self, i: np.ndarray, j: np.ndarray) -> None:
        at = i * len(self.window) + j
        self.used = np.union1d(self.used, at)
        self.gone.update(at.tolist())

    def rows(self, above: np.ndarray, first: int, last: int, lo: int) -> Iterator[np.ndarray]:
        """Rows first + 1 to last of the scores; `above` is row `first`, which begins before place lo of the window."""
        n, ramp = len(self.window), -GAP * np.arange(len(above), dtype=np.int32)
        hi = lo + len(above) - 1
        for i in range(first, last):
            gain = (self.window[lo:hi] == self.item[i]).astype(np.int32)
            if len(self.used):
                a, b = np.searchsorted(self.used, (i * n + lo, i * n + hi))
                gain[self.used[a:b] - (i * n + lo)] = 0
            row = np.maximum(above + np.int32(GAP), 0)
            np.maximum(row[1:], above[:-1] + gain * np.int32(MATCH - MISMATCH) + np.int32(MISMATCH), out=row[1:])
            above = np.maximum.accumulate(row + ramp) - ramp
            yield above


def _best_path(pair: _Pair, least: float = 0) -> tuple[int, list[tuple[int, int]]]:
    """Score and cells of the best local alignment of an item (rows) and a window, from before its first words to its last; no
    cells if the score is under `least`. The scores of a large table are made twice: once for the best cell, then, of the columns that
    an alignment which ends there can reach, every step-th row, from which the rows between are made again when the path comes to them."""
    m, n = len(pair.item), len(pair.window)
    zeros = np.zeros(n + 1, np.int32)
    small = (m + 1) * (n + 1) <= CELLS
    block, best, i, j = [zeros], 0, 0, 0
    for k, row in enumerate(pair.rows(zeros, 0, m, 0), 1):
        at = int(row.argmax())
        if row[at] > best:
            best, i, j = int(row[at]), k, at
        if small:
            block.append(row)
    if best < least:
        return best, []
    base, lo, step, kept = 0, 0, m + 1, {}
    if not small:
        lo, step = max(0, j - _reach(m)), math.isqrt(i) + 1
        kept[0] = zeros[lo : j + 1]
        kept |= {k: row for k, row in enumerate(pair.rows(kept[0], 0, i, lo), 1) if k % step == 0}
        base = m + 1
    path = [(i, j)]
    while i:
        if i <= base and base:
            base = (i - 1) // step * step
            block = [kept[base][: j - lo + 1]]
            block += pair.rows(block[0], base, i, lo)
        here = block[i - base]
        if here[j - lo] == 0:
            break
        above = block[i - 1 - base]
        equal = pair.item[i - 1] == pair.window[j - 1] and (i - 1) * n + j - 1 not in pair.gone
        if here[j - lo] == above[j - 1 - lo] + (MATCH if equal else MISMATCH):
            i, j = i - 1, j - 1
        elif here[j - lo] == above[j - lo] + GAP:
            i -= 1
        else:
            j -= 1
        path.append((i, j))
    return best, path[::-1]


def _summed(pair: _Pair, path: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a path's cells: place in the item, in the window, and points and equal words up to each."""
    i, j = np.array(path, np.int64).T
    both = (np.diff(i) == 1) & (np.diff(j) == 1)
    same = both.copy()
    same[both] = pair.equal(i[:-1][both], j[:-1][both])
    points = np.where(same, MATCH, np.where(both, MISMATCH, GAP))
    return i, j, np.concatenate(([0], np.cumsum(points))), np.concatenate(([0], np.cumsum(same)))


def smith_waterman(item: np.ndarray, window: np.ndarray) -> tuple[int, int, int, int, int, int]:
    """Best local alignment of two word sequences: score, equal words, item start and end, window start and end."""
    pair = _Pair(item, window)
    best, path = _best_path(pair)
    i, j, _, same = _summed(pair, path)
    return best, int(same[-1]), int(i[0]), int(i[-1]), int(j[0]), int(j[-1])


def held_part(item: np.ndarray, window: np.ndarray) -> tuple[int, int, int, int, int, int] | None:
    """The alignment, or the part of one, with the largest score of those that pass, as smith_waterman gives it."""
    pair, whole = _Pair(item, window), MIN_SCORE * MATCH * len(item)
    # k equal words that pass span k / MIN_IDENTITY words, so at most so many more in either, each unequal or in a gap
    least = min(MIN_RUN * MATCH + 2 * GAP * (MIN_RUN / MIN_IDENTITY - MIN_RUN), whole)
    best = None
    while len(item) and len(window):
        points, path = _best_path(pair, least if best is None else max(least, best[0] + 1))
        if not path:
            break
        i, j, upto, same = _summed(pair, path)
        found = (0, len(path) - 1) if points >= whole else _longest_part(i, j, same)
        if found is not None:
            a, b = found
            part = int(upto[b] - upto[a]), int(same[b] - same[a]), int(i[a]), int(i[b]), int(j[a]), int(j[b])
            best = part if best is None or part[0] > best[0] else best
        at = np.flatnonzero(np.diff(same))
        pair.use(i[at], j[at])
    return best


def _longest_part(i: np.ndarray, j: np.ndarray, same: np.ndarray) -> tuple[int, int] | None:
    """Where the part of a path with the most equal words of those that pass by identity begins and ends. A part that passes
    still does so when it is extended by equal words, so it begins where a run of them begins."""
    found, most = None, MIN_RUN - 1
    step = np.concatenate(([0], np.diff(same), [0]))
    for a in np.flatnonzero((step[1:] == 1) & (step[:-1] == 0)).tolist():
        count = same[a:] - same[a]
        passing = np.flatnonzero((count > most) & (count >= MIN_IDENTITY * np.maximum(i[a:] - i[a], j[a:] - j[a])))
        if len(passing):
            b = int(passing[np.argmax(count[passing])])
            found, most = (a, a + b), int(count[b])
    return found


def leaks(seeds: Seeds, texts: list[str | None]) -> list[tuple[int, int, int, float, int, int, int, int, int]]:
    """Held items of each text: (text, item, seeds, score, matches, text start and end, item start and end)."""
    words, at = tv.word_hashes(texts)
    out = []
    known: dict[tuple[int, bytes], tuple | None] = {}
    for t, i, n_seeds, windows in _windows(seeds, words, at):
        own, item = words[at[t] : at[t + 1]], seeds.words[i]
        need = min(MIN_RUN, MIN_SCORE * len(item))
        best = None
        for diagonals in windows:
            whole = next((d for d in diagonals if d >= 0 and np.array_equal(own[d : d + len(item)], item)), None)
            if whole is not None:
                best = MATCH * len(item), len(item), 0, len(item), whole, whole + len(item)
                break
            for a, b in _pieces(max(0, diagonals[0] - PAD), min(len(own), diagonals[-1] + len(item) + PAD), len(item)):
                key = (i, own[a:b].tobytes())
                if key not in known:
                    known[key] = held_part(item, own[a:b]) if np.isin(item, own[a:b]).sum() >= need else None
                s = known[key]
                if s is not None and (best is None or s[0] > best[0]):
                    best = (*s[:4], s[4] + a, s[5] + a)
        if best is not None:
            points, matches, i0, i1, j0, j1 = best
            out.append((t, i, n_seeds, points / (MATCH * len(item)), matches, j0, j1, i0, i1))
    return out


def _windows(seeds: Seeds, words: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int, list[list[int]]]]:
    """(text, item, number of hits, windows) by text and item. A window is the distinct diagonals, ordered, of hits that
    are at most PAD apart and cover enough words."""
    found = []
    for n, places, text, lo, hi in seeds.hits(words, at):
        _, item, place = seeds.by_length[n]
        count = hi - lo
        k = np.arange(count.sum()) + np.repeat(lo - (np.cumsum(count) - count), count)
        found.append((np.repeat(text, count), item[k], np.repeat(places - at[text], count) - place[k], place[k], np.full(len(k), n)))
    if not any(len(x[0]) for x in found):
        return
    t, i, d, q, n = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((q, d, i, t))
    t, i, d, q, n = t[order], i[order], d[order], q[order], n[order]
    turn = np.flatnonzero((np.diff(t) != 0) | (np.diff(i) != 0)) + 1
    cut = np.union1d(turn, np.flatnonzero(np.diff(d) > PAD) + 1)
    begin, end = np.concatenate(([0], cut)).astype(np.int64), np.concatenate((cut, [len(t)])).astype(np.int64)
    pair = np.searchsorted(turn, begin, "right")
    sizes = np.diff(np.concatenate(([0], turn, [len(t)])))
    enough = np.array([min(COVER, len(w)) for w in seeds.words], np.int64)[i[begin]]
    last, windows = -1, []
    for k in np.flatnonzero(np.add.reduceat(n, begin) >= enough).tolist():
        a, b = begin[k], end[k]
        if n[a:b].max() < enough[k] and len({w for p, m in zip(q[a:b].tolist(), n[a:b].tolist(), strict=True) for w in range(p, p + m)}) < enough[k]:
            continue
        if pair[k] != last and windows:
            yield (*where, windows)
            windows = []
        last, where = pair[k], (int(t[a]), int(i[a]), int(sizes[pair[k]]))
        windows.append(np.unique(d[a:b]).tolist())
    if windows:
        yield (*where, windows)


def _reach(m: int) -> int:
    """The most words of a window in one alignment with an item of m words, whose equal words pay for the gaps."""
    return m + MATCH * m // -GAP


def _pieces(a: int, b: int, m: int) -> Iterator[tuple[int, int]]:
    """Stretches of a window, each with all of the next one that an alignment can reach."""
    reach = _reach(m)
    size = max(PIECE, 2 * reach)
    while b - a > size:
        yield a, a + size
        a += size - reach
    yield a, b


def _blocks(items: DataFrame) -> Iterator[Seeds]:
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, -(-total // BLOCK_BYTES))
    for k in range(count):
        block = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k) if count > 1 else items
        rows = sorted(block.collect(), key=lambda r: (r["item_id"] is None, *([r["item_id"]] if r["item_id"] is not None else []), r["text"] or ""))
        yield Seeds.of([r["item_id"] for r in rows], [r["text"] for r in rows])


def seed_blocks(items: DataFrame) -> Iterator[Seeds]:
    """The seeds of each block of items."""
    for seeds in _blocks(items.select("item_id", "text")):
        if seeds.by_length:
            yield seeds


def find_leaks(texts: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per text row and held item: doc_id and item_id, with the types of key and item_id, and COLUMNS."""
    own, held = texts.schema[key].dataType, items.schema["item_id"].dataType
    schema = f"doc_id {own.simpleString()}, item_id {held.simpleString()}, {COLUMNS}"
    item_kind, names = to_arrow_type(held), [f.split()[0] for f in schema.split(", ")]

    def finder(seeds: Seeds) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, own in tv.chunks(batches):
                rows = leaks(seeds, own)
                if rows:
                    columns = list(zip(*rows, strict=True))
                    ids = batch.column(0).take(pa.array(columns[0], pa.int64()))
                    items_held = pa.array([seeds.ids[i] for i in columns[1]], item_kind)
                    kinds = [pa.int64(), pa.float64(), *[pa.int64()] * 5]
                    yield pa.RecordBatch.from_arrays([ids, items_held, *[pa.array(c, k) for c, k in zip(columns[2:], kinds, strict=True)]], names=names)

        return run

    out = None
    for seeds in seed_blocks(items):
        part = texts.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(finder(seeds), schema)
        out = part if out is None else out.unionByName(part)
    return texts.sparkSession.createDataFrame([], schema) if out is None else out


def without_leaks(texts: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The rows, all columns, of texts that hold no item."""

    def keeper(seeds: Seeds) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, own in tv.chunks(batches, text):
                keep = np.ones(len(own), bool)
                keep[[row[0] for row in leaks(seeds, own)]] = False
                yield batch.filter(pa.array(keep))

        return run

    out = texts
    for seeds in seed_blocks(items):
        out = out.mapInArrow(keeper(seeds), texts.schema)
    return out

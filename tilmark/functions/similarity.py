"""The same scores and alignments in Python, for Arrow batches: bit-parallel subsequences and tables of word distances."""

from __future__ import annotations

import functools
from collections.abc import Sequence

import numpy as np

CORRECT, SUBSTITUTION, DELETION, INSERTION = "correct", "substitution", "deletion", "insertion"
STATUSES = (CORRECT, SUBSTITUTION, DELETION, INSERTION)
#: Cells of a table of moves that is held whole, two bits each; bytes of the places of words that are kept.
CELLS = 1 << 24
HELD = 1 << 24


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence: one bit per character of a, one integer addition per character of b
    (Hyyro 2004)."""
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return 0
    where: dict[str, int] = {}
    if len(a) < 128:
        for i, ch in enumerate(a):
            where[ch] = where.get(ch, 0) | 1 << i
    else:
        points = np.frombuffer(a.encode("utf-32-le", "surrogatepass"), np.uint32)
        for ch in set(b):
            where[ch] = int.from_bytes(np.packbits(points == ord(ch), bitorder="little").tobytes(), "little")
    full = (1 << len(a)) - 1
    state = full
    for ch in b:
        if (hit := state & where.get(ch, 0)):
            state = (state + hit | state - hit) & full
    return len(a) - state.bit_count()


def ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 100.0 if not total else 100.0 - 100.0 * (total - 2 * lcs(a, b)) / total


def set_score(la: int, lb: int, shared: int, indel: int) -> float:
    """The token-set score from the lengths of both joined differences, of the joined intersection, and the
    insert-delete distance of the differences."""
    g = 1 if shared else 0
    r1 = 100.0 - 100.0 * indel / (2 * (shared + g) + la + lb)
    if not shared:
        return r1
    return max(r1, 100.0 - 100.0 * (g + la) / (2 * shared + g + la), 100.0 - 100.0 * (g + lb) / (2 * shared + g + lb))


def token_set_ratio(a: str, b: str) -> float:
    p, q = set(a.split()), set(b.split())
    if not p or not q:
        return 0.0
    both = p & q
    if both and (both == p or both == q):
        return 100.0
    x, y = " ".join(sorted(p - q)), " ".join(sorted(q - p))
    return set_score(len(x), len(y), len(" ".join(both)), len(x) + len(y) - 2 * lcs(x, y))


class _Places:
    """For each word of a text, where it stands, as the bits of a number. Numbers are kept up to HELD bytes in all; those of further words are made anew, so memory stays bounded."""

    def __init__(self, words: Sequence[str]):
        self.size = len(words)
        self.at: dict[str, list[int]] = {}
        for i, w in enumerate(words):
            self.at.setdefault(w, []).append(i)
        self.held: dict[str, int] = {}
        self.free = HELD

    def of(self, word: str) -> int:
        if (bits := self.held.get(word)) is not None:
            return bits
        if (at := self.at.get(word)) is None:
            return 0
        if len(at) == 1:
            bits = 1 << at[0]
        else:
            raw = bytearray(at[-1] // 8 + 1)
            for i in at:
                raw[i >> 3] |= 1 << (i & 7)
            bits = int.from_bytes(raw, "little")
        if (cost := at[-1] // 7 + 100) <= self.free:
            self.free -= cost
            self.held[word] = bits
        return bits


def _rows(places: _Places, ref: Sequence[str], up: int, down: int, full: int, kept: list[tuple[int, int]] | None = None) -> tuple[int, int]:
    """The table of Levenshtein distances, a row at a time: one bit per word of hyp, some integer operations per word of ref (Hyyro 2003). A row is where it rises and
    falls by one; given is that before the first word of ref, returned that after the last. full: a bit for each column in use. kept: for each row, where a cell is that of the row before and the
    column before, and where it is one more than the cell of the row before."""
    held, of = places.held.get, places.of
    for word in ref:
        equal = held(word)
        if equal is None:
            equal = of(word)
        same = ((((equal & up) + up) ^ up) | equal | down) & full
        more = down | full ^ (same | up)
        if kept is not None:
            kept.append((same, more))
        less = (same & up) << 1
        more = more << 1 | 1
        down = same & more
        up = (less | ~(same | more)) & full
    return up, down


def edit_distance(hyp: Sequence[str], ref: Sequence[str]) -> int:
    """Levenshtein distance of two sequences, in the memory of one row and of the places of words."""
    if len(hyp) < len(ref):
        hyp, ref = ref, hyp
    full = (1 << len(hyp)) - 1
    up, down = _rows(_Places(hyp), ref, full, 0, full)
    return len(ref) + up.bit_count() - down.bit_count()


def best_moves(hyp: Sequence[str], ref: Sequence[str], cells: int = CELLS) -> list[int]:
    """The moves of one best alignment in text order, as indexes into STATUSES: from the end of both, equal words win, then substitution, deletion, insertion.

    Rows of the table are made by bits, and a path goes back through those that are kept. Of a table of more than `cells`, the row in the middle is made first and the
    part after it is gone through; the path then enters the part before at the column that it has come to, and columns behind that are no longer needed. A row is made of rows before it only, so all
    have the same bits as in the whole; memory is linear in the words, and time at most three times that of one table."""
    places = _Places(hyp)
    j = len(hyp)
    start = (1 << j) - 1, 0
    out: list[int] = []
    open_ = [(0, len(ref), *start)]
    while open_:  # the last part first
        a, b, up, down = open_.pop()
        full = (1 << j) - 1
        if not j:
            out += [2] * (b - a)
            continue
        up, down = up & full, down & full
        if b - a > 1 and (b - a) * j > cells:
            middle = (a + b) // 2
            open_ += [(a, middle, up, down), (middle, b, *_rows(places, ref[a:middle], up, down, full))]
            continue
        kept: list[tuple[int, int]] = []
        _rows(places, ref[a:b], up, down, full, kept)
        for i in range(b - 1, a - 1, -1):
            word, (same, more) = ref[i], kept[i - a]
            while j:
                j -= 1
                if hyp[j] == word:
                    out.append(0)
                elif not same >> j & 1:
                    out.append(1)
                elif more >> j & 1:
                    j += 1
                    out.append(2)
                else:
                    out.append(3)
                    continue
                break
            else:
                out.append(2)
    out += [3] * j
    return out[::-1]


def align_words(hyp: Sequence[str], ref: Sequence[str], shown: Sequence[str], cells: int = CELLS) -> list[tuple[str, str, str, str, float]]:
    """Rows (hyp_word, ref_word, ref_word_with_diac, status, similarity) of one best alignment, in text order. shown: what
    stands for each reference word."""
    i = j = 0
    rows = []
    for move in best_moves(hyp, ref, cells):
        kind = STATUSES[move]
        rows.append(_pair(kind, hyp[j] if kind != DELETION else "", ref[i] if kind != INSERTION else "", shown[i] if kind != INSERTION else ""))
        i, j = i + (kind != INSERTION), j + (kind != DELETION)
    return rows


def _pair(kind: str, said: str, wanted: str, shown: str) -> tuple[str, str, str, str, float]:
    score = {CORRECT: lambda: 1.0, SUBSTITUTION: lambda: word_similarity(said, wanted)}.get(kind, lambda: 0.0)
    return said, wanted, shown, kind, score()


@functools.lru_cache(maxsize=1 << 17)
def word_similarity(said: str, wanted: str) -> float:
    return ratio(said, wanted) / 100

"""Finding the verse of a hypothesis: by key, or by the best token-set score above a threshold.

The corpus is mostly a dimension of a few thousand verses. It is collected for the workers only up to MAX_BLOCK verses;
a larger one stays distributed, and its blocks pass by the hypotheses of each task, each keeping the better winner, so no pair of hypothesis and verse is ever a row.
In a worker, scores of all verses are bounded from above at once: the lengths of shared and of differing tokens are
known from an inverted index, and the common subsequence of the rest is at most its common characters. Verses are then
scored exactly in falling order of the bound until no bound can win: by groups of up to GROUP verses
whose common subsequences are found at once, as the bits of one long integer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilmark.functions.similarity import token_set_ratio

THRESHOLD = 40.0
#: Verses of a corpus that is sent to the workers, those of a block of a larger one, and hypotheses that a task holds.
MAX_BLOCK = 20_000
BLOCK = 2_000
SLOT_ROWS = 20_000
#: Verses of a group, which are of like length; if so few of them are left, they are scored one by one.
FEW, GROUP = 2, 64
#: Bytes of the places of characters that an index keeps for its groups.
HELD = 1 << 27
#: Tokens whose character counts an index keeps, and bits that stay empty behind a verse's tokens.
COUNTED, GUARD = 20_000, 8
#: Shared tokens whose characters are counted at a time.
TOKENS = 64
EXACT, MATCHED, NOT_FOUND, BELOW = "exact", "matched", "not_found", "below_threshold"


def with_verse(hyps: DataFrame, corpus: DataFrame) -> DataFrame:
    """Hypotheses with surah and ayah, joined with their verse (idx, plain, original; null if there is none)."""
    first = corpus.groupBy("surah", "ayah").agg(F.min_by(F.struct("idx", "plain", "original"), "idx").alias("v")).select("surah", "ayah", "v.*")
    return hyps.join(first, ["surah", "ayah"], "left")


class VerseGroup:
    """Verses whose token-set scores with a text are found together. Each has a lane of bits: its sorted tokens, each behind a blank, and GUARD bits or more that
    take up its carries (each fills one more) until they are emptied, so that none leaves the lane. A step takes one character of the text's sorted tokens in all lanes (Hyyro 2004); shared tokens match nothing in their lanes, on
    either side, and neither does the blank before the first token that is left."""

    def __init__(self, sets: list[set[str]]):
        n = len(sets)
        self.tokens = np.array([len(s) for s in sets], np.int64)
        self.letters = np.array([sum(map(len, s)) for s in sets], np.int64)
        self.lanes = 0
        #: By token: (lane, its bits) of each verse that holds it, and all bits of those lanes.
        self.holders: dict[str, list[tuple[int, int]]] = {}
        self.held: dict[str, int] = {}
        self.blanks: list[list[tuple[int, str]]] = []  # by lane, in order: the blank's bit, the token behind it
        ends = np.cumsum((self.letters + self.tokens + GUARD + 7) // 8)  # lanes are whole bytes
        self.begins, self.size = np.concatenate([[0], ends[:-1]]).astype(np.int64), int(ends[-1]) if n else 0
        marks: dict[str, bytearray] = {}
        for lane, s in enumerate(sets):
            at = int(self.begins[lane]) * 8
            own = (1 << int(self.letters[lane] + self.tokens[lane])) - 1 << at
            self.lanes |= own
            self.blanks.append([])
            for w in sorted(s):
                self.blanks[-1].append((at, w))
                self.holders.setdefault(w, []).append((lane, (1 << len(w) + 1) - 1 << at))
                self.held[w] = self.held.get(w, 0) | own
                for c in " " + w:
                    raw = marks.setdefault(c, bytearray(self.size))
                    raw[at >> 3] |= 1 << (at & 7)
                    at += 1
        self.where = {c: int.from_bytes(raw, "little") for c, raw in marks.items()}
        self.firsts = sum(1 << b[0][0] for b in self.blanks if b)

    def scores(self, own: set[str]) -> np.ndarray:
        """token_set_ratio of each verse with a text of these tokens."""
        n = len(self.tokens)
        if not own:
            return np.zeros(n)
        shared, letters = np.zeros(n, np.int64), np.zeros(n, np.int64)
        off, lanes = 0, set()
        for w in own:
            for lane, bits in self.holders.get(w, ()):
                shared[lane] += 1
                letters[lane] += len(w)
                off |= bits
                lanes.add(lane)
        off |= self.firsts
        for lane in lanes:
            off |= next((1 << at for at, w in self.blanks[lane] if w not in own), 0)
        full = self.lanes
        on = full & ~off
        where = {c: bits & on for c, bits in self.where.items()}
        blank = where.get(" ", 0)
        state, begun = full, 0
        for w in sorted(own):
            here = full & ~held if (held := self.held.get(w)) else full  # lanes whose verse lacks the token
            if begun and (hit := state & blank & begun & here if held or begun != full else state & blank):
                state = state + hit | state ^ hit
            if begun != full:
                begun |= here
            for n_signs, c in enumerate(w, 2):  # the blank was one
                if bits := where.get(c):
                    hit = state & bits & here if held else state & bits
                    state = state + hit | state ^ hit
                if not n_signs % GUARD:
                    state &= full
            state &= full
        raw = np.frombuffer((full & ~state).to_bytes(self.size, "little"), np.uint8)
        same = np.add.reduceat(np.bitwise_count(raw), self.begins, dtype=np.int64) if n else shared
        x, y = len(own) - shared, self.tokens - shared
        la = sum(map(len, own)) - letters + np.maximum(x - 1, 0)
        lb = self.letters - letters + np.maximum(y - 1, 0)
        return np.where(self.tokens == 0, 0.0, np.where((shared > 0) & ((x == 0) | (y == 0)), 100.0, set_scores(la, lb, shared, letters, same)))


def set_scores(la: np.ndarray, lb: np.ndarray, shared: np.ndarray, letters: np.ndarray, same: np.ndarray) -> np.ndarray:
    """similarity.set_score of arrays; shared tokens and their letters; same: lengths of the common subsequences."""
    sl = letters + np.maximum(shared - 1, 0)
    g = (shared > 0).astype(np.int64)
    with np.errstate(divide="ignore", invalid="ignore"):
        r1 = 100.0 - 100.0 * (la + lb - 2 * same) / (2 * (sl + g) + la + lb)
        r2 = 100.0 - 100.0 * (g + la) / (2 * sl + g + la)
        r3 = 100.0 - 100.0 * (g + lb) / (2 * sl + g + lb)
    return np.where(shared > 0, np.maximum(np.maximum(r1, r2), r3), r1)


class _Counted(dict):
    """Counts of tokens' characters, of up to COUNTED tokens kept."""

    def __init__(self, count: Callable[[str], np.ndarray]):
        self.count = count

    def __missing__(self, token: str) -> np.ndarray:
        made = self.count(token)
        if len(self) < COUNTED:
            self[token] = made
        return made


class VerseIndex:
    """Verses in index order, with what bounds their scores."""

    def __init__(self, rows: list[tuple[int, int, str]]):
        rows = sorted(rows)
        self.idx = np.array([r[0] for r in rows], np.int64)
        self.surah = np.array([r[1] for r in rows], np.int64)
        self.plain = [r[2] for r in rows]
        sets = [set(p.split()) for p in self.plain]
        self.alphabet = {c: i for i, c in enumerate(sorted({c for s in sets for w in s for c in w}))}
        self.tokens = np.array([len(s) for s in sets], np.int64)
        self.letters = np.array([sum(map(len, s)) for s in sets], np.int64)
        self.counts = np.zeros((len(rows), len(self.alphabet)), np.int32)
        holders: dict[str, list[int]] = {}
        for i, s in enumerate(sets):
            for w in s:
                holders.setdefault(w, []).append(i)
            self.counts[i] = self._count("".join(s))
        self.holders = {w: np.array(at, np.int64) for w, at in holders.items()}
        self.token_counts = _Counted(self._count)
        self.groups, self.free = {}, HELD
        self.by_length = np.argsort(self.letters + self.tokens, kind="stable")
        self.group_of = np.empty(len(rows), np.int64)
        self.group_of[self.by_length] = np.arange(len(rows)) // GROUP

    def _count(self, text: str) -> np.ndarray:
        """How often each character of the alphabet is in a text."""
        return np.bincount([self.alphabet[c] for c in text if c in self.alphabet], minlength=len(self.alphabet)).astype(np.int32)

    def bounds(self, text: str) -> np.ndarray:
        """No verse's score with text is above its bound; a bound of 0 is exact."""
        own = set(text.split())
        n = len(self.plain)
        if not own:
            return np.zeros(n)
        mine = self._count("".join(own))
        known = [w for w in own if w in self.holders]
        at = np.concatenate([self.holders[w] for w in known] or [np.empty(0, np.int64)])
        which = np.repeat(np.arange(len(known)), [len(self.holders[w]) for w in known])
        shared = np.bincount(at, minlength=n)
        letters = np.bincount(at, np.array([len(w) for w in known], np.float64)[which], n).astype(np.int64)
        common = np.zeros((n, len(self.alphabet)), np.float32)
        for k in range(0, len(known), TOKENS):  # counts are small whole numbers, so sums of floats are exact
            held = np.zeros((TOKENS, n), np.float32)
            some = (which >= k) & (which < k + TOKENS)
            held[which[some] - k, at[some]] = 1
            common += held[: len(known) - k].T @ np.stack([self.token_counts[w] for w in known[k : k + TOKENS]]).astype(np.float32)
        common = common.astype(np.int32)
        x, y = len(own) - shared, self.tokens - shared
        la = sum(map(len, own)) - letters + np.maximum(x - 1, 0)
        lb = self.letters - letters + np.maximum(y - 1, 0)
        same = np.minimum(mine[None, :] - common, self.counts - common).sum(axis=1) + np.minimum(np.maximum(x - 1, 0), np.maximum(y - 1, 0))
        out = set_scores(la, lb, shared, letters, same)
        return np.where(self.tokens == 0, 0.0, np.where((shared > 0) & ((x == 0) | (y == 0)), 100.0, out))

    def members(self, k: int) -> np.ndarray:
        """Places of the k-th group's verses, ascending."""
        return np.sort(self.by_length[k * GROUP : (k + 1) * GROUP])

    def group(self, k: int) -> VerseGroup:
        """The k-th group of verses, made when it is first asked for, and kept as long as there is room."""
        if (found := self.groups.get(k)) is None:
            found = VerseGroup([set(self.plain[i].split()) for i in self.members(k).tolist()])
            cost = found.size * len(found.where)
            if cost <= self.free:
                self.free -= cost
                self.groups[k] = found
        return found

    def best(self, text: str, surah: int | None, threshold: float) -> tuple[int, float] | None:
        """(place, score) of the first verse with the largest score, of at least threshold."""
        bounds = self.bounds(text)
        if surah is not None:
            bounds = np.where(self.surah == surah, bounds, -1.0)
        own = set(text.split())
        winner: tuple[int, float] | None = None
        while True:
            bounds[bounds + 1e-6 < (winner[1] if winner else threshold)] = -1.0  # cannot win
            if not len(bounds) or bounds[i := int(np.argmax(bounds))] < 0:
                return winner
            members = self.members(int(self.group_of[i]))
            if np.count_nonzero(bounds[members] >= 0) <= FEW:
                members, scores = np.array([i]), np.array([token_set_ratio(text, self.plain[i])])
            else:
                scores = np.where(bounds[members] >= 0, self.group(int(self.group_of[i])).scores(own), -1.0)
            bounds[members] = -1.0
            k = int(np.argmax(scores))
            score, at = float(scores[k]), int(members[k])
            if score >= threshold and (winner is None or (score, -at) > (winner[1], -winner[0])):
                winner = at, score


def verse_index(corpus: DataFrame) -> VerseIndex | None:
    """The index of a corpus of at most MAX_BLOCK verses, else None. To be made once where hypotheses come in many batches."""
    rows = corpus.select("idx", "surah", "plain").limit(MAX_BLOCK + 1).collect()
    return VerseIndex([tuple(r) for r in rows]) if len(rows) <= MAX_BLOCK else None


Best = tuple[int | None, float | None]


def _better(index: VerseIndex, text: str | None, scope: int | None, so_far: Best, threshold: float) -> Best:
    """The best verse so far (idx, score), or one of the index: a larger score, or an equal one with a smaller idx. What is known is the threshold."""
    if text is None:
        return so_far
    i, w = so_far
    new = index.best(text, scope, threshold if w is None else w)
    if new is None or w is not None and (new[1], -int(index.idx[new[0]])) <= (w, -i):
        return so_far
    return int(index.idx[new[0]]), new[1]


def verse_blocks(corpus: DataFrame, size: int) -> DataFrame:
    """(block, verses) of about `size` verses, by their idx."""
    verses = F.collect_list(F.struct("idx", "surah", "plain")).alias("verses")
    return corpus.select(F.col("idx").cast("long").alias("idx"), F.col("surah").cast("long").alias("surah"), "plain").groupBy(F.floor(F.col("idx") / size).cast("long").alias("block")).agg(verses)


def best_verses_by_blocks(hyps: DataFrame, corpus: DataFrame, threshold: float = THRESHOLD, size: int = BLOCK, slot_rows: int = SLOT_ROWS) -> DataFrame:
    """best_verses against a corpus of any size, which stays a distributed table. hyps are dealt evenly to slots of at most slot_rows, every slot gets all
    blocks, and its task takes them one after the other, each with the best scores so far as thresholds. A task holds its hypotheses and one block; equal hypotheses are searched once."""
    spark = hyps.sparkSession
    named = hyps.withColumn("scope", F.col("scope").cast("int"))
    rows = named.count()
    slots = max(1, -(-rows // slot_rows), min(rows, spark.sparkContext.defaultParallelism))
    asked = named.select("*", F.pmod(F.monotonically_increasing_id(), F.lit(slots)).cast("int").alias("_slot"), F.lit(None).cast("long").alias("_block"), F.lit(None).cast("array<struct<idx:bigint,surah:bigint,plain:string>>").alias("_verses"))
    every = F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("_slot")
    blocks = verse_blocks(corpus, size).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in named.schema.fields], every, F.col("block").alias("_block"), F.col("verses").alias("_verses"))
    dealt = asked.unionByName(blocks).repartitionById(slots, "_slot").sortWithinPartitions(F.col("_block").asc_nulls_first())
    names = named.columns
    width, text, scope = len(names), names.index("hypothesis"), names.index("scope")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        best: dict[tuple[str | None, int | None], Best] = {}
        for batch in batches:
            asked_rows = batch.column(width + 1).null_count
            if asked_rows:
                held.append(own := batch.slice(0, asked_rows))
                best |= dict.fromkeys(zip(own.column(text).to_pylist(), own.column(scope).to_pylist(), strict=True), (None, None))
            for i in range(asked_rows, len(batch)):
                verses = batch.column(width + 2)[i].values
                index = VerseIndex(list(zip(*(verses.field(f).to_pylist() for f in ("idx", "surah", "plain")), strict=True)))
                for key, found in best.items():
                    best[key] = _better(index, *key, found, threshold)
        for own in held:
            found = [best[key] for key in zip(own.column(text).to_pylist(), own.column(scope).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*own.columns[:width], pa.array([i for i, _ in found], pa.int64()), pa.array([w for _, w in found], pa.float64())], names=[*names, "idx", "match_score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in named.schema.fields)
    return dealt.mapInArrow(run, f"{schema}, idx long, match_score double").drop("scope")


def best_verses(hyps: DataFrame, corpus: DataFrame, threshold: float = THRESHOLD, spread: int | None = None, index: VerseIndex | None = None) -> DataFrame:
    """hyps (hypothesis in normal form or null, scope: a surah or null, and any other columns) with idx and match_score of the best verse, or nulls.
    A corpus of at most MAX_BLOCK verses is sent to the workers, and hyps are read once where they lie; a larger one is searched by blocks, without being collected. spread: deal hyps to so many
    tasks first, which pays where they come in a few small files; splits of large inputs need none."""
    index = index or verse_index(corpus)
    if index is None:
        return best_verses_by_blocks(hyps, corpus, threshold)
    found = hyps.repartition(spread) if spread else hyps
    found = found.withColumns({"scope": F.col("scope").cast("int"), "idx": F.lit(None).cast("long"), "match_score": F.lit(None).cast("double")})
    text, scope, at, score = (found.columns.index(c) for c in ("hypothesis", "scope", "idx", "match_score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = list(zip(batch.column(text).to_pylist(), batch.column(scope).to_pylist(), strict=True))
            once = {key: _better(index, *key, (None, None), threshold) for key in set(asked)}
            rows = [once[key] for key in asked]
            columns = list(batch.columns)
            columns[at], columns[score] = pa.array([i for i, _ in rows], pa.int64()), pa.array([w for _, w in rows], pa.float64())
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return found.mapInArrow(run, found.schema).drop("scope")

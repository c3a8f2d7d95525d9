"""Product codes of vectors by exact integer arithmetic, with a partial-distance search for the nearest entry.

A component x becomes the integer floor(SCALE * x); vectors are cut into PARTS equal consecutive parts. Each part has a codebook of ENTRIES
entries, at first those parts of the kept vectors with the smallest ids. A round assigns every part to its nearest entry (squared
Euclidean distance, ties to the lower index) and replaces each entry by the floored mean of its parts; an entry without parts stays.

The search holds, for every part of a block of rows, the best complete distance so far. It begins with the entry that is nearest in the first
dimension. For each further entry the dimensions come in falling order of the codebook's variance, and a mask drops the rows whose accumulated
distance strictly exceeds their best: no sum of the rest can make up for it. What is left is complete, so ties are seen exactly.

A round is one pass over the vectors where they lie: a task adds up its parts by entry, and what it sends on is at most one row for each
place of the codebooks and digit, however many vectors it read. Sums travel as digits of 24 bits, so that no sum overflows. The codebooks (PARTS
times ENTRIES entries, a bound that does not grow with the input) go through the driver between rounds. The last pass writes the codes.

Defined cases: a null vector, or one with a null or non-finite component, has no row; the dimension is that of most kept vectors (of equally many,
the largest) and a vector of another length, or of one that PARTS does not divide, has a row with null code and error, outside all sums; codebooks of fewer than ENTRIES vectors
are as small as that, and equal entries stand side by side (the first is used); among equal ids the smaller vector comes first, null ids come last;
repeated rows count each; components too large for 64-bit distances are worked on as Python integers, and distances or sums of errors above the
range of long are given as its largest value; an empty table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilmark.llm.runtime import written

SCALE = 4096
PARTS, ENTRIES, ROUNDS = 8, 16, 6
#: Rows of a block of the search.
BLOCK = 4096
#: Magnitudes below this are searched in 64-bit integers: a part of up to 2**12 components has squared distances below 2**62.
SMALL = 1 << 24
DIGIT = 24
LONGEST = (1 << 63) - 1
#: So many labels' sums are broadcast at most; more are joined by a shuffle.
BROADCAST_LABELS = 10_000

Codebooks = list[list[list[int]]]


def usable(vector: Column | str) -> Column:
    """Vectors that have a code: not null, all components finite."""
    v = F.col(vector) if isinstance(vector, str) else vector
    return v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def _integer(x: float) -> int:
    return math.floor(x * SCALE) if abs(x) < 2.0**52 else int(x) * SCALE


def integers(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * x): 64-bit integers where all are SMALL, else Python's."""
    scaled = np.floor(np.minimum(np.abs(values), 2.0**40) * np.sign(values) * SCALE)
    if not len(scaled) or np.abs(scaled).max() < SMALL:
        return scaled.astype(np.int64)
    return np.array([_integer(float(x)) for x in values], object)


def falling_variance(book: np.ndarray) -> list[int]:
    """The dimensions of a codebook (entry, position), those of the largest variance first, equal ones in order. A multiple of the variance, in exact integers."""
    n = len(book)
    spread = [n * sum(int(x) ** 2 for x in book[:, j]) - sum(int(x) for x in book[:, j]) ** 2 for j in range(book.shape[1])]
    return sorted(range(book.shape[1]), key=lambda j: (-spread[j], j))


def nearest(rows: np.ndarray, book: np.ndarray, order: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of the nearest entry of each row, ties to the lower index, by a partial-distance search in `order`."""
    n = len(rows)
    code, best = np.zeros(n, np.int64), np.zeros(n, rows.dtype)
    if not order:
        return code, best
    first = rows[:, order[0]]
    code = np.argmin(np.abs(first[:, None] - book[:, order[0]][None, :]), axis=1).astype(np.int64)
    begun = code.copy()
    for j in order:
        best += (rows[:, j] - book[code, j]) ** 2
    for k in range(len(book)):
        at = np.flatnonzero(begun != k)
        so_far = np.zeros(len(at), rows.dtype)
        for j in order:
            so_far = so_far + (rows[at, j] - book[k, j]) ** 2
            still = np.asarray(so_far <= best[at], bool)
            if not still.all():
                at, so_far = at[still], so_far[still]
            if not len(at):
                break
        better = np.asarray(so_far < best[at], bool) | (k < code[at])  # what is left is at most the best: else a tie with a lower index
        code[at[better]], best[at[better]] = k, so_far[better]
    return code, best


def _blocks(batches: Iterator[pa.RecordBatch], place: int, width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of batches of at most BLOCK rows with their integers (row, component). All vectors have `width` components."""
    for batch in batches:
        for at in range(0, len(batch), BLOCK):
            part = batch.slice(at, BLOCK)
            yield part, integers(np.asarray(part.column(place).flatten(), np.float64)).reshape(len(part), width)


class Coder:
    """Codebooks [part][entry][position] for searching."""

    def __init__(self, books: Codebooks):
        self.width = len(books[0][0])
        top = max((abs(x) for book in books for entry in book for x in entry), default=0)
        self.small = top < SMALL
        self.books = [np.array(b, np.int64 if self.small else object).reshape(len(b), self.width) for b in books]
        self.orders = [falling_variance(b) for b in self.books]

    def codes(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entries and squared distances (row, part)."""
        own = rows if rows.dtype == object or self.small else rows.astype(object)
        books = self.books if own.dtype != object else [b.astype(object) for b in self.books]
        found = [nearest(own[:, p * self.width : (p + 1) * self.width], b, o) for p, (b, o) in enumerate(zip(books, self.orders, strict=True))]
        return np.stack([c for c, _ in found], axis=1), np.stack([d for _, d in found], axis=1)


def _digits(value: int) -> Iterator[tuple[int, int]]:
    """Signed digits of a sum, so that the sum of sums is the sum of digits."""
    sign, rest, place = (-1 if value < 0 else 1), abs(value), 0
    while rest:
        if part := rest & ((1 << DIGIT) - 1):
            yield place, sign * part
        rest >>= DIGIT
        place += 1


def _sums(vectors: DataFrame, books: Codebooks) -> dict[tuple[int, int, int], int]:
    """By (part, entry, position) the sum of the assigned parts' components, at position -1 their number."""
    coder = Coder(books)
    width = coder.width * len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int, int], int] = {}
        for _, rows in _blocks(batches, 0, width):
            codes, _ = coder.codes(rows)
            for p in range(len(books)):
                own = rows[:, p * coder.width : (p + 1) * coder.width]
                for k in np.unique(codes[:, p]).tolist():
                    here = codes[:, p] == k
                    for j, v in enumerate([int(here.sum()), *own[here].sum(axis=0).tolist()], -1):
                        totals[p, k, j] = totals.get((p, k, j), 0) + int(v)
        each = [(*place, d, v) for place, total in totals.items() for d, v in _digits(total)]
        columns = list(zip(*each, strict=True)) if each else [()] * 5
        kinds = pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64()
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["part", "entry", "position", "digit", "v"])

    partial = vectors.select("v").mapInArrow(run, "part int, entry int, position int, digit int, v long")
    out: dict[tuple[int, int, int], int] = {}
    for p, k, j, d, v in partial.groupBy("part", "entry", "position", "digit").agg(F.sum("v").alias("v")).collect():
        out[p, k, j] = out.get((p, k, j), 0) + (v << (DIGIT * d))
    return out


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks of vectors (id, v array<double>) of one length that `parts` divides; none if there are no vectors."""
    order = [F.col("id").isNull(), "id", "v"]
    first = [integers(np.array(r["v"], np.float64)).tolist() for r in vectors.orderBy(*order).limit(entries).collect()]
    if not first:
        return []
    width = len(first[0]) // parts
    books = [[v[p * width : (p + 1) * width] for v in first] for p in range(parts)]
    for _ in range(rounds):
        sums = _sums(vectors, books)
        for p, book in enumerate(books):
            for k in range(len(book)):
                if n := sums.get((p, k, -1), 0):
                    book[k] = [sums.get((p, k, j), 0) // n for j in range(width)]
    return books


def digest(books: Codebooks) -> str:
    """SHA-256 of all components by part, entry and position."""
    return hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()


def encode(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """vectors (v and any other columns) with code, a list of entries, and error, the sum of squared distances."""
    coder = Coder(books)
    place = vectors.columns.index("v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _blocks(batches, place, coder.width * len(books)):
            codes, far = coder.codes(rows)
            errors = [min(LONGEST, int(x)) for x in far.astype(object).sum(axis=1)]
            flat = pa.array(codes.astype(np.int32).reshape(-1))
            listed = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, len(books)), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([*part.columns, listed, pa.array(errors, pa.int64())], names=[*part.schema.names, "code", "error"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema.fields)
    return vectors.mapInArrow(run, f"{kinds}, code array<int>, error long")


def _with_label_sums(rows: DataFrame) -> DataFrame:
    """label_error, the sum of error over rows of equal labels (nulls together). A label may have most of the rows: sums of few labels are broadcast, else
    Spark's join may split the label's rows, as each has one partner."""
    exact = F.coalesce(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
    sums = written(rows.groupBy("label").agg(F.least(exact, F.lit(LONGEST).cast("decimal(38,0)")).cast("long").alias("label_error")), "label-sums")
    other = F.broadcast(sums) if sums.count() <= BROADCAST_LABELS else sums
    named = other.withColumnRenamed("label", "other")
    return rows.join(named, F.col("label").eqNullSafe(F.col("other")), "left").drop("other")


def vector_codes(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """One row per usable vector: the key, code (hex, two digits an entry), error, label_error and codebooks_sha256."""
    if not 1 <= entries <= 256:
        raise ValueError("an entry's index has two hex digits: 1 to 256 entries")
    named = vectors.select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v")).filter(usable("v"))
    sizes = named.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows")).filter(F.col("n") % parts == 0).filter("n > 0")
    most = sizes.orderBy(F.desc("rows"), F.desc("n")).head()
    width = most["n"] if most else None
    fits = named.filter(F.size("v") == F.lit(width))
    books = train(fits, parts, entries, rounds)
    blank = named.filter(~F.coalesce(F.size("v") == F.lit(width), F.lit(False))).select("id", "label", F.lit(None).cast("array<int>").alias("code"), F.lit(None).cast("long").alias("error"))
    coded = encode(fits, books).select("id", "label", "code", "error").unionByName(blank) if books else blank
    out = _with_label_sums(written(coded, "codes"))
    hexed = F.array_join(F.transform("code", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return out.select(F.col("id").alias(key), hexed.alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))

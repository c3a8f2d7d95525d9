"""Edit distances and similarity scores as column expressions.

Word and character error rates use unit-cost Levenshtein distance; the similarity scores use the insert-delete
distance, from the longest common subsequence. The expressions suit sentences; for matching against a corpus and for long
texts the Arrow functions of tilmark.operators do the same.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tilmark.functions.text import remove_spaces

#: Code points from U+20000 on stand for words.
FIRST_SIGN = 0x20000
SIGNS = 0x110000 - FIRST_SIGN


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def characters(c: Column) -> Column:
    """The code points of a text, as an array."""
    return F.filter(F.split(c, ""), lambda x: x != "")


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two arrays: one row of the table at a time."""

    def next_row(row: Column, x: Column) -> Column:
        def cell(made: Column, j: Column) -> Column:
            here = F.when(F.element_at(b, j) == x, F.element_at(row, j) + 1).otherwise(F.greatest(F.element_at(row, j + 1), F.element_at(made, -1)))
            return F.concat(made, F.array(here))

        return F.aggregate(F.sequence(F.lit(1), F.size(b)), F.array(F.lit(0)), cell)

    table = F.aggregate(a, F.array_repeat(F.lit(0), F.size(b) + 1), next_row)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0)).otherwise(F.element_at(table, -1))


def indel_distance(a: Column | str, b: Column | str) -> Column:
    """Insertions and deletions between two texts."""
    x, y = characters(_col(a)), characters(_col(b))
    return F.size(x) + F.size(y) - 2 * lcs_length(x, y)


def ratio(a: Column | str, b: Column | str) -> Column:
    """Similarity of two texts, 0 to 100; two empty texts are equal."""
    a, b = _col(a), _col(b)
    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(100.0)).otherwise(100.0 - 100.0 * indel_distance(a, b) / total)


def _joined_length(words: Column) -> Column:
    return F.length(F.array_join(words, " "))


def token_set_ratio(a: Column | str, b: Column | str, tokens=None) -> Column:
    """Similarity of the token sets of two texts, 0 to 100; 0 if either is empty. tokens: how a text is tokenised."""
    from tilmark.functions.text import tokenise

    make = tokens or tokenise
    p, q = F.array_distinct(make(_col(a))), F.array_distinct(make(_col(b)))
    both = F.array_intersect(p, q)
    x, y = F.array_join(F.array_sort(F.array_except(p, q)), " "), F.array_join(F.array_sort(F.array_except(q, p)), " ")
    la, lb, sl = F.length(x), F.length(y), _joined_length(both)
    g = F.when(sl > 0, 1).otherwise(0)
    r1 = 100.0 - 100.0 * indel_distance(x, y) / (2 * (sl + g) + la + lb)
    r2 = 100.0 - 100.0 * (g + la) / (2 * sl + g + la)
    r3 = 100.0 - 100.0 * (g + lb) / (2 * sl + g + lb)
    scored = F.when(sl == 0, r1).otherwise(F.greatest(r1, r2, r3))
    return F.when((F.size(p) == 0) | (F.size(q) == 0), F.lit(0.0)).when((F.size(both) > 0) & ((la == 0) | (lb == 0)), F.lit(100.0)).otherwise(scored)


def _let(value: Column, use) -> Column:  # noqa: ANN001
    """use(value) with the value made once: it is the one element that an outer transform sees."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _coded(x: Column) -> Column:
    """Both word arrays of a struct (h, r) as texts (h, r) with a sign for each word, equal words with equal signs. The words of both are sorted once; runs of equal words
    are numbered, and a second sort puts the numbers back in their places."""
    placed = lambda words, side: F.transform(words, lambda w, i: F.struct(w.alias("w"), F.lit(side).alias("side"), i.alias("i")))
    point = lambda n: F.decode(F.unhex(F.lpad(F.hex(n + FIRST_SIGN), 8, "0")), "UTF-32")

    def numbered(words: Column) -> Column:
        return _let(F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: (i == 0) | (F.get(words, i)["w"] != F.get(words, i - 1)["w"])), lambda begins: repeated(words, begins))

    def repeated(words: Column, begins: Column) -> Column:
        many = F.size(begins) > SIGNS
        number = lambda n: F.when(many, F.raise_error(F.lit(f"more than {SIGNS} different words")).cast("int")).otherwise(n)
        ids = F.flatten(F.transform(begins, lambda b, n: F.array_repeat(number(n), F.coalesce(F.get(begins, n + 1), F.size(words)) - b)))
        return F.array_sort(F.zip_with(words, ids, lambda w, n: F.struct(w["side"].alias("side"), w["i"].alias("i"), n.alias("n"))))

    text = lambda coded, side: F.array_join(F.transform(F.filter(coded, lambda c: c["side"] == side), lambda c: point(c["n"])), "")
    ordered = F.array_sort(F.concat(placed(x["h"], 0), placed(x["r"], 1)))
    return _let(_let(ordered, numbered), lambda coded: F.struct(text(coded, 0).alias("h"), text(coded, 1).alias("r")))


def word_distance(hyp: Column, ref: Column) -> Column:
    """Levenshtein distance of two word arrays without nulls: each distinct word becomes one code point, for the built-in function. Coding sorts the words, so
    its time grows as n log n; up to SIGNS different words."""
    pair = F.struct(hyp.alias("h"), ref.alias("r"))
    far = _let(pair, lambda x: F.when(F.size(x["h"]) + F.size(x["r"]) == 0, F.lit(0)).otherwise(_let(_coded(x), lambda c: F.levenshtein(c["h"], c["r"]))))
    return F.when(hyp.isNotNull() & ref.isNotNull(), far)


def wer(hyp: Column, ref: Column) -> Column:
    """Word error rate of word arrays: distance over reference words. Of an empty reference: 0 if both are empty, else 1."""
    return F.when(F.size(ref) == 0, F.when(F.size(hyp) == 0, 0.0).otherwise(1.0)).otherwise(word_distance(hyp, ref) / F.size(ref))


def cer(hyp: Column | str, ref: Column | str) -> Column:
    """Character error rate of texts without spaces, as wer."""
    h, r = remove_spaces(hyp), remove_spaces(ref)
    return F.when(F.length(r) == 0, F.when(F.length(h) == 0, 0.0).otherwise(1.0)).otherwise(F.levenshtein(h, r) / F.length(r))


def word_accuracy(rate: Column | str) -> Column:
    """Percentage (1 - wer) * 100; negative for rates above 1."""
    return (1 - _col(rate)) * 100


def fixed(c: Column | str, digits: int) -> Column:
    """A number with a fixed count of decimals, rounded on its exact binary value, ties to even."""
    x = _col(c).cast("double")
    size, unit, scale = F.abs(x), 1 << 62, 10**digits
    whole = F.floor(size).cast("bigint")
    part = ((size - whole) * float(unit)).cast("bigint").cast("decimal(20,0)") * F.lit(scale).cast("decimal(5,0)")
    rest = part % F.lit(unit).cast("decimal(20,0)")
    down = ((part - rest) / F.lit(unit).cast("decimal(20,0)")).cast("bigint") + whole * scale
    half = F.lit(unit // 2).cast("decimal(20,0)")
    up = (rest > half) | ((rest == half) & (F.pmod(down, F.lit(2)) == 1))
    value = down + F.when(up, 1).otherwise(0)
    sign = F.when(x < 0, "-").otherwise("")
    tail = F.concat(F.lit("."), F.lpad(F.pmod(value, F.lit(scale)).cast("string"), digits, "0")) if digits else F.lit("")
    return F.concat(sign, ((value - F.pmod(value, F.lit(scale))) / scale).cast("bigint").cast("string"), tail)

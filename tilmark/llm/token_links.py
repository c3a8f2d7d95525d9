"""Cross-tokenizer alignment: which tokens of two tokenizers stand for the same bytes, and how often pairs of ids are linked.

Tokenizer A (byte-level pairs) reads a blank and the text, tokenizer B (pieces, which puts the blank there itself) the text. Where the bytes of both are those of
the blank and the text, a token of A and one of B are linked if their byte ranges overlap. Over this bipartite graph union-find gives the connected
components, which are exactly the minimal groups: the byte offsets where tokens of both end are the cuts between them. The members of a component, in order, are
expanded into its links, and pairs of ids are counted over all texts by Spark.

Neither tokenizer joins anything over a blank that has other signs on both sides, so a text is read as units, each a blank and what stands up to the next such
blank. A unit's tokens, components and links are found once and remembered by the worker (at most REMEMBERED units, then it begins anew), so
common words cost a look-up. This holds for a vocabulary of pieces without inner blanks, which is checked; with another vocabulary, or where a
unit's bytes differ, the text is read whole.

Texts are encoded once, into a table with the pairs of each text; counts are made from it and joined to it again. Pairs that more texts hold than an even
share of BROADCAST_PAIRS pairs would are broadcast, at most BROADCAST_PAIRS of them whatever the corpus is; rarer ones, of which none is hot, are joined by a shuffle.

Defined cases: null and empty texts, and texts of which a tokenizer does not give back the bytes (say, with U+2581), have no tokens: all numbers are 0 and
groups_sha256 is ''; texts that look like special tokens are plain text; a very long text is read whole, unit by unit; ties for a B id's highest count are all best; repeated rows and
rows with a null id count each; an empty table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilmark.llm import textvec as tv
from tilmark.llm.runtime import written

BYTES = "/opt/tokenizers/byte_bpe_50k.json"
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
REMEMBERED = 300_000
BROADCAST_PAIRS = 500_000
BLANK = "▁"
#: A blank with a sign that is no blank before it, and one that is no white space after it.
CUT = re.compile(r"(?<=[^ ]) (?=\S)")
#: Where CUT and str.split(" ") may differ.
ODD = re.compile(r" \s|^ | $")


def byte_alphabet() -> dict[str, int]:
    """The sign that stands for each byte in a byte-level vocabulary: itself if it is printable, else the next free one from U+0100 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pair:
    """Both tokenizers, from the contents of their files, with the bytes of each id."""

    def __init__(self, a: bytes, b: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a.decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        letters = byte_alphabet()
        names = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.a_bytes[i] = bytes(letters[c] for c in name) if all(c in letters for c in name) else name.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(pieces)]
        self.units = all(BLANK not in p.lstrip(BLANK) for p in pieces)
        self.a_size, self.b_size = (np.array([len(x) for x in own], np.int64) for own in (self.a_bytes, self.b_bytes))
        self.signs = [f"{i}{end}" for n, ends in ((len(self.a_bytes), ",|"), (len(self.b_bytes), ",;")) for end in ends for i in range(n)]

    def encode(self, texts: Sequence[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of each text by A (after a blank) and by B."""
        return [e.ids for e in self.a.encode_batch_fast([f" {t}" for t in texts], add_special_tokens=False)], self.b.encode(list(texts), num_threads=1)

    def whole(self, text: str, a: list[int], b: list[int]) -> bool:
        """Do both give back the bytes?"""
        raw = f" {text}".encode()
        return b"".join(map(self.a_bytes.__getitem__, a)) == raw and b"".join(map(self.b_bytes.__getitem__, b)) == raw


_pairs: dict[str, Pair] = {}


def pair_of(a: bytes, b: bytes) -> Pair:
    """A worker's tokenizers, made once."""
    key = hashlib.sha256(a).hexdigest() + hashlib.sha256(b).hexdigest()
    if key not in _pairs:
        _pairs.clear()
        _pairs[key] = Pair(a, b)
    return _pairs[key]


def united(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union-find over nodes 0 to n - 1 with links (a, b), all links at a time: the smallest node of each node's component. The roots of a link's ends are hooked, larger to
    smaller, and paths are halved, until no link joins two roots."""
    parent = np.arange(n)
    while True:
        x, y = parent[a], parent[b]
        apart = x != y
        if not apart.any():
            return parent
        np.minimum.at(parent, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up


@dataclass
class Linked:
    """What texts that were laid end to end hold, one place each: tokens, groups (also as text), and the pairs from begin[i] to begin[i + 1]."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    groups: list[str]
    begin: np.ndarray
    pairs: np.ndarray


def linked(pair: Pair, ids_a: np.ndarray, ids_b: np.ndarray, cuts: np.ndarray) -> Linked | None:
    """Components and links of texts laid end to end, which end at the bytes `cuts`; None where a token crosses one. The tokens of both have equal bytes."""
    n, m, k = len(ids_a), len(ids_b), len(cuts)
    end_a, end_b = np.cumsum(pair.a_size[ids_a]), np.cumsum(pair.b_size[ids_b])
    upto_a, upto_b = np.searchsorted(end_a, cuts), np.searchsorted(end_b, cuts)
    if not (np.array_equal(end_a[upto_a], cuts) and np.array_equal(end_b[upto_b], cuts)):
        return None
    upto_a, upto_b = upto_a + 1, upto_b + 1
    ends = np.sort(np.concatenate((end_a, end_b)), kind="stable")
    ends = ends[np.append(True, ends[1:] != ends[:-1])]  # every byte range between two ends lies in one token of A and one of B
    of_a, of_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
    root = united(n + m, of_a, n + of_b)  # a component's root is its first token of A
    pairs = ids_a[of_a] << 32 | ids_b[of_b]
    last_a, last_b = (np.append(r[1:] != r[:-1], True) for r in (root[:n], root[n:]))
    signs = np.concatenate((ids_a + len(pair.a_bytes) * last_a, 2 * len(pair.a_bytes) + ids_b + len(pair.b_bytes) * last_b))
    members = np.argsort(root * 2 + (np.arange(n + m) >= n), kind="stable")
    text = list(map(pair.signs.__getitem__, signs[members].tolist()))
    both = (upto_a + upto_b).tolist()
    groups = ["".join(text[i:j])[:-1] for i, j in zip([0, *both], both, strict=False)]
    begin = np.append(0, np.searchsorted(ends, cuts) + 1)
    upto_groups = np.append(0, np.cumsum(last_a)[upto_a - 1])
    return Linked(np.diff(upto_a, prepend=0), np.diff(upto_b, prepend=0), np.diff(upto_groups), groups, begin, pairs) if k else None


class Aligner:
    """Links of texts, by units that are remembered: each has a place in arrays, its pairs lie one after the other."""

    def __init__(self, pair: Pair, remembered: int = REMEMBERED):
        self.pair, self.remembered = pair, remembered
        self.forget()

    def forget(self) -> None:
        self.places: dict[str, int] = {}
        self.groups: list[str] = []
        self.counts = np.empty((3, 0), np.int64)
        self.begin, self.pairs = np.zeros(1, np.int64), np.empty(0, np.int64)

    def cut(self, text: str) -> list[str]:
        """A text's units, without the blank that each begins with."""
        if not self.pair.units:
            return [text]
        return CUT.split(text) if ODD.search(text) else text.split(" ")

    def encoded(self, texts: list[str], joined: bool) -> Linked | None:
        """texts, encoded as one text with a blank between any two, where that cuts them as each by itself; None if the bytes differ."""
        if joined:
            whole = " ".join(texts)
            (a,), (b,) = self.pair.encode([whole])
            if not self.pair.whole(whole, a, b):
                return None
        else:
            parts_a, parts_b = self.pair.encode(texts)
            if not all(map(self.pair.whole, texts, parts_a, parts_b)):
                return None
            a, b = ([i for part in own for i in part] for own in (parts_a, parts_b))
        return linked(self.pair, np.array(a, np.int64), np.array(b, np.int64), np.cumsum([len(t.encode()) + 1 for t in texts]))

    def learn(self, units: set[str]) -> None:
        new = [u for u in units if u not in self.places]
        if not new:
            return
        if self.places and len(self.places) + len(new) > self.remembered:
            self.forget()
            new = list(units)
        plain = [u for u in new if u and self.pair.units and not u[0].isspace() and u[-1] != " "]
        many = len(plain) > 1 and self.remember(plain, self.encoded(plain, True))
        for u in set(new) - set(plain) if many else new:
            if not self.remember([u], self.encoded([u], False)):
                self.places[u] = -1

    def remember(self, units: list[str], found: Linked | None) -> bool:
        if found is None:
            return False
        self.places.update(zip(units, range(len(self.groups), len(self.groups) + len(units)), strict=True))
        self.groups += found.groups
        self.counts = np.concatenate((self.counts, np.stack((found.n_a, found.n_b, found.n_groups))), axis=1)
        self.begin = np.concatenate((self.begin, self.begin[-1] + found.begin[1:]))
        self.pairs = np.concatenate((self.pairs, found.pairs))
        return True

    def texts(self, texts: Sequence[str | None]) -> Iterator[tuple]:
        """(n_a, n_b, n_groups, n_links, groups_sha256, pairs, times) of each text; pairs are sorted and different."""
        cuts = [self.cut(t) if t else [] for t in texts]
        self.learn({u for c in cuts for u in c})
        for text, cut in zip(texts, cuts, strict=True):
            places = list(map(self.places.__getitem__, cut))
            if -1 in places:
                whole = self.encoded([text], False)
                yield (0, 0, 0, 0, "", *[np.empty(0, np.int64)] * 2) if whole is None else _row(whole.groups, np.stack((whole.n_a, whole.n_b, whole.n_groups)), whole.pairs)
                continue
            if not places:
                yield 0, 0, 0, 0, "", np.empty(0, np.int64), np.empty(0, np.int64)
                continue
            at = np.array(places)
            size = self.begin[at + 1] - self.begin[at]
            own = np.repeat(self.begin[at] - np.cumsum(size) + size, size) + np.arange(size.sum())
            yield _row([self.groups[i] for i in places], self.counts[:, at], self.pairs[own])


def _row(groups: list[str], counts: np.ndarray, pairs: np.ndarray) -> tuple:
    n_a, n_b, n_groups = counts.sum(axis=1).tolist()
    ordered = np.sort(pairs)
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    return n_a, n_b, n_groups, len(pairs), hashlib.sha256(";".join(groups).encode()).hexdigest(), ordered[first], np.diff(np.append(first, len(pairs)))


NUMBERS = ("n_a", "n_b", "n_groups", "n_links")


def encoded(texts: DataFrame, key: str, text: str, a: str, b: str) -> DataFrame:
    """A written table: row, the key, NUMBERS, groups_sha256, and the text's different pairs with the times that each is linked in it."""
    with open(a, "rb") as f, open(b, "rb") as g:
        files = texts.sparkSession.sparkContext.broadcast((f.read(), g.read()))
    kept = T.StructType([texts.schema[key]])
    names = [key, *NUMBERS, "groups_sha256", "pairs", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(pair_of(*files.value))
        kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        for batch, own in tv.chunks(batches, "text"):
            columns = list(zip(*aligner.texts(own), strict=True))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["id", *names[1:]])

    id_kind = kept[0].dataType.simpleString()
    found = texts.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {id_kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>")
    return written(found.withColumn("row", F.monotonically_increasing_id()), "links")


def pair_counts(links: DataFrame) -> DataFrame:
    """(pair, count, texts, best) of a table of encoded(): how many links hold the pair, how many texts, and whether no other pair of its B id has more."""
    each = links.select(F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("p.*")
    counts = written(each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("times").alias("count"), F.count("*").alias("texts")), "pair-counts")
    by_b = F.col("pair").bitwiseAND(0xFFFFFFFF).alias("b")
    highest = counts.groupBy(by_b).agg(F.max("count").alias("highest"))
    return counts.select("*", by_b).join(highest, "b").select("pair", "count", "texts", (F.col("count") == F.col("highest")).alias("best"))


def token_links(texts: DataFrame, key: str = "doc_id", text: str = "text", a: str = BYTES, b: str = PIECES, broadcast: int = BROADCAST_PAIRS) -> DataFrame:
    """One row per input row: the key, NUMBERS, n_best, count_sum and groups_sha256."""
    links = encoded(texts, key, text, a, b)
    counts = written(pair_counts(links), "counts")
    held, different = counts.agg(F.sum("texts"), F.count("*")).head()
    common = F.col("texts") > (held or 0) // broadcast if different > broadcast else F.lit(True)
    each = links.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    joined = each.join(F.broadcast(counts.filter(common)), "pair")
    if different > broadcast:
        rare = each.join(F.broadcast(counts.filter(common).select("pair")), "pair", "left_anti")
        joined = joined.unionByName(rare.join(counts.filter(~common), "pair"))
    sums = joined.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return links.drop("pairs", "times").join(sums, "row", "left").select(F.col("id").alias(key), *NUMBERS, zero("n_best"), zero("count_sum"), "groups_sha256")

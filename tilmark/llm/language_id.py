"""Language identification of code-switched text by a linear-chain conditional random field over words.

Emissions are linear in hashed features of a lower-cased word: affixes of 1 to 3 letters, letter 2- and 3-grams with
the word's ends marked, and the word itself (the lexicon). Transitions between languages are learned
with them, by stochastic gradient steps on the chains' log-likelihood; its gradient is observed minus expected counts,
from forward-backward. Training chains join runs of words from texts of different languages, so that the
transitions see switches. Prediction runs forward-backward over every word of a text and
takes the language with the largest mean posterior, which is the score. Texts of over CHAIN words are cut into chains that are worked on side by side: of
each chain the product of its steps is made first, with these the messages at the cuts are handed on in both directions, and each chain
then starts and ends with them. The posteriors are those of the uncut text.

Training data: a bounded sample of the labelled rows (SAMPLE_ROWS texts per language, by a hash of id and text, equal rows once; with more
languages fewer of each, so that all have about TOTAL_ROWS, and fewer where a language's texts are so long that these would have over
TOTAL_BYTES, but at least one). All words of a sampled text are collected and learned from. Every language is learned;
the model is a few MB, 128 KB a language, and travels to the workers. Every text is predicted whole.

Defined cases: a null text, or one without a letter, is `und` with score 0; with nothing to learn from, every text is
`und`; letters are runs of Unicode letters; of languages with equal mean posteriors the first by code point is taken; a text of any length is predicted whole; repeated rows and rows with a null id give one row each; extra columns
are ignored or, where rows are filtered, kept; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilmark.llm import textvec as tv

WORDS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
BITS = 15
CHAIN = 256
GROUP = 512
SAMPLE_ROWS = 200
TOTAL_ROWS, TOTAL_BYTES = 12_800, 64_000_000
DRAWS = 1 << 62
STEPS, BATCH, TRAIN_CHAIN, RATE, DECAY = 150, 64, 48, 0.05, 1e-4
CACHE = 150_000
PART = 8_192
FOLDS = 5
MIN_SCORE = 0.35


def held_out(key: Column, folds: int = FOLDS, fold: int = 0) -> Column:
    """Whether a row belongs to the fold that nothing is learned from; a null key does not."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of words: all ids, and where each word's ids begin. Every word has at least three."""
    marked = [f"\x02{w}\x03" for w in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "replace"), np.uint32).astype(tv.U)
    lengths = np.fromiter(map(len, marked), np.int64, len(marked))
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    owner = np.repeat(np.arange(len(words)), lengths)
    place = np.arange(len(codes)) - starts[owner]
    after = lengths[owner] - place
    c1, c2 = np.append(codes[1:], tv.U(0)), np.append(codes[2:], [tv.U(0)] * 2)
    two, three = tv.mix(codes * tv.U(1 << 21) + c1), tv.mix((codes * tv.U(1 << 21) + c1) * tv.U(1 << 21) + c2)
    one = tv.mix(codes + tv.U(7 << 40))
    c3 = np.append(codes[3:], [tv.U(0)] * 3)
    four = tv.mix(three * tv.U(31) + c3)
    with np.errstate(over="ignore"):
        total = np.concatenate(([tv.U(0)], np.cumsum(tv.mix(codes + place.astype(tv.U) * tv.U(0x9E3779B97F4A7C15)), dtype=tv.U)))
        whole = tv.mix(total[starts + lengths] - total[starts] + tv.U(3))
    ids, own = [], []
    for kind, (values, where) in enumerate((
        (two, after >= 2), (three, after >= 3),  # letter n-grams; those with an end mark are affixes of 1 and 2
        (four, (place == 0) & (after >= 4)), (four, (after == 4) & (place >= 0)),  # prefix and suffix of 3
        (one, (place > 0) & (after >= 2)),
    )):
        at = np.flatnonzero(where)
        ids.append(tv.mix(values[at] + tv.U(kind + 11)))
        own.append(owner[at])
    ids.append(tv.mix(whole + tv.U(97)))
    own.append(np.arange(len(words)))
    allids, allown = np.concatenate(ids), np.concatenate(own)
    order = np.argsort(allown, kind="stable")
    begins = np.concatenate(([0], np.cumsum(np.bincount(allown, minlength=len(words)))[:-1]))
    return (allids[order] >> tv.U(64 - BITS)).astype(np.int64), begins


def forward_backward(potentials: np.ndarray, transitions: np.ndarray, lengths: np.ndarray, starts: np.ndarray | None = None, ends: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors of chains. potentials: exp emissions (step, chain, label), chains by falling length; transitions: exp,
    (from, to); starts and ends: the messages (chain, label) that reach a chain's first word from before and its last from after, up to a factor. Returns
    (step, chain, label) marginals and the sum of the expected transitions within the chains."""
    steps, chains, labels = potentials.shape
    active = (lengths[None, :] > np.arange(steps)[:, None]).sum(axis=1)
    alpha, scale = np.zeros_like(potentials), np.ones((steps, chains))
    for t in range(steps):
        n = active[t]
        if t:
            a = (alpha[t - 1, :n] @ transitions) * potentials[t, :n]
        else:
            a = potentials[0, :n] if starts is None else starts[:n] * potentials[0, :n]
        scale[t, :n] = a.sum(axis=1)
        alpha[t, :n] = a / scale[t, :n, None]
    beta = np.ones((chains, labels))
    if ends is not None:
        last = alpha[lengths - 1, np.arange(chains)]
        beta = ends / (last * ends).sum(axis=1, keepdims=True)
    marginals, expected = np.zeros_like(potentials), np.zeros((labels, labels))
    for t in range(steps - 1, -1, -1):
        n = active[t]
        marginals[t, :n] = alpha[t, :n] * beta[:n]
        if t:
            ahead = potentials[t, :n] * beta[:n] / scale[t, :n, None]
            expected += transitions * (alpha[t - 1, :n].T @ ahead)
            beta[:n] = ahead @ transitions.T
    return marginals, expected


def chain_products(potentials: np.ndarray, transitions: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Of chains as forward_backward takes them, what (chain, from, to) turns the message that reaches the first word into the one that
    leaves the last, up to a factor."""
    _, chains, labels = potentials.shape
    out = potentials[0][:, :, None] * np.eye(labels)[None]
    for t in range(1, len(potentials)):
        n = int((lengths > t).sum())
        step = (out[:n] @ transitions) * potentials[t, :n, None, :]
        out[:n] = step / step.max(axis=(1, 2), keepdims=True)
    return out


def messages(products: np.ndarray, transitions: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of chains in the order of their texts, of which text gives the number."""
    starts, ends = np.ones(products.shape[:2]), np.ones(products.shape[:2])
    for k in range(1, len(text)):
        if text[k] == text[k - 1]:
            v = (starts[k - 1] @ products[k - 1]) @ transitions
            starts[k] = v / v.sum()
    for k in range(len(text) - 2, -1, -1):
        if text[k] == text[k + 1]:
            v = transitions @ (products[k + 1] @ ends[k + 1])
            ends[k] = v / v.sum()
    return starts, ends


def _coded(text: str, vocabulary: dict[str, int]) -> np.ndarray:
    """The words of a text as numbers; new words are numbered on."""
    return np.fromiter((vocabulary.setdefault(m[0], len(vocabulary)) for m in WORDS.finditer(text.lower())), np.int32)


@dataclass
class Tagger:
    """A trained field: languages, emission weights (feature, language) and transition weights (from, to)."""

    languages: list[str]
    weights: np.ndarray
    moves: np.ndarray
    known: dict[str, int] = field(default_factory=dict, repr=False)
    rows: list[np.ndarray] = field(default_factory=list, repr=False)

    def __getstate__(self) -> dict:
        return {"languages": self.languages, "weights": self.weights, "moves": self.moves, "known": {}, "rows": []}

    @classmethod
    def train(cls, samples: list[tuple[str, str]], seed: int = 7) -> Tagger:
        """samples: (language, text). Deterministic for equal samples in equal order."""
        rng = np.random.default_rng(seed)
        languages = sorted({lang for lang, _ in samples})
        vocabulary: dict[str, int] = {}
        coded = [(languages.index(lang), _coded(text, vocabulary)) for lang, text in samples]
        coded = [(label, c) for label, c in coded if len(c)]
        tagger = cls(languages, np.zeros((1 << BITS, len(languages)), np.float32), np.zeros((len(languages), len(languages))))
        if len(languages) < 2 or not coded:
            return tagger
        known, found, sizes = list(vocabulary), [], []
        for at in range(0, len(known), PART):
            part, first = features(known[at : at + PART])
            found.append(part.astype(np.int32))
            sizes.append(np.diff(np.append(first, len(part))))
        ids, ends = np.concatenate(found), np.cumsum(np.concatenate(sizes))
        begins = np.concatenate(([0], ends[:-1]))
        by_label = [[c for label, c in coded if label == k] for k in range(len(languages))]
        labels_there = [k for k, c in enumerate(by_label) if c]
        m, v = np.zeros_like(tagger.weights), np.zeros_like(tagger.weights)
        mt, vt = np.zeros_like(tagger.moves), np.zeros_like(tagger.moves)
        for step in range(1, STEPS + 1):
            words, truth = np.empty((TRAIN_CHAIN, BATCH), np.int64), np.empty((TRAIN_CHAIN, BATCH), np.int64)
            for b in range(BATCH):
                at = 0
                while at < TRAIN_CHAIN:
                    k = labels_there[rng.integers(len(labels_there))]
                    own = by_label[k][rng.integers(len(by_label[k]))]
                    run = int(rng.geometric(1 / 24))
                    begin = int(rng.integers(max(1, len(own) - run + 1)))
                    piece = own[begin : begin + run][: TRAIN_CHAIN - at]
                    words[at : at + len(piece), b], truth[at : at + len(piece), b] = piece, k
                    at += len(piece)
            kinds, place = np.unique(words, return_inverse=True)
            counts = ends[kinds] - begins[kinds]
            flat = np.repeat(begins[kinds] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())
            used, back = np.unique(ids[flat], return_inverse=True)
            emission = np.add.reduceat(tagger.weights[used][back], np.concatenate(([0], np.cumsum(counts)[:-1])), axis=0)
            scores = emission[place.reshape(words.shape)].astype(np.float64)
            marginals, expected = forward_backward(np.exp(scores - scores.max(axis=2, keepdims=True)), np.exp(tagger.moves), np.full(BATCH, TRAIN_CHAIN))
            slope = -marginals
            np.put_along_axis(slope, truth[:, :, None], np.take_along_axis(slope, truth[:, :, None], 2) + 1, 2)
            by_word = np.zeros((len(kinds), len(languages)))
            np.add.at(by_word, place.ravel(), slope.reshape(-1, len(languages)))
            gradient = np.zeros((len(used), len(languages)))
            np.add.at(gradient, back, np.repeat(by_word, counts, axis=0))
            gradient = gradient / BATCH - DECAY * tagger.weights[used]
            seen = np.zeros_like(tagger.moves)
            np.add.at(seen, (truth[:-1].ravel(), truth[1:].ravel()), 1)
            turn = (seen - expected) / BATCH - DECAY * tagger.moves
            m[used] = 0.9 * m[used] + 0.1 * gradient
            v[used] = 0.99 * v[used] + 0.01 * gradient**2
            mt, vt = 0.9 * mt + 0.1 * turn, 0.99 * vt + 0.01 * turn**2
            size = RATE * (1 - step / (STEPS + 1))
            tagger.weights[used] += size * (m[used] / (1 - 0.9**step)) / (np.sqrt(v[used] / (1 - 0.99**step)) + 1e-8)
            tagger.moves += size * (mt / (1 - 0.9**step)) / (np.sqrt(vt / (1 - 0.99**step)) + 1e-8)
        return tagger

    def emissions(self, words: list[str]) -> np.ndarray:
        """Emission weights (word, language). Distinct words are kept from call to call, up to CACHE of them."""
        if len(self.known) > CACHE:
            self.known, self.rows = {}, []
        new = [w for w in dict.fromkeys(words) if w not in self.known]
        if new:
            base = len(self.known)
            for at in range(0, len(new), PART):
                part = new[at : at + PART]
                ids, begins = features(part)
                self.rows.append(np.add.reduceat(self.weights[ids], begins, axis=0))
            self.known.update(zip(new, range(base, base + len(new)), strict=True))
            self.rows = [np.concatenate(self.rows)]
        return self.rows[0][np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))]

    def posteriors(self, texts: list[list[str]]) -> list[np.ndarray]:
        """For each text, given as its lower-cased words, the posteriors (word, language)."""
        counts = np.array([len(w) for w in texts], np.int64)
        words = [w for own in texts for w in own]
        out = np.empty((len(words), len(self.languages)))
        if len(words) and len(self.languages) > 1:
            scores = self.emissions(words).astype(np.float64)
            potentials = np.exp(scores - scores.max(axis=1, keepdims=True))
            chains, moves = -(-counts // CHAIN), np.exp(self.moves)
            owner = np.repeat(np.arange(len(texts)), chains)
            number = np.arange(len(owner)) - np.repeat(np.cumsum(chains) - chains, chains)
            begin = (np.cumsum(counts) - counts)[owner] + number * CHAIN
            length = np.minimum(CHAIN, counts[owner] - number * CHAIN)
            starts = ends = np.ones((len(owner), len(self.languages)))
            cut = np.flatnonzero(chains[owner] > 1)
            if len(cut):
                products = np.empty((len(cut), len(self.languages), len(self.languages)))
                for part, at, size in _groups(begin[cut], length[cut], GROUP):
                    products[part] = chain_products(potentials[at], moves, size)
                starts, ends = starts.copy(), starts.copy()
                starts[cut], ends[cut] = messages(products, moves, owner[cut])
            for part, at, size in _groups(begin, length, GROUP):
                marginals, _ = forward_backward(potentials[at], moves, size, starts[part], ends[part])
                there = np.arange(len(at))[:, None] < size[None, :]
                out[at[there]] = marginals[there]
        else:
            out[:] = 1.0
        return np.split(out, np.cumsum(counts)[:-1]) if len(texts) else []

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        words = [WORDS.findall((t or "").lower()) for t in texts]
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        mean = [p.mean(axis=0) if len(p) else None for p in self.posteriors(words)]
        mean = [p if p is not None and any(c.isalpha() for w in t for c in w) else None for p, t in zip(mean, texts, strict=True)]
        best = [UNKNOWN if p is None else self.languages[int(p.argmax())] for p in mean]
        return best, np.array([0.0 if p is None else min(1.0, float(p.max())) for p in mean])


def _groups(begin: np.ndarray, length: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Chains by falling length, `size` at a time: which, the places (step, chain) of their words, and their lengths."""
    order = np.argsort(-length, kind="stable")
    for a in range(0, len(order), size):
        part = order[a : a + size]
        steps = np.arange(length[part[0]])[:, None]
        yield part, begin[part] + np.minimum(steps, length[part] - 1), length[part]


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in tv.chunks(batches):
        words = [" ".join(WORDS.findall(t.lower())) for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(words, pa.string())], names=["label", "draw", "text"])


def train_tagger(texts: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", rows: int = SAMPLE_ROWS) -> Tagger:
    """A tagger from a bounded sample of the rows outside the held-out fold that have a label."""
    usable = texts.select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(text).alias("text")).filter(~held_out(F.col("id")) & F.col("id").isNotNull() & F.col("label").isNotNull())
    counts = usable.groupBy("label").agg(F.count("*").alias("count"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).collect()
    draw = F.pmod(F.xxhash64("id", "text", F.lit(11)), F.lit(DRAWS))
    if not counts:
        return Tagger.train([])
    rows = max(1, min(rows, TOTAL_ROWS // len(counts)))
    below = []
    for r in counts:
        own = max(1, min(rows, int(TOTAL_BYTES / len(counts) * r["count"] / max(1, r["bytes"]))))
        drawn = max(1.3 * own, own + 5 * math.sqrt(own) + 10)  # on average, so that hardly ever fewer than own are
        below.append((r["label"], int(min(1.0, drawn / r["count"]) * DRAWS), own))
    cuts = F.broadcast(texts.sparkSession.createDataFrame(below, "label string, below long, rows int"))
    some = usable.join(cuts, "label").filter((draw < F.col("below")) & F.col("text").isNotNull())
    first = Window.partitionBy("label").orderBy("draw", "text")
    words = some.select("label", draw.alias("draw"), "text").mapInArrow(_sampled, "label string, draw long, text string").dropDuplicates(["label", "draw"])  # equal rows once
    found = words.withColumn("place", F.row_number().over(first)).join(cuts, "label").filter(F.col("place") <= F.col("rows")).select("label", "draw", "text").collect()
    found.sort(key=lambda r: (r["label"], r["draw"], r["text"]))
    return Tagger.train([(r["label"], r["text"]) for r in found])


def _predictor(tagger: Tagger) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in tv.chunks(batches):
            best, score = tagger.predict(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.string()), pa.array(score)], names=["id", "lang_pred", "score"])

    return run


def identify(texts: DataFrame, tagger: Tagger, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: the key, lang_pred and score."""
    kind = texts.schema[key].dataType.simpleString()
    done = texts.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(_predictor(tagger), f"id {kind}, lang_pred string, score double")
    return done.withColumnRenamed("id", key)


def label_words(tagger: Tagger, text: str | None) -> list[tuple[int, int, str, float]]:
    """The words of one text as (start, end, language, posterior)."""
    found = list(WORDS.finditer(text or ""))
    if not found or not tagger.languages:
        return []
    p = tagger.posteriors([[m[0].lower() for m in found]])[0]
    return [(m.start(), m.end(), tagger.languages[int(x.argmax())], float(x.max())) for m, x in zip(found, p, strict=True)]


def identified(texts: DataFrame, tagger: Tagger, text: str = "text", least: float = MIN_SCORE) -> DataFrame:
    """The rows, all columns, whose language is known with a score of at least `least`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, own in tv.chunks(batches, text):
            best, score = tagger.predict(own)
            yield batch.filter(pa.array([b != UNKNOWN and s >= least for b, s in zip(best, score, strict=True)], pa.bool_()))

    return texts.mapInArrow(run, texts.schema)

"""Quality scores by positive-unlabelled learning with the non-negative unbiased risk.

Trusted positives are rows labelled 1 outside the held-out fold; the unlabelled set is drawn from all texts outside it.
Labels of 0 are never read. The class prior, the share of positives among the unlabelled texts, is estimated from scores by which a first
classifier tells positives from unlabelled texts, each score from a classifier that did not see the row (PRIOR_FOLDS folds). Of the rows above a cut on
these scores the unlabelled ones hold at least the prior times the positives' share, and no more where only positives are; the prior is the least ratio of the two
shares, at the cut whose upper confidence bound on it is the least. The second classifier, one hidden layer, minimises

    prior * E_P[l(f)] + max(0, E_U[l(-f)] - prior * E_P[l(-f)])

with the logistic loss l; where the bracket is negative, its gradient is followed upwards instead, so that it
stops fitting single unlabelled texts. The score is the logistic function of f, an estimate of the
probability that the label is 1, averaged over MODELS classifiers that start from different weights.

Features of a whole text (no label, language, source or id): square roots of the relative frequencies of pairs of
neighbouring character classes, of word lengths, shares of distinct words, word pairs and lines, of the most
frequent word and of words that repeat the one before, and logarithms of sizes.

Training data: at most POSITIVE_ROWS positives, one text of each id, and UNLABELLED_ROWS unlabelled texts (by a hash of id and text, equal
rows once, so that an id with a third of all rows has its share and no more; as features, so their size does not depend on the texts) are
collected. Every text is scored whole.

Defined cases: a null text counts as empty and is scored; with no positives or no unlabelled texts every score is the
prior 0.5; ids with several labels count as positive if any label is 1; texts with equal features score equally; a very long text is scored whole;
repeated rows and rows with a null id give
one row each; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilmark.llm import textvec as tv
from tilmark.llm.language_id import held_out

FOLDS, FOLD = 4, 2
POSITIVE_ROWS, UNLABELLED_ROWS = 2000, 6000
DRAWS = 1 << 62
HIDDEN, STEPS, BATCH, RATE, DECAY, MODELS = 16, 800, 256, 0.01, 1e-3, 5
PRIOR_FOLDS, PRIOR_STEPS = 5, 100
PRIOR_MISS, PRIOR_SLACK = 0.1, 0.01
CUT = 0.7

# Character classes by byte: control, blank, line end, digit, upper, lower, non-ASCII, sentence marks, quotes and
# brackets, dashes and slashes, and one class for each mark that layout and noise repeat.
_CLASSES = 18
_CLASS = np.zeros(256, np.int64)
for _c in range(256):
    ch = chr(_c)
    _CLASS[_c] = (
        6 if _c >= 128
        else 2 if ch == "\n"
        else 1 if ch in " \t"
        else 3 if ch.isdigit()
        else 4 if ch.isupper()
        else 5 if ch.islower()
        else 7 if ch in ".,;:?"
        else 8 if ch in "\"'()[]{}<>"
        else 9 if ch in "-_/\\"
        else 10 + "!|#$%&*".index(ch) if ch in "!|#$%&*"
        else 17 if ch in "@+=^~`"
        else 0
    )
_LENGTHS = 16
WIDTH = _CLASSES * _CLASSES + _LENGTHS + 8


def features(text: str | None) -> np.ndarray:
    raw = (text or "").encode("utf-8", "replace")
    out = np.zeros(WIDTH, np.float32)
    if not raw:
        return out
    data = np.frombuffer(raw, np.uint8)
    kinds = _CLASS[data]
    pairs = np.bincount(kinds[:-1] * _CLASSES + kinds[1:], minlength=_CLASSES * _CLASSES) if len(kinds) > 1 else np.zeros(_CLASSES * _CLASSES)
    out[: _CLASSES * _CLASSES] = np.sqrt(pairs / max(1, len(kinds) - 1))
    inside = np.concatenate(([0], ((kinds != 1) & (kinds != 2)).astype(np.int8), [0]))
    turns = np.diff(inside)
    starts, ends = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)
    base = _CLASSES * _CLASSES
    if len(starts):
        lengths = np.minimum(ends - starts, _LENGTHS) - 1
        out[base : base + _LENGTHS] = np.sqrt(np.bincount(lengths, minlength=_LENGTHS) / len(lengths))
    lines = raw.split(b"\n")
    words = raw.split()
    pairs = list(zip(words, words[1:], strict=False))
    times = Counter(words)
    out[base + _LENGTHS :] = (
        len(times) / max(1, len(words)),
        sum(a == b for a, b in pairs) / max(1, len(pairs)),
        len(set(pairs)) / max(1, len(pairs)),
        max(times.values(), default=0) / max(1, len(words)),
        len(set(lines)) / len(lines),
        np.log1p(len(words)) / 8,
        np.log1p(len(words) / len(lines)) / 8,
        1.0,
    )
    return out


@dataclass
class Scorer:
    mean: np.ndarray
    scale: np.ndarray
    models: list[list[np.ndarray]]
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.models:
            return np.full(len(x), self.prior)
        scaled = (x - self.mean) / self.scale
        return np.mean([_logistic(_forward(layers, scaled)[0]) for layers in self.models], axis=0)


def _logistic(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(np.clip(z, -60, 60) / 2))


def _forward(layers: list[np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w, b, u, c = layers
    h = np.tanh(x @ w + b)
    return h @ u + c[0], h


def _fit(p: np.ndarray, u: np.ndarray, slope: Callable, steps: int, seed: int) -> list[np.ndarray]:
    """Adam on minibatches of both sets; slope gives the risk's derivatives by the outputs on each."""
    rng = np.random.default_rng(seed)
    width = p.shape[1]
    layers = [rng.normal(0, 1 / np.sqrt(width), (width, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.3, HIDDEN), np.zeros(1)]
    m, v = [np.zeros_like(a) for a in layers], [np.zeros_like(a) for a in layers]
    for step in range(1, steps + 1):
        x = np.concatenate((p[rng.integers(len(p), size=BATCH)], u[rng.integers(len(u), size=2 * BATCH)]))
        f, h = _forward(layers, x)
        d = np.concatenate(slope(f[:BATCH], f[BATCH:]))
        back = d[:, None] * layers[2] * (1 - h**2)
        gradients = [x.T @ back + DECAY * layers[0], back.sum(0), h.T @ d + DECAY * layers[2], np.array([d.sum()])]
        size = RATE * (1 - step / (steps + 1))
        for k, g in enumerate(gradients):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            layers[k] = layers[k] - size * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return layers


def _apart(fp: np.ndarray, fu: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Derivatives of the logistic loss that tells positives from unlabelled texts."""
    return -_logistic(-fp) / len(fp), _logistic(fu) / len(fu)


def estimate_prior(p: np.ndarray, u: np.ndarray, seed: int = 5) -> float:
    """The share of positives in u, by the least ratio of the shares of u and p above a cut on cross-fitted scores."""
    folds = min(PRIOR_FOLDS, len(p), len(u))
    if folds < 2:
        return 0.5
    rng = np.random.default_rng(seed)
    own_p, own_u = rng.permutation(len(p)) % folds, rng.permutation(len(u)) % folds
    sp, su = np.empty(len(p)), np.empty(len(u))
    for k in range(folds):
        layers = _fit(p[own_p != k], u[own_u != k], _apart, PRIOR_STEPS, seed + k)
        sp[own_p == k], su[own_u == k] = _forward(layers, p[own_p == k])[0], _forward(layers, u[own_u == k])[0]
    cuts = np.sort(sp)
    above_p = 1 - np.searchsorted(cuts, cuts, "left") / len(p)
    above_u = 1 - np.searchsorted(np.sort(su), cuts, "left") / len(u)
    width = (1 + PRIOR_SLACK) * sum(np.sqrt(np.log(4 / PRIOR_MISS) / (2 * n)) for n in (len(p), len(u)))
    at = np.argmin((above_u + width) / above_p)
    return float(np.clip(above_u[at] / above_p[at], 0.05, 0.95))


def risk_slope(fp: np.ndarray, fu: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Derivatives of the risk by the outputs on positives and on unlabelled texts. Where the bracket of the risk is negative, those of its opposite
    alone."""
    negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
    bent = prior * _logistic(fp) / len(fp)
    if negative < 0:
        return bent, -_logistic(fu) / len(fu)
    return -prior * _logistic(-fp) / len(fp) - bent, _logistic(fu) / len(fu)


def train_scorer(p: np.ndarray, u: np.ndarray, prior: float | None = None, seed: int = 3) -> Scorer:
    """A scorer from features of positives and of unlabelled texts, and their class prior if it is known."""
    if not len(p) or not len(u):
        return Scorer(np.zeros(WIDTH), np.ones(WIDTH), [], 0.5)
    mean, scale = u.mean(axis=0), u.std(axis=0) + 0.02
    p, u = (p - mean) / scale, (u - mean) / scale
    prior = prior or estimate_prior(p, u)

    return Scorer(mean, scale, [_fit(p, u, lambda fp, fu: risk_slope(fp, fu, prior), STEPS, seed + k) for k in range(MODELS)], prior)


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in tv.chunks(batches):
        rows = [features(t).tobytes() for t in texts]
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(rows, pa.binary())], names=["positive", "plain", "one", "draw", "x"])


def train_on(texts: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> Scorer:
    """A scorer from bounded samples of the rows outside the held-out fold."""
    draw = lambda seed, *columns: F.pmod(F.xxhash64(*columns, F.lit(seed)), F.lit(DRAWS))
    open_rows = lambda frame: frame.filter(F.col("id").isNotNull() & ~held_out(F.col("id"), FOLDS, FOLD))
    own = open_rows(texts.select(F.col(key).alias("id"), F.col(text).alias("text")))
    good = open_rows(labels.select(F.col(key).alias("id"), F.col(label).alias("label"))).filter("label = 1").select("id").distinct()
    n_good, n_own = good.count(), own.select("id").count()
    part = lambda want, there: int(min(1.0, 1.2 * want / max(1, there)) * DRAWS)
    chosen = F.broadcast(good.filter(draw(1, "id") < part(POSITIVE_ROWS, n_good)).withColumn("positive", F.lit(True)))  # at most about 1.2 * POSITIVE_ROWS ids
    plain = draw(2, "id", "text") < part(UNLABELLED_ROWS, n_own)
    wanted = own.join(chosen, "id", "left").select(F.coalesce("positive", F.lit(False)).alias("positive"), plain.alias("plain"), F.xxhash64("id").alias("one"), F.xxhash64("id", "text", F.lit(3)).alias("draw"), "text")
    found = wanted.filter("positive or plain").mapInArrow(_featurise, "positive boolean, plain boolean, one long, draw long, x binary")
    kind = lambda name, group: F.struct(F.col(name).alias("held"), F.lit(name).alias("kind"), F.col(group).alias("group"))
    kinds = F.filter(F.array(kind("positive", "one"), kind("plain", "draw")), lambda k: k["held"])
    grouped = found.select(F.explode(kinds).alias("k"), F.struct("draw", "x").alias("row")).groupBy("k.kind", "k.group").agg(F.min("row").alias("row"))
    rows = grouped.select("kind", "row.draw", "row.x").orderBy("draw").limit(2 * (POSITIVE_ROWS + UNLABELLED_ROWS)).collect()
    rows.sort(key=lambda r: (r["draw"], bytes(r["x"])))
    array = lambda name, most: np.array([np.frombuffer(r["x"], np.float32) for r in rows if r["kind"] == name][:most], np.float64).reshape(-1, WIDTH)
    return train_scorer(array("positive", POSITIVE_ROWS), array("plain", UNLABELLED_ROWS))


def score_texts(texts: DataFrame, scorer: Scorer, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: the key and the score of its text."""
    kind = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, own in tv.chunks(batches):
            x = np.array([features(t) for t in own], np.float64).reshape(-1, WIDTH)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scorer.scores(x))], names=["id", "score"])

    return texts.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", key)

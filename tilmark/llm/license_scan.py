"""License scan: exact set-containment join of text blocks with license templates.

Words are runs of ``[0-9a-z]`` and non-ASCII characters after A-Z are lower-cased. Two results per text:

* base: every place where a phrase's words stand consecutively;
* method: blocks of words over the whole text, joined with the templates. A template of m words is held against blocks of twice
  `step` words, one every `step` words, with the smallest step of BLOCK_STEP, 2 * BLOCK_STEP, 4 * BLOCK_STEP, ... that is at least m: wherever
  its m words stand in a row, a block holds them all, whatever m is. A block matches when it holds at least THRESHOLD of a
  template's distinct words. Tokens are ordered by their frequency over all texts (rarest first). With need = ceil(THRESHOLD * size), a match
  must share one of a template's size - need + 1 rarest words (prefix filter), must hold need template
  words (length filter), and its first shared word must leave enough words after it on both sides
  (position filter). What passes is verified by its exact overlap.

Templates are a stated query set: they travel as literals, GROUP_TEMPLATES at a time (all groups in the same pass over the texts), each with an inverted
index from token rank to templates; texts are never shuffled and each row is handled where it is read.

Defined cases: a null text counts as empty; an empty text has no words, no labels and score 0; a text of any length is scanned whole; of several
matches of a template all are given, and labels are sorted, so that ties do not matter; a template without a word matches nothing; repeated
rows and rows with a null doc_id each give one row; extra input columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrases of the base rule and their labels.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

#: Customary notice wordings and the label of each.
TEMPLATES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("to the extent possible under law the author has waived all copyright", "cc0"),
    ("proprietary and confidential unauthorized copying of this file is strictly prohibited", "proprietary"),
    ("all rights reserved", "all-rights-reserved"),
)

THRESHOLD = 0.9
BLOCK_STEP = 32
GROUP_TEMPLATES = 4096
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD, SEPARATORS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def split_words(text: Column) -> Column:
    """The words of a text between separators, with an empty word where a text begins or ends with a separator."""
    return F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS)


def trimmed(words: Column) -> Column:
    """Split words without the empty ones at the ends."""
    begins, ends = (F.get(words, F.lit(0)) == "").cast("int"), ((F.size(words) > 1) & (F.element_at(words, -1) == "")).cast("int")
    return F.slice(words, begins + 1, F.size(words) - begins - ends)


def token_counts(texts: DataFrame, tokens: Sequence[str], text: str = "text") -> dict[str, int]:
    """How often each of the given tokens stands in all texts. The result has at most len(tokens) rows."""
    if not tokens:
        return {}
    counted = (
        texts.select(split_words(F.col(text)).alias("w"))
        .select(F.explode(F.filter("w", lambda w: w.isin(list(tokens)))).alias("token"))
        .groupBy("token")
        .count()
    )
    found = {r["token"]: r["count"] for r in counted.collect()}
    return {t: found.get(t, 0) for t in tokens}


def _ints(values: Sequence[int]) -> Column:
    return F.array(*[F.lit(int(v)) for v in values]).cast("array<int>")


def step_of(template: str) -> int:
    """Words between the blocks that a template is held against; blocks are twice as long."""
    step = BLOCK_STEP
    while step < len(template.split()):
        step *= 2
    return step


def template_groups(templates: Sequence[tuple[str, str]]) -> list[tuple[int, list[tuple[list[str], str]]]]:
    """(step, sorted distinct words and label of each template) for at most GROUP_TEMPLATES templates of one step."""
    by_step: dict[int, list] = {}
    for t, label in templates:
        if t.split():
            by_step.setdefault(step_of(t), []).append((sorted(set(t.split())), label))
    return [(step, own[a : a + GROUP_TEMPLATES]) for step, own in sorted(by_step.items()) for a in range(0, len(own), GROUP_TEMPLATES)]


class Matcher:
    """Expressions that find the templates of one group. rank numbers all template words, rarest first."""

    def __init__(self, step: int, sets: list[tuple[list[str], str]], rank: dict[str, int], threshold: float):
        self.step = step
        words = sorted({w for t, _ in sets for w in t}, key=rank.__getitem__)
        own = {w: i + 1 for i, w in enumerate(words)}
        rows, holders = [], [[] for _ in words]
        for number, (tokens, label) in enumerate(sets):
            ranks = sorted(own[w] for w in tokens)
            need = math.ceil(threshold * len(ranks) - 1e-9)
            prefix = ranks[: len(ranks) - need + 1]
            for r in prefix:
                holders[r - 1].append(number)
            rows.append(F.struct(F.lit(label).alias("label"), _ints(ranks).alias("ranks"), _ints(prefix).alias("prefix"), F.lit(need).alias("need")))
        self.known, self.index, self.vocabulary = F.array(*rows), F.array(*[_ints(x) for x in holders]), F.lit(words)
        self.seeds = [w for w, h in zip(words, holders, strict=True) if h]

    def blocks(self, w: Column, n: Column) -> Column:
        """(start, sorted ranks) of the blocks with a word of any prefix."""
        step = self.step
        hit = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, i).isin(self.seeds))
        numbers = F.array_distinct(F.flatten(F.transform(hit, lambda i: F.array(F.floor(i / step).cast("int") - 1, F.floor(i / step).cast("int")))))
        rank = lambda x: F.array_position(self.vocabulary, x).cast("int")
        return F.transform(
            F.filter(numbers, lambda b: b >= 0),
            lambda b: F.struct(
                (b * step).alias("start"),
                F.array_sort(F.array_distinct(F.filter(F.transform(F.slice(w, b * step + 1, 2 * step), rank), lambda r: r > 0))).alias("ranks"),
            ),
        )

    def verified(self, block: Column) -> Column:
        """(start, words, label, containment) of the templates that a block holds."""
        known = lambda number: F.get(self.known, number)
        candidates = F.array_distinct(F.flatten(F.transform(block["ranks"], lambda r: F.get(self.index, r - 1))))
        common = lambda t: F.size(F.array_intersect(block["ranks"], t["ranks"]))

        def passes(number: Column) -> Column:
            t = known(number)
            first = F.get(F.array_intersect(block["ranks"], t["prefix"]), F.lit(0))
            after = F.least(F.size(t["ranks"]) - F.array_position(t["ranks"], first), F.size(block["ranks"]) - F.array_position(block["ranks"], first))
            return (F.size(block["ranks"]) >= t["need"]) & (after + 1 >= t["need"]) & (common(t) >= t["need"])

        return F.transform(
            F.filter(candidates, passes),
            lambda number: F.struct(
                block["start"].alias("start"), F.lit(2 * self.step).alias("words"), known(number)["label"].alias("label"), (common(known(number)) / F.size(known(number)["ranks"])).alias("containment")
            ),
        )


def license_scan(
    texts: DataFrame,
    keys: Sequence[str] = ("doc_id",),
    text: str = "text",
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    phrases: Sequence[tuple[str, str]] = PHRASES,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per input row: keys, n_words, places (start, label of each base place), matches (block start and words,
    label and containment of each matching block and template)."""
    groups = template_groups(templates)
    counts = token_counts(texts, sorted({w for _, sets in groups for t, _ in sets for w in t}), text)
    rank = {w: i for i, w in enumerate(sorted(counts, key=lambda w: (counts[w], w)))}
    matchers = [Matcher(step, sets, rank, threshold) for step, sets in groups]
    split = [(p.split(), label) for p, label in phrases]
    gate = sorted({*(w for m in matchers for w in m.seeds), *(min(p, key=lambda w: (counts.get(w, 0), w)) for p, _ in split)})

    def places(w: Column, n: Column) -> Column:
        def of(p: list[str], label: str) -> Column:
            starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: _all([F.get(w, i + k) == t for k, t in enumerate(p)]))
            return F.transform(starts, lambda i: F.struct(i.alias("start"), F.lit(label).alias("label")))

        at = [of(p, label) for p, label in split]
        return F.concat(*at)

    no_places = F.array().cast("array<struct<start:int,label:string>>")
    no_blocks = F.array().cast("array<struct<start:int,ranks:array<int>>>")
    no_matches = F.array().cast("array<struct<start:int,words:int,label:string,containment:double>>")
    w, n = F.col("__w"), F.col("n_words")
    split_up = texts.select(*[F.col(k) for k in keys], split_words(F.col(text)).alias("__s")).select(*keys, trimmed(F.col("__s")).alias("__w"))
    gated = split_up.select(*keys, "__w", F.size("__w").alias("n_words"), F.arrays_overlap("__w", F.lit(gate)).alias("__gate"))
    found = gated.select(
        *keys,
        n.cast("long").alias("n_words"),
        F.when(F.col("__gate"), places(w, n)).otherwise(no_places).alias("places"),
        *[F.when(F.col("__gate"), m.blocks(w, n)).otherwise(no_blocks).alias(f"__blocks{k}") for k, m in enumerate(matchers)],
    )
    matches = [F.flatten(F.transform(f"__blocks{k}", m.verified)) for k, m in enumerate(matchers)]
    return found.select(*keys, "n_words", "places", F.concat(*matches, no_matches).alias("matches"))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out

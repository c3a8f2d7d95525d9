"""Properties on drawn inputs, without Spark."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tilmark.llm import mixing as mx
from tilmark.llm import near_dedup as nd
from tilmark.llm import secret_scan as ss
from tilmark.llm import sharding as sh
from tilmark.llm import textvec as tv
from tilmark.llm import token_scan as ts

plain = st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=60)


@given(st.lists(st.none() | plain, max_size=8))
def test_words_of_any_text(texts):
    hashes, at = tv.word_hashes(texts)
    words = [tv.WORD.findall((t or "").lower()) for t in texts]
    assert np.diff(at).tolist() == [len(w) for w in words]
    names = {}
    for h, w in zip(hashes.tolist(), (w for own in words for w in own), strict=True):
        assert names.setdefault(w, h) == h
    assert len(set(names.values())) == len(names)


@given(st.lists(st.integers(0, 5), max_size=30), st.lists(st.integers(0, 5), max_size=30))
def test_overlap_of_bags(a, b):
    x, y = (np.sort(np.array(v, np.uint64)) for v in (a, b))
    assert nd.overlap(x, y) == (Counter(a) & Counter(b)).total()


@given(st.text(alphabet="aAfF019 =:\"'kiKIpPsStTeoOnNwWrdDc_-\n", max_size=200))
def test_base_spans_of_any_text(text):
    want = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[1]) >= 12]
    want += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    want += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    assert sorted(ss.base_spans(text)) == sorted(want)
    ends = [(a, b) for a, _, b, _ in ss.literal_spans(text)]
    assert all(0 <= a < b <= len(text) for a, b in ends)


@given(st.lists(st.integers(0, 10**6), min_size=1, max_size=30))
def test_targets_share_all_words(sizes):
    weights = [1 + i % 3 for i in range(len(sizes))]
    goals = mx.targets(sizes, weights)
    assert all(0 <= g <= 3 * s for g, s in zip(goals, sizes, strict=True))
    assert abs(sum(goals) - sum(sizes)) <= 1e-6 * max(1, sum(sizes))
    free = [g / w for g, s, w in zip(goals, sizes, weights, strict=True) if g < 3 * s]
    assert not free or max(free) - min(free) <= 1e-6 * max(free)


@settings(deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=64, max_size=64), st.integers(1, 9))
def test_rebalancing_never_widens_the_gap(sizes, shards):
    slots = sh.SlotMap.even(shards, 64)
    total = lambda m: [sum(s for s, j in zip(sizes, m.shard_of, strict=True) if j == k) for k in range(shards)]
    before = total(slots)
    after = total(slots.rebalance(sizes, shards))
    assert sum(after) == sum(before)
    assert max(after) - min(after) <= max(before) - min(before)


@given(st.lists(st.sampled_from([1, 2, ts.EOD]), max_size=50))
def test_scanned_blocks(ids):
    size, seps = ts.scan_block(np.array(ids, ts.TOKEN).tobytes(), ts.EOD)
    assert (size, seps) == (len(ids), [i for i, x in enumerate(ids) if x == ts.EOD])

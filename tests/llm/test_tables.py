"""Mixing, sharding, embeddings and the pipeline against brute force."""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tilmark.llm import decontaminate as dc
from tilmark.llm import embedding_dedup as ed
from tilmark.llm import graph
from tilmark.llm import mixing as mx
from tilmark.llm import queries as q
from tilmark.llm import sharding as sh
from tilmark.llm import textvec as tv

SMALL = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


def test_targets():
    assert mx.targets([100, 100, 100], [1, 2, 3]) == [50.0, 100.0, 150.0]
    assert mx.targets([10, 1000, 10], [1, 1, 1]) == [30.0, 960.0, 30.0]
    assert mx.targets([0, 0], [1, 2]) == [0.0, 0.0]
    assert mx.targets([], []) == []
    rng = np.random.default_rng(0)
    for _ in range(100):
        sizes = rng.integers(0, 1000, rng.integers(1, 12)).tolist()
        weights = [1 + i % 3 for i in range(len(sizes))]
        goal, open_, rest = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
        while open_ and rest > 1e-9:
            level = rest / sum(weights[i] for i in open_)
            full = {i for i in open_ if weights[i] * level >= 3 * sizes[i]}
            for i in full or open_:
                goal[i] = 3.0 * sizes[i] if full else weights[i] * level
                rest -= goal[i]
            open_ -= full or open_
        assert np.allclose(mx.targets(sizes, weights), goal)


def test_quotas():
    quotas = [1000, 10, 0, 377, 5]
    split = mx.split_quotas(quotas, 8)
    assert split.sum(axis=1).tolist() == quotas
    assert np.ptp(split.sum(axis=0)) <= 1
    assert (split >= 0).all()
    assert np.array_equal(split, mx.split_quotas(quotas, 8))
    mean = np.mean([mx.split_quotas([60, 20], 4, seed)[0] for seed in range(300)], axis=0)
    assert np.allclose(mean, 15, atol=0.5)


def test_draws_of_any_size():
    for own, everything, wanted in ((5, 12, 4), (1, 3, 3), (7, 7, 3), (30, 90, 45)):
        from math import comb

        chance = [comb(own, k) * comb(everything - own, wanted - k) / comb(everything, wanted) if wanted - k <= everything - own else 0.0 for k in range(min(own, wanted) + 1)]
        upto = np.cumsum(chance)
        for u in np.random.default_rng(1).random(200):
            assert mx.hypergeometric(float(u), own, everything, wanted) == int(np.count_nonzero(upto < u))
    big = [3 * 16**5 * 400 + i for i in range(50)]
    split = mx.split_quotas(big, 8)
    assert split.sum(axis=1).tolist() == big
    assert np.ptp(split.sum(axis=0)) <= 1


def brute_mix(rows, shards, seed):
    """(taken words by shard of each row, in order): a stream of blocks for every source, cut by the tree's quotas."""
    keys = [hashlib.md5(f"{i}:{hashlib.md5(t.encode()).hexdigest()}".encode()).hexdigest() for i, t, _ in rows]
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t)) for _, t, _ in rows]
    sources = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
    own = {s: [k for k, r in enumerate(rows) if r[2] == s] for s in sources}
    totals = [sum(size[k] for k in own[s]) for s in sources]
    goals = mx.targets(totals, [mx.WEIGHTS[i % 3] for i in range(len(sources))])
    streams, quotas = [], []
    for s, total, goal in zip(sources, totals, goals, strict=True):
        digits = next(d for d in range(6) if d == 5 or mx.BLOCK_ROWS * 16**d >= len(own[s]))
        blocks = [[] for _ in range(16**digits)]
        for k in sorted(own[s], key=lambda k: keys[k]):
            blocks[int(keys[k][:digits] or "0", 16)].append(k)
        left, stream = int(np.floor(goal + 0.5)), []
        while left > 0 and total:
            stream.append([])
            for k in blocks[(len(stream) - 1) % len(blocks)]:
                stream[-1].append((k, min(size[k], left)))
                left -= stream[-1][-1][1]
        streams.append(stream)
        quotas.append(len(stream))
    split = mx.split_quotas(quotas, shards, seed)
    taken = [[0] * shards for _ in rows]
    for stream, counts in zip(streams, split.tolist(), strict=True):
        place = 0
        for j, n in enumerate(counts):
            for block in stream[place : place + n]:
                for k, words in block:
                    taken[k][j] += words
            place += n
    return taken


@pytest.mark.parametrize("seed", [mx.SEED, 5])
def test_shards_draw_by_the_tree(spark, seed):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join("w" * int(rng.integers(1, 5)) for _ in range(int(rng.integers(0, 60)))), None if i % 9 == 0 else "hot" if i % 3 else f"s{i % 5}") for i in range(900)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in mx.mix_words(frame, seed=seed).collect()}
    want = brute_mix(rows, 8, seed)
    assert [got[i]["by_shard"] for i in range(900)] == want
    assert all(r["taken"] == sum(r["by_shard"]) for r in got.values())


def test_nothing_is_taken_without_the_tree(spark, monkeypatch):
    rows = [(i, "some words of a text", f"s{i % 3}") for i in range(200)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    one = {r["doc_id"]: r["by_shard"] for r in mx.mix_words(frame).collect()}
    other = {r["doc_id"]: r["by_shard"] for r in mx.mix_words(frame, seed=1).collect()}
    assert one != other
    monkeypatch.setattr(mx, "split_quotas", lambda quotas, shards, seed: np.zeros((len(quotas), shards), np.int64))
    assert all(r["taken"] == 0 for r in mx.mix_words(frame).collect())
    assert mx.mix_documents(frame).collect() == []


def test_documents_lie_by_shard_in_local_order(spark, monkeypatch):
    monkeypatch.setattr(mx, "part_bytes", lambda spark: 1000)
    rows = [(i, " ".join(["w"] * (i % 30)), f"s{i % 4}", "clash") for i in range(800)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, __size string")
    drawn = mx.mix_documents(frame)
    assert drawn.columns == ["doc_id", "text", "source", "__size", "mix_shard", "mix_order"]
    by_part: dict = {}
    for r in drawn.selectExpr("*", "spark_partition_id() p").collect():
        by_part.setdefault(r["p"], []).append((r["mix_shard"], r["mix_order"]))
        assert r["__size"] == "clash"
    assert all(own == sorted(own) for own in by_part.values())
    assert len(by_part) > 8
    spans = sorted((own[0], own[-1]) for part in by_part.values() for own in [[x for x in part if x[0] == j] for j in {s for s, _ in part}])
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_mix_takes_each_target(spark):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join("w" * int(rng.integers(1, 5)) for _ in range(int(rng.integers(0, 60)))), None if i % 9 == 0 else "hot" if i % 3 else f"s{i % 5}") for i in range(900)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = {r["doc_id"]: r for r in mx.mix_words(frame).collect()}
    assert got == {r["doc_id"]: r for r in mx.mix_words(frame.repartition(5)).collect()}
    taken, target = Counter(), {}
    for i, text, source in rows:
        r = got[i]
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", text))
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[source] += r["taken"]
        target[source] = r["target"]
    for source, goal in target.items():
        assert abs(taken[source] - goal) <= 0.5 + 1e-6
    drawn = mx.mix_documents(frame).collect()
    times = Counter(r["doc_id"] for r in drawn)
    assert all(abs(times[i] - got[i]["taken"] / got[i]["size"]) <= 0.5 for i in got if got[i]["size"])
    assert {r["mix_shard"] for r in drawn} <= set(range(8))


@needs_tables
def test_shards_are_even(spark):
    rows = q.op9_shards(spark, SMALL).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    size, places = Counter(), {}
    for r in rows:
        text = docs[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(text) + 1, zlib.crc32(text))
        size[r["shard"]] += r["size"]
        places.setdefault(r["shard"], []).append(r["slot"])
    assert sorted(places) == list(range(8))
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert max(size.values()) - min(size.values()) < 0.05 * sum(size.values()) / 8


def brute_shards(sizes, shard_of, shards):
    """Greedy moves of slots, as stated for SlotMap.rebalance, by plain search."""
    shard_of = list(shard_of)
    while True:
        total = [sum(s for s, j in zip(sizes, shard_of, strict=True) if j == k) for k in range(shards)]
        most, least = total.index(max(total)), total.index(min(total))
        gap = total[most] - total[least]
        moves = [(abs(gap - 2 * s), slot) for slot, s in enumerate(sizes) if shard_of[slot] == most and 0 < s < gap]
        if not moves:
            return shard_of
        shard_of[min(moves)[1]] = least


def test_slots_and_shards_recomputed(spark):
    rows = [(i, "t" * (i * 37 % 400)) for i in range(500)] + [(None, None), (7, "again"), (7, "again")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    slots = {(r["doc_id"], r["size"], r["crc"]): r["v"] for r in frame.select("doc_id", sh.record_size(frame["text"]).alias("size"), sh.record_crc(frame["text"]).alias("crc"), sh.virtual_slot(frame["doc_id"], frame["text"], 64).alias("v")).collect()}
    sizes = [0] * 64
    for i, t in rows:
        size = len((t or "").encode()) + 1
        sizes[slots[i, size, zlib.crc32((t or "").encode())]] += size
    want = brute_shards(sizes, [s * 8 // 64 for s in range(64)], 8)
    got = sh.place_records(frame, slots=64).collect()
    assert len(got) == len(rows)
    assert all(r["shard"] == want[slots[r["doc_id"], r["size"], r["text_crc32"]]] for r in got)
    held = sh.with_shards(frame, slots=64).collect()
    assert all(r["shard"] == want[r["virtual_slot"]] for r in held)


def test_stored_maps_are_edited(spark, tmp_path, monkeypatch):
    store = f"file://{tmp_path}/map"
    text = lambda i: "t" * (i * 37 % 400)
    first = spark.createDataFrame([(i, text(i)) for i in range(600)], "doc_id long, text string")
    one = {r["doc_id"]: r["shard"] for r in sh.place_records(first, slots=128, store=store).collect()}
    v1 = sh.load_map(spark, store)
    assert v1.version == 1
    assert one == {r["doc_id"]: r["shard"] for r in sh.place_records(first, slots=128, store=store).collect()}
    assert sh.load_map(spark, store).version == 1
    more = spark.createDataFrame([(i, text(i) if i < 600 else "x" * (2000 if i % 2 else 30)) for i in range(700)], "doc_id long, text string")
    two = {r["doc_id"]: (r["virtual_slot"], r["shard"]) for r in sh.with_shards(more, slots=128, store=store).collect()}
    v2 = sh.load_map(spark, store)
    assert (v2.version, v2.edits != []) == (2, True)
    edited = {slot for _, slot, _, _ in v2.edits}
    assert edited == {s for s in range(128) if v1.shard_of[s] != v2.shard_of[s]}
    assert {i for i in one if two[i][1] != one[i]} == {i for i in one if two[i][0] in edited}
    assert 0 < len(edited) < 64
    assert sh.load_map(spark, store, 1).shard_of == v1.shard_of
    assert sh.load_map(spark, store, 9) is None
    (tmp_path / "map" / "version-3").mkdir()  # a write that broke off
    assert sh.load_map(spark, store).version == 2
    monkeypatch.setattr(sh, "WAIT", 0.0)
    last = more.withColumn("text", F.repeat("text", 1 + F.col("doc_id").cast("int") % 5))
    three = {r["virtual_slot"]: r["shard"] for r in sh.with_shards(last, slots=128, store=store).collect()}
    v4 = sh.load_map(spark, store)
    assert v4.version == 4
    assert {s for s in range(128) if v2.shard_of[s] != v4.shard_of[s]} == {slot for _, slot, _, _ in v4.edits} != set()
    assert all(v4.shard_of[slot] == shard for slot, shard in three.items())


def test_partitions_of_a_mix_are_even_ranges(spark):
    rows = spark.range(40_000).select((F.col("id") % 8).cast("int").alias("mix_shard"), F.md5(F.col("id").cast("string")).alias("mix_order"), "id")
    laid = mx.by_local_order(rows, 8, 8).select("*", F.spark_partition_id().alias("p")).collect()
    parts: dict[int, list] = {}
    for r in laid:
        parts.setdefault(r["p"], []).append((r["mix_shard"], r["mix_order"]))
    assert set(parts) == set(range(64))
    assert max(map(len, parts.values())) <= 1.3 * len(laid) / 64
    for p, own in parts.items():
        assert {s for s, _ in own} == {p // 8}
        assert own == sorted(own)
    assert [x for p in range(64) for x in parts[p]] == sorted(x for own in parts.values() for x in own)


def test_of_several_writers_one_commits(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    store = f"file://{tmp_path}/map"
    rng = np.random.default_rng(1)
    sizes = rng.integers(0, 1000, 64).tolist()
    maps = [sh.SlotMap(rng.permutation(64).tolist(), 1) for _ in range(6)]
    with ThreadPoolExecutor(6) as pool:
        saved = list(pool.map(lambda m: sh.save_map(spark, store, m), maps))
    assert saved.count(True) == 1
    assert sh.load_map(spark, store).shard_of == maps[saved.index(True)].shard_of
    assert sorted(p.name.split("-")[0] for p in (tmp_path / "map").iterdir() if not p.name.startswith(".")) == ["map", "version"]  # losers leave nothing
    with ThreadPoolExecutor(4) as pool:
        got = list(pool.map(lambda _: sh.balanced_map(spark, sizes, 8, 64, store).shard_of, range(4)))
    last = sh.load_map(spark, store)
    assert len(last.shard_of) == 64
    assert sh.balanced_map(spark, sizes, 8, 64, store).shard_of == last.shard_of == got[0] == got[1] == got[2] == got[3]


def test_damaged_maps_are_errors(spark, tmp_path):
    store = f"file://{tmp_path}/map"
    assert sh.save_map(spark, store, sh.SlotMap([0, 1, 2, 3], 1))
    (table,) = [p for p in (tmp_path / "map").iterdir() if p.name.startswith("map-")]
    spark.createDataFrame([(1, 0, 0, None), (1, 0, 1, None)], sh.MAP).write.mode("append").parquet(f"file://{table}")
    with pytest.raises(ValueError, match="damaged"):
        sh.load_map(spark, store)


def test_copies_of_one_row_are_made_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(sh, "COPIES", 50)
    frame = spark.createDataFrame([(1, "one")] * 3000 + [(i, "text") for i in range(2, 50)], "doc_id long, text string")
    made = sh.place_records(frame, slots=16).groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in made) < 2000


def test_tables_belong_to_a_run(spark):
    from tilmark.llm import runtime as rt

    frame = spark.createDataFrame([(i, f"text of {i}", f"s{i % 2}") for i in range(40)], "doc_id long, text string, source string")
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    lazy = mx.mix_words(frame)
    with rt.tables() as own:
        one, two = rt.written(frame, "one"), rt.written(frame, "two")
        inner = rt.owned(lambda: rt.written(rt.written(frame, "three").filter("doc_id < 5"), "four"))()
        own.keep(two, inner)
        assert [p.rsplit("/", 1)[1].split("-")[0] for _, p in own.made] == ["two", "four"]
        assert (two.count(), inner.count(), lazy.count()) == (40, 5, 40)
        with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist"):
            one.collect()
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == was


def test_places_in_parts(spark, monkeypatch):
    monkeypatch.setattr(sh, "PART_ROWS", 3)
    frame = spark.createDataFrame([(i // 2, "text" * (i // 2 % 7)) for i in range(600)], "doc_id long, text string")
    rows = sh.place_records(frame, slots=16).collect()
    assert len(rows) == 600
    for shard in range(8):
        own = [r["slot"] for r in rows if r["shard"] == shard]
        assert sorted(own) == list(range(len(own)))


def test_row_with_a_third_of_all(spark, monkeypatch):
    monkeypatch.setattr(sh, "COPIES", 7)
    frame = spark.createDataFrame([(1, "one")] * 100 + [(i, "text" * (i % 7)) for i in range(2, 202)], "doc_id long, text string")
    rows = sh.place_records(frame, slots=16).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter({1: 100} | dict.fromkeys(range(2, 202), 1))
    for shard in range(8):
        own = [r["slot"] for r in rows if r["shard"] == shard]
        assert sorted(own) == list(range(len(own)))


def test_map_versions():
    rng = np.random.default_rng(2)
    sizes = rng.integers(0, 1000, 512).tolist()
    first = sh.SlotMap.even(8, 512).rebalance(sizes, 8)
    held = [sum(s for s, j in zip(sizes, first.shard_of, strict=True) if j == k) for k in range(8)]
    assert max(held) - min(held) <= 0.002 * sum(sizes) / 8
    before = list(first.shard_of)
    grown = first.grow(sizes, 8)
    assert grown.version == 2
    moved = [s for s in range(512) if before[s] != grown.shard_of[s]]
    assert moved
    assert all(grown.shard_of[s] == 8 for s in moved)
    assert sum(sizes[s] for s in moved) == pytest.approx(sum(sizes) / 9, rel=0.05)
    replay = list(sh.SlotMap.even(8, 512).shard_of)
    for _, slot, was, to in grown.edits:
        assert replay[slot] == was
        replay[slot] = to
    assert replay == grown.shard_of


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (220, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(7, 7), (None, 3)]
    near: dict[int, set] = {}
    for a, b in edges:
        if a is not None:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want, left = {}, set(near)
    while left:
        seen, todo = set(), [min(left)]
        while todo:
            k = todo.pop()
            if k not in seen:
                seen.add(k)
                todo += near[k]
        want |= dict.fromkeys(seen, min(seen))
        left -= seen
    frame = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["component"] for r in graph.components(frame).collect()}
    assert got == want
    some, more = frame.limit(150), frame.exceptAll(frame.limit(150))
    assert {r["node"]: r["component"] for r in graph.merged(graph.components(some), more).collect()} == want


def test_forest_recall(spark, monkeypatch):
    monkeypatch.setattr(ed, "LEAF_ROWS", 32)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(150, 24))
    points = np.concatenate([centres + rng.normal(scale=0.12, size=centres.shape) for _ in range(6)]).astype(np.float32)
    label = rng.integers(0, 3, len(points)) * 0 + np.arange(len(points)) % 150 % 3
    frame = spark.createDataFrame([(i, p.tolist(), int(k)) for i, (p, k) in enumerate(zip(points, label, strict=True))], "vec_id long, embedding array<float>, label int")
    rows = {r["vec_id"]: r for r in ed.near_embeddings(frame).collect()}
    unit = points.astype(float) / np.linalg.norm(points.astype(float), axis=1, keepdims=True)
    linked = (unit @ unit.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(linked, False)
    want = linked.sum(axis=1)
    got = np.array([rows[i]["n_links"] for i in range(len(points))])
    assert (got <= want).all()
    assert got.sum() >= 0.97 * want.sum()
    assert all(rows[i]["component_id"] <= i for i in rows)


def test_large_leaves_are_cut(spark, monkeypatch):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=24)
    points = np.concatenate((centre + rng.normal(scale=0.3, size=(300, 24)), rng.normal(size=(100, 24)))).astype(np.float32)
    frame = spark.createDataFrame([(i, p.tolist(), 1) for i, p in enumerate(points)], "vec_id long, embedding array<float>, label int")
    whole = sorted(map(tuple, ed.near_embeddings(frame).collect()))
    monkeypatch.setattr(ed, "MOST_ROWS", 64)
    assert sorted(map(tuple, ed.near_embeddings(frame).collect())) == whole
    unit = points.astype(float) / np.linalg.norm(points.astype(float), axis=1, keepdims=True)
    assert sum(r[1] for r in whole) >= 0.97 * ((unit @ unit.T >= 0.93).sum() - len(points))


@pytest.mark.parametrize("block", [2048, 7])
def test_leaf_counts_pairs_once(monkeypatch, block):
    monkeypatch.setattr(ed, "BLOCK", block)
    rng = np.random.default_rng(5)
    v = rng.normal(size=(80, 5))
    v[40:] = v[:40] + rng.normal(scale=0.05, size=(40, 5))
    codes = [np.array(sorted({int(c) for c in rng.integers(0, 4, 2)} | {9})) for _ in range(80)]
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.93
    np.fill_diagonal(linked, False)
    total = np.zeros(80, int)
    for leaf in (0, 1, 2, 3, 9):
        own = [i for i in range(80) if leaf in codes[i]]
        counts, edges = ed.leaf_links(v[own], np.ones(len(own), int), [codes[i] for i in own], leaf)
        total[own] += counts
        assert all(i < len(own) and j < len(own) for i, j in edges)
    assert np.array_equal(total, linked.sum(axis=1))


@needs_tables
def test_pipeline_like_brute_force(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    left = {k: r for k, r in docs.items() if re.search(r"[^\W\d_]", r["text"] or "")}

    def bag(t):
        w = tv.WORD.findall(t.lower())
        k = min(5, len(w))
        return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if k else Counter()

    bags = {k: bag(r["text"]) for k, r in left.items()}
    kept, near = [], {}
    ids = sorted(left)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            common = sum((bags[a] & bags[b]).values())
            if common and common >= 0.8 * (bags[a].total() + bags[b].total() - common):
                near.setdefault(a, set()).add(b)
                near.setdefault(b, set()).add(a)
    seen: set[int] = set()
    for a in ids:
        if a not in seen:
            kept.append(a)
            todo = [a]
            while todo:
                k = todo.pop()
                if k not in seen:
                    seen.add(k)
                    todo += near.get(k, ())
    items = [tv.WORD.findall(r["text"].lower()) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    words = {k: " " + " ".join(tv.WORD.findall(left[k]["text"].lower())) + " " for k in kept}
    kept = [k for k in kept if not any(" " + " ".join(w) + " " in words[k] for w in items)]
    stage3 = spark.read.parquet(f"{SMALL}/documents.parquet").filter(f"doc_id in ({','.join(map(str, kept))})")
    assert dc.without_leaks(stage3, spark.read.parquet(f"{SMALL}/benchmark.parquet")).count() == len(kept)
    size = {k: len(re.findall(r"[^\x20\x09-\x0D]+", left[k]["text"])) for k in kept}
    sources = sorted({left[k]["source"] for k in kept})
    goals = mx.targets([sum(size[k] for k in kept if left[k]["source"] == s) for s in sources], [mx.WEIGHTS[i % 3] for i in range(len(sources))])
    times = Counter()
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    for s, goal in zip(sources, goals, strict=True):
        own = sorted((md5(f"{k}:{md5(left[k]['text'])}"), k) for k in kept if left[k]["source"] == s)
        quota, total, at = int(np.floor(goal + 0.5)), sum(size[k] for _, k in own), 0
        for _, k in own:
            taken = size[k] * (quota // total) + max(0, min(size[k], quota % total - at))
            at += size[k]
            times[k] = (2 * taken + size[k]) // (2 * size[k])
    rows = corpus_pipeline.run(spark, SMALL).collect()
    assert Counter(r["doc_id"] for r in rows) == +times
    assert all(r["text"] == docs[r["doc_id"]]["text"] for r in rows)
    assert {r["shard"] for r in rows} == set(range(8))
    assert len({(r["doc_id"], r["shard"]) for r in rows}) == len({r["doc_id"] for r in rows})

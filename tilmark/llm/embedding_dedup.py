"""Near-duplicate embeddings by a random-projection tree forest.

Rows with equal label and vector are one *node* with a number of copies, so copies never meet as pairs. A forest of
TREES trees is fitted on a bounded sample (SAMPLE_ROWS nodes by hash): level by level a random direction splits each
cell at the sample's median; where a cell has too few sample points, its last ancestor's points place the median.
The depth follows the largest label, so that a leaf holds about LEAF_ROWS nodes of a label. Every node is indexed
in every tree; within SPILL of the nearest points to a split it goes to both sides.

Nodes of one label in one leaf are compared by cosine in double precision, in blocks. A pair that shares several
leaves counts in the first of them only, which every leaf can tell by itself, as nodes carry their leaf codes. So a leaf
gives a count per node and the edges of a spanning forest, never a list of pairs. Components come from the edges.

Leaves are counted before vectors are shuffled. One with more than MOST_ROWS nodes of a label is cut by hash into parts of about half that, and every pair of
parts is a task of its own, so that a task holds at most about MOST_ROWS vectors, and matrices of BLOCK rows or WIDTH columns of them, however large a leaf is.
All its pairs are still compared. Two nodes with equal 64-bit hashes of label and vector would count as one (of n different ones, about n * n / 2^65 pairs are).

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and rows with a null id or a
null label, link with nothing and are their own component (null for a null id, not kept); vectors of
different length never link; repeated rows are copies and link with each other; a pair at exactly THRESHOLD is linked; vectors may be of any length; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilmark.llm.graph import components
from tilmark.llm.runtime import written

THRESHOLD = 0.93
TREES = 8
LEAF_ROWS = 256
SAMPLE_ROWS = 20_000
SPILL = 0.12
LEAST_POINTS = 16
BLOCK = 2048
MOST_ROWS = 4096
WIDTH = 1024
SEED = 17


@dataclass
class Tree:
    """directions (level, dimension); splits[level][cell] and margins[level][cell]."""

    directions: np.ndarray
    splits: list[np.ndarray]
    margins: list[np.ndarray]

    @classmethod
    def fit(cls, points: np.ndarray, depth: int, seed: int) -> Tree:
        rng = np.random.default_rng(seed)
        directions = rng.normal(size=(depth, points.shape[1]))
        directions /= np.linalg.norm(directions, axis=1, keepdims=True)
        cells: list[np.ndarray] = [np.arange(len(points))]
        splits, margins = [], []
        for level in range(depth):
            at = points @ directions[level]
            split, margin, below = np.empty(len(cells)), np.empty(len(cells)), []
            for k, own in enumerate(cells):
                values = at[own]
                split[k] = np.median(values)
                margin[k] = np.quantile(np.abs(values - split[k]), SPILL)
                sides = own[values <= split[k]], own[values > split[k]]
                below += [side if len(side) >= LEAST_POINTS else own for side in sides]
            splits.append(split)
            margins.append(margin)
            cells = below
        return cls(directions, splits, margins)

    def leaves(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and leaf codes: each row once for each leaf that it is in."""
        row, code = np.arange(len(points)), np.zeros(len(points), np.int64)
        for level, direction in enumerate(self.directions):
            off = (points @ direction)[row] - self.splits[level][code]
            side = (off > 0).astype(np.int64)
            both = np.abs(off) <= self.margins[level][code]
            row = np.concatenate((row, row[both]))
            code = np.concatenate((2 * code + side, 2 * code[both] + 1 - side[both]))
        return row, code


def fit_forest(points: np.ndarray, depth: int, trees: int = TREES) -> list[Tree]:
    return [Tree.fit(points, depth, SEED + t) for t in range(trees)]


def _unit(rows: np.ndarray) -> np.ndarray:
    largest = np.abs(rows).max(axis=1, keepdims=True)
    scaled = rows / largest
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _vectors(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one leaf, label, vector length and pair of parts at a time; rows come ordered by these."""
    left: pa.Table | None = None
    for batch in batches:
        if not len(batch):
            continue
        rows = pa.Table.from_batches([batch])
        rows = (rows if left is None else pa.concat_tables([left, rows])).combine_chunks()
        keys = rows.column(0), rows.column(2), pc.list_value_length(rows.column(4)), rows.column(6), rows.column(7)
        turns = np.zeros(len(rows) - 1, bool)
        for key in keys:
            turns |= np.asarray(pc.not_equal(key.slice(1), key.slice(0, len(rows) - 1)))
        bounds = [0, *(np.flatnonzero(turns) + 1).tolist()]
        for a, b in zip(bounds, bounds[1:], strict=False):
            yield rows.slice(a, b - a)
        left = rows.slice(bounds[-1])
    if left is not None:
        yield left


def leaf_links(
    vectors: np.ndarray, copies: np.ndarray, codes: list[np.ndarray], own: int, threshold: float = THRESHOLD, side: np.ndarray | None = None
) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Of one leaf with code `own`: linked rows of each node, pairs that share an earlier leaf left out, and edges
    that span the leaf's components, as positions. codes: each node's sorted leaf codes. side: if given, only pairs of different sides count."""
    n = len(vectors)
    unit = _unit(vectors)
    flat, holder = np.concatenate(codes), np.repeat(np.arange(n), [len(c) for c in codes])
    early = flat < own
    _, column, times = np.unique(flat[early], return_inverse=True, return_counts=True)
    place = np.cumsum(times > 1) - 1
    there = times[column] > 1
    column, holder = place[column[there]], holder[early][there]
    order = np.argsort(column, kind="stable")
    column, holder = column[order], holder[order]
    counts = np.zeros(n, np.int64)
    edges: list[tuple[int, int]] = []

    def seen(block: np.ndarray) -> np.ndarray:
        """Which pairs of the block's nodes with all nodes share an earlier leaf."""
        out = np.zeros((len(block), n), bool)
        for a in range(0, int(column[-1]) + 1 if len(column) else 0, WIDTH):
            lo, hi = np.searchsorted(column, (a, a + WIDTH))
            part = np.zeros((n, WIDTH), np.float32)
            part[holder[lo:hi], column[lo:hi] - a] = 1
            out |= part[block] @ part.T > 0
        return out

    def rows(block: np.ndarray) -> np.ndarray:
        """Which nodes the block's nodes link with; counts those pairs that this leaf is the first to see."""
        near = unit[block] @ unit.T >= threshold
        near[np.arange(len(block)), block] = False
        if side is not None:
            near &= side[block][:, None] != side[None, :]
        if near.any():
            counts[block] = (near & ~seen(block)) @ copies
        return near

    whole = rows(np.arange(n)) if n <= BLOCK else None
    root = np.full(n, -1)
    for start in range(n) if whole is None else np.flatnonzero(whole.any(axis=1)).tolist():
        if root[start] >= 0:
            continue
        root[start] = start
        order = [start]
        while order:  # breadth first, a block of nodes at a time: every node is compared once
            block, order = np.array(order[:BLOCK]), order[BLOCK:]
            near = rows(block) if whole is None else whole[block]
            reached = np.flatnonzero(near.any(axis=0) & (root < 0))
            root[reached] = start
            edges += [(start, int(k)) for k in reached]
            order += reached.tolist()
    return counts, edges


def _index(forests: dict[int, list[Tree]]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), BLOCK):
                batch = whole.slice(at, BLOCK)
                sizes = np.asarray(pc.list_value_length(batch.column(3)))
                for size in np.unique(sizes).tolist():
                    part = batch.filter(pa.array(sizes == size))
                    points = _unit(_vectors(part.column(3)))
                    found = [tree.leaves(points) for tree in forests[size]]
                    row = np.concatenate([r for r, _ in found])
                    code = np.concatenate([c + (t << 40) for t, (_, c) in enumerate(found)])
                    order = np.lexsort((code, row))
                    row, code = row[order], code[order]
                    offsets = np.searchsorted(row, np.arange(len(part) + 1)).astype(np.int32)
                    every = pa.ListArray.from_arrays(pa.array(offsets), pa.array(code))
                    out = part.take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([pa.array(code), *out.columns, every.take(pa.array(row))], names=["leaf", *part.schema.names, "codes"])

    return run


def _loads(forests: dict[int, list[Tree]]) -> Callable:
    """(leaf, label, nodes): how many nodes of a label a batch puts into each leaf."""
    index = _index(forests)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in index(batches):
            table = pa.table([part.column(0), part.column(2)], names=["leaf", "label"])
            counted = table.group_by(["leaf", "label"]).aggregate([([], "count_all")])
            yield from counted.select(["leaf", "label", "count_all"]).rename_columns(["leaf", "label", "nodes"]).to_batches()

    return run


def dealt_leaves(indexed: DataFrame, loads: DataFrame) -> DataFrame:
    """indexed rows with i, j and part: once, with zeros, in small leaves; in a large one for every pair (i, j) of its parts that holds the row's."""
    large = written(loads.groupBy("leaf", "label").agg(F.sum("nodes").alias("nodes")).filter(F.col("nodes") > MOST_ROWS), "large")
    zero = F.lit(0)
    if not large.limit(1).count():
        return indexed.select("*", zero.alias("i"), zero.alias("j"), zero.alias("part"))
    parts = F.ceil(F.coalesce("nodes", zero) * 2 / MOST_ROWS).cast("int")
    named = indexed.join(large, ["leaf", "label"], "left").withColumn("parts", F.greatest(parts, F.lit(1))).withColumn("part", F.pmod(F.xxhash64("node", F.lit(9)), F.col("parts")).cast("int"))
    others = F.explode(F.sequence(zero, F.col("parts") - 1))
    each = named.withColumn("other", others)
    return each.select(*indexed.columns, F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part")


def _compare(threshold: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):  # leaf, node, label, copies, vector, codes, i, j, part
            if len(group) < 2:
                continue
            leaf, nodes, copies = group.column(0)[0].as_py(), np.asarray(group.column(1)), np.asarray(group.column(3))
            vectors, codes = group.column(4).combine_chunks(), group.column(5).combine_chunks()
            each = np.split(np.asarray(codes.flatten()), np.cumsum(np.asarray(pc.list_value_length(codes)))[:-1])
            i, j = (group.column(k)[0].as_py() for k in (6, 7))
            counts, edges = leaf_links(_vectors(vectors), copies, each, leaf, threshold, None if i == j else np.asarray(group.column(8)))
            some = np.flatnonzero(counts)
            a = nodes[[i for i, _ in edges]] if edges else np.empty(0, np.int64)
            b = nodes[[j for _, j in edges]] if edges else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate((nodes[some], a))), pa.array(np.concatenate((np.full(len(some), -1), b))), pa.array(np.concatenate((counts[some], np.full(len(a), 0)))), pa.array(np.concatenate((np.zeros(len(some), bool), np.ones(len(a), bool))))],
                names=["a", "b", "links", "edge"],
            )

    return run


def _usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def near_embeddings(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD, trees: int = TREES) -> DataFrame:
    """One row per input row: the key, n_links, component_id and kept."""
    plain = vectors.select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    usable = F.col("id").isNotNull() & F.col("label").isNotNull() & _usable(F.col("vector"))
    rows = plain.withColumn("node", F.when(usable, F.xxhash64("label", "vector")))
    nodes = written(rows.filter("node is not null").groupBy("node").agg(F.first("label").alias("label"), F.count("*").alias("copies"), F.first("vector").alias("vector"), F.min("id").alias("first")), "nodes")
    sizes = nodes.groupBy(F.size("vector").alias("size"), "label").count().groupBy("size").agg(F.sum("count").alias("rows"), F.max("count").alias("most")).collect()
    forests = {}
    for r in sizes:
        depth = max(0, math.ceil(math.log2(r["most"] / LEAF_ROWS)))
        share = int(min(1.0, 1.1 * SAMPLE_ROWS / r["rows"]) * (1 << 30)) if depth else 0
        drawn = nodes.filter((F.size("vector") == r["size"]) & (F.pmod(F.xxhash64("node", F.lit(5)), F.lit(1 << 30)) < share)).select("node", "vector").collect()
        drawn.sort(key=lambda x: x["node"])
        points = _unit(np.array([x["vector"] for x in drawn], np.float64)) if drawn else np.ones((1, r["size"]))
        forests[r["size"]] = fit_forest(points, depth, trees)
    kind = vectors.schema[vector].dataType.simpleString()
    mark = vectors.schema[label].dataType.simpleString()
    indexed = nodes.select("node", "label", "copies", "vector").mapInArrow(_index(forests), f"leaf long, node long, label {mark}, copies long, vector {kind}, codes array<long>")
    loads = nodes.select("node", "label", "copies", "vector").mapInArrow(_loads(forests), f"leaf long, label {mark}, nodes long")
    keyed = dealt_leaves(indexed, loads).withColumn("size", F.size("vector")).repartition("leaf", "label", "i", "j")
    dealt = keyed.sortWithinPartitions("leaf", "label", "size", "i", "j").drop("size")
    found = written(dealt.mapInArrow(_compare(threshold), "a long, b long, links long, edge boolean"), "found")
    links = found.filter("not edge").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    classes = components(found.filter("edge").select("a", "b"))
    named = nodes.select("node", "copies", "first").join(classes, "node", "left").join(links, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    by_node = named.join(least, "component").select("node", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = rows.select("id", "node").join(by_node, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))

"""Near-duplicate classes of texts by BagMinHash signatures, banding and exact multiset verification.

Two texts are linked when the weighted Jaccard similarity of their bags of five-word shingles is at least
THRESHOLD; a class is a connected component of links. Steps:

1. One pass over the texts gives each a fingerprint of its word sequence (the *node*) and band hashes of its
   BagMinHash signature. Texts with equal words are one node, so copies never meet as pairs.
2. In each band bucket the smallest node is the hub and every other node is paired with it.
3. Pairs whose sizes allow the threshold are verified on their shingle bags, and components are formed.
4. Buckets that still hold more than one component go on with those nodes that can have another link: the
   shingles that no other such node has, and the bits of a bitmap of shingles that the other node lacks, bound
   each overlap from above, which is exact. First the HUBS nodes
   with the largest shared parts are paired with the bucket's other components, then all pairs that cross
   components and that the bound allows are verified. So no link that banding proposes between classes is lost, and pairs
   inside one class are never listed. A bucket with more than CELL_NODES such nodes is cut by hash into parts of about half
   that, and every two parts meet in a task of their own, so no task holds a whole bucket.

With 25 bands of 6 components a pair at similarity 0.8 shares no bucket with probability 5e-4, at 0.9 1e-8.

Defined cases: null texts and texts without words link with nothing and form a class each; a text of one to
four words has one shingle; texts with equal fingerprints count as equal (of n different texts, about n * n / 2^65 pairs do); rows with a null id take part and their class is the smallest id in it, or null;
rows with equal ids and different texts are different nodes; very long texts are hashed in pieces, and their whole bags verified; of equal smallest ids one row is
kept by its text's hash; extra columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilmark.llm import bag_minhash as bm
from tilmark.llm import textvec as tv
from tilmark.llm.graph import components, merged
from tilmark.llm.runtime import written

THRESHOLD = 0.8
BAND_ROWS = 6
HUBS = 6
PARTS = 32
CELL_NODES = 2048
BITMAP_LONGS = 32
SLACK = 1e-9  # bounds leave room for rounding: 50.4 may compare as less than 0.8 * 63


def _bag(words: np.ndarray) -> np.ndarray:
    return np.sort(tv.shingles(words))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in tv.chunks(batches):
        words, at = tv.word_hashes(texts)
        nodes, sizes, owner, element, weight = [], [], [], [], []
        for i in range(len(texts)):
            own = words[at[i] : at[i + 1]]
            bag, counts = np.unique(tv.shingles(own), return_counts=True)
            nodes.append(tv.fingerprint(own) if len(own) else None)
            sizes.append(int(counts.sum()))
            owner.append(np.full(len(bag), i))
            element.append(bag)
            weight.append(counts)
        signature = bm.signatures(np.concatenate(owner).astype(np.int64), np.concatenate(element), np.concatenate(weight).astype(np.float64), len(texts))
        keys = bm.bands(signature, BAND_ROWS)
        held = np.array(sizes) > 0
        offsets = np.concatenate(([0], np.cumsum(held * keys.shape[1]))).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[held].ravel(), pa.int64()))],
            names=["id", "content", "node", "size", "bands"],
        )


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in tv.chunks(batches):
        words, at = tv.word_hashes(texts)
        bags = [_bag(words[at[i] : at[i + 1]]) for i in range(len(texts))]
        offsets = np.concatenate(([0], np.cumsum([len(b) for b in bags]))).astype(np.int32)
        values = np.concatenate(bags).view(np.int64)
        bits = np.zeros((len(bags), BITMAP_LONGS), tv.U)
        for i, bag in enumerate(bags):
            at = bag & tv.U(64 * BITMAP_LONGS - 1)
            np.bitwise_or.at(bits[i], (at >> tv.U(6)).astype(np.int64), tv.U(1) << (at & tv.U(63)))
        ends = np.arange(0, bits.size + 1, BITMAP_LONGS, dtype=np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(o), pa.array(v)) for o, v in ((offsets, values), (ends, bits.ravel().view(np.int64)))]
        yield pa.RecordBatch.from_arrays([batch.column(0), *lists], names=["node", "bag", "bits"])


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the multiset intersection of two sorted arrays."""
    ua, ca = np.unique(a, return_counts=True)
    ub, cb = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    return int(np.minimum(ca[i], cb[j]).sum())


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            p, q = (np.asarray(x.flatten()).view(tv.U) for x in (left, right))
            i, j = (np.concatenate(([0], np.cumsum(np.asarray(pc.list_value_length(x))))) for x in (left, right))
            s = np.empty(len(batch))
            for k in range(len(batch)):
                a, b = p[i[k] : i[k + 1]], q[j[k] : j[k + 1]]
                common = overlap(a, b)
                s[k] = common / (len(a) + len(b) - common)
            keep = pa.array(s >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s)], names=["a", "b", "similarity"]).filter(keep)
        tv.give_back()

    return run


class NearDuplicates:
    """The classes of one table of texts. sketch: (id, content, node, size, bands) of every row; links: verified
    (a, b, similarity) between nodes, enough to connect each class; classes: (node, class_node) of linked nodes."""

    def __init__(self, texts: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD):
        self.threshold = threshold
        self.source = texts.select(F.col(key).alias("id"), F.xxhash64(F.col(text)).alias("content"), F.col(text).alias("text"))
        self.sketch = written(self.source.mapInArrow(_sketch, f"id {texts.schema[key].dataType.simpleString()}, content long, node long, size long, bands array<long>"), "sketch")
        one = self.sketch.filter("node is not null").groupBy("node").agg(F.min(F.struct("id", "content")).alias("row"), F.first("size").alias("size"), F.first("bands").alias("bands"))
        self.nodes = written(one, "nodes")
        entries = self.nodes.select(F.explode("bands").alias("bucket"), "node", "size")
        shared = entries.groupBy("bucket").agg(F.min("node").alias("hub"), F.max("node").alias("other"), F.min_by("size", "node").alias("hub_size")).filter("hub != other")
        self.entries = written(entries.join(shared.drop("other"), "bucket"), "entries")
        self.bags = self._all_bags()
        pairs = self.entries.filter("node != hub").select(F.col("hub").alias("a"), F.col("node").alias("b"), F.col("hub_size").alias("m"), F.col("size").alias("n"))
        self.tested = None
        self.links = self._verified(pairs)
        self.classes = components(self.links)
        for crossing in (self._to_hubs, self._all_crossing):
            mixed = self._mixed()
            if mixed is None:
                break
            more = self._verified(crossing(mixed))
            if more.limit(1).count():
                self.links = self.links.unionByName(more)
                self.classes = merged(self.classes, more)

    def _all_bags(self) -> DataFrame:
        """(node, bag, bits) of every node that shares a bucket: its sorted shingle hashes, repeats included, and a bitmap
        of them."""
        wanted = self.entries.select("node").distinct()
        rows = self.nodes.join(wanted, "node").select("node", F.col("row.id").alias("id"), F.col("row.content").alias("content"))
        there = rows.join(self.source, rows["id"].eqNullSafe(self.source["id"]) & (rows["content"] == self.source["content"]))
        return written(there.select("node", "text").mapInArrow(_bags, "node long, bag array<long>, bits array<long>").dropDuplicates(["node"]), "bags")

    def _verified(self, pairs: DataFrame) -> DataFrame:
        """Links among candidate pairs (a, b, sizes m and n). Only sizes within the threshold of each other can reach it."""
        pairs = pairs.filter(F.least("m", "n") >= (1 - SLACK) * self.threshold * F.greatest("m", "n")).select("a", "b").distinct()
        if self.tested is not None:
            pairs = pairs.join(self.tested, ["a", "b"], "left_anti")
        pairs = written(pairs, "pairs")
        self.tested = pairs if self.tested is None else self.tested.unionByName(pairs)
        joined = pairs.join(self.bags.select(F.col("node").alias("a"), F.col("bag").alias("p")), "a").join(self.bags.select(F.col("node").alias("b"), F.col("bag").alias("q")), "b")
        return written(joined.select("a", "b", "p", "q").mapInArrow(_verify(self.threshold), "a long, b long, similarity double"), "verified")

    def _mixed(self) -> DataFrame | None:
        """Entries (bucket, node, size, component, shared) of buckets with several components, without nodes that can
        have no further link. shared is the number of a node's shingles that any other of these nodes has: no overlap
        is larger, so a node needs threshold * size of them."""
        named = self.entries.select("bucket", "node", "size").join(self.classes, "node", "left").withColumn("component", F.coalesce("component", "node"))
        named = written(named, "named")
        several = named.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo != hi")
        mixed = written(named.join(several.select("bucket"), "bucket"), "mixed")
        if not mixed.limit(1).count():
            return None
        there = self.bags.join(mixed.select("node").distinct(), "node").select("node", F.explode("bag").alias("shingle"))
        own = there.groupBy("shingle").agg(F.min("node").alias("node"), F.max("node").alias("other"), F.count("*").alias("n")).filter("node = other")
        alone = own.groupBy("node").agg(F.sum("n").alias("alone"))
        out = mixed.join(alone, "node", "left").withColumn("shared", F.col("size") - F.coalesce("alone", F.lit(0))).drop("alone")
        out = out.filter(F.col("shared") >= (1 - SLACK) * self.threshold * F.col("size"))
        return written(out.join(self.bags.select("node", "bits"), "node"), "open")

    def _to_hubs(self, mixed: DataFrame) -> DataFrame:
        """Each bucket's HUBS nodes with the largest shared parts, with the bucket's nodes of other components."""
        order = (F.col("shared") / F.col("size")).desc(), F.col("node")
        dealt = mixed.withColumn("part", F.pmod("node", F.lit(PARTS)))
        some = dealt.withColumn("place", F.row_number().over(Window.partitionBy("bucket", "part").orderBy(*order))).filter(F.col("place") <= HUBS)
        some = some.select("bucket", "node", "size", "shared", "component", "bits")  # a large bucket is ranked in PARTS tasks first
        top = some.withColumn("place", F.row_number().over(Window.partitionBy("bucket").orderBy(*order))).filter(F.col("place") <= HUBS)
        hubs = top.select("bucket", F.col("node").alias("y"), F.col("size").alias("n"), F.col("shared").alias("t"), F.col("component").alias("d"), F.col("bits").alias("q"))
        return self._crossed(mixed, hubs, F.col("c") != F.col("d"), all_parts=True)

    def _all_crossing(self, mixed: DataFrame) -> DataFrame:
        """All pairs of a bucket's nodes of different components that their shared parts allow."""
        right = mixed.select("bucket", F.col("node").alias("y"), F.col("size").alias("n"), F.col("shared").alias("t"), F.col("component").alias("d"), F.col("bits").alias("q"))
        return self._crossed(mixed, right, (F.col("c") != F.col("d")) & (F.col("x") < F.col("y")))

    def _crossed(self, mixed: DataFrame, right: DataFrame, condition: Column, all_parts: bool = False) -> DataFrame:
        """Pairs of a bucket whose overlap can reach the threshold: it is bounded by the shared parts, and by a size less
        the bits of its bitmap that the other lacks, as each stands for a shingle that the other lacks. all_parts: the rows of
        right are few in a bucket, and each goes to all parts of left."""
        left = mixed.select("bucket", F.col("node").alias("x"), F.col("size").alias("m"), F.col("shared").alias("s"), F.col("component").alias("c"), F.col("bits").alias("p"))
        lacking = lambda one, other: F.aggregate(F.zip_with(one, other, lambda i, j: F.bit_count(i.bitwiseAND(F.bitwise_not(j)))), F.lit(0), lambda total, k: total + k)
        enough = lambda overlap: overlap * (1 + self.threshold) >= (1 - SLACK) * self.threshold * (F.col("m") + F.col("n"))
        reach = enough(F.least("s", "t")) & enough(F.col("m") - lacking("p", "q")) & enough(F.col("n") - lacking("q", "p"))
        left, right, cell = self._celled(mixed, left, right, all_parts)
        return left.join(right, cell).filter(condition & reach).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "m", "n")

    def _celled(self, mixed: DataFrame, left: DataFrame, right: DataFrame, all_parts: bool) -> tuple[DataFrame, DataFrame, list[str]]:
        """left and right, and the columns that they are joined by. Where a bucket of mixed is large, its rows of left have a part i and
        stand once for each part j of right, and those of right the other way round, so that two rows meet in one cell (i, j)."""
        sizes = mixed.groupBy("bucket").agg(F.count("*").alias("open")).filter(F.col("open") > CELL_NODES)
        large = written(sizes.select("bucket", F.ceil(F.col("open") * 2 / CELL_NODES).cast("int").alias("parts")), "large")
        if not large.limit(1).count():
            return left, right, ["bucket"]
        parts, zero = F.coalesce("parts", F.lit(1)), F.lit(0)
        own = lambda node: F.pmod(F.xxhash64(node, F.lit(11)), parts).cast("int")
        every = F.explode(F.sequence(zero, parts - 1))
        cut = lambda side, i, j: side.join(large, "bucket", "left").select(*side.columns, i.alias("i"), j.alias("j"))
        if all_parts:
            return cut(left, own("x"), zero), cut(right, every, zero), ["bucket", "i", "j"]
        return cut(left, own("x"), every), cut(right, every, own("y")), ["bucket", "i", "j"]

    def membership(self) -> DataFrame:
        """(id, content, component, class_id): one row per input row. component is null for texts without words; class_id is
        the smallest id of the class."""
        named = self.nodes.select("node", F.col("row.id").alias("first")).join(self.classes, "node", "left").withColumn("component", F.coalesce("component", "node"))
        least = named.groupBy("component").agg(F.min("first").alias("class_id"))
        by_node = named.join(least, "component").select("node", "component", "class_id")
        out = self.sketch.select("id", "content", "node").join(by_node, "node", "left")
        return out.select("id", "content", "component", F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"))


def near_duplicates(texts: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: the key, class_id (smallest key of its class) and kept (whether it is that one)."""
    found = NearDuplicates(texts, key, text, threshold).membership()
    return found.select(F.col("id").alias(key), "class_id", F.coalesce(F.col("id") == F.col("class_id"), F.lit(False)).alias("kept"))


def without_near_duplicates(texts: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The input rows, all columns, with one row of each class: one with the smallest key. Repeated rows are copies.
    Texts without words all stay, but for repeats with equal keys."""
    found = NearDuplicates(texts, key, text, threshold).membership()
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "content"))
    chosen = found.filter("component is not null").groupBy("component").agg(first.alias("row")).select("row.id", "row.content")
    keep = chosen.union(found.filter("component is null").select("id", "content").distinct())
    keep = keep.select(F.xxhash64("id", "content").alias("__k"), F.col("id").alias("__id"), F.col("content").alias("__content"))
    rows = texts.withColumn("__at", F.xxhash64(F.col(text))).withColumn("__k", F.xxhash64(F.col(key), F.col("__at")))
    same = (rows["__k"] == keep["__k"]) & rows[key].eqNullSafe(keep["__id"]) & (rows["__at"] == keep["__content"])
    return rows.join(keep, same, "left_semi").dropDuplicates(["__k", key, "__at"]).select(*texts.columns)

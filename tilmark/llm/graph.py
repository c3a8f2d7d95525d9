"""Connected components of a link table, by label propagation with pointer jumping, wholly in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilmark.llm.runtime import dropped, written

#: Labels are written in files of about this many rows, so that small graphs do not make a file per shuffle partition and round.
ROWS_PER_FILE = 20_000


def components(links: DataFrame) -> DataFrame:
    """links(a, b) of longs -> (node, component): each node that stands in a link, with the smallest node of its
    component. Self links and repeated links are allowed; rows with a null are ignored.

    Every round takes the smallest label among a node and its neighbours and then that label's own label, so
    stars end in two rounds and a chain of n links in about log n. Labels are written each round."""
    both = written(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).dropna().distinct(), "links")
    parts = max(1, -(-both.count() // ROWS_PER_FILE))
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")).coalesce(parts), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        after = written(lower.join(jump, "label").select("node", F.least("label", "next").alias("label"), "was").coalesce(parts), "labels")
        moved = after.filter(F.col("was") != F.col("label")).limit(1).count()
        dropped(labels)
        labels = after.select("node", "label")
        if not moved:
            return labels.select("node", F.col("label").alias("component"))


def merged(classes: DataFrame, links: DataFrame) -> DataFrame:
    """Components (node, component) after more links (a, b): only the links between components are walked."""
    named = lambda c: classes.select(F.col("node").alias(c), F.col("component").alias(f"c_{c}"))
    ends = links.select("a", "b").join(named("a"), "a", "left").join(named("b"), "b", "left")
    between = ends.select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b")).filter("a != b")
    joined = components(between)
    moved = joined.select(F.col("node").alias("component"), F.col("component").alias("into"))
    kept = classes.join(moved, "component", "left").select("node", F.coalesce("into", "component").alias("component"))
    return written(kept.union(joined.join(classes, "node", "left_anti")), "classes")

"""A sink for micro-batches that a restart may repeat: every batch's results and dead letters are stored once, together, and its callbacks are not called again.

Layout: results/part=<name>/ and dead/part=<name>/ hold what a try has written, commits/<query>-<batch> names the try that counts. A batch is committed after both
are written; what a broken-off try left has no commit and is never read. A callback that has returned is marked; after a restart only those that are not are called,
with the stored rows. A crash between the end of a callback and its mark is the one case in which it is called twice.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilmark.plans import store

KINDS = ("results", "dead")


class Once:
    """One batch of one query in a sink's folder."""

    def __init__(self, spark: SparkSession, folder: str, query: str, batch: int):
        self.spark, self.folder, self.name = spark, folder.rstrip("/"), f"{query}-{batch}"

    def write(self, make: Callable[[], tuple[DataFrame, DataFrame]]) -> bool:
        """Store what make() returns (results, dead), unless the batch is committed; make is then not called."""
        if store.committed(self.spark, f"{self.folder}/commits/{self.name}") is not None:
            return False
        part = uuid.uuid4().hex
        for kind, rows in zip(KINDS, make(), strict=True):
            rows.write.parquet(f"{self.folder}/{kind}/part={part}")
        return store.commit_once(self.spark, f"{self.folder}/commits/{self.name}", part)

    def rows(self, kind: str) -> DataFrame:
        part = store.committed(self.spark, f"{self.folder}/commits/{self.name}")
        return self.spark.read.parquet(f"{self.folder}/{kind}/part={part}")

    def call(self, kind: str, callback: Callable[[DataFrame, int], None] | None, number: int) -> None:
        mark = f"{self.folder}/called/{self.name}-{kind}"
        if callback is None or store.committed(self.spark, mark) is not None:
            return
        callback(self.rows(kind), number)
        store.commit_once(self.spark, mark, "called")


def stored(spark: SparkSession, folder: str, kind: str = "results") -> DataFrame:
    """All committed rows of a sink."""
    commits = spark.read.text(f"{folder.rstrip('/')}/commits").select(F.col("value").alias("commit"))
    rows = spark.read.parquet(f"{folder.rstrip('/')}/{kind}").withColumn("part", F.col("part").cast("string"))
    return rows.join(commits, rows["part"] == commits["commit"], "left_semi").drop("part")

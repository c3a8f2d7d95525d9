"""Sharding by fixed virtual slots.

A record's hash gives its virtual slot, one of SLOTS, for good. Bytes are summed per slot, and a slot map says
which shard holds which slot. A map is versioned and stored: load_map reads the latest whole version of a store, every rebalancing
edits that by moving single slots, and save_map writes the next version with its edits, so only the moved slots' records change their
shard when a table grows. With the map edited until the shards' bytes are near equal, the law that holds is `bytes`.

A store is a folder in the shared folder. A version is written as a table of rows (version, virtual_slot, shard, moved_from), moved_from null for slots that the version left
where they were, in a folder of its own, and committed by a mark of the version's number that names the folder. The mark gets its name in one step, which fails where
the name is taken, so of runs that write the same version one commits it; the others read that one and go on from it. Tables without a mark are
never read. On a local or mounted file system the step is a hard link, elsewhere a rename, which HDFS refuses where the name is taken; an object store must refuse it too.

Data: records become narrow rows (hash, size); equal rows are counted before they are shuffled. Collected are one
sum and one count per slot, and the map (SLOTS rows each). Places within a shard come from counts per slot and per part of a slot;
a part holds about PART_ROWS rows, so no task sorts a whole shard.

Defined cases: a null text has size 1; null and repeated ids are hashed with size and checksum; equal records
stand in one slot, at places in any sequence; records of equal size and checksum are told apart by id only; a text of any length is one
record, and a slot with one very long text may hold a shard's bytes above the mean; an empty table gives an empty result and a map of
equal numbers of slots; extra columns are ignored or, in with_shards, kept (a column named shard or
virtual_slot is replaced).
"""

from __future__ import annotations

import hashlib
import os
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilmark.llm.runtime import shared_dir, written

SLOTS = 4096
PART_ROWS = 10_000
COPIES = 10_000
#: Copies that a task makes, about.
TASK_ROWS = 1_000_000
ATTEMPTS, WAIT = 20, 0.1


def record_size(text: Column) -> Column:
    return (F.octet_length(F.coalesce(text, F.lit(""))) + 1).cast("long")


def record_crc(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


@dataclass
class SlotMap:
    """shard_of[slot], with the history of edits: (version, slot, from, to)."""

    shard_of: list[int]
    version: int = 0
    edits: list[tuple[int, int, int, int]] = field(default_factory=list)

    @classmethod
    def even(cls, shards: int, slots: int = SLOTS) -> SlotMap:
        return cls([s * shards // slots for s in range(slots)])

    def _move(self, slot: int, to: int) -> None:
        self.edits.append((self.version, slot, self.shard_of[slot], to))
        self.shard_of[slot] = to

    def rebalance(self, sizes: list[int], shards: int) -> SlotMap:
        """A next version: slots move from the fullest to the emptiest shard while that brings the two closer."""
        self.version += 1
        held: list[dict[int, int]] = [{} for _ in range(shards)]
        for slot, shard in enumerate(self.shard_of):
            held[shard][slot] = sizes[slot]
        total = [sum(h.values()) for h in held]
        while True:
            most, least = max(range(shards), key=lambda j: (total[j], -j)), min(range(shards), key=lambda j: (total[j], j))
            gap = total[most] - total[least]
            fitting = [(abs(gap - 2 * size), slot) for slot, size in held[most].items() if 0 < size < gap]
            if not fitting:
                return self
            slot = min(fitting)[1]
            size = held[most].pop(slot)
            held[least][slot] = size
            total[most] -= size
            total[least] += size
            self._move(slot, least)

    def grow(self, sizes: list[int], shards: int) -> SlotMap:
        """A next version with one more shard, numbered shards, which takes its share of slots from all others."""
        self.version += 1
        total, taken = [0] * shards, 0
        for slot, shard in enumerate(self.shard_of):
            total[shard] += sizes[slot]
        share = sum(total) / (shards + 1)
        for slot in sorted(range(len(sizes)), key=lambda s: (-sizes[s], s)):
            shard = self.shard_of[slot]
            if total[shard] - sizes[slot] >= share and taken + sizes[slot] <= share:
                total[shard] -= sizes[slot]
                taken += sizes[slot]
                self._move(slot, shards)
        return self


MAP = "version int, virtual_slot int, shard int, moved_from int"


def map_store(spark: SparkSession, name: str) -> str:
    """The folder of the map of a table or job called name."""
    return f"{shared_dir(spark)}/tilmark/slot-maps/{hashlib.sha256(name.encode()).hexdigest()[:32]}"


def _path(spark: SparkSession, at: str):  # noqa: ANN202
    """Hadoop's path, and its file system."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, store: str) -> tuple[list[int], int]:
    """Committed versions of a store, in order, and the largest number that is taken: a folder of that name is no mark, but takes it."""
    path, files = _path(spark, store)
    found = [(s.getPath().getName(), s.isFile()) for s in files.listStatus(path)] if files.exists(path) else []
    numbers = [(int(n.removeprefix("version-")), mark) for n, mark in found if n.startswith("version-")]
    return sorted(n for n, mark in numbers if mark), max((n for n, _ in numbers), default=0)


def _commit(spark: SparkSession, store: str, version: int, table: str) -> bool:
    """Make `table` the content of a version, if no other run has: a whole mark is given its name in one step that fails where the name is taken."""
    path, files = _path(spark, f"{store}/mark-{uuid.uuid4().hex}")
    to, _ = _path(spark, f"{store}/version-{version}")
    out = files.create(path, False)
    out.writeBytes(table)
    out.close()
    try:
        if files.getScheme() != "file":
            return bool(files.rename(path, to))  # Hadoop's file systems rename no file to one that is there
        os.link(path.toUri().getPath(), to.toUri().getPath())
        return True
    except FileExistsError:
        return False
    finally:
        files.delete(path, False)


def _table_of(spark: SparkSession, store: str, version: int) -> str:
    """The folder that a version's mark names."""
    return spark.read.text(f"{store}/version-{version}").head()[0]


def load_map(spark: SparkSession, store: str, version: int | None = None) -> SlotMap | None:
    """The latest stored map, or the one of a version; null if there is none. A table that has not one row for every slot is an error."""
    there, _ = _versions(spark, store)
    if not there or version is not None and version not in there:
        return None
    number = version or there[-1]
    table = f"{store}/{_table_of(spark, store, number)}"
    rows = sorted(spark.read.schema(MAP).parquet(table).collect(), key=lambda r: r["virtual_slot"])
    if [r["virtual_slot"] for r in rows] != list(range(len(rows))) or not rows or any(r["version"] != number or r["shard"] is None for r in rows):
        raise ValueError(f"the slot map in {table} is damaged")
    edits = [(r["version"], r["virtual_slot"], r["moved_from"], r["shard"]) for r in rows if r["moved_from"] is not None]
    return SlotMap([r["shard"] for r in rows], number, edits)


def map_table(spark: SparkSession, slot_map: SlotMap) -> DataFrame:
    """The stored form of a map, SLOTS rows."""
    was: dict[int, int] = {}
    for version, slot, before, _ in slot_map.edits:
        if version == slot_map.version:
            was.setdefault(slot, before)
    return spark.createDataFrame([(slot_map.version, s, j, was.get(s)) for s, j in enumerate(slot_map.shard_of)], MAP)


def save_map(spark: SparkSession, store: str, slot_map: SlotMap) -> bool:
    """Write a version to a folder of its own and commit it. False, and nothing is left, if another run has committed that version."""
    name = f"map-{uuid.uuid4().hex}"
    map_table(spark, slot_map).coalesce(1).write.parquet(f"{store}/{name}")
    if _commit(spark, store, slot_map.version, name):
        return True
    path, files = _path(spark, f"{store}/{name}")
    files.delete(path, True)
    return False


def balanced_map(spark: SparkSession, sizes: list[int], shards: int, slots: int, store: str | None) -> SlotMap:
    """The stored map of this many slots and shards, or an even one, edited for these sizes. What changes is stored; if another run was first, from its map."""
    for attempt in range(ATTEMPTS):
        there, taken = _versions(spark, store) if store else ([], 0)  # one listing: a commit after it takes the number that is tried here
        last = load_map(spark, store, there[-1]) if there else None
        fits = last is not None and len(last.shard_of) == slots and max(last.shard_of) < shards
        current = SlotMap(list(last.shard_of), taken) if fits else SlotMap(SlotMap.even(shards, slots).shard_of, taken)
        current.rebalance(sizes, shards)
        if not store or fits and not current.edits or save_map(spark, store, current):
            return current
        time.sleep(WAIT * attempt)
    raise RuntimeError(f"others have committed to {store} {ATTEMPTS} times in a row")


def virtual_slot(key: Column, text: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(key, record_size(text), record_crc(text)), F.lit(slots)).cast("int")


def _slot_sums(rows: DataFrame, slots: int) -> tuple[list[int], list[int]]:
    sizes, counts = [0] * slots, [0] * slots
    for r in rows.groupBy("virtual_slot").agg(F.sum(F.col("size") * F.col("copies")).alias("bytes"), F.sum("copies").alias("rows")).collect():
        sizes[r["virtual_slot"]], counts[r["virtual_slot"]] = r["bytes"], r["rows"]
    return sizes, counts


def place_records(texts: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 8, slots: int = SLOTS, store: str | None = None) -> DataFrame:
    """One row per input row: key, size, text_crc32, shard and slot, its place in the shard (gapless from 0), by the map in store, which is edited
    where sizes have changed."""
    spark = texts.sparkSession
    plain = texts.select(F.col(key).alias("id"), record_size(F.col(text)).alias("size"), record_crc(F.col(text)).alias("crc"), virtual_slot(F.col(key), F.col(text), slots).alias("virtual_slot"))
    rows = written(plain.groupBy("id", "size", "crc", "virtual_slot").agg(F.count("*").alias("copies")), "records")
    sizes, counts = _slot_sums(rows, slots)
    shard_of = balanced_map(spark, sizes, shards, slots, store).shard_of
    begin, at = [0] * shards, []
    for slot in range(slots):
        at.append((slot, shard_of[slot], begin[shard_of[slot]]))
        begin[shard_of[slot]] += counts[slot]
    places = spark.createDataFrame(at, "virtual_slot int, shard int, first long")
    parts = max(1, -(-sum(counts) // (slots * PART_ROWS)))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("crc", "size", "id", F.lit(1)), F.lit(parts)).cast("int"))
    if parts > 1:
        earlier = Window.partitionBy("virtual_slot").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        offsets = rows.groupBy("virtual_slot", "part").agg(F.sum("copies").alias("n")).withColumn("skip", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
        rows = rows.join(offsets, ["virtual_slot", "part"])
    else:
        rows = rows.withColumn("skip", F.lit(0))
    before = Window.partitionBy("virtual_slot", "part").orderBy("id", "size", "crc").rowsBetween(Window.unboundedPreceding, -1)
    ranked = rows.withColumn("start", F.coalesce(F.sum("copies").over(before), F.lit(0)))
    out = ranked.join(F.broadcast(places), "virtual_slot")
    out = out.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / COPIES))))  # no array holds all copies
    if rows.filter(F.col("copies") > COPIES).limit(1).count():
        # the runs of one record are made by many tasks; as many as that, for a run is a small row until its copies are made
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sum(counts) // TASK_ROWS))
        out = out.repartition(tasks, "virtual_slot", "crc", "size", "id", "run")
    out = out.withColumn("k", F.explode(F.sequence(F.col("run") * COPIES, F.least("copies", (F.col("run") + 1) * COPIES) - 1)))
    place = (F.col("first") + F.col("skip") + F.col("start") + F.col("k")).cast("long")
    return out.select(F.col("id").alias(key), "size", F.col("crc").alias("text_crc32"), "shard", place.alias("slot"))


def with_shards(texts: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 8, slots: int = SLOTS, store: str | None = None) -> DataFrame:
    """The input rows, all columns, plus virtual_slot and shard by the map in store. Texts are not shuffled: the map is SLOTS rows."""
    spark = texts.sparkSession
    slot = virtual_slot(F.col(key), F.col(text), slots)
    sums = texts.select(record_size(F.col(text)).alias("size"), slot.alias("virtual_slot"), F.lit(1).alias("copies"))
    slot_map = balanced_map(spark, _slot_sums(sums, slots)[0], shards, slots, store)
    at = spark.createDataFrame(list(enumerate(slot_map.shard_of)), "virtual_slot int, shard int")
    kept = [c for c in texts.columns if c not in ("shard", "virtual_slot")]
    return texts.select(*kept, slot.alias("virtual_slot")).join(F.broadcast(at), "virtual_slot").select(*kept, "virtual_slot", "shard")

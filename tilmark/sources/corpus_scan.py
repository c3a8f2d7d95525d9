"""A nested corpus document of any size, cut into verses by many tasks.

Spark's text reader splits the file at closing braces, so every split begins behind one, maybe inside a text. A first pass finds for each split how
many quotes are in it, modulo two, and how much deeper it ends, both if it begins outside a text and if inside. Sums over the splits before (one narrow row each) say
how each begins. In the second pass a split that knows its start cuts itself at clean points, behind braces that leave depth 2 or less: what lies between two of
them is read at once. The ends, up to the first clean point and from the last, are seams; those of neighbouring splits, and of splits without a clean point, are joined and
read the same way. A verse before whose key no surah's key came in its split belongs to the last one of the splits before.

The rows are those of tilmark.sources.corpus.flatten_nested: a repeated key keeps its first place and its last value. A document that is not one
JSON object is an error. Several files are read as one document each, whose keys meet, in the order of their paths.
"""

from __future__ import annotations

import contextlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilmark.plans import store

SURAHS, AYAHS = 1, 2
#: Bytes of a document that a task reads at least, if that leaves every core its share.
TASK_BYTES = 1 << 25
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\],:]', re.DOTALL)
_ESCAPE = re.compile(r"\\.", re.DOTALL)
_EVENTS = "path string, unit long, n int, surah string, ayah string, value string"
_CUTS = f"{_EVENTS}, piece long, place int, begins boolean, depth int, text string"


def depths(text: str) -> tuple[int, int, int]:
    """Quotes modulo two, and how much deeper a text ends if it begins outside a string, and inside one."""
    parts = _ESCAPE.sub("", text).split('"') if "\\" in text else text.split('"')
    deeper = [0, 0]
    for i, part in enumerate(parts):
        deeper[i % 2] += part.count("{") + part.count("[") - part.count("}") - part.count("]")
    return (len(parts) - 1) % 2, deeper[0], deeper[1]


def events(text: str, depth: int) -> Iterator[tuple[str | None, str | None, str | None]]:
    """(surah key, None, None) for a surah, (None, ayah key, value) for an ayah, in order, of a text between two clean points; depth: at its begin."""
    key, begin, last = None, None, None  # the ayah's key, where its value begins, the last string
    for token in _TOKEN.finditer(text):
        sign = token[0]
        if sign[0] == '"':
            last = sign
        elif sign == ":":
            if depth == SURAHS:
                yield json.loads(last, strict=False), None, None
            elif depth == AYAHS and key is None:
                key, begin = json.loads(last, strict=False), token.end()
        elif sign in "{[":
            depth += 1
        else:
            if key is not None and depth == AYAHS:
                yield None, key, text[begin : token.start()]
                key = None
            if sign != ",":
                depth -= 1
    if key is not None:
        yield None, key, text[begin:]


def _records(spark: SparkSession, path: str, split: int | None) -> DataFrame:
    """Texts up to a closing brace. Of small splits, a task reads several, one after the other."""
    lines = spark.read.option("lineSep", "}").text(path)
    if split:
        splits = lines.rdd.getNumPartitions()
        lines = lines.coalesce(max(1, min(splits, spark.sparkContext.defaultParallelism), -(-splits * split // TASK_BYTES)))
    return lines.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_size").alias("size"))


def _splits(records: DataFrame) -> DataFrame:
    """(path, start, size, quotes, outside, inside, bytes) of each split, written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, found = None, None
        for batch in batches:
            for value, *split in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if split != at:
                    if at is not None:
                        yield _row(at, found)
                    at, found = split, [0, 0, 0, 0]
                q, *deeper = depths(value + "}")
                turned = found[0]
                found = [turned ^ q, found[1] + deeper[turned], found[2] + deeper[1 - turned], found[3] + len(value.encode()) + 1]
        if at is not None:
            yield _row(at, found)

    def _row(at: list, found: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({n: pa.array([v], pa.string() if n == "path" else pa.int64()) for n, v in zip(("path", "start", "size", "quotes", "outside", "inside", "bytes"), (*at, *found), strict=True)})

    return store.written(records.mapInArrow(run, "path string, start long, size long, quotes long, outside long, inside long, bytes long"), "splits")


def _begins(splits: DataFrame) -> DataFrame:
    """(path, start, piece, within, depth): how each split begins."""
    order = Window.partitionBy("path").orderBy("start")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    within = splits.select("path", "start", F.row_number().over(order).cast("long").alias("number"), (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2).alias("within"), "outside", "inside", "quotes", "size", "bytes")
    deeper = F.when(F.col("within") == 1, F.col("inside")).otherwise(F.col("outside"))
    return within.select("path", "start", (F.col("number") - 1).alias("piece"), "within", F.coalesce(F.sum(deeper).over(before), F.lit(0)).alias("depth"), deeper.alias("deeper"), "quotes", "size", "bytes")


def _check(begins: DataFrame) -> None:
    """A last record without a brace was given one: then the document ends one less deep than it seems."""
    whole = begins.groupBy("path").agg(F.sum("deeper").alias("depth"), F.sum("quotes").alias("quotes"), F.sum("bytes").alias("bytes"), F.max("size").alias("size"))
    bad = whole.filter((F.col("depth") + F.col("bytes") - F.col("size") != 0) | (F.col("quotes") % 2 != 0)).head()
    if bad is not None:
        raise ValueError(f"{bad['path']} is not one JSON object")


def _cuts(records: DataFrame, begins: DataFrame) -> DataFrame:
    """Events of what lies between clean points, and (text not null) the seams."""
    known = records.drop("size").join(F.broadcast(begins.select("path", "start", "piece", "within", "depth")), ["path", "start"])
    names = [c.split()[0] for c in _CUTS.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.string()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, []
        for batch in batches:
            for value, path, piece, within, depth in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (path, piece) != at:
                    if at is not None:
                        rows.append((at[0], None, None, None, None, None, at[1], 1, clean, below, "".join(held)))
                    at, inside, now, clean, below, held, n = (path, piece), within, depth, piece == 0, depth, [], 0
                held.append(value + "}")
                q, *deeper = depths(held[-1])
                now, inside = now + deeper[inside], inside ^ q
                if inside or now > AYAHS:
                    continue
                if clean and piece + n:
                    for surah, ayah, content in events("".join(held), below):
                        rows.append((path, 2 * piece + 1, n, surah, ayah, content, None, None, None, None, None))
                        n += 1
                else:
                    rows.append((path, None, None, None, None, None, piece, 0, clean, below, "".join(held)))
                    n += piece == 0
                clean, below, held = True, now, []
            if rows:
                yield batch_of(rows)
                rows = []
        if at is not None:
            yield batch_of([(at[0], None, None, None, None, None, at[1], 1, clean, below, "".join(held))])

    return store.written(known.select("value", "path", "piece", "within", "depth").mapInArrow(run, _CUTS), "cuts")


def _seams(cuts: DataFrame) -> DataFrame:
    """Events of the seams, as units before those of the split that they end in."""
    ends = cuts.filter("text is not null")
    order = Window.partitionBy("path").orderBy("piece", "place")
    group = ends.select("path", "piece", "place", F.sum(F.col("begins").cast("int")).over(order).alias("seam"))
    each = F.array_sort(F.collect_list(F.struct("piece", "place", "text")))
    joined = ends.join(group, ["path", "piece", "place"]).groupBy("path", "seam").agg(F.max(F.when(F.col("begins"), F.col("depth"))).alias("depth"), F.max("piece").alias("piece"), F.array_join(F.transform(each, lambda x: x["text"]), "").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(path, 2 * piece, n, *event) for path, piece, depth, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) for n, event in enumerate(events(text, depth))]
            if rows:
                kinds = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[c.split()[0] for c in _EVENTS.split(", ")])

    return joined.select("path", "piece", F.coalesce("depth", F.lit(0)).alias("depth"), "text").mapInArrow(run, _EVENTS)


@contextlib.contextmanager
def _split_size(spark: SparkSession, size: int | None) -> Iterator[None]:
    """Files are split to about `size` bytes meanwhile; None: as the session says."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    was = {n: spark.conf.get(n) for n in names} if size else {}
    for n, v in zip(was, (size, 0), strict=False):
        spark.conf.set(n, v)
    try:
        yield
    finally:
        for n, v in was.items():
            spark.conf.set(n, v)


def scan_nested(spark: SparkSession, path: str, split: int | None = None) -> DataFrame:
    """(surah_pos, ayah_pos, surah, ayah, original) of the nested document in a file that all executors see. split: bytes of a split, if not the session's."""
    with store.step(), _split_size(spark, split):
        records = _records(spark, path, split)
        begins = store.written(_begins(_splits(records)), "begins")
        _check(begins)
        cuts = _cuts(records, begins)
        found = store.written(cuts.filter("unit is not null").select(*[c.split()[0] for c in _EVENTS.split(", ")]).unionByName(_seams(cuts)), "events")
        files = found.select("path").distinct().select("path", F.row_number().over(Window.orderBy("path")).alias("file"))
        placed = found.join(F.broadcast(files), "path").withColumn("pos", F.struct("file", "unit", "n"))
        members = placed.filter("surah is not null").select("file", "unit", "n", "pos", "surah")
        # which surah a verse is of: the last key before it in its unit, else in the units before
        in_unit = Window.partitionBy("file", "unit").orderBy("n")
        held = placed.withColumn("own", F.last(F.when(F.col("surah").isNotNull(), F.struct("pos", "surah")), ignorenulls=True).over(in_unit)).filter("ayah is not null")
        last = placed.groupBy("file", "unit").agg(F.max_by(F.when(F.col("surah").isNotNull(), F.struct("pos", "surah")), F.when(F.col("surah").isNotNull(), F.col("n"))).alias("last"))
        before = last.select("file", "unit", F.last("last", ignorenulls=True).over(Window.partitionBy("file").orderBy("unit").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
        of = held.join(before, ["file", "unit"]).select("pos", "ayah", "value", F.coalesce("own", "before").alias("m"))
        kept = members.groupBy("surah").agg(F.min("pos").alias("surah_pos"), F.max("pos").alias("m_pos"))
        verses = of.join(kept, (F.col("m.surah") == F.col("surah")) & (F.col("m.pos") == F.col("m_pos")))
        text = F.from_json("value", "struct<text:string>")["text"]
        flat = verses.groupBy("surah_pos", "surah", "ayah").agg(F.min("pos").alias("ayah_pos"), F.max_by(text, "pos").alias("original"))
        return store.result(flat.select("surah_pos", "ayah_pos", F.col("surah").cast("int").alias("surah"), F.col("ayah").cast("int").alias("ayah"), "original"), "verses")

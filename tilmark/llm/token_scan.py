"""Token counts of documents in flat, unindexed token streams, by a separator scan.

A token file is a run of little-endian unsigned 16-bit ids; a document ends with the end-of-document id. There is
no index. Files are scanned in blocks that ignore document bounds: in each block a vectorised search finds the
separators, which gives the lengths inside the block, the tokens before its first separator and those after its
last. A prefix scan over a file's blocks (sums of tokens and separators, and the last separator so far) stitches
documents that cross blocks, however many blocks they span.

Sources of blocks, rows (file, block, data): flat_files reads binary files in ranges of RANGE_BYTES, each of which is a row that any task can take, so that
a file of any size is read by many; write_streams tokenises texts into
streams, one per input partition, each with the ids of its documents in order beside it.

Defined cases: a null or empty text is a document of no tokens; text that looks like a special token is
ordinary text; tokens after a file's last separator are a last document, marked as not ended; an empty file has no
documents; a file that is no whole number of tokens is an error; a very long text is tokenised whole; equal texts are counted each; repeated rows and rows with a null id are documents of their own; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tilmark.llm import textvec as tv
from tilmark.llm.runtime import written

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
EOD = 50256
BLOCK_TOKENS = 1 << 16
RANGE_BYTES = 64_000_000
TOKEN = np.dtype("<u2")
#: Fixed value: how the vocabulary's byte-level pairs split text into pre-tokens.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoding(vocabulary: bytes):
    """The byte-pair encoding of a vocabulary file's content."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, vocabulary.splitlines()))}
    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def check_vocabulary(vocabulary: bytes, eod: int) -> None:
    """Ids must fit a token, and the end-of-document id must be free."""
    ids = {int(line.split()[1]) for line in vocabulary.splitlines() if line}
    if max(ids | {eod}) > np.iinfo(TOKEN).max:
        raise ValueError(f"ids over {np.iinfo(TOKEN).max} do not fit a token of {TOKEN.itemsize} bytes")
    if eod in ids:
        raise ValueError(f"the vocabulary uses the end-of-document id {eod}")


def encode(texts: list[str | None], vocabulary: bytes, eod: int = EOD) -> np.ndarray:
    """The texts' ids, each text followed by the end-of-document id."""
    coder = encoding(vocabulary)
    out: list[int] = []
    for text in texts:
        out += coder.encode_ordinary(text or "")
        out.append(eod)
    return np.array(out, TOKEN)


def write_streams(texts: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, eod: int = EOD, block: int = BLOCK_TOKENS) -> tuple[DataFrame, DataFrame]:
    """Tokenised streams: blocks (file, block, data) and documents (file, number, key)."""
    with open(vocabulary, "rb") as f:
        content = f.read()
    check_vocabulary(content, eod)
    held = texts.schema[key].dataType
    own_id = to_arrow_type(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, number, made, left = TaskContext.get().partitionId(), 0, 0, np.empty(0, TOKEN)

        def blocks(stream: np.ndarray) -> pa.RecordBatch:
            nonlocal made
            parts = [stream[a : a + block].tobytes() for a in range(0, len(stream), block)]
            made += len(parts)
            return batch_of([file] * len(parts), list(range(made - len(parts), made)), parts, [None] * len(parts))

        for batch, own in tv.chunks(batches):
            ids = batch.column(0).to_pylist()
            yield batch_of([file], [number], [None], [ids])
            number += len(ids)
            stream = np.concatenate((left, encode(own, content, eod)))
            whole = len(stream) - len(stream) % block
            if whole:
                yield blocks(stream[:whole])
            left = stream[whole:]
        if len(left):
            yield blocks(left)

    def batch_of(file: list, at: list, data: list, ids: list) -> pa.RecordBatch:
        kinds = pa.int64(), pa.int64(), pa.binary(), pa.list_(own_id)
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip((file, at, data, ids), kinds, strict=True)], names=["file", "at", "data", "ids"])

    plain = texts.select(F.col(key).alias("id"), F.col(text).alias("text"))
    stored = written(plain.mapInArrow(run, f"file long, at long, data binary, ids array<{held.simpleString()}>"), "tokens")
    documents = stored.filter("ids is not null").select("file", "at", F.posexplode("ids").alias("place", key))
    return stored.filter("data is not null").select("file", F.col("at").alias("block"), "data"), documents.select("file", (F.col("at") + F.col("place")).alias("number"), key)


def flat_files(spark: SparkSession, path: str, block: int = BLOCK_TOKENS, span: int = RANGE_BYTES) -> DataFrame:
    """Blocks (file, block, data) of the binary token files in a folder, or of one file, on any file system that pyarrow opens, which all executors see.
    Listed are names and sizes only."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    listed = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(where)
    sizes = sorted((f.getPath().toString(), f.getLen()) for f in listed if f.isFile() and not f.getPath().getName().startswith(("_", ".")))
    for file, size in sizes:
        if size % TOKEN.itemsize:
            raise ValueError(f"{file} is no whole number of tokens")
    step = block * TOKEN.itemsize
    span = max(step, span - span % step)
    ranges = [(file, at, min(span, size - at)) for file, size in sizes for at in range(0, size, span)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, at, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                system, name = FileSystem.from_uri(file if "://" in file else f"file://{file.removeprefix('file:')}")
                with system.open_input_file(name) as f:
                    f.seek(at)
                    for place in range(at, at + length, step):
                        data = f.read(min(step, at + length - place))
                        yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([place // step], pa.int64()), pa.array([data], pa.binary())], names=["file", "block", "data"])

    rows = spark.createDataFrame(ranges, "file string, at long, length long")
    return rows.repartition(max(1, len(ranges))).mapInArrow(run, "file string, block long, data binary")


def scan_block(data: bytes, eod: int) -> tuple[int, list[int]]:
    """Tokens of a block and the places of its separators."""
    ids = np.frombuffer(data, TOKEN)
    return len(ids), np.flatnonzero(ids == eod).tolist()


def scan_tokens(blocks: DataFrame, eod: int = EOD) -> DataFrame:
    """One row per document: file, number (from 0), start (token offset in the file), n_tokens and ended."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scan_block(d, eod) for d in batch.column(2).to_pylist()]
            kinds = pa.int64(), pa.list_(pa.int64())
            columns = [pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["file", "block", "size", "seps"])

    kind = blocks.schema["file"].dataType.simpleString()
    scanned = blocks.select("file", "block", "data").mapInArrow(run, f"file {kind}, block long, size long, seps array<long>")
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    stitched = (
        scanned.withColumn("begin", F.coalesce(F.sum("size").over(before), F.lit(0)))
        .withColumn("next", F.col("begin") + F.try_element_at("seps", F.lit(-1)) + 1)
        .withColumns({"open": F.coalesce(F.max("next").over(before), F.lit(0)), "number": F.coalesce(F.sum(F.size("seps")).over(before), F.lit(0)), "final": F.lead("block").over(order).isNull()})
    )
    ends = F.transform("seps", lambda at: F.col("begin") + at)
    open_end = F.col("begin") + F.col("size")
    unended = F.col("final") & (open_end > F.coalesce("next", "open"))
    cut = stitched.select("file", "open", "number", F.size("seps").alias("whole"), F.concat(ends, F.when(unended, F.array(open_end)).otherwise(F.array().cast("array<long>"))).alias("ends"))
    spans = F.transform("ends", lambda end, i: F.struct(F.when(i == 0, F.col("open")).otherwise(F.get("ends", i - 1) + 1).alias("start"), end.alias("end")))
    each = cut.select("file", "number", "whole", F.posexplode(spans).alias("place", "d"))
    return each.select("file", (F.col("number") + F.col("place")).cast("long").alias("number"), F.col("d.start").alias("start"), (F.col("d.end") - F.col("d.start")).alias("n_tokens"), (F.col("place") < F.col("whole")).alias("ended"))


def count_tokens(texts: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per input row: the key, file, start and n_tokens of the document in its stream."""
    blocks, documents = write_streams(texts, key, text, vocabulary)
    return documents.join(scan_tokens(blocks), ["file", "number"]).select(key, "file", "start", "n_tokens")

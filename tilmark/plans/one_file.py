"""One ordered file of a table: ranges of its key are sorted and made bytes by a task each; as a file has one writer, one task then copies those bytes, some at a time."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilmark.plans import store

#: Bytes that are copied at a time.
COPIED = 1 << 22


def _file(path: str) -> tuple[FileSystem, str]:
    return FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")


def opened(path: str) -> BinaryIO:
    system, name = _file(path)
    return system.open_input_file(name)


def created(path: str) -> BinaryIO:
    system, name = _file(path)
    system.create_dir(name.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(name)


def sorted_bytes(rows: DataFrame, folder: str, encode: Callable[[pa.Array], bytes]) -> DataFrame:
    """rows (a key, a value) in the order of the key as files of bytes in a folder; written as (key, path, n: rows of the file)."""
    key, value = rows.columns

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, n = f"{folder}/{uuid.uuid4().hex}", 0
        with contextlib.ExitStack() as file:
            for batch in batches:
                if not len(batch):
                    continue
                if not n:
                    first, out = batch.column(0).slice(0, 1), file.enter_context(created(own))
                out.write(encode(batch.column(1)))
                n += len(batch)
        if n:
            yield pa.RecordBatch.from_arrays([first, pa.array([own]), pa.array([n], pa.int64())], names=["key", "path", "n"])

    return store.written(rows.repartitionByRange(key).sortWithinPartitions(key).mapInArrow(ranges, f"key {rows.schema[key].dataType.simpleString()}, path string, n long"), "parts")


def joined(parts: DataFrame, name: str, begin: bytes, end: bytes = b"", suffix: str = "") -> str:
    """Such files as one, between two pieces of bytes; its path, which begins with a name. A repeated task's own file has another path."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = f"{name}-{uuid.uuid4().hex}{suffix}"
        with created(own) as out:
            out.write(begin)
            for batch in batches:  # one row: the paths in order
                for path in batch.column(0)[0].as_py():
                    with opened(path) as f:
                        while some := f.read(COPIED):
                            out.write(some)
            out.write(end)
        yield pa.RecordBatch.from_pydict({"path": [own]})

    ordered = parts.agg(F.array_sort(F.collect_list(F.struct("key", "path"))).alias("p")).select("p.path")
    return store.written(ordered.mapInArrow(whole, "path string"), "joined").head()["path"]

"""Tables written to the folder that all executors share, so that later plans start from files whatever executors are lost."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """A folder that all executors see: in spark.checkpoint.dir, or in local mode a temporary one."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if where is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tilmark-"))
        where = spark.sparkContext.getCheckpointDir()
    return f"{where.rstrip('/')}/tilmark"


_made: ContextVar[list[tuple[SparkSession, str]] | None] = ContextVar("tilmark_made", default=None)


def fresh(spark: SparkSession, name: str) -> str:
    """The path of a folder that nothing else uses; of the step around it, if there is one."""
    path = f"{shared(spark)}/{name}-{uuid.uuid4().hex}"
    if (made := _made.get()) is not None:
        made.append((spark, path))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written once as Parquet and read back."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def rename(spark: SparkSession, file: str, to: str) -> None:
    paths = [spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p) for p in (file, to)]
    if not paths[1].getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).rename(*paths):
        raise OSError(f"{file} could not be renamed {to}")


@contextlib.contextmanager
def step() -> Iterator[None]:
    """Folders that are made meanwhile are deleted at the end. What is to outlast them is written outside, or kept() by its path."""
    made: list[tuple[SparkSession, str]] = []
    around = _made.set(made)
    try:
        yield
    finally:
        _made.reset(around)
        for spark, path in made:
            delete(spark, path)


def result(df: DataFrame, name: str) -> DataFrame:
    """df, written inside a step() and kept after it."""
    out = written(df, name)
    if (made := _made.get()) is not None:
        made.pop()
    return out


def commit_once(spark: SparkSession, mark: str, content: str) -> bool:
    """Make a file with this content, if there is none of that name: a whole file gets the name in one step that fails where it is taken. On a local or mounted file system the
    step is a hard link, elsewhere a rename, which HDFS refuses where the name is taken; an object store must refuse it too."""
    jvm = spark.sparkContext._jvm
    at, to = (jvm.org.apache.hadoop.fs.Path(p) for p in (f"{mark}.{uuid.uuid4().hex}", mark))
    files = to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = files.create(at, False)
    out.writeBytes(content)
    out.close()
    try:
        if files.getScheme() != "file":
            return bool(files.rename(at, to))
        os.link(at.toUri().getPath(), to.toUri().getPath())
        return True
    except FileExistsError:
        return False
    finally:
        files.delete(at, False)


def committed(spark: SparkSession, mark: str) -> str | None:
    """The content of such a file, or null if there is none."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(mark)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.text(mark, wholetext=True).head()["value"]

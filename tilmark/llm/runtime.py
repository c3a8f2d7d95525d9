"""Lineage cuts that survive lost executors: tables written to the folder named by spark.checkpoint.dir.

Tables belong to the run that makes them: `owned` gives a function a run of its own, and what its result does not read
is deleted when it returns. A result that is still to be computed keeps the tables it reads.
"""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Only where it is unset in local mode (tests), a temporary folder that is then set."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tilmark-"))
    return sc.getCheckpointDir().rstrip("/")


class Tables:
    """The written tables of one run."""

    def __init__(self) -> None:
        self.made: list[tuple[SparkSession, str]] = []

    def keep(self, *frames: DataFrame) -> None:
        """Delete the run's tables that none of these frames reads. Only when no other plan over them is left to run."""
        read = {f.rsplit("/", 1)[0].rsplit("/", 1)[1] for frame in frames for f in frame.inputFiles()} if self.made else set()
        for spark, path in self.made:
            if path.rsplit("/", 1)[1] not in read:
                _delete(spark, path)
        self.made = [(spark, path) for spark, path in self.made if path.rsplit("/", 1)[1] in read]


_run: ContextVar[Tables | None] = ContextVar("tilmark_tables", default=None)


@contextlib.contextmanager
def tables() -> Iterator[Tables]:
    """A run: tables that are written meanwhile belong to it. What it still has at its end goes to the run around it."""
    own, around = Tables(), _run.get()
    token = _run.set(own)
    try:
        yield own
    finally:
        _run.reset(token)
        if around is not None:
            around.made += own.made


def owned(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """f, in a run of its own. Intermediate tables that its result does not read are gone when it returns."""

    @functools.wraps(f)
    def call(*args: object, **named: object) -> DataFrame:
        with tables() as own:
            out = f(*args, **named)
            own.keep(out)
            return out

    return call


#: Rows of an Arrow batch while a table is written. A batch of whole texts is held several times over, in the JVM and in
#: Python. A session that has set the number itself keeps it.
BATCH_ROWS = 2000
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextlib.contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    was = spark.conf.get(_ROWS, "10000")
    if was != "10000":
        yield
        return
    spark.conf.set(_ROWS, BATCH_ROWS)
    try:
        yield
    finally:
        spark.conf.set(_ROWS, was)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet under the shared folder and read it back: later plans start from files."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tilmark/{name}-{uuid.uuid4().hex}"
    run = _run.get()
    if run is not None:
        run.made.append((spark, path))
    with _small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def dropped(df: DataFrame) -> None:
    """Delete the files behind a written() table that no later plan reads."""
    for file in df.inputFiles()[:1]:
        folder = file.rsplit("/", 1)[0]
        if "/tilmark/" in folder:
            _delete(df.sparkSession, folder)


def dropped_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder of a run's own under the shared one."""
    if "/tilmark/" in folder:
        _delete(spark, folder)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

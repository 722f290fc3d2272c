"""The shared folder, written tables and Python code on executors."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of an Arrow batch; one longer row is a batch.
BATCH_ROWS = 1000
BATCH_BYTES = 16 << 20


#: Lists that tracked() is filling.
_tracking: ContextVar[tuple[list[str], ...]] = ContextVar("tracking", default=())


@contextmanager
def tracked() -> Iterator[list[str]]:
    """A list that gets the folders made inside, by this thread."""
    folders: list[str] = []
    token = _tracking.set((*_tracking.get(), folders))
    try:
        yield folders
    finally:
        _tracking.reset(token)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session may go without that setting; it then gets a temporary folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        java = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = java.get() if java.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        found = "file://" + tempfile.mkdtemp(prefix="docgrain-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    """A folder of its own below the shared one; clean() deletes it."""
    made = f"{shared_dir(spark)}/docgrain-{name}-{uuid.uuid4().hex}"
    context = spark.sparkContext
    context._docgrain_dirs = [*getattr(context, "_docgrain_dirs", ()), made]
    for folders in _tracking.get():
        folders.append(made)
    return made


def made(spark: SparkSession) -> list[str]:
    """The folders that this context has made so far."""
    return list(getattr(spark.sparkContext, "_docgrain_dirs", ()))


def clean(spark: SparkSession, folders: list[str] | None = None, but: DataFrame | None = None) -> int:
    """Deletes the folders that this context has made, or those of them that are listed, and with them the results that
    still read them; folders that ``but`` reads stay."""
    context = spark.sparkContext
    gone = made(spark) if folders is None else [x for x in made(spark) if x in set(folders)]
    if but is not None and gone:
        read = {name for f in but.inputFiles() for name in f.split("/") if name.startswith("docgrain-")}
        gone = [x for x in gone if x.rpartition("/")[2] not in read]
    context._docgrain_dirs = [x for x in made(spark) if x not in set(gone)]
    for folder in gone:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    return len(gone)


def put(df: DataFrame, path: str, codec: str | None = None) -> DataFrame:
    """``df`` as a Parquet table at ``path``, compressed by ``codec`` (the session's)."""
    (df.write if codec is None else df.write.option("compression", codec)).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends here and its size is known to the planner."""
    return put(df, new_dir(df.sparkSession, name), codec)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing refers to any more, which it does when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt to all cores if it comes in fewer parts than there are cores, as one small file does.

    A table of many files has more parts than cores and stays as it is: nothing large is shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once a context; they need not have it installed.

    Also bounds what Spark holds for a Python worker at a time: Arrow batches get BATCH_ROWS rows and BATCH_BYTES bytes
    at the most, for the rest of the session, as plans read the setting when they run. Smaller settings stay.
    """
    for setting, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        if not 0 < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(setting)) <= most:
            spark.conf.set(setting, str(most))
    context = spark.sparkContext
    if getattr(context, "_docgrain_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="docgrain-")), "docgrain_package.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    context.addPyFile(target)
    context._docgrain_shipped = True


def trim() -> None:
    """Gives freed memory back to the system: a worker that waits for its next task should hold none."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def map_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow() with this package on the executors."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            trim()

    return df.mapInArrow(run, schema)


def on_group(function: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """For applyInArrow() of groups."""

    def run(table: pa.Table) -> pa.Table:
        try:
            return function(table)
        finally:
            trim()

    return run


def on_batches(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For applyInArrow() of groups whose results come in parts; such functions are told by their annotations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            trim()

    run.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return run


def on_cogroup(function: Callable[[pa.Table, pa.Table], pa.Table]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """For applyInArrow() of two sides' groups."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return function(left, right)
        finally:
            trim()

    return run

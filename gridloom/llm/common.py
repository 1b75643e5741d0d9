"""What the operators share: where lineage is cut, and how arrays come back from Arrow functions."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: what the session names in spark.checkpoint.dir.

    Where that is unset and Spark runs in this process alone, as in tests, a temporary one
    is made; on a cluster it is an error, as executors can't read the driver's disk.
    """
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="gridloom-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def settle(df: DataFrame) -> DataFrame:
    """The same rows, computed once and written to the shared folder.  For tables of numbers."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of numbers that are worth a task of their own.
PER_TASK = 1 << 18


def narrow(df: DataFrame, rows: int | None = None, each: int = PER_TASK) -> DataFrame:
    """The same rows in no more partitions than one for each ``each`` of them, without a shuffle.

    rows, if the number isn't known, is counted, so df should then be settled.  Large tables keep
    their partitions; small ones don't leave hundreds of tiny files at every step.
    """
    return df.coalesce(max(1, -(-(df.count() if rows is None else rows) // each)))


def new_folder(spark: SparkSession, kind: str) -> str:
    """The name of a folder that isn't there yet, in the shared one."""
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def stored(df: DataFrame, compression: str = "snappy", path: str | None = None) -> DataFrame:
    """The same rows, written as Parquet in the shared folder and read again.  For tables with texts; drop() deletes them."""
    path = path or new_folder(df.sparkSession, "table")
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.parquet(path)


#: Bytes of a batch of rows on its way to Python, unless the session says otherwise.
BATCH = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; batches of its rows are then held to BATCH bytes, so that long texts don't come by the thousand."""
    size = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark._jsparkSession.sessionState().conf().contains(size):
        spark.conf.set(size, BATCH)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop(spark: SparkSession, path: str) -> None:
    """Delete a folder of stored() or of checkpoints; nothing happens if there is none."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def _trim() -> None:
    """Give free memory back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, whose worker doesn't hold on to the memory its batches took: workers are used again, task after task."""

    @wraps(run)
    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(batches):
            yield batch
            del batch
        _trim()

    return own

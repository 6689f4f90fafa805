"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseframe.sources.storage import delete, fresh_path

_scopes: list[list[str]] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it goes when the session ends, if not before."""
    path = fresh_path(spark, name)
    for scope in _scopes:
        scope.append(path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """What is written to scratch paths in here goes at the end; results must be written elsewhere by then."""
    _scopes.append([])
    try:
        yield
    finally:
        delete(spark, *_scopes.pop())


@contextmanager
def setting(spark: SparkSession, name: str, value: str):
    """Queries that run in here run under the setting; the former one comes back."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def shuffle_files_go_at_the_end(spark: SparkSession):
    """Shuffle files of queries that run in here are deleted when the query ends: what they write needs them no more."""
    return setting(spark, _CLEANUP, "true")


def small_batches(spark: SparkSession, rows: int = 1000):
    """Arrow hands Python so many rows at once, so that neither side holds more than a few megabytes of common texts and the longest one."""
    return setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    It cuts lineage, survives lost executors, and the size of the files is known to
    the planner, so that joins with small tables broadcast under the size threshold.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    with shuffle_files_go_at_the_end(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the files of materialized frames that nothing reads any more."""
    for df in frames:
        delete(df.sparkSession, df._scratch)


def fresh(name: str, *frames: DataFrame) -> str:
    """name, with underscores ahead until no frame has a column called so (Spark's names know no case)."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


#: Rows that a table may have to be broadcast; callers keep their rows to a few hundred bytes.
MAX_BROADCAST = 1 << 18


def small(df: DataFrame, most: int = MAX_BROADCAST) -> DataFrame:
    """df, marked for broadcast if it has been counted to at most so many rows; else the planner joins it as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def give_back() -> None:
    """Memory that Python and Arrow hold without need goes back to the system: workers outlive their tasks and stand beside those of later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # other C libraries than glibc have no such call
        ctypes.CDLL(None).malloc_trim(0)


def freed(batches: Iterator) -> Iterator:
    """The batches of a task; what Arrow holds of earlier ones without need goes back to the system ahead of each, and all else at the end."""
    for batch in batches:
        yield batch
        del batch
        pa.default_memory_pool().release_unused()
    give_back()


def text_or_empty(column: str | Column = "text") -> Column:
    """The text, where null counts as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")

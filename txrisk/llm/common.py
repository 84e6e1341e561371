"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txrisk.storage import discard, stash  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def whole(text: Column) -> Column:
    """Null texts count as empty."""
    return F.coalesce(text, F.lit(""))


#: Columns of ``keyed``: which row this is.
KEY = ["_file", "_at"]


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` packed in a struct ``r``, with a key (``_file``, ``_at``) that is unique and the same in every pass.

    A frame that is read straight from files has one already: the file and the row's place in it, so
    no text is written again.  Rows of any other frame are written to the shared folder with numbers.
    """
    row = F.struct("*").alias("r")
    plan = docs._jdf.queryExecution().analyzed().getClass().getSimpleName()
    if plan == "LogicalRelation" and "_metadata" not in docs.columns and docs.columns:
        path = F.col("_metadata.file_path")
        names = docs.select(path.alias("path")).distinct()
        if not names.groupBy(F.xxhash64("path").alias("h")).count().where("count > 1").limit(1).count():
            return docs.select(row, F.xxhash64(path).alias("_file"), F.col("_metadata.row_index").alias("_at"))
    return stash(docs.select(row, F.lit(0).cast("long").alias("_file"), F.monotonically_increasing_id().alias("_at")))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Short runs of Arrow batches, so that few texts are Python objects at a time."""
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """What runs inside exchanges at most ``rows`` rows at a time with Python: a batch is held in both processes of a task."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: What empties the caches that operators keep in a Python worker.
CACHES: list[Callable[[], None]] = []


def forget() -> None:
    """Give back what the operators before have left in this worker, which serves all stages of a session in turn."""
    for clear in CACHES:
        clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)

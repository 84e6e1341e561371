"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_own_dirs: dict[str, str] = {}
#: Folders that ``stash`` has written and nobody has discarded, with the session and thread of each.
_written: dict[str, tuple[SparkSession, int]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the cluster's ``spark.checkpoint.dir``.  Only where that is unset and all tasks run in the
    driver's own process (tests) a folder of our own is made; a cluster without the setting is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="txrisk-")
    return _own_dirs[app]


def new_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/txrisk-{uuid.uuid4().hex}"


def stash(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage in a way that a lost executor cannot undo, gives the next plan true
    sizes, and makes values such as row numbers stable.  ``discard`` deletes the table once nothing
    reads it; what is left goes when the driver ends.
    """
    spark = df.sparkSession
    path = new_path(spark)
    df.write.parquet(path)
    _written[path] = spark, threading.get_ident()
    out = spark.read.schema(df.schema).parquet(path)
    out.stash_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete stashed tables that no later plan reads."""
    for t in tables:
        _delete(t.stash_path)


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """What this thread stashes inside goes at the end: write the result down before."""
    before = set(_written)
    yield
    for path, (_, thread) in list(_written.items()):
        if path not in before and thread == threading.get_ident():
            _delete(path)


def _delete(path: str) -> None:
    spark, _ = _written.pop(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _delete_all() -> None:
    for path in list(_written):
        with contextlib.suppress(Exception):  # the session may have ended before
            _delete(path)

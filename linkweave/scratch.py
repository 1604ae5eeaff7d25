"""Intermediate tables in the folder that all executors share.

A lost executor must not lose an intermediate result, so lineage is cut with
Parquet tables below ``spark.checkpoint.dir``.  Where a session names no such
folder (tests), one is made next to the warehouse of a local session only.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
#: Tables that are still there, by path.
_STORED: dict[str, DataFrame] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; a local master without one gets its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="linkweave-")
        atexit.register(_remove_local, _OWN[app])
    return "file://" + _OWN[app]


def _remove_local(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


def store(df: DataFrame) -> DataFrame:
    """Write ``df`` below the shared folder and read it again: its lineage ends there.

    What isn't dropped before goes when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/linkweave-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["_stored_at"] = path
    fs, where = _file_system(out, path)
    fs.deleteOnExit(where)
    _STORED[path] = out
    return out


def _file_system(df: DataFrame, path: str):
    where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()), where


def drop(df: DataFrame | None) -> None:
    """Delete what ``store`` wrote; only for tables that no later plan reads."""
    path = None if df is None else df.__dict__.get("_stored_at")
    if path is None:
        return
    fs, where = _file_system(df, path)
    fs.delete(where, True)
    fs.cancelDeleteOnExit(where)
    _STORED.pop(path, None)


@contextmanager
def temporary() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables stored in this block are dropped at its end, but for those given to what it yields."""
    before, kept = set(_STORED), set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df.__dict__["_stored_at"])
        return df

    try:
        yield keep
    finally:
        for path in set(_STORED) - before - kept:
            drop(_STORED[path])

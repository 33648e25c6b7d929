"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import sys
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accordant.session import scratch_path


#: Tables kept by steps that are still going on, innermost last.
_passing: list[list[str]] = []


def _write(df: DataFrame, path: str, codec: str = "snappy") -> None:
    """Write a table, and take away what its plan shuffled as soon as it is there.

    Else shuffled rows stay on the executors' disks until the driver happens to
    collect its garbage, and those of one step lie beside those of the next.
    """
    conf, cleanup = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(cleanup, None)
    conf.set(cleanup, "true")
    try:
        df.write.parquet(path, compression=codec)
    finally:
        if before is None:
            conf.unset(cleanup)
        else:
            conf.set(cleanup, before)


def keep(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write a table to the shared folder and read it back.

    Lineage ends at files that outlive any executor, and the work before them is
    done once however often the table is read.  Tables of texts are smaller with
    the ``codec`` zstd.
    """
    path = scratch_path(df.sparkSession, name)
    _write(df, path, codec)
    if _passing:
        _passing[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keep_alone(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """Keep what a step makes, and take away the tables it kept on the way there."""
    _passing.append([])
    try:
        made = make()
        path = scratch_path(spark, name)
        _write(made, path)
    finally:
        passed = _passing.pop()
    files = spark._jvm.org.apache.hadoop.fs
    for old in passed:
        place = files.Path(old)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    if _passing:
        _passing[-1].append(path)
    return spark.read.schema(made.schema).parquet(path)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def worker_cache(key: Any, make: Callable[[], Any]) -> Any:
    """An object that a Python worker makes once and all its tasks use.

    Functions travel by value, so their own globals start empty in every task.
    """
    store = sys.__dict__.setdefault("_accordant_worker_cache", {})
    if key not in store:
        store[key] = make()
    return store[key]


def text_or_empty(name: str):
    return F.coalesce(F.col(name), F.lit(""))


def shared_uri(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one, as a URI that tasks can open themselves."""
    path = scratch_path(spark, name)
    return path if "://" in path or path.startswith("file:") else f"file://{path}"

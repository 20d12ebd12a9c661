"""Stages of iterative operators, written to the folder that all executors share.

All stages of an application lie below one folder, which is removed when the driver ends; a loop drops a round's stage
as soon as the next one no longer reads it.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

_ROOTS: dict[str, tuple[SparkSession, str]] = {}


def root_folder(spark: SparkSession) -> str:
    """The application's folder below ``spark.checkpoint.dir``; a folder of our own only on one machine (tests)."""
    own = spark.sparkContext.applicationId
    if own not in _ROOTS:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = "file:///tmp/loomspark-checkpoints"  # one machine, as in tests
        _ROOTS[own] = (spark, f"{base.rstrip('/')}/stages-{own}-{uuid.uuid4().hex[:8]}")
    return _ROOTS[own][1]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it lies."""
    context = spark.sparkContext
    own = context._jvm.org.apache.hadoop.fs.Path(path)
    own.getFileSystem(context._jsc.hadoopConfiguration()).delete(own, True)


@atexit.register
def _remove_all() -> None:
    for spark, path in _ROOTS.values():
        try:
            if spark.sparkContext._jsc is not None:
                remove(spark, path)
        except Exception:  # the session is gone already: its folder is left to the cluster's own clearing
            continue


def new_folder(spark: SparkSession) -> str:
    return f"{root_folder(spark)}/{uuid.uuid4().hex}"


def stage(df: DataFrame) -> DataFrame:
    """Write and read back: cuts lineage, survives lost executors, and is read at its real size."""
    spark, path = df.sparkSession, new_folder(df.sparkSession)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stage = path
    return out


def drop(*stages: DataFrame) -> None:
    """Delete stages that nothing reads any more."""
    for df in stages:
        if path := getattr(df, "_stage", None):
            remove(df.sparkSession, path)

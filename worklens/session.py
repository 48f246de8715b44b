"""Spark session settings and cut points between stages."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Shuffled joins hash their smaller side when every partition of it is small.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
    # Partitioned writes keep a file open per value instead of sorting first.
    "spark.sql.maxConcurrentOutputFileWriters": "16",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app_name: str = "worklens", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings every job here assumes.

    Without ``master`` the cluster manager's own choice is kept, so the same
    call works under ``spark-submit``.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession) -> str:
    """Shared folder for cut points: ``spark.checkpoint.dir`` of the session.

    A local-mode session without that setting (tests) gets a fresh folder of
    its own; a cluster session without it is an error, because a folder on one
    machine is lost with that machine.
    """
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if path:
        return path
    if not context.master.startswith("local"):
        raise RuntimeError("Set spark.checkpoint.dir to a folder every executor can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="worklens-"))
    return context.getCheckpointDir()


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


#: Spark deletes a write's shuffle files as soon as it is done; else they lie until the driver collects its garbage.
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Frames and paths of the cut points made inside the innermost ``scratch``.
_made: ContextVar[list[tuple[DataFrame, str]] | None] = ContextVar("cut points", default=None)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of each write inside are deleted once it is done."""
    held = spark.conf.get(_FREE, "false")
    spark.conf.set(_FREE, "true")
    try:
        yield
    finally:
        spark.conf.set(_FREE, held)


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Cut points made inside are deleted at the end, but for those passed to the function it gives.

    Frames that read deleted ones must be written, or be of no more use, by then.
    """
    made, kept, outer = [], [], _made.get()
    token = _made.set(made)

    def keep(frame: DataFrame) -> DataFrame:
        kept.append(frame)
        return frame

    try:
        yield keep
    finally:
        _made.reset(token)
        for frame, path in made:
            if any(frame is k for k in kept):
                if outer is not None:
                    outer.append((frame, path))
            else:
                _delete(frame.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


def materialize(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write a stage result once as Parquet and continue from the files.

    Used where a result feeds several later branches: it is computed once,
    survives the loss of executors, and its file sizes give the planner true
    statistics. Its shuffle files are deleted with the write.
    """
    return materialize_parts([df], name, partition_by)


def materialize_parts(parts: Iterable[DataFrame], name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """The rows of all parts as one cut point; parts are made and written one by one, so each one's shuffle files go before the next."""
    path = None
    for df in parts:
        spark = df.sparkSession
        path = path or new_path(spark, name)
        with shuffles_freed(spark):
            df.write.mode("append").option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    if _made.get() is not None:
        _made.get().append((stored, path))
    return stored


def release(spark: SparkSession) -> None:
    """Delete the cut points of this application once its results are written."""
    _delete(spark, f"{work_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}")

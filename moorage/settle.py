"""Cutting lineage through a table in the cluster's shared checkpoint folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: the session's checkpoint folder.

    Where the session names none, a folder of our own is set if driver and executors are one machine's process
    (``local`` masters, as in tests); on a cluster that is an error, as each executor would write to its own disk.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured is None:
        master = spark.sparkContext.master
        if not re.match(r"local($|\[)", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        configured = tempfile.mkdtemp(prefix="moorage-")
        spark.sparkContext.setCheckpointDir(configured)
    return configured


#: Whether Spark removes an execution's shuffle files at its end.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_SCOPE: ContextVar[list[str] | None] = ContextVar("settled tables of the innermost scope", default=None)


@contextmanager
def settled_for_now(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that are settled inside are deleted at the end: nothing that is still to run may read them.

    What is to outlive them is settled by the function this gives, as a table of the scope around.
    """
    paths: list[str] = []
    outer = _SCOPE.get()
    token = _SCOPE.set(paths)

    def hand_over(df: DataFrame) -> DataFrame:
        inner = _SCOPE.set(outer)
        try:
            return settle(df)
        finally:
            _SCOPE.reset(inner)

    try:
        yield hand_over
    finally:
        _SCOPE.reset(token)
        for path in paths:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of what is written inside go once it is written; else they stay until the driver's memory is collected."""
    conf, before = spark.conf, spark.conf.get(_CLEANUP, "false")
    conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        conf.set(_CLEANUP, before)


def settle(df: DataFrame, *, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as a parquet table and read it back.

    Unlike a cached plan it survives the loss of executors, later readers prune its columns, and
    the optimiser knows its true size: a join against it is broadcast exactly when the files are
    below ``spark.sql.autoBroadcastJoinThreshold`` and shuffled otherwise. The shuffle files behind it are
    removed once it is written, as nothing reads them again. Texts of messages repeat their field names, so the
    files are compressed with zstd.
    """
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/settled-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists").option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if (scope := _SCOPE.get()) is not None:
        scope.append(path)
    with shuffles_removed(df.sparkSession):
        writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

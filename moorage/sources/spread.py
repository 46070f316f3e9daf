"""Using all cores on sources that one task must read."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of input files for which a shuffle begins with one partition more.
_INPUT_PER_PARTITION = 4 * 2**20
_FIRST_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
#: Shuffled bytes, compressed, up to which partitions are merged: rows of a sort by message take some 30 times as much.
_MERGED_BYTES = 16 * 2**20
_MERGED_SIZE = "spark.sql.adaptive.advisoryPartitionSizeInBytes"


_UNITS = {"b": 1, "k": 2**10, "m": 2**20, "g": 2**30}


def _bytes(text: str) -> int:
    """A size as Spark writes it, such as ``64MB``, ``8m`` or ``1024b``."""
    text = text.strip().lower()
    number = text.rstrip("bkmg")
    return int(number) * _UNITS[text[len(number) :][:1] or "b"]


def _size(spark: SparkSession, path: str) -> int:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()


def deal_by_size(spark: SparkSession, paths: Iterable[str]) -> int:
    """Let the session's shuffles begin with partitions in proportion to the files at ``paths``; gives their number.

    A fixed ``spark.sql.shuffle.partitions`` makes what one task sorts grow with the input. Adaptive execution merges
    partitions that turn out small up to its advisory size, so too many cost little and that size bounds a task; it
    is lowered to 16 MB, as numbers and texts of messages are ten to thirty times as large in memory. A smaller one stays.
    """
    size = sum(_size(spark, path) for path in paths)
    first = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // _INPUT_PER_PARTITION))
    spark.conf.set(_FIRST_PARTITIONS, str(first))
    if _bytes(spark.conf.get(_MERGED_SIZE)) > _MERGED_BYTES:
        spark.conf.set(_MERGED_SIZE, f"{_MERGED_BYTES}b")
    return first


#: Bytes of a file from which its split into tasks is looked at: dealing out less costs little.
_LARGE_FILE = 32 * 2**20


def read_by_all(table: DataFrame) -> bool:
    """Whether a large file is read by tasks of about equal shares, enough for all cores; if so, dealing out its rows would only move them.

    Rows are counted per task, from the row groups' heads.
    """
    spark, (file,) = table.sparkSession, table.inputFiles()
    if _size(spark, file) < _LARGE_FILE:
        return False
    rows = [r["count"] for r in table.groupBy(F.spark_partition_id()).count().collect()]  # one row a task
    return max(rows, default=0) * spark.sparkContext.defaultParallelism <= 2 * sum(rows)


def spread(df: DataFrame) -> DataFrame:
    """Rows of a source whose format allows one task per file, dealt to all cores."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)

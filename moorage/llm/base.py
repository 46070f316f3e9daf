"""What the operators of this package share: reading documents, folds, shared folders, Arrow rows."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moorage.settle import settle, settled_for_now, shared_folder

__all__ = ["documents", "fold", "fresh_folder", "map_rows", "map_texts", "may_hold", "prepare_workers", "settle", "settled_for_now", "small_batches", "sorted_distinct", "table", "to_arrow", "worker_cache"]

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


#: What has the C library give freed memory back, and Arrow use it. A worker lives through many stages.
#: It keeps 64 MB for the next arrays: taking every array from the system anew costs a quarter of the time.
_WORKER_MEMORY = {"MALLOC_ARENA_MAX": "2", "MALLOC_MMAP_THRESHOLD_": "33554432", "MALLOC_TRIM_THRESHOLD_": "67108864", "ARROW_DEFAULT_MEMORY_POOL": "system"}
_BATCH_SETTING, _SPARKS_OWN, _BATCH_SIZE = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8m"


def prepare_workers(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, and hold little memory.

    The path matters in local mode only; on a cluster the package is installed or sent with ``--py-files``. Batches
    go to workers 8 MB at a time unless the session sets another size; what the environment sets already stays.
    """
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "")
    if _ROOT not in known.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [_ROOT, known]))
    for name, value in _WORKER_MEMORY.items():
        environment.setdefault(name, value)
    if spark.conf.get(_BATCH_SETTING) == _SPARKS_OWN:
        spark.conf.set(_BATCH_SETTING, _BATCH_SIZE)


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id's decimal text, modulo ``parts``; a null id counts as the text ``null``."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % parts


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own, not yet made, in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Bytes of rows that are Python objects at the same time.
_BATCH_BYTES = 16 << 20
_CACHES: dict[str, dict] = {}


def worker_cache(owner: str) -> dict:
    """What a worker keeps between an operator's tasks. An operator that asks drops what others kept.

    A worker lives on from stage to stage, so it would else hold the caches of all operators it ever ran.
    """
    if owner not in _CACHES:
        _CACHES.clear()
        _CACHES[owner] = {}
    return _CACHES[owner]


def small_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of bounded bytes; a longer row is a batch of its own."""
    for batch in batches:
        if batch.num_rows < 2 or batch.nbytes <= _BATCH_BYTES:
            yield batch
        else:
            half = batch.num_rows // 2
            yield from small_batches(iter((batch.slice(0, half), batch.slice(half))))


def map_texts(value: Callable[[list[str | None]], list], kind: str) -> Callable[[Column], Column]:
    """A column function of whole texts, asked for texts of bounded bytes at a time."""
    arrow_kind = to_arrow(f"value {kind}").field(0).type

    @F.arrow_udf(kind)
    def mapped(texts: pa.Array) -> pa.Array:
        parts = small_batches(iter((pa.RecordBatch.from_arrays([texts], ["text"]),)))
        return pa.concat_arrays([pa.array(value(part.column(0).to_pylist()), arrow_kind) for part in parts])

    return mapped


def sorted_distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct numbers. ``np.unique`` asked for nothing else goes through a hash table, many times slower."""
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])[: len(values)]]


def map_rows(df: DataFrame, rows: Callable[[Iterator[dict[str, list]]], Iterator[dict[str, list]]], schema: str) -> DataFrame:
    """``mapInArrow`` over dicts of Python lists, one per batch; column types come from ``schema``."""
    kind = to_arrow(schema)
    prepare_workers(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in rows(batch.to_pydict() for batch in small_batches(batches)):
            yield pa.RecordBatch.from_pydict(out, schema=kind)

    return df.mapInArrow(run, schema)


#: Bits of a bitmap of keys, at most: 16 MB.
_BITMAP_BITS = 27
_CELL_BITS = 15


def may_hold(df: DataFrame, key: str, wanted: DataFrame, wanted_key: str, *, others: bool = False) -> DataFrame:
    """Rows of ``df`` whose bigint ``key`` may be in the settled ``wanted``: all that are, and few more while keys are few.

    ``others``: the other rows instead, none of which is in it. The keys are marked in a bitmap of 16 bits a key, at
    most 16 MB, that is broadcast whatever their number; beyond some ten million keys more and more rows pass,
    so it spares an exact step rows but never replaces it. A null key is in nothing.
    """
    size = min(_BITMAP_BITS, max(16, (16 * wanted.count()).bit_length()))

    def place(name: str) -> Column:
        return F.pmod(F.xxhash64(name), F.lit(1 << size))

    marks = wanted.where(F.col(wanted_key).isNotNull()).select(place(wanted_key).alias("place")).select(F.shiftright("place", _CELL_BITS).alias("cell of keys"), F.col("place").bitwiseAND((1 << _CELL_BITS) - 1).alias("bit"))
    cells = settle(marks.groupBy("cell of keys").agg(F.bitmap_construct_agg("bit").alias("bits of keys")))
    asked = df.withColumn("place of key", place(key)).withColumn("cell of keys", F.shiftright("place of key", _CELL_BITS))
    bit = F.col("place of key").bitwiseAND((1 << _CELL_BITS) - 1)
    byte = F.conv(F.hex(F.substring(F.col("bits of keys"), (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    marked = (F.getbit(byte, bit.bitwiseAND(7).cast("int")) == 1) & F.col(key).isNotNull()
    joined = asked.join(F.broadcast(cells), "cell of keys", "left" if others else "inner")
    return joined.where(~F.coalesce(marked, F.lit(False)) if others else marked).select(*(f"`{c}`" for c in df.columns))


def to_arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T._parse_datatype_string(schema))

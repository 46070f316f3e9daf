"""Centroid clustering in integers, with most centroids ruled out in a rotated space.

Vectors become integers, and all distances, sums and centroids are integers too, so results do not depend on the order of
addition. To look at few components, the axes are turned to the corpus's principal components. A vector keeps its leading
rotated coordinates and the norm of the rest; so does each centroid. With the leading parts y and the rests'
norms r,

    |x - c|^2  >=  |y_x - y_c|^2 + (r_x - r_c)^2

holds by the triangle inequality in the rest's space. The centroid with the least bound is verified first, in integers;
then every other whose bound, less what rounding may have added, does not exceed the distance found.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moorage.llm.base import prepare_workers, settle, settled_for_now, to_arrow

#: Components may have this magnitude at most, so that squared distances fit in 64 bits.
LARGEST = 1 << 27


@dataclass(frozen=True)
class ClusterSpec:
    """``leading``: rotated coordinates that are kept. Start: the vectors with the least sha256 of ``seed:id``."""

    size: int = 64
    scale: int = 1024
    clusters: int = 8
    rounds: int = 10
    leading: int = 12
    seed: int = 3


@dataclass(frozen=True)
class Rotation:
    centre: np.ndarray
    axes: np.ndarray

    def turned(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leading coordinates (rows, leading) and norms of the rest."""
        centred = vectors - self.centre
        leading = centred @ self.axes
        rest = np.einsum("ij,ij->i", centred, centred) - np.einsum("ij,ij->i", leading, leading)
        return leading, np.sqrt(np.maximum(rest, 0))


def rotation(n: int, sums: np.ndarray, products: np.ndarray, leading: int) -> Rotation:
    """Axes of largest variance from the count, the sums and the summed products of components."""
    centre = sums / max(n, 1)
    spread = products / max(n, 1) - np.outer(centre, centre)
    _, axes = np.linalg.eigh(spread)
    return Rotation(centre, np.ascontiguousarray(axes[:, ::-1][:, :leading]))


@dataclass(frozen=True)
class Centroids:
    """Integer centroids with their place in the rotated space."""

    vectors: np.ndarray
    leading: np.ndarray
    rest: np.ndarray

    @classmethod
    def of(cls, vectors: np.ndarray, turn: Rotation) -> Centroids:
        return cls(vectors, *turn.turned(vectors.astype(np.float64)))


def nearest(vectors: np.ndarray, leading: np.ndarray, rest: np.ndarray, centroids: Centroids) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of the nearest centroid (the smaller of ties), squared distance, and how many distances were computed."""
    # |y_x - y_c|^2 + (r_x - r_c)^2 is a squared distance of points that have the rest's norm as one more coordinate.
    own, to = np.column_stack([leading, rest]), np.column_stack([centroids.leading, centroids.rest])
    sizes = np.einsum("ij,ij->i", own, own)[:, None] + np.einsum("ij,ij->i", to, to)
    bounds = sizes - 2 * own @ to.T
    bounds -= 1e-9 * sizes + 1e-6  # rounding of the rotation and of the sums above is far below this

    best = np.argmin(bounds, axis=1)
    distance = _distances(vectors, centroids.vectors[best])
    computed = len(vectors)
    for k in range(len(centroids.vectors)):
        asked = np.flatnonzero((bounds[:, k] <= distance) & (best != k))
        found = _distances(vectors[asked], centroids.vectors[k])
        computed += len(asked)
        closer = (found < distance[asked]) | ((found == distance[asked]) & (k < best[asked]))
        best[asked[closer]], distance[asked[closer]] = k, found[closer]
    return best, distance, computed


def _distances(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    apart = left.astype(np.int64) - right
    return np.einsum("ij,ij->i", apart, apart)


def whole_vectors(table: DataFrame, spec: ClusterSpec, *, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, v (array of integers): rows with ``size`` components, none null, NaN or infinite."""
    vector = F.col(embedding).cast("array<double>")
    good = (F.size(vector) == spec.size) & F.forall(vector, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    rows = table.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.when(good, vector).alias("x")).where("x IS NOT NULL")
    largest = F.array_max(F.transform("x", lambda x: F.abs(spec.scale * x)))
    checked = F.when(largest < LARGEST, F.col("x")).otherwise(F.raise_error(F.lit(f"a component of {LARGEST / spec.scale:g} or more")))
    return rows.select("vec_id", F.transform(checked, lambda x: F.floor(spec.scale * x).cast("int")).alias("v"))


def start_order(vec_id: Column, seed: int) -> Column:
    """A null id counts as the text ``null``."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(vec_id.cast("string"), F.lit("null"))), 256)


def _matrix(column: pa.Array, size: int, kind: str) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, size).astype(kind, copy=False)


def _moments(vectors: DataFrame, size: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, sums and summed products, exact in 64-bit floats while below 2^53 and near enough beyond."""
    schema = "row int, n double, s array<double>"
    kind = to_arrow(schema)
    prepare_workers(vectors.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros((size + 1, size))
        for batch in batches:
            x = _matrix(batch.column(0), size, "f8")
            n += len(x)
            total[:size] += x.T @ x
            total[size] += x.sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size + 1, dtype=np.int32)), pa.array(np.full(size + 1, float(n))), pa.array(list(total), pa.list_(pa.float64()))], schema=kind)

    parts = vectors.select("v").mapInArrow(run, schema).select("row", "n", F.posexplode("s").alias("column", "s"))
    out, n = np.zeros((size + 1, size)), 0
    for r in parts.groupBy("row", "column").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect():
        out[r.row, r.column], n = r.s, int(r.n)
    return n, out[size], out[:size]


def _turned(vectors: DataFrame, turn: Rotation, spec: ClusterSpec) -> DataFrame:
    """vec_id, v, leading, rest."""
    schema = "vec_id bigint, v array<int>, leading array<double>, rest double"
    kind, sent = to_arrow(schema), vectors.sparkSession.sparkContext.broadcast(turn)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leading, rest = sent.value.turned(_matrix(batch.column(1), spec.size, "f8"))
            yield pa.RecordBatch.from_arrays([*batch.columns, _lists(leading), pa.array(rest)], schema=kind)

    return vectors.mapInArrow(run, schema)


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))


def _assigned(batch: pa.RecordBatch, spec: ClusterSpec, centroids: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    vectors = _matrix(batch.column(1), spec.size, "i4")
    leading = _matrix(batch.column(2), centroids.leading.shape[1], "f8")
    return vectors, *nearest(vectors, leading, batch.column(3).to_numpy(), centroids)[:2]


def _next_centroids(turned: DataFrame, centroids: Centroids, spec: ClusterSpec) -> np.ndarray:
    """One round: each task adds up its vectors by centroid; Spark adds up the tasks."""
    schema = "cluster int, n bigint, s array<bigint>"
    kind, sent = to_arrow(schema), turned.sparkSession.sparkContext.broadcast(centroids)
    count = len(centroids.vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(count, np.int64), np.zeros((count, spec.size), np.int64)
        for batch in batches:
            vectors, best, _ = _assigned(batch, spec, sent.value)
            n += np.bincount(best, minlength=count)
            for k in np.unique(best).tolist():
                total[k] += vectors[best == k].sum(axis=0, dtype=np.int64)
        own = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(n[own]), _lists(total[own])], schema=kind)

    parts = turned.mapInArrow(run, schema).select("cluster", "n", F.posexplode("s").alias("place", "s"))
    out = centroids.vectors.copy()
    for r in parts.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect():
        out[r.cluster, r.place] = r.s // r.n  # Python's division rounds down
    sent.destroy()
    return out


def _places(turned: DataFrame, centroids: Centroids, spec: ClusterSpec) -> DataFrame:
    """vec_id, cluster, distance."""
    schema = "vec_id bigint, cluster int, distance bigint"
    kind, sent = to_arrow(schema), turned.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, best, distance = _assigned(batch, spec, sent.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best.astype(np.int32)), pa.array(distance)], schema=kind)

    return turned.mapInArrow(run, schema)


def cluster(table: DataFrame, spec: ClusterSpec = ClusterSpec(), *, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, centroid (its components).

    Vectors that are null, have another number of components, or a null, NaN or infinite one are left out. Rows are vectors of
    their own even if ids or vectors repeat; of rows with equal ids, those with the lesser components start first. Fewer vectors
    than ``clusters`` make fewer centroids. Distances of equal size go to the centroid with the smaller number. Empty
    centroids stay. A component of 131,072 (``LARGEST / scale``) or more in magnitude is an error. An empty table, or
    one that keeps nothing, gives an empty result.
    """
    spark = table.sparkSession
    with settled_for_now(spark) as hand_over:
        with settled_for_now(spark) as hand_on:
            vectors = settle(whole_vectors(table, spec, vec_id=vec_id, embedding=embedding))
            start = vectors.orderBy(start_order(F.col("vec_id"), spec.seed), "v").limit(spec.clusters).select("v").collect()
            turn = rotation(*_moments(vectors, spec.size), spec.leading)
            turned = hand_on(_turned(vectors, turn, spec))
        centroids = np.array([r.v for r in start], np.int64).reshape(-1, spec.size)
        for _ in range(spec.rounds if len(centroids) else 0):
            after = _next_centroids(turned, Centroids.of(centroids, turn), spec)
            if (after == centroids).all():
                break  # every further round would repeat this one
            centroids = after
        found = hand_over(_places(turned, Centroids.of(centroids, turn), spec))
    sums = {r.cluster: r.n for r in found.groupBy("cluster").agg(F.sum("distance").alias("n")).collect()}
    facts = [
        (k, sums.get(k, 0), sum(sums.values()), hashlib.sha256(",".join(map(str, row)).encode()).hexdigest(), row)
        for k, row in enumerate(centroids.tolist())
    ]
    # One row per centroid.
    named = spark.createDataFrame(facts, "of int, cluster_inertia bigint, inertia bigint, centroid_sha256 string, centroid array<bigint>")
    return found.join(F.broadcast(named), F.col("cluster") == F.col("of")).drop("of")

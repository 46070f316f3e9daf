import hashlib

import numpy as np
import pytest

from moorage.llm import rotated_centroids as rc
from tests.compare import difference, duck

SCHEMA = "vec_id bigint, embedding array<float>, cluster string, v string, leading string, distance string"


def exact(vectors, centroids):
    distances = ((vectors[:, None, :].astype(np.int64) - centroids[None]) ** 2).sum(axis=2)
    return distances.argmin(axis=1), distances.min(axis=1)


@pytest.mark.parametrize("leading", [1, 6, 16])
@pytest.mark.parametrize("spread", [3, 1000, 1 << 26])
def test_bounds_leave_the_nearest_centroid(leading, spread):
    rng = np.random.default_rng(leading + spread)
    vectors = rng.integers(-spread, spread + 1, (3000, 16))
    vectors[:500] = vectors[0]
    centroids = np.vstack([vectors[rng.integers(0, 3000, 9)], vectors[:2]])  # some are equal: ties
    x = vectors.astype(float)
    turn = rc.rotation(len(x), x.sum(axis=0), x.T @ x, leading)
    best, distance, computed = rc.nearest(vectors, *turn.turned(x), rc.Centroids.of(centroids, turn))
    expected = exact(vectors, centroids)
    assert (best == expected[0]).all() and (distance == expected[1]).all()
    assert computed <= vectors.shape[0] * len(centroids)


def test_bounds_spare_most_distances():
    rng = np.random.default_rng(5)
    middles = rng.normal(0, 1000, (8, 64))
    vectors = np.rint(middles[rng.integers(0, 8, 5000)] + rng.normal(0, 100, (5000, 64))).astype(np.int64)
    x = vectors.astype(float)
    turn = rc.rotation(len(x), x.sum(axis=0), x.T @ x, 8)
    _, _, computed = rc.nearest(vectors, *turn.turned(x), rc.Centroids.of(np.rint(middles).astype(np.int64), turn))
    assert computed < 1.2 * len(vectors)


def brute_force(rows, spec):
    kept = [(i, np.floor(spec.scale * np.array(e, np.float64)).astype(np.int64)) for i, e in rows if e is not None and len(e) == spec.size and all(x is not None and np.isfinite(x) for x in e)]
    kept = [(i, v) for i, v in kept]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"{spec.seed}:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[1].tolist()))
    if not kept:
        return []
    vectors, centroids = np.stack([v for _, v in kept]), np.stack([v for _, v in first[: spec.clusters]])
    for _ in range(spec.rounds):
        best, _ = exact(vectors, centroids)
        for k in range(len(centroids)):
            if (best == k).any():
                centroids[k] = vectors[best == k].sum(axis=0) // (best == k).sum()
    best, distance = exact(vectors, centroids)
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    return [(i, int(k), int(d), int(distance[best == k].sum()), int(distance.sum()), names[k]) for (i, _), k, d in zip(kept, best, distance)]


def order(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((v is None, v or 0) for v in r))


def test_odd_vectors(spark):
    rng = np.random.default_rng(3)
    spec = rc.ClusterSpec(size=4, clusters=5, rounds=4, leading=2)
    rows = [(i, rng.normal(0, 2, 4).astype(np.float32).tolist()) for i in range(120)]
    rows += [(1, rows[1][1]), (1, rows[2][1]), (None, rows[3][1]), (None, [0.0] * 4)] + [(200 + i, [1.0, -0.0, -1.5, 2.0]) for i in range(50)]
    rows += [(300, None), (301, []), (302, [1.0] * 3), (303, [1.0] * 5), (304, [1.0, None, 1.0, 1.0]), (305, [float("nan")] * 4), (306, [float("-inf"), 0.0, 0.0, 0.0])]
    table = spark.createDataFrame([(*r, "clash", "clash", "clash", "clash") for r in rows], SCHEMA).repartition(4)
    got = rc.cluster(table, spec).drop("centroid")
    assert order(got.collect()) == order(brute_force(rows, spec))
    few = table.where("vec_id < 3")
    assert order(rc.cluster(few, spec).drop("centroid").collect()) == order(brute_force([r for r in rows if r[0] is not None and r[0] < 3], spec))


def test_nothing_to_cluster(spark):
    assert rc.cluster(spark.createDataFrame([], SCHEMA)).collect() == []
    assert rc.cluster(spark.createDataFrame([(1, None, "", "", "", "")], SCHEMA)).collect() == []


def test_components_that_are_too_large_are_refused(spark):
    table = spark.createDataFrame([(1, [3e8] * 64)], "vec_id bigint, embedding array<double>")
    with pytest.raises(Exception, match="a component of"):
        rc.cluster(table).collect()


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_query_beside_its_sql(spark, folder):
    from moorage.llm.oracles import ORACLES
    from moorage.llm.queries import QUERIES

    name = "op11_rotated_centroids"
    assert difference(QUERIES[name](spark, folder), duck(folder).sql(ORACLES[name])) is None

"""Centroid clustering against plain rounds, and its bounds against points of the spheres."""

import hashlib
import math
import random

import numpy as np
import pytest

from ratecube.llm import clustering

SCHEMA = "vec_id long, embedding array<double>, cluster int, before string, v int"


def plain(rows, dimensions, count, rounds, scale=256):
    """(vec_id, cluster, distance), and the final centroids, by scanning everything."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:count]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        own = assign()
        for k in range(len(centroids)):
            inside = [v for (_, v), (_, c) in zip(kept, own, strict=True) if c == k]
            if inside:
                centroids[k] = [sum(x) // len(inside) for x in zip(*inside, strict=True)]
    return [(i, k, d) for (i, _), (d, k) in zip(kept, assign(), strict=True)], centroids


def vectors(dimensions=6):
    rng = random.Random(1)
    rows = []
    for i in range(400):
        middle = rng.choice([(-1,) * dimensions, (0,) * dimensions, (2, 0) * (dimensions // 2)])
        rows.append((i, [m + rng.gauss(0, 0.6) for m in middle]))
    hot = [0.5] * dimensions
    rows += [(1000 + i, hot) for i in range(150)] + [(7, rows[7][1]), (7, hot), (None, hot), (None, rows[3][1])]
    rows += [(2000, None), (2001, []), (2002, [1.0]), (2003, [math.nan] + [0.0] * (dimensions - 1)), (2004, [None] + [0.0] * (dimensions - 1)), (2005, [math.inf] * dimensions)]
    return rows


def table_of(spark, rows):
    return spark.createDataFrame([(i, v, 5, "b", 6) for i, v in rows], SCHEMA)


@pytest.mark.parametrize("count", [1, 7, 40])
def test_clusters(spark, count):
    rows = vectors()
    table = clustering.report(table_of(spark, rows), dimensions=6, centroids=count)
    want, centroids = plain(rows, 6, count, 5)
    got = table.collect()
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got), key=repr) == sorted(want, key=repr)
    inertia = [sum(d for _, k, d in want if k == c) for c in range(count)]
    for r in got:
        assert (r.cluster_inertia, r.inertia) == (inertia[r.cluster], sum(inertia))
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centroids[r.cluster])).encode()).hexdigest()


def test_fewer_vectors_than_centroids(spark):
    rows = vectors()[:3]
    got = clustering.report(table_of(spark, rows), dimensions=6).collect()
    assert sorted((r.vec_id, r.cluster, r.distance) for r in got) == sorted(plain(rows, 6, 40, 5)[0])
    assert clustering.report(table_of(spark, []), dimensions=6).collect() == []
    assert clustering.report(table_of(spark, [(1, None), (2, [1.0])]), dimensions=6).collect() == []


def test_wide_values(spark):
    """Squares beyond 53 and 63 bits on the way are still exact."""
    rows = [(i, [1e6 * i, -1e6 * (i % 3), 3.0]) for i in range(9)]
    got = clustering.report(table_of(spark, rows), dimensions=3, centroids=3).collect()
    assert sorted((r.vec_id, r.cluster, r.distance) for r in got) == sorted(plain(rows, 3, 3, 5)[0])
    far = np.array([[1 << 40, 0], [-(1 << 40), 1]])
    assert clustering.squared_distances(far, far).tolist() == [[0, (1 << 82) + 1], [(1 << 82) + 1, 0]]


def test_bounds_hold_and_loosen_less_than_the_drift():
    rng = np.random.default_rng(3)
    less = 0
    for _ in range(200):
        old = rng.integers(-300, 300, (6, 4))
        new = old + rng.integers(-60, 60, (6, 4)) * rng.integers(0, 2, (6, 1))
        radius = rng.uniform(0, 250, 6)
        fall = clustering.loosening(old, new, radius)
        drift = np.sqrt(((new - old) ** 2).sum(axis=1))
        for i in range(6):
            others = [j for j in range(6) if j != i]
            less += fall[i] < 0.9 * drift[others].max()
            step = rng.normal(size=(300, 4))
            points = old[i] + step / np.linalg.norm(step, axis=1)[:, None] * radius[i] * rng.uniform(0, 1, (300, 1)) ** 0.2
            for j in others:
                fallen = np.linalg.norm(points - old[j], axis=1) - np.linalg.norm(points - new[j], axis=1)
                assert fallen.max() <= fall[i] + 1e-9
    assert less > 200


def test_most_vectors_are_not_scanned():
    rng = np.random.default_rng(4)
    middles = rng.integers(-500, 500, (8, 16))
    values = middles[rng.integers(0, 8, 5000)] + rng.integers(-40, 40, (5000, 16))
    old = values[:8].copy()
    cluster, upper, lower = clustering.scanned(values, old)
    for _ in range(4):
        radius = np.array([upper[cluster == c].max(initial=0) for c in range(8)])
        new = np.array([values[cluster == c].sum(axis=0) // max(1, (cluster == c).sum()) if (cluster == c).any() else old[c] for c in range(8)])
        cluster, upper, lower, scans = clustering.assigned(values, cluster, upper, lower, old, new, radius)
        assert (cluster == clustering.squared_distances(values, new).argmin(axis=1)).all()
        old = new
    assert scans < 500

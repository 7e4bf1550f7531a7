"""Centroid clustering in integers, with distance bounds loosened by geometric drift tightening.

Each vector holds an upper bound of the distance to its own centroid and a lower bound of that to any other.
When centroid j moves by p, the distance from it falls by no more than p times the cosine of the angle between
the move and a vector, seen from the middle of the move: (|x - a| + |x - b|) is at least twice the distance from
the middle, so |x - a| - |x - b| <= p cos. All vectors of a cluster lie in a sphere around its centroid, so the
angle is at least that of the sphere's centre less the angle under which the radius is seen. Both are measured
in the plane of the move and the centre. A lower bound is loosened by the largest such fall of the other
centroids, which is less than their full drift unless the sphere holds the middle of a move. A vector whose
upper bound is below its lower bound, or below half the way to the centroid nearest to its own, keeps its
cluster; all others are scanned exactly. Bounds are doubles, rounded to the safe side; distances, sums and
centroids are integers.

A round reads and writes one table of vectors with their bounds. To the driver come the sums of the vectors that
changed cluster, one row for each cluster and component, and the radii: they are bounded by the number of
centroids, whatever the size of the table.

Defined cases: vectors that are null, of another length, or with a null or non-finite component are left out;
equal vectors, and equal ids, are rows of their own; rows without an id seed last; with fewer vectors than
centroids there are as many centroids as vectors, and an empty table gives an empty result. Equal distances go
to the smaller number. Components must be below 2 ** 63 when scaled; a distance of over 63 bits is an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratecube.llm.common import DOUBLE, INT, LONG, bounded_batches, list_of, stored, struct_of

DIMENSIONS = 64
CENTROIDS = 40
ROUNDS = 5
SCALE = 256
#: Factors that make a rounded bound safe, and the slack of a cosine.
UP, DOWN, SLACK = 1 + 1e-12, 1 - 1e-12, 1e-7
#: Vectors that a worker gets at once.
ROWS = 4096


def whole_vectors(table: DataFrame, vec_id: str, vector: str, dimensions: int, scale: int) -> DataFrame:
    """(vec_id, v): the vectors that count, in integers."""

    def usable(x: Column) -> Column:
        return x.isNotNull() & (F.abs(x.cast("double")) < F.lit(float("inf")))

    own = table.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("v"))
    own = own.filter(F.col("v").isNotNull() & (F.size("v") == dimensions) & F.forall("v", usable))
    return own.select("vec_id", F.transform("v", lambda x: F.floor(x.cast("double") * scale).cast("bigint")).alias("v"))


def seeds(vectors: DataFrame, count: int, salt: str) -> np.ndarray:
    """The vectors with the smallest hashes of their ids, in that order."""
    by_hash = vectors.select(F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256).alias("hash"), "v")
    return np.array([r.v for r in by_hash.orderBy(F.col("hash").asc_nulls_last(), "v").limit(count).collect()], np.int64)


def squared_distances(values: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact: in doubles or 64-bit integers where their range is enough, else in Python's integers."""
    reach = values.shape[1] * (int(np.abs(values).max(initial=0)) + int(np.abs(centroids).max(initial=0))) ** 2
    kind = np.float64 if reach < 1 << 53 else np.int64 if reach < 1 << 63 else object
    x, c = values.astype(kind), centroids.astype(kind)
    found = (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None, :]
    return found.astype(np.int64) if kind is np.float64 else found


def own_distances(values: np.ndarray, centroids: np.ndarray, cluster: np.ndarray) -> np.ndarray:
    """Exact squared distances of vectors to the centroids of their clusters."""
    reach = values.shape[1] * (int(np.abs(values).max(initial=0)) + int(np.abs(centroids).max(initial=0))) ** 2
    gap = (values - centroids[cluster]) if reach < 1 << 63 else values.astype(object) - centroids[cluster].astype(object)
    return (gap * gap).sum(axis=1)


def roots(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64))


def scanned(values: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, upper, lower) by all distances; without a second centroid the lower bound is infinite."""
    squares = squared_distances(values, centroids)
    rows, cluster = np.arange(len(values)), squares.argmin(axis=1)
    upper = roots(squares[rows, cluster]) * UP
    if len(centroids) == 1:
        return cluster, upper, np.full(len(values), np.inf)
    others = roots(squares)
    others[rows, cluster] = np.inf
    return cluster, upper, others.min(axis=1) * DOWN


def loosening(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """For each cluster, how much the distance from any of its vectors to any other centroid can have fallen.

    `radius` bounds the distances of a cluster's vectors from its old centroid.
    """
    a, b = old.astype(np.float64), new.astype(np.float64)
    move = b - a
    drift = np.sqrt((move * move).sum(axis=1)) * UP
    towards = a[:, None, :] - (a + b)[None, :, :] / 2  # from the middle of move j to the centre of sphere i
    away = np.sqrt((towards * towards).sum(axis=2))
    with np.errstate(divide="ignore", invalid="ignore"):
        cos_centre = np.clip((towards * move[None, :, :]).sum(axis=2) / (away * drift[None, :]), -1, 1)
        sin_radius = radius[:, None] / away
    outside = (sin_radius < 1) & (drift[None, :] > 0)
    cos_centre, sin_radius = np.where(outside, cos_centre, 1), np.where(outside, sin_radius, 0)
    sin_centre, cos_radius = np.sqrt(1 - cos_centre**2), np.sqrt(1 - sin_radius**2)
    nearest = np.where(cos_centre >= cos_radius, 1.0, cos_centre * cos_radius + sin_centre * sin_radius)
    fall = drift[None, :] * np.clip(np.where(outside, nearest + SLACK, 1.0), 0, 1)
    np.fill_diagonal(fall, 0)
    return fall.max(axis=1, initial=0)


def half_gaps(centroids: np.ndarray) -> np.ndarray:
    """Half the way from each centroid to the nearest other."""
    gaps = roots(squared_distances(centroids, centroids))
    np.fill_diagonal(gaps, np.inf)
    return gaps.min(axis=1) / 2 * DOWN


STATE = struct_of(vec_id=LONG, v=list_of(LONG), cluster=INT, before=INT, upper=DOUBLE, lower=DOUBLE)
LABEL = struct_of(vec_id=LONG, cluster=INT, distance=LONG)


def matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, dimensions)


def first_assignment(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    dimensions = centroids.shape[1]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, upper, lower = scanned(matrix(batch.column("v"), dimensions), centroids)
            yield state_batch(batch, cluster, np.full(len(cluster), -1), upper, lower)

    return vectors.mapInArrow(assign, STATE)


def state_batch(batch: pa.RecordBatch, cluster, before, upper, lower) -> pa.RecordBatch:
    columns = [batch.column("vec_id").cast(pa.int64()), batch.column("v"), pa.array(cluster, pa.int32()), pa.array(before, pa.int32())]
    return pa.RecordBatch.from_arrays([*columns, pa.array(upper), pa.array(lower)], STATE.names)


def assigned(values: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, old: np.ndarray, new: np.ndarray, radius: np.ndarray):
    """(cluster, upper, lower, number scanned) after the centroids have moved from `old` to `new`."""
    move = (new - old).astype(np.float64)
    upper = (upper + np.sqrt((move * move).sum(axis=1))[cluster]) * UP
    lower = np.maximum(0, lower - loosening(old, new, radius)[cluster]) * DOWN
    safe = np.maximum(lower, half_gaps(new)[cluster])
    open_ = np.flatnonzero(upper >= safe)
    upper[open_] = roots(own_distances(values[open_], new, cluster[open_])) * UP
    open_ = open_[upper[open_] >= safe[open_]]
    cluster = cluster.copy()
    cluster[open_], upper[open_], lower[open_] = scanned(values[open_], new)
    return cluster, upper, lower, len(open_)


def next_assignment(state: DataFrame, old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> DataFrame:
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before = np.asarray(batch.column("cluster"))
            bounds = [np.asarray(batch.column(c)) for c in ("upper", "lower")]
            cluster, upper, lower, _ = assigned(matrix(batch.column("v"), new.shape[1]), before, *bounds, old, new, radius)
            yield state_batch(batch, cluster, before, upper, lower)

    return state.mapInArrow(assign, STATE)


def radii(state: DataFrame, count: int) -> np.ndarray:
    out = np.zeros(count)
    for r in state.groupBy("cluster").agg(F.max("upper").alias("radius")).collect():
        out[r.cluster] = r.radius
    return out


def add_moves(state: DataFrame, sums: np.ndarray, counts: np.ndarray) -> None:
    """Take the vectors that changed cluster out of the sums of the old one and into those of the new one."""
    moved = state.filter("cluster <> before")
    ends = F.array(F.struct(F.col("cluster").alias("c"), F.lit(1).alias("sign")), F.struct(F.col("before").alias("c"), F.lit(-1).alias("sign")))
    long = moved.select(F.inline(ends), "v").filter("c >= 0").select("c", "sign", F.posexplode("v").alias("at", "x"))
    for r in long.groupBy("c", "at").agg(F.sum(F.col("x") * F.col("sign")).alias("total"), F.sum("sign").alias("n")).collect():
        sums[r.c, r.at] += r.total
        if r.at == 0:
            counts[r.c] += r.n


def moved_centroids(centroids: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Componentwise floor of the mean; empty clusters keep their centroid."""
    out = centroids.copy()
    full = counts > 0
    out[full] = sums[full] // counts[full][:, None]
    return out


def labelled(state: DataFrame, old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of a last assignment."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = matrix(batch.column("v"), new.shape[1])
            bounds = [np.asarray(batch.column(c)) for c in ("cluster", "upper", "lower")]
            cluster, *_ = assigned(values, *bounds, old, new, radius)
            distance = own_distances(values, new, cluster).tolist()
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], LABEL.names)

    return state.mapInArrow(assign, LABEL)


def cluster(
    table: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    dimensions: int = DIMENSIONS,
    centroids: int = CENTROIDS,
    rounds: int = ROUNDS,
    scale: int = SCALE,
    salt: str = "2:",
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of each vector that counts, and the final centroids.

    `rounds` times all vectors are assigned and the centroids moved; then all are assigned once more.
    """
    spark = table.sparkSession
    bounded_batches(spark, ROWS, 8 << 20)
    vectors = whole_vectors(table, vec_id, vector, dimensions, scale)
    now = seeds(vectors, centroids, salt)
    if not len(now):
        return spark.createDataFrame([], LABEL), np.empty((0, dimensions), np.int64)
    sums, counts = np.zeros(now.shape, np.int64), np.zeros(len(now), np.int64)
    old, radius = now, np.zeros(len(now))
    state = stored(first_assignment(vectors, now), "clusters")
    for step in range(rounds):
        if step:
            state = stored(next_assignment(state, old, now, radius), "clusters")
        add_moves(state, sums, counts)
        radius, old, now = radii(state, len(now)), now, moved_centroids(now, sums, counts)
    return stored(labelled(state, old, now, radius), "labels"), now


def report(table: DataFrame, **parameters) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector."""
    labels, centroids = cluster(table, **parameters)
    inertia = {r.cluster: r.total for r in labels.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    rows = [
        (i, inertia.get(i, 0), sum(inertia.values()), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest())
        for i, c in enumerate(centroids.tolist())
    ]
    # As many rows as there are centroids.
    about = table.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return labels.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

"""Centroid clustering in integers, with a filter on rotated coordinates.

Vectors become whole numbers, and every distance that decides is computed in whole numbers. Before that, the vectors are
turned into the axes of their principal components once: the ``LEADING`` first coordinates and the length of what is
left are stored. For two vectors the squared distance of the leading coordinates plus the squared difference of the
remaining lengths is never more than their squared distance, so a centroid whose bound lies above the distance to
the most promising one needs no look. The others are verified. Rounding of the bound is covered by a margin, so the
filter changes the work and never the result.

A round is one pass over the stored vectors; each task sums its vectors by cluster, and only centroids x components
numbers of each task are shuffled. The driver holds the centroids, nothing that grows with the table.

Edge cases: vectors that are null, of another width, or hold null or non-finite components take no part; rows without
an id are clustered but start no centroid; repeated ids and vectors count each; with fewer vectors than centroids each
starts one; ties go to the smaller number; an empty cluster keeps its centroid; an empty table gives an empty result.
Components beyond 2^27 after scaling, whose squared distances might not fit a long, are an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docproof.llm.common import staged
from docproof.llm.topk import usable, whole_numbers

CLUSTERS = 16
ROUNDS = 3
WIDTH = 64
SCALE = 64.0
SEED = 1
LEADING = 16
LARGEST = 1 << 27
SLAB = 4096


class Rotation:
    """Centre and principal axes; the first ``leading`` ones are kept apart."""

    def __init__(self, centre: np.ndarray, axes: np.ndarray, leading: int = LEADING):
        self.centre, self.axes, self.leading = centre, axes, min(leading, axes.shape[1])

    def __call__(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leading coordinates and the length of the remaining ones."""
        turned = (numbers.astype(np.float64) - self.centre) @ self.axes
        return turned[:, : self.leading], np.sqrt((turned[:, self.leading :] ** 2).sum(axis=1))


def matrix_of(column: pa.ChunkedArray | pa.Array, kind: type = np.int64) -> np.ndarray:
    rows = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(kind, copy=False).reshape(rows, -1) if rows else np.zeros((0, WIDTH), kind)


def squared(numbers: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    apart = numbers - centroid
    return np.einsum("ij,ij->i", apart, apart)


def nearest(numbers: np.ndarray, leading: np.ndarray, rest: np.ndarray, centroids: np.ndarray,
            rotation: Rotation) -> tuple[np.ndarray, np.ndarray, int]:
    """Cluster and squared distance of every vector, and how many distances were computed in full."""
    if max(np.abs(numbers).max(initial=0), np.abs(centroids).max(initial=0)) >= LARGEST:
        raise ValueError("scaled components of 2^27 and more are not supported")
    c_leading, c_rest = rotation(centroids)
    bound = ((leading[:, None, :] - c_leading[None, :, :]) ** 2).sum(axis=2) + (rest[:, None] - c_rest[None, :]) ** 2
    lengths = (leading**2).sum(axis=1) + rest**2
    c_lengths = (c_leading**2).sum(axis=1) + c_rest**2
    bound -= 1e-9 * (lengths[:, None] + c_lengths[None, :]) + 1e-6
    cluster = bound.argmin(axis=1)
    distance = squared(numbers, centroids[cluster])
    seen = len(numbers)
    first, ceiling = cluster.copy(), distance.copy()
    for c in range(len(centroids)):
        rows = np.flatnonzero((bound[:, c] <= ceiling) & (first != c))
        seen += len(rows)
        d = squared(numbers[rows], centroids[c])
        better = (d < distance[rows]) | ((d == distance[rows]) & (c < cluster[rows]))
        cluster[rows[better]], distance[rows[better]] = c, d[better]
    return cluster, distance, seen


def fit_rotation(sound: DataFrame, width: int = WIDTH, leading: int = LEADING) -> Rotation:
    """Principal axes of all vectors, from sums that each task makes of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width + 1, width + 1))
        for batch in batches:
            x = matrix_of(batch.column("numbers"), np.float64)
            x = np.column_stack([x, np.ones(len(x))])
            total += x.T @ x
        place = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(place.astype(np.int32)), pa.array(total.ravel()[place])], names=["place", "value"])

    sums = sound.select("numbers").mapInArrow(run, "place int, value double").groupBy("place").agg(F.sum("value").alias("value"))
    total = np.zeros((width + 1) ** 2)
    for row in sums.collect():  # at most (width + 1)^2 numbers
        total[row["place"]] = row["value"]
    total = total.reshape(width + 1, width + 1)
    n = max(1.0, total[width, width])
    centre = total[width, :width] / n
    spread = total[:width, :width] / n - np.outer(centre, centre)
    if not np.isfinite(spread).all():
        spread = np.eye(width)
    _, axes = np.linalg.eigh((spread + spread.T) / 2)
    return Rotation(centre, np.ascontiguousarray(axes[:, ::-1]), leading)


def rotated(sound: DataFrame, rotation: Rotation) -> DataFrame:
    """(vec_id, numbers, leading, rest), stored: every round reads it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leading, rest = rotation(matrix_of(batch.column("numbers")))
            ends = np.arange(0, leading.size + 1, leading.shape[1]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(leading.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("numbers"), lists, pa.array(rest)],
                                             names=["vec_id", "numbers", "leading", "rest"])

    return staged(sound.mapInArrow(run, "vec_id long, numbers array<long>, leading array<double>, rest double"))


def _slabs(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, rotation: Rotation):
    for batch in batches:
        for at in range(0, batch.num_rows, SLAB):
            part = batch.slice(at, SLAB)
            numbers = matrix_of(part.column("numbers"))
            leading = matrix_of(part.column("leading"), np.float64)
            rest = part.column("rest").to_numpy()
            cluster, distance, _ = nearest(numbers, leading, rest, centroids, rotation)
            yield part, numbers, cluster, distance


def moved(stored: DataFrame, centroids: np.ndarray, rotation: Rotation) -> np.ndarray:
    """The centroids after one round: the floor of each mean, as exact whole numbers."""
    k, width = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, width + 1), np.int64)
        for _, numbers, cluster, _ in _slabs(batches, centroids, rotation):
            for c in np.unique(cluster):
                mine = numbers[cluster == c]
                total[c, :width] += mine.sum(axis=0)
                total[c, width] += len(mine)
        place = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(place.astype(np.int32)), pa.array(total.ravel()[place])], names=["place", "value"])

    sums = stored.select("numbers", "leading", "rest").mapInArrow(run, "place int, value long")
    sums = sums.groupBy("place").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    total = {row["place"]: int(row["value"]) for row in sums.collect()}  # at most k x (width + 1) numbers
    after = centroids.copy()
    for c in range(k):
        count = total.get(c * (width + 1) + width, 0)
        if count:
            after[c] = [total.get(c * (width + 1) + i, 0) // count for i in range(width)]
    return after


def starting_centroids(stored: DataFrame, k: int, seed: int) -> np.ndarray:
    """The vectors with the k smallest hashes of seed and id."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("hash")
    first = stored.filter(F.col("vec_id").isNotNull()).select(hashed, "numbers").orderBy("hash", "numbers").limit(k)
    return np.array([row["numbers"] for row in first.collect()], np.int64)


def cluster_vectors(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, width: int = WIDTH, scale: float = SCALE,
                    seed: int = SEED, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that takes part."""
    kept: Column = usable(F.col(vector)) & (F.size(vector) == width)
    sound = vectors.filter(kept).select(F.col(vec_id).cast("long").alias("vec_id"),
                                        whole_numbers(F.col(vector), scale).alias("numbers"))
    rotation = fit_rotation(sound, width)
    stored = rotated(sound, rotation)
    centroids = starting_centroids(stored, k, seed).reshape(-1, width)
    if not len(centroids):
        return sound.limit(0).select("vec_id", *(F.lit(None).cast(t).alias(n) for n, t in (
            ("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))))
    for _ in range(rounds):
        centroids = moved(stored, centroids, rotation)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, cluster, distance in _slabs(batches, centroids, rotation):
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(cluster.astype(np.int32)), pa.array(distance)],
                                             names=["vec_id", "cluster", "distance"])

    assigned = staged(stored.mapInArrow(run, "vec_id long, cluster int, distance long"))
    sums = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"))
    inertia = {row["cluster"]: int(row["s"]) for row in sums.collect()}  # at most k rows
    names = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    facts = assigned.sparkSession.createDataFrame(
        [(c, inertia[c], sum(inertia.values()), names[c]) for c in sorted(inertia)] or [(0, 0, 0, "")],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia",
                                                              "centroid_sha256")

"""Centroid clustering by the threshold algorithm, in exact integer arithmetic.

Vectors of `size` finite components become integers floor(1024 * x). Each of `rounds` rounds assigns every
vector to its nearest centroid and moves every non-empty centroid to its vectors' componentwise floor(mean).

Assignment is the threshold algorithm over sorted lists. Each dimension has the centroids' values in
order. A vector enters each list where its own value belongs and walks outward, one entry of each list a
step, the nearer neighbour first. A centroid met for the first time gets its exact distance. The frontier
sum adds, over the dimensions, the squared distance of the entry just met: no unmet centroid is nearer than
that, so a vector stops as soon as its frontier sum strictly exceeds its best exact distance (at equality
an unmet centroid of a smaller number could still win), or when it has met all centroids. The vectors of a batch walk
together; those that have stopped drop out.

Only the centroids travel to the tasks (`count` times `size` integers), and only sums by cluster come back: a
task adds its vectors up before anything is shuffled, and the driver reads count times size sums a round. The
integer vectors are written once to the shared folder; no vector is shuffled, so equal vectors, in whatever
number, make no hot group.

Defined results: vectors that are null, of another length, or hold a null or non-finite component are left
out. Components beyond +-BOUND count as that bound, so that every squared distance fits a long; an inertia
beyond a long is the largest long. Rows with a null id take part, but start no centroid. Repeated rows
count as often as they stand; of equal ids the least vector starts first. Fewer than `count` usable rows start
fewer centroids; no rows give no rows. Extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, stored

COUNT, SIZE, ROUNDS, SEED = 8, 64, 10, 3
#: Largest size of an integer component: SIZE squared differences of twice that fit a long.
BOUND = 2**27
LONGEST = 2**63 - 1
#: Vectors that walk together.
BLOCK = 4096


def integers(vector: Column, size: int = SIZE) -> Column:
    """floor(1024 * x) of each component, or null for a vector that takes no part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = F.transform(vector, lambda x: F.floor(F.least(F.greatest(x.cast("double") * 1024, F.lit(-float(BOUND))), F.lit(float(BOUND)))).cast("int"))
    return F.when((F.size(vector) == size) & finite, scaled)


def first_centroids(vectors: DataFrame, count: int, seed: int) -> np.ndarray:
    """The vectors whose ids have the least sha256 of `seed:id`."""
    named = vectors.filter("id IS NOT NULL").withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256))
    return np.array([r.v for r in named.orderBy("h", "v").limit(count).select("v").collect()], np.int64)


class Lists:
    """The centroids' values of each dimension in order."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.order = np.argsort(centroids, axis=0, kind="stable").T  # (dimension, place) -> centroid
        self.values = np.take_along_axis(centroids, self.order.T, 0).T

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of the nearest centroid of each row."""
        n, size = x.shape
        count = len(self.centroids)
        best, number = np.full(n, LONGEST, np.int64), np.zeros(n, np.int64)
        seen = np.zeros((n, count), bool)
        # each list is entered behind the last value that isn't above the vector's own
        high = (self.values.T[None, :, :] <= x[:, None, :]).sum(1)
        low, rows, dims = high - 1, np.arange(n), np.arange(size)
        while len(rows):
            own = x[rows]
            below = np.where(low >= 0, own - self.values[dims, np.maximum(low, 0)], LONGEST)
            above = np.where(high < count, self.values[dims, np.minimum(high, count - 1)] - own, LONGEST)
            down = below <= above
            met = self.order[dims, np.where(down, low, np.minimum(high, count - 1))]
            frontier = np.where(down, below, above)
            low, high = low - down, high + ~down
            new = np.zeros((len(rows), count), bool)
            new[np.arange(len(rows))[:, None], met] = True
            new &= ~seen[rows]
            seen[rows] |= new
            for c in range(count):  # in ascending order: at ties the smaller number stands
                at = rows[new[:, c]]
                gap = x[at] - self.centroids[c]
                distance = np.einsum("ij,ij->i", gap, gap)
                better = (distance < best[at]) | ((distance == best[at]) & (c < number[at]))
                best[at[better]], number[at[better]] = distance[better], c
            on = ~(seen[rows].all(1) | (np.einsum("ij,ij->i", frontier, frontier) > best[rows]))
            rows, low, high = rows[on], low[on], high[on]
        return number, best


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for b in batches:
        for a in range(0, b.num_rows, BLOCK):
            part = b.slice(a, BLOCK)
            if part.num_rows:
                yield part, part.column("v").flatten().to_numpy().astype(np.int64).reshape(part.num_rows, -1)


def sums(vectors: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Number of vectors and componentwise sums of each non-empty cluster."""

    def make(batches):
        lists, total, n = Lists(centroids), np.zeros(centroids.shape, object), np.zeros(len(centroids), np.int64)
        for _, x in _blocks(batches):
            number, _ = lists.nearest(x)
            for c in np.unique(number):
                total[c] += x[number == c].sum(0).astype(object)
                n[c] += np.count_nonzero(number == c)
        for c in np.flatnonzero(n):
            values = [str(s) for s in (n[c], *total[c])]
            yield pa.RecordBatch.from_arrays([pa.array([c] * len(values), pa.int32()), pa.array(range(len(values)), pa.int32()), pa.array(values)], names=["cluster", "at", "value"])

    parts = vectors.select("v").mapInArrow(make, "cluster int, at int, value string")
    out: dict[int, dict[int, int]] = {}
    for r in parts.groupBy("cluster", "at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect():  # count * (size + 1) rows
        out.setdefault(r.cluster, {})[r.at] = int(r.value)
    return {c: (s[0], [s[i] for i in range(1, len(s))]) for c, s in out.items()}


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(id, cluster, distance) of every vector."""

    def make(batches):
        lists = Lists(centroids)
        for b, x in _blocks(batches):
            number, distance = lists.nearest(x)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(number.astype(np.int32)), pa.array(distance)], names=["id", "cluster", "distance"])

    return vectors.mapInArrow(make, f"id {dict(vectors.dtypes)['id']}, cluster int, distance long")


def cluster_vectors(
    vectors: DataFrame, count: int = COUNT, size: int = SIZE, rounds: int = ROUNDS, seed: int = SEED, id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid) of every usable vector; centroid is its final one's integers."""
    spark = vectors.sparkSession
    whole = stored(vectors.select(F.col(id_col).alias("id"), integers(F.col(vec_col), size).alias("v")).filter("v IS NOT NULL"), "integers")
    centroids = first_centroids(whole, count, seed)
    if not len(centroids):
        none = f"{id_col} {dict(whole.dtypes)['id']}, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>"
        return spark.createDataFrame([], none)
    for _ in range(rounds):
        for c, (n, total) in sums(whole, centroids).items():
            centroids[c] = [s // n for s in total]
    rows = stored(assigned(whole, centroids), "assigned")
    discard(whole)
    inertia = {r.cluster: int(r.s) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    every = min(sum(inertia.values()), LONGEST)
    told = [(c, min(s, LONGEST), every, centroids[c].tolist()) for c, s in inertia.items()]
    clusters = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return rows.join(F.broadcast(clusters), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def centroid_digest(centroid: Column) -> Column:
    """Lowercase hex sha256 of the components as decimal integers joined by commas."""
    return F.sha2(F.array_join(centroid.cast("array<string>"), ","), 256)

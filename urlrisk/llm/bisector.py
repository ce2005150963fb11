"""Centroid clustering of integer vectors by a bisector tournament.

Two centroids i < j are parted by the plane between them: x is strictly nearer to j than
to i where x . 2(c_j - c_i) > |c_j|^2 - |c_i|^2. Normals and thresholds of all pairs are
integers and are computed once a round. A vector starts with centroid 0 as its winner and
meets the others in order; each of the k - 1 sign tests eliminates a loser, and zero
favours the smaller number. That is the nearest centroid exactly, without a distance; the
distance is computed for the winner alone, at the end.

Every round is one narrow pass over the vectors: a task hands on one row of sums per
centroid, and k rows reach the driver. Vectors are never shuffled, so neither a crowded
cluster nor repeated vectors load one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlrisk.llm.scratch import Scratch
from urlrisk.llm.texts import slices

#: Integer components lie within this, so that sums, sign tests and squared distances of
#: up to 64 components are exact in 64-bit integers.
LARGEST = 2**26


@dataclass(frozen=True)
class Settings:
    clusters: int = 16
    rounds: int = 3
    dims: int = 64  #: at most 64
    scale: float = 64.0
    seed: int = 1


def quantised(vectors: DataFrame, settings: Settings) -> DataFrame:
    """`vec_id, v` (integers) of the vectors that take part."""
    x = F.col("embedding")
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    whole = F.transform(x, lambda e: F.floor(e.cast("double") * settings.scale))
    fits = F.forall(whole, lambda e: (e <= LARGEST) & (e >= -LARGEST))
    rows = vectors.select("vec_id", "embedding").where((F.size(x) == settings.dims) & finite)
    return rows.where(fits).select("vec_id", F.transform(whole, lambda e: e.cast("int")).alias("v"))


def start_key(seed: int, vec_id: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), vec_id.cast("string")), 256)


class Bisectors:
    """Integer normals and thresholds of all centroid pairs."""

    def __init__(self, centroids: list[list[int]]):
        import numpy as np

        self.centroids = c = np.array(centroids, np.int64)
        square = (c * c).sum(1)
        self.normals = 2 * (c[None, :, :] - c[:, None, :])
        self.thresholds = square[None, :] - square[:, None]

    def winners(self, x):
        """Number of the nearest centroid of every row, ties to the smaller number."""
        import numpy as np

        winner = np.zeros(len(x), np.int64)
        for j in range(1, len(self.centroids)):
            side = np.einsum("nd,nd->n", x, self.normals[winner, j]) - self.thresholds[winner, j]
            winner[side > 0] = j
        return winner

    def distances(self, x, winner):
        away = x - self.centroids[winner]
        return (away * away).sum(1)


def _matrix(column, dims: int):
    import numpy as np

    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def _sums(bisectors: Bisectors):
    k, dims = bisectors.centroids.shape

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        n, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for whole in batches:
            for batch in slices(whole, 4096):
                x = _matrix(batch.column(0), dims)
                winner = bisectors.winners(x)
                n += np.bincount(winner, minlength=k)
                np.add.at(sums, winner, x)
        some = np.flatnonzero(n)
        yield pa.record_batch(
            [pa.array(some, pa.int32()), pa.array(n[some]), pa.array(list(sums[some]), pa.list_(pa.int64()))], names=("cluster", "n", "sums")
        )

    return run


def _assignments(bisectors: Bisectors):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for whole in batches:
            for batch in slices(whole, 4096):
                x = _matrix(batch.column(1), bisectors.centroids.shape[1])
                winner = bisectors.winners(x)
                yield pa.record_batch(
                    [batch.column(0), pa.array(winner, pa.int32()), pa.array(bisectors.distances(x, winner))], names=("vec_id", "cluster", "distance")
                )

    return run


def moved(rows: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Centroids after one round: floor of the mean of their vectors; empty ones stay."""
    exact = [F.sum(F.col("sums")[d].cast("decimal(38,0)")).alias(f"s{d}") for d in range(len(centroids[0]))]
    parts = rows.select("v").mapInArrow(_sums(Bisectors(centroids)), "cluster int, n long, sums array<long>")
    out = list(centroids)
    for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *exact).collect():  # at most k rows
        out[r["cluster"]] = [int(r[f"s{d}"]) // r["n"] for d in range(len(centroids[0]))]
    return out


def centroid_sha256(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def cluster(vectors: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """`vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`, one row per
    row of `vectors` (`vec_id, embedding`) that takes part; other columns are not read.

    Vectors that are null, hold a null or non-finite component, have another length than
    `dims`, or a component beyond `LARGEST` after scaling, take no part. Starting centroids
    are the vectors with the smallest key, ties to the smaller vector; a null id has no key
    and comes last. Repeated rows all count. With fewer vectors than `clusters` every one
    is a starting centroid; an empty table gives an empty table. An inertia beyond a long
    is null.
    """
    spark = vectors.sparkSession
    kind = dict(vectors.dtypes)["vec_id"]
    rows = quantised(vectors, settings)
    first = rows.orderBy(start_key(settings.seed, F.col("vec_id")).asc_nulls_last(), "v").limit(settings.clusters)
    centroids = [list(r["v"]) for r in first.select("v").collect()]
    if not centroids:
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(settings.rounds):
        centroids = moved(rows, centroids)
    assigned = rows.mapInArrow(_assignments(Bisectors(centroids)), f"vec_id {kind}, cluster int, distance long")
    assigned = Scratch(spark, "bisector").put(assigned, "assigned")
    sums = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    of = [sums.get(c, 0) for c in range(len(centroids))]
    fit = lambda s: s if s < 2**63 else None
    known = [(c, fit(of[c]), fit(sum(of)), centroid_sha256(centroids[c])) for c in range(len(centroids))]  # k rows
    facts = spark.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

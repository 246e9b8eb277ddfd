"""Centroid clustering of vectors in integer arithmetic, with DataFrame expressions only.

A vector is kept if it has exactly ``dims`` components, none null or not finite.  Its
components become the integers ``floor(scale * x)``, held within +-2^27, so that no squared
distance leaves a long.  The first centroids are the kept vectors with the smallest sha256 of
``<salt>:<id>``.

Every round is one scan of the quantised vectors: ``zip_with`` and ``aggregate`` give the
squared distances to the centroids, which are literal arrays of the plan, ``array_min`` of
(distance, number) structs chooses the cluster (ties: the smaller number), and one hash
aggregation sums each component by cluster.  Each task sends one row per cluster, whatever the
sizes of the clusters; ``k`` rows come to the driver and become the next literals as the exact
floor of sum / count.  A cluster without vectors keeps its centroid.

Vectors are quantised once, into the shared folder; a lost executor costs a part of a scan.
Null ids read as empty ones in the hash; equal ids are ordered by their components.  Repeated
rows count as often as they stand.  With fewer kept vectors than ``k``, every one is a
centroid; without any, the result is empty.  A sum of distances beyond a long is null.  Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.llm.repeats import settled

DIMS, SCALE, CENTROIDS, ROUNDS, SALT = 64, 1024, 8, 10, 3
LIMIT = 1 << 27


@dataclass
class Clustering:
    """The quantised vectors (id, q), the final centroids, and the sizes after every round."""

    vectors: DataFrame
    centroids: list[list[int]]
    sizes: list[dict[int, int]]

    def assigned(self) -> DataFrame:
        """(id, q, distance, cluster) of every kept vector."""
        return with_nearest(self.vectors, self.centroids)


def quantised(vectors: DataFrame, key: str, vector: str, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """(id, q): the kept vectors with integer components."""
    x = F.col("x")
    wide = vectors.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("x"))
    usable = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    kept = wide.where((F.size(x) == dims) & usable)
    bounded = F.transform(x, lambda c: F.floor(F.greatest(F.least(c * scale, F.lit(float(LIMIT))), F.lit(float(-LIMIT)))))
    return kept.select("id", bounded.cast("array<bigint>").alias("q"))


def first_centroids(vectors: DataFrame, k: int, salt: int) -> list[list[int]]:
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    return [list(r["q"]) for r in vectors.select("q", digest.alias("h")).orderBy("h", "q").limit(k).collect()]


def squared_distance(q: Column, centroid: list[int]) -> Column:
    squares = F.zip_with(q, F.lit(centroid).cast("array<bigint>"), lambda a, b: (a - b) * (a - b))
    return F.aggregate(squares, F.lit(0).cast("bigint"), lambda s, d: s + d)


def with_nearest(vectors: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """``vectors`` with ``distance`` and ``cluster``."""
    if not centroids:  # then there are no vectors either
        return vectors.withColumns({"distance": F.lit(0).cast("bigint"), "cluster": F.lit(0)})
    each = [F.struct(squared_distance(F.col("q"), c).alias("distance"), F.lit(i).alias("cluster"))
            for i, c in enumerate(centroids)]
    best = F.array_min(F.array(*each))
    return vectors.withColumn("best", best).select("*", "best.distance", "best.cluster").drop("best")


def fit(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS,
        dims: int = DIMS, scale: int = SCALE, salt: int = SALT) -> Clustering:
    own = settled(quantised(vectors, key, vector, dims, scale), "centroid-vectors")
    centroids, sizes = first_centroids(own, k, salt), []
    columns = [F.sum(F.col("q")[i]).alias(f"s{i}") for i in range(dims)]
    for _ in range(rounds if centroids else 0):
        sums = with_nearest(own, centroids).groupBy("cluster").agg(F.count("*").alias("n"), *columns).collect()
        for row in sums:  # at most k rows
            centroids[row["cluster"]] = [row[f"s{i}"] // row["n"] for i in range(dims)]
        sizes.append({row["cluster"]: row["n"] for row in sums})
    return Clustering(own, centroids, sizes)


def cluster_report(found: Clustering, key: str = "vec_id") -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector."""
    near = found.assigned()
    total = near.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()
    by_cluster = {row["cluster"]: int(row["d"]) for row in total}
    fits = lambda v: v if v < 1 << 63 else None
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids]
    sums = F.array(*(F.lit(fits(by_cluster.get(i, 0))).cast("bigint") for i in range(len(digests)))).cast("array<bigint>")
    return near.select(
        F.col("id").alias(key), "cluster", "distance", F.get(sums, F.col("cluster")).alias("cluster_inertia"),
        F.lit(fits(sum(by_cluster.values()))).cast("bigint").alias("inertia"),
        F.get(F.array(*map(F.lit, digests)).cast("array<string>"), F.col("cluster")).alias("centroid_sha256"))

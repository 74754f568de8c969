"""Centroid clustering in whole numbers; the nearest centroid is found by a tournament of bisectors.

For two centroids i < j the points nearer to j lie on one side of a hyperplane: j is nearer exactly where
``2 (c_j - c_i) . x > |c_j|^2 - |c_i|^2``. Normals and thresholds of all pairs are computed once a round. A
vector starts with centroid 0 and meets the others in turn; each of the k - 1 linear tests leaves one winner,
and a zero leaves the smaller number. No distance is computed but that to the final winner.

Vectors that are null, of another length, or hold null or non-finite components are left out. Repeated rows are
clustered like others. Rows without an id are clustered and never start a centroid; among rows of one id the
smallest vector starts first. With fewer than ``k`` vectors each is a start. An empty table gives no rows.
Other columns are not carried on, whatever their names. A component of more than 2^25 after scaling ends the job
with a message, as its distances would not fit a long.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import map_batches, written
from pagemill.llm.whole_vectors import GroupSums, digest, group_means, is_complete, matrix, scaled, slices


@dataclass(frozen=True)
class Clustering:
    """``k`` centroids of ``dims`` components; k * k * dims numbers are held by each task."""

    k: int = 8
    rounds: int = 10
    dims: int = 64
    scale: int = 1024
    seed: int = 3


def bisectors(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normals [i, j, dims] and thresholds [i, j] of all pairs."""
    normals = 2 * (centroids[None, :, :] - centroids[:, None, :])
    squares = np.einsum("kd,kd->k", centroids, centroids)
    return normals, squares[None, :] - squares[:, None]


def tournament(rows: np.ndarray, normals: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """The number of the nearest centroid of every row."""
    winner = np.zeros(len(rows), np.int64)
    for rival in range(1, len(normals)):
        side = np.einsum("nd,nd->n", rows, normals[winner, rival]) - thresholds[winner, rival]
        winner[side > 0] = rival
    return winner


def whole_table(df: DataFrame, params: Clustering, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The kept vectors as whole numbers: (vec_id, whole)."""
    given = df.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("vector"))
    kept = given.where((F.size("vector") == params.dims) & is_complete("vector"))
    return kept.select("vec_id", scaled("vector", params.scale).alias("whole"))


def starts(vectors: DataFrame, params: Clustering) -> np.ndarray:
    """The vectors whose ids have the smallest hashes, in hash order."""
    name = F.concat(F.lit(f"{params.seed}:"), F.col("vec_id").cast("string"))
    first = vectors.where("vec_id is not null").select(F.sha2(name, 256).alias("hash"), "whole")
    rows = first.orderBy("hash", "whole").limit(params.k).collect()
    if len(rows) < params.k:  # rows without an id stand in only where there is no other
        rows += vectors.where("vec_id is null").orderBy("whole").limit(params.k - len(rows)).collect()
    return np.array([row["whole"] for row in rows], np.int64).reshape(len(rows), params.dims)


def adder(normals: np.ndarray, thresholds: np.ndarray) -> Callable[[GroupSums, np.ndarray], None]:
    def add(sums: GroupSums, rows: np.ndarray) -> None:
        sums.take(tournament(rows, normals, thresholds), rows)

    return add


def fit(vectors: DataFrame, params: Clustering) -> np.ndarray:
    """Final centroids [k, dims] over all rows of a written table of whole vectors."""
    centroids = starts(vectors, params)
    for _ in range(params.rounds if len(centroids) else 0):
        add = adder(*bisectors(centroids))
        for cluster, mean in group_means(vectors.select("whole"), len(centroids), params.dims, add).items():
            centroids[cluster] = mean
    return centroids


def assign(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Every vector with its cluster and exact squared distance: (vec_id, cluster, distance)."""
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def make() -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
        normals, thresholds = bisectors(centroids)

        def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for part in slices(batch):
                rows = matrix(part.column("whole"))
                cluster = tournament(rows, normals, thresholds)
                gap = rows - centroids[cluster]
                distance = np.einsum("nd,nd->n", gap, gap)
                columns = [part.column("vec_id"), pa.array(cluster.astype(np.int32)), pa.array(distance)]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "cluster", "distance"])

        return one

    return map_batches(vectors, f"vec_id {kind}, cluster int, distance long", make)


def cluster(df: DataFrame, params: Clustering = Clustering(), vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Cluster all vectors: (vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)."""
    spark = df.sparkSession
    vectors = written(whole_table(df, params, vec_id, vector), "whole-vectors")
    centroids = fit(vectors, params)
    assigned = written(assign(vectors, centroids), "clusters")
    # One row a cluster: at most k rows come to the driver and go out as a lookup.
    total = F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")
    totals = {row["cluster"]: int(row["total"]) for row in assigned.groupBy("cluster").agg(total).collect()}
    rows = [(number, totals.get(number, 0), sum(totals.values()), digest(values)) for number, values in enumerate(centroids)]
    known = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(known), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )

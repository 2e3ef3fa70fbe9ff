"""Centroid clustering by sort-means: exact k-means that compares a vector with few centroids.

In each round the other centroids are ordered by their distance from each centroid. A vector starts at the centroid it was
assigned to and goes through the others in that one's order; it stops at the first that lies strictly beyond twice its own
distance from the old centroid, as none from there on can be nearer, nor as near. All is in integers, so ties are exact.

Scale: a round is a pass over blocks of vectors without an exchange; it gathers a count and a sum for each centroid and component.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import vector_blocks as blocks
from tessera.llm.common import materialise, table

CLUSTERS, ROUNDS, SCALE, DIMS, SEED = 8, 10, 1024, 64, 3
RESULT = "id bigint, cluster int, distance bigint"


def distances(vectors: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    away = vectors - centroid
    return np.einsum("ij,ij->i", away, away)


def nearest(vectors: np.ndarray, before: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest centroid (the smaller number on ties) and its squared distance, from each vector's old one; and how many
    distances that took."""
    between = np.stack([distances(centroids, c) for c in centroids])
    best, found, looks = np.array(before, dtype=np.int32), np.empty(len(vectors), dtype=np.int64), len(vectors)
    for old in np.unique(before):
        rows = np.flatnonzero(before == old)
        own = distances(vectors[rows], centroids[old])
        near, at = own.copy(), np.full(len(rows), old)
        for other in np.argsort(between[old], kind="stable"):
            if other == old:
                continue
            on = np.flatnonzero(between[old, other] <= 4 * own)  # twice the distance, squared; those that stop do so for good
            if not len(on):
                break
            looks += len(on)
            d = distances(vectors[rows[on]], centroids[other])
            better = (d < near[on]) | ((d == near[on]) & (other < at[on]))
            near[on[better]], at[on[better]] = d[better], other
        best[rows], found[rows] = at, near
    return best, found, looks


def _sums(vectors: np.ndarray, cluster: np.ndarray, k: int, looks: int) -> list[int]:
    """For each centroid the count and the sums of components; last, the number of distances."""
    out = np.zeros((k, vectors.shape[1] + 1), dtype=np.int64)
    for c in np.unique(cluster):
        rows = vectors[cluster == c]
        out[c, 0], out[c, 1:] = len(rows), rows.sum(axis=0)
    return [*out.ravel().tolist(), looks]


def moved(centroids: np.ndarray, total: list[int]) -> np.ndarray:
    """Each centroid at the floor of its vectors' mean; without vectors it stays."""
    k, dims = centroids.shape
    out = centroids.copy()
    for c in range(k):
        n, *sums = total[c * (dims + 1) : (c + 1) * (dims + 1)]
        if n:
            out[c] = [s // n for s in sums]
    return out


class Clustering:
    """The outcome: ``assigned`` (id, cluster, distance) of every kept vector, ``centroids`` and, for each pass, how many
    distances it took (``looks``)."""

    def __init__(self, df: DataFrame, *, k: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, dims: int = DIMS, seed: int = SEED, id_col: str = "vec_id", vec_col: str = "embedding"):
        """Vectors with a null, with a number that is not finite, or of another size than ``dims`` are left out. The first
        centroids are the ``k`` vectors whose ids have the smallest hashes; equal ids follow in order of their components, null
        ids come last. With fewer vectors there are fewer centroids; without any the result is empty. Repeated rows count as
        often as they are there, other columns are ignored, and integers beyond 2^26 count as 2^26."""
        rows = blocks.kept(df, id_col, vec_col).where(F.size("v") == dims)
        first = rows.orderBy(F.asc_nulls_last(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)), "v").select("v").limit(k).collect()
        self.looks: list[int] = []
        if not first:
            self.centroids, self.assigned = np.zeros((0, dims), dtype=np.int64), df.sparkSession.createDataFrame([], RESULT)
            return
        self.centroids = blocks.integers(np.array([r[0] for r in first]), scale)
        n = len(first)
        size = n * (dims + 1) + 1
        found = blocks.blocks(rows, scale, dims, lambda v: (np.zeros(len(v), "<i4").tobytes(), [0] * size))
        for last in [False] * rounds + [True]:
            before, found = found, blocks.advance(found, dims, _step(self.centroids))
            total = blocks.totals(found, size)
            self.looks.append(total[-1])
            before.unpersist()
            if not last:
                self.centroids = moved(self.centroids, total)
        self.assigned = materialise(found.mapInArrow(_rows(self.centroids), RESULT), "clusters")
        found.unpersist()

    def digest(self, c: int) -> str:
        """SHA-256 of a centroid's components as decimal integers."""
        return hashlib.sha256(",".join(map(str, self.centroids[c].tolist())).encode()).hexdigest()


def _step(centroids: np.ndarray):
    def run(vectors: np.ndarray, state: bytes, _: list[int]) -> tuple[bytes, list[int]]:
        cluster, _, looks = nearest(vectors, np.frombuffer(state, "<i4"), centroids)
        return cluster.astype("<i4").tobytes(), _sums(vectors, cluster, len(centroids), looks)

    return run


def _rows(centroids: np.ndarray):
    def run(chunks):
        for batch in chunks:
            for i in range(batch.num_rows):
                cluster = np.frombuffer(batch.column("state")[i].as_py(), "<i4")
                vectors = blocks.vectors_of(batch.column("vectors")[i].as_py(), centroids.shape[1])
                away = vectors - centroids[cluster]
                yield pa.record_batch([batch.column("ids")[i].values, pa.array(cluster), pa.array(np.einsum("ij,ij->i", away, away))], names=["id", "cluster", "distance"])

    return run


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = Clustering(table(spark, sf_dir, "embeddings"))
    inertia = [0] * len(done.centroids)
    for c, n in done.assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)"))).collect():  # one row for each centroid
        inertia[c] = int(n)
    given = lambda values, kind: F.get(F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>"), F.col("cluster"))
    return done.assigned.select(
        F.col("id").alias("vec_id"), "cluster", "distance", given(inertia, "bigint").alias("cluster_inertia"), F.lit(sum(inertia)).cast("bigint").alias("inertia"),
        given([done.digest(c) for c in range(len(inertia))], "string").alias("centroid_sha256"),
    )

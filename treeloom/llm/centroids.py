"""Centroid clustering: plain Lloyd over integer vectors.

Each round sends the centroids to every task. ``mapInPandas`` takes the squared
integer differences to one centroid after the other, the smallest wins, the
lower number on ties, and a task hands on one sum for each centroid. The sums
merge through a groupBy, and only they, as many numbers as the centroids have
components, reach the driver. Nothing else is kept between rounds: a lost
executor costs its own tasks, and no group of vectors meets in one task.

The start is drawn by hash of the ids, so that it does not depend on the order
or the number of files.

Defined results: rows whose vector is null, has another number of components
than ``dims``, or holds null, NaN or infinity, are left out. Components become
floor(scale * x); those beyond ``_vectors.reach`` (2**27 for 64 components)
count as that, so that distances fit a long. A null id is hashed as an empty
one. Repeated rows and ids count each time; of rows with equal ids the one of
smaller vector starts first. Centroids that start or become equal keep their
numbers, and the lower one gets the vectors; a centroid without vectors stays
where it is. Fewer vectors than ``k`` make as many centroids; an empty table
gives no rows. Columns other than the id are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.llm import _vectors
from treeloom.plans.durable import stored


def nearest(points: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each point the number of its nearest centroid, the lowest on ties, and the squared distance."""
    apart = np.stack([np.square(points - c).sum(axis=1) for c in centroids], axis=1)
    at = apart.argmin(axis=1)
    return at, apart[np.arange(len(at)), at]


def _rows(vectors: DataFrame, dims: int, id: str, vector: str) -> DataFrame:
    v = F.col(vector)
    return vectors.where(_vectors.sound(v, dims)).select(F.col(id).cast("string").alias("id"), v.cast("array<double>").alias("vector"))


def fit(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: float = 64.0, salt: str = "1", id: str = "vec_id", vector: str = "embedding") -> np.ndarray:
    """The centroids (at most ``k``, ``dims`` integers each) after ``rounds`` rounds over all vectors."""
    rows = _rows(vectors, dims, id, vector)
    hashed = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce("id", F.lit(""))), 256)
    first = rows.select(hashed.alias("hash"), "vector").orderBy("hash", "vector").limit(k).collect()
    centroids = _vectors.integers(np.array([r.vector for r in first], np.float64).reshape(len(first), dims), scale)
    for _ in range(rounds if len(first) else 0):
        held = rows.sparkSession.sparkContext.broadcast(centroids)

        def sums(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            n = np.zeros(len(held.value), np.int64)
            total = np.zeros(held.value.shape, np.int64)
            for b in batches:
                points = _vectors.integers(np.stack(b["vector"].to_list()), scale)
                at, _ = nearest(points, held.value)
                n += np.bincount(at, minlength=len(n))
                np.add.at(total, at, points)
            if (got := np.flatnonzero(n)).size:
                yield pd.DataFrame({"part": 0, "entry": got, "n": n[got], "sums": list(total[got])})

        found = _vectors.merged(rows.select("vector").mapInPandas(sums, _vectors.SUMS))
        held.unpersist()
        centroids = np.array([[x // found[0, c][0] for x in found[0, c][1]] if (0, c) in found else old for c, old in enumerate(centroids.tolist())], np.int64)
    return centroids


def assign(vectors: DataFrame, centroids: np.ndarray, scale: float = 64.0, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, cluster, distance) of every vector: its nearest centroid's number and the squared distance to it."""
    kind = vectors.schema[id].dataType
    if not len(centroids):
        return vectors.select(id).where("false").withColumns({"cluster": F.lit(0), "distance": F.lit(0).cast("long")})
    held = vectors.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at, apart = nearest(_vectors.integers(np.stack(b["vector"].to_list()), scale), held.value)
            yield pd.DataFrame({"id": b["id"], "cluster": at, "distance": apart})

    # ids travel as text: pandas would turn whole numbers beside nulls into doubles
    out = _rows(vectors, centroids.shape[1], id, vector).mapInPandas(run, "id string, cluster int, distance long")
    return out.select(F.col("id").cast(kind).alias(id), "cluster", "distance")


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: float = 64.0, salt: str = "1", id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid) of every vector under the fitted centroids."""
    centroids = fit(vectors, k, rounds, dims, scale, salt, id, vector)
    out = stored(assign(vectors, centroids, scale, id, vector))
    per = {r.cluster: r for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("x")).collect()}  # at most k rows
    most = (1 << 63) - 1
    whole = min(most, sum(int(r.x) for r in per.values()))
    known = [(c, min(most, int(r.x)), whole, centroids[c].tolist()) for c, r in per.items()]
    table = out.sparkSession.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return out.join(F.broadcast(table), "cluster").select(id, "cluster", "distance", "cluster_inertia", "inertia", "centroid")

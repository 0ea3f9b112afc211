"""Centroid clustering of integer vectors; every assignment is an Orchard search over sorted neighbour lists."""
from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanquarry.llm.shared import cut


def neighbour_lists(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every centroid all others by ascending distance (ties: smaller number), and their squared distances."""
    apart = np.stack([((centroids - c) ** 2).sum(1) for c in centroids])
    np.fill_diagonal(apart, -1)
    order = np.argsort(apart, axis=1, kind="stable")[:, 1:]
    return order, np.take_along_axis(apart, order, 1)


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of every vector's nearest centroid; of equally near ones the smaller number.

    A search walks the list of its current centroid, measures what it has not visited, and goes on at the head of the
    list of a closer centroid as soon as one is found. It stops where the list is strictly beyond twice the current
    distance: what follows is farther from the vector than its centroid is. All searches of a batch take a step at once.
    """
    order, apart = neighbour_lists(centroids)
    best, at = np.zeros(len(vectors), np.int64), np.zeros(len(vectors), np.int64)
    distance = ((vectors - centroids[0]) ** 2).sum(1)
    visited = np.zeros((len(vectors), len(centroids)), bool)
    visited[:, 0] = True
    going = np.arange(len(vectors))
    while True:
        going = going[at[going] < order.shape[1]]
        going = going[apart[best[going], at[going]] <= 4 * distance[going]]  # squares: twice the distance is four times
        if not len(going):
            return best, distance
        found = order[best[going], at[going]]
        at[going] += 1
        new = ~visited[going, found]
        rows, found = going[new], found[new]
        visited[rows, found] = True
        d = ((vectors[rows] - centroids[found]) ** 2).sum(1)
        closer = (d < distance[rows]) | ((d == distance[rows]) & (found < best[rows]))
        rows = rows[closer]
        best[rows], distance[rows], at[rows] = found[closer], d[closer], 0


def quantised(vectors: DataFrame, dims: int = 64, scale: int = 64) -> DataFrame:
    """``vec_id, v``: the vectors of exactly ``dims`` finite components, each as floor(scale * x) in double precision.

    A scaled component so large that squared distances would leave 64 bits is an error, not a wrong distance.
    """
    limit = math.isqrt((1 << 63) // (16 * dims))
    x = F.col("embedding")
    kept = vectors.select("vec_id", "embedding").where(
        (F.size(x) == dims) & ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))))
    return kept.select("vec_id", F.transform(x, lambda e: F.floor(e.cast("double") * scale).cast("long")).alias("v")).withColumn(
        "v", F.when(F.exists("v", lambda e: (e > limit) | (e < -limit)), F.raise_error(F.lit(f"a scaled component is beyond {limit}")).cast("array<long>")).otherwise(F.col("v")))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_list()).astype(np.int64)


def starts(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors of least sha256 of ``seed:vec_id``, in that order (ties by content); only they reach the driver."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    return np.array([r["v"] for r in vectors.orderBy(F.sha2(name, 256), "v").limit(k).collect()], np.int64)


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Every centroid at the exact componentwise floor of the mean of its vectors; one without vectors stays.

    A batch gives one row of sums per centroid, so what is shuffled does not grow with the vectors of a cluster.
    """
    dims = centroids.shape[1]

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            v = _matrix(b["v"])
            best, _ = nearest(v, centroids)
            yield pd.DataFrame([(int(c), int((best == c).sum()), v[best == c].sum(0)) for c in np.unique(best)], columns=["cluster", "n", "total"])

    parts = vectors.select("v").mapInPandas(sums, "cluster int, n long, total array<long>")
    whole = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[i].cast("decimal(38,0)")) for i in range(dims)]).alias("total"))
    out = centroids.copy()
    for r in whole.collect():  # at most one row a centroid
        out[r["cluster"]] = [int(t) // r["n"] for t in r["total"]]
    return out


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``vectors`` with ``cluster`` and squared ``distance``."""

    @F.pandas_udf("cluster int, distance long")
    def search(column: pd.Series) -> pd.DataFrame:
        best, distance = nearest(_matrix(column), centroids) if len(column) else (np.zeros(0, int), np.zeros(0, int))
        return pd.DataFrame({"cluster": best.astype(np.int32), "distance": distance})

    return vectors.withColumn("__found", search("v")).select(*vectors.columns, "__found.cluster", "__found.distance")


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every kept row of ``vec_id, embedding``.

    Only the centroids (``k`` rows of ``dims`` numbers, whatever the table's size) are held by the driver and sent to the
    tasks; a round is one pass over the written vectors. Defined results: vectors that are null, of another length, or
    hold a null or non-finite component give no row; a null vec_id is kept and counts as an empty text when the start
    is chosen; rows that repeat are rows of their own; fewer vectors than ``k`` make as many centroids; without any
    the result is empty. Other columns of ``vectors`` are ignored.
    """
    spark = vectors.sparkSession
    kept = cut(quantised(vectors, dims, scale))
    centroids = starts(kept, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        centroids = moved(kept, centroids)
    found = cut(assigned(kept, centroids).drop("v"))
    inertia = {r["cluster"]: int(r["d"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    about = [(c, d, sum(inertia.values()), sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, d in inertia.items()]
    clusters = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(clusters), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1) -> str:
    """The same clustering in SQL, each round written out."""
    steps = [f"""kept AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}),
cells AS (SELECT r, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM kept),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS c, v FROM kept QUALIFY c < {k})"""]
    for n in range(rounds + 1):
        steps.append(f"""a{n} AS (
  SELECT r, vec_id, c, d FROM (
    SELECT kept.r, kept.vec_id, c{n}.c, list_sum(list_transform(range(1, {dims + 1}), lambda i: (kept.v[i] - c{n}.v[i]) * (kept.v[i] - c{n}.v[i]))) AS d
    FROM kept, c{n}) QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)""")
        if n < rounds:
            steps.append(f"""c{n + 1} AS (
  SELECT c{n}.c, coalesce(m.v, c{n}.v) AS v FROM c{n} LEFT JOIN (
    SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM (
      SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM a{n} JOIN cells USING (r) GROUP BY c, i) GROUP BY c) m ON m.c = c{n}.c)""")
    return "WITH " + ",\n".join(steps) + f"""
SELECT a.vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance,
  CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(list_transform(m.v, lambda x: CAST(x AS VARCHAR)), ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} m ON m.c = a.c"""

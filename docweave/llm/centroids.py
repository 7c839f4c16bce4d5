"""Centroid clustering: plain Lloyd rounds on whole numbers.

The centroids, `k` rows of `dims` numbers, are broadcast. In a round every task computes the squared differences between its vectors and
each centroid, takes the nearest one, and adds up the vectors of each cluster; the tasks' sums, a row per cluster and dimension,
merge through a groupBy. Only the merged sums, k * (dims + 1) numbers, come back to the driver. All arithmetic is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.functions.session import spool

#: Vectors compared with a centroid at a time.
CHUNK = 2048
#: The largest number of 64 bits, and the largest that floating point has below it.
LARGEST, BORDER = 2**63 - 1, float(2**63 - 1024)


def whole_numbers(vectors: list, scale: float, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors that take part, and their components as floor(scale * x): 64 bits where squared distances fit, else Python numbers."""
    size = np.array([-1 if v is None else len(v) for v in vectors])
    at = np.flatnonzero(size == dims)
    x = np.array([np.asarray(vectors[i], np.float64) for i in at]).reshape(len(at), dims)  # a null component is NaN
    fine = np.isfinite(x).all(axis=1)
    with np.errstate(over="ignore"):
        x = np.clip(np.floor(x[fine] * scale), -(2.0**63), BORDER)
    if dims * 4 * np.abs(x).max(initial=0) ** 2 < BORDER:
        return at[fine], x.astype(np.int64)
    return at[fine], np.array([[int(c) for c in row] for row in x.tolist()], object).reshape(x.shape)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each vector, the lowest index among equals, and its squared distance."""
    most = max(int(np.abs(a).max(initial=0)) for a in (x, centroids))
    bound = x.shape[1] * 4 * most**2
    kind = object if x.dtype == object or bound > LARGEST else np.int32 if bound < 2**31 else np.int64
    x, c = x.astype(kind), centroids.astype(kind)
    distance = np.empty((len(x), len(c)), kind)
    for i in range(0, len(x), CHUNK):
        part = x[i : i + CHUNK]
        for k in range(len(c)):
            d = part - c[k]
            distance[i : i + CHUNK, k] = (d * d).sum(axis=1) if kind is object else np.einsum("ij,ij->i", d, d)
    at = distance.argmin(axis=1)
    distance = distance[np.arange(len(x)), at]
    return at, (np.minimum(distance, LARGEST) if kind is object else distance).astype(np.int64)


def seeds(vectors: DataFrame, k: int, id_col: str, vector_col: str, scale: float, dims: int, salt: str) -> np.ndarray:
    """The k vectors that take part whose id has the smallest hash, in order of the hash; of equal ids, by their components."""
    v = F.col(vector_col).cast("array<double>")
    fine = (F.size(v) == dims) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    drawn = F.sha2(F.concat(F.lit(salt), F.col(id_col).cast("string")), 256)
    first = vectors.where(F.col(id_col).isNotNull() & fine).select(drawn.alias("draw"), v.alias("v")).orderBy("draw", "v").limit(k).collect()
    _, x = whole_numbers([r.v for r in first], scale, dims)
    return x


def assigned(vectors: DataFrame, centroids: np.ndarray, id_col: str, vector_col: str, scale: float, dims: int) -> DataFrame:
    """(id, cluster, distance) of every vector that takes part; a distance beyond 64 bits stands at the border."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at, x = whole_numbers(b["v"].tolist(), scale, dims)
            cluster, distance = nearest(x, shared.value)
            yield pd.DataFrame({"id": b["id"].to_numpy()[at], "cluster": cluster.astype(np.int32), "distance": distance})

    return rows_of(vectors, id_col, vector_col).mapInPandas(run, "id long, cluster int, distance long")


def rows_of(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    return vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))


def moved(vectors: DataFrame, centroids: np.ndarray, id_col: str, vector_col: str, scale: float, dims: int) -> np.ndarray:
    """The centroids after one round: floor of sum by count over each cluster; an empty one stays."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, count = np.zeros(shared.value.shape, object), np.zeros(len(shared.value), np.int64)
        for b in batches:
            _, x = whole_numbers(b["v"].tolist(), scale, dims)
            cluster, _ = nearest(x, shared.value)
            for k in np.unique(cluster).tolist():
                own = x[cluster == k]
                count[k] += len(own)
                total[k] += own.sum(axis=0)
        k, d = np.nonzero(np.broadcast_to((count > 0)[:, None], total.shape))
        if len(k):
            yield pd.DataFrame({"cluster": k.astype(np.int32), "dim": d.astype(np.int32), "n": count[k], "total": [str(x) for x in total[k, d]]})

    part = rows_of(vectors, id_col, vector_col).mapInPandas(sums, "cluster int, dim int, n long, total string")
    merged = part.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    new = centroids.astype(object)
    for r in merged:
        new[r.cluster, r.dim] = int(r.total) // r.n
    shared.unpersist()
    return new


def lloyd(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0, salt: str = "2:") -> tuple[DataFrame, np.ndarray]:
    """((id, cluster, distance) of every vector that takes part, the final centroids).

    A vector takes part if its id is not null and it has exactly `dims` components, none null or non-finite; components become floor(scale * x).
    Centroids start as the k vectors with the smallest sha256 of `salt` and id, in that order; fewer vectors, fewer centroids. Each round assigns every vector to the
    nearest centroid, ties to the smaller number, and moves every centroid that has vectors to the floor of their mean. Then vectors are assigned once more.
    Repeated rows, and rows that share an id, count each by themselves. A component, distance or sum beyond 64 bits stands at
    the border; everything else is exact. Other columns are not looked at. An empty table, or one without a vector that takes part, gives no rows.
    """
    args = (id_col, vector_col, scale, dims)
    centroids = seeds(vectors, k, *args, salt)
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], "id long, cluster int, distance long"), centroids
    for _ in range(rounds):
        centroids = moved(vectors, centroids, *args)
    return assigned(vectors, centroids, *args), centroids


def clusters(vectors: DataFrame, **options) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of `lloyd`: with the distances summed over the cluster and over all, and the hash of the
    final centroid's components, joined by commas."""
    found, centroids = lloyd(vectors, **options)
    found = spool(found, "clusters")
    # at most k rows
    own = {r.cluster: int(r.own) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own")).collect()}
    rows = [(i, min(own.get(i, 0), LARGEST), min(sum(own.values()), LARGEST), ",".join(str(x) for x in c)) for i, c in enumerate(centroids.tolist())]
    sums = found.sparkSession.createDataFrame(rows, "number int, cluster_inertia long, inertia long, components string").withColumn("centroid_sha256", F.sha2("components", 256))
    return found.join(F.broadcast(sums), found["cluster"] == sums["number"]).select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def query(spark, sf_dir: str) -> DataFrame:
    """op12: 40 clusters of all `embeddings` vectors of 64 components, after 5 rounds."""
    from docweave.functions.session import table

    return clusters(table(spark, sf_dir, "embeddings"))


def oracle(k: int = 40, rounds: int = 5, dims: int = 64) -> str:
    """SQL of the query: each round is a pair of expressions."""
    parts = [
        f"f AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1)::INT AS cluster, v FROM f ORDER BY sha256('2:' || vec_id) LIMIT {k})",
    ]
    for i in range(rounds + 1):
        parts.append(
            f"d{i} AS (SELECT f.vec_id, c.cluster, list_sum(list_transform(list_zip(f.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS distance FROM f, c{i} c),"
            f"a{i} AS MATERIALIZED (SELECT vec_id, arg_min(cluster, (distance, cluster)) AS cluster, min(distance) AS distance FROM d{i} GROUP BY vec_id)"
        )
        if i < rounds:
            parts.append(
                f"m{i} AS (SELECT cluster, unnest(range(1, {dims + 1})) AS dim, unnest(v) AS x FROM a{i} JOIN f USING (vec_id)),"
                f"t{i} AS (SELECT cluster, dim, sum(x)::BIGINT AS s, count(*) AS n FROM m{i} GROUP BY cluster, dim),"
                f"n{i} AS (SELECT cluster, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY dim) AS v FROM t{i} GROUP BY cluster),"
                f"c{i + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(n{i}.v, c.v) AS v FROM c{i} c LEFT JOIN n{i} USING (cluster))"
            )
    return f"""
WITH {", ".join(parts)}
SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} c USING (cluster)
"""


ORACLE = oracle()

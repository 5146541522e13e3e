"""Centroid clustering by Lloyd's rounds in whole numbers.

Centroids are broadcast; each task sums, for each centroid, the vectors nearest
to it, and the sums of all tasks merge in one aggregation. Distances, sums and
means are integers, so a result depends neither on how rows are dealt nor on how
often a task ran.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable

#: Components lie below this in size, so that squared distances and their sums over a task fit 64 bits.
LARGEST = 1 << 26


def quantised(vectors: DataFrame, dims: int, scale: int) -> DataFrame:
    """``(vec_id long, v array<int>)``: floor(scale * x) of each component, as double.

    Rows stay whose ``embedding`` has ``dims`` components, none null or
    non-finite; a null ``vec_id`` stays null, repeated rows stay. A component of
    ``LARGEST`` or more after scaling is an error, since its square has no place.
    """
    x = F.col("embedding").cast("array<double>")
    whole = F.coalesce(F.size(x) == dims, F.lit(False)) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    small = lambda c: F.when(F.abs(c * F.lit(float(scale))) < LARGEST, F.floor(c * F.lit(float(scale))).cast("int")).otherwise(F.raise_error(F.lit(f"a component is {LARGEST} or more after scaling")).cast("int"))
    return vectors.where(whole).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, small).alias("v"))


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances, a column for each centroid."""
    out = np.empty((len(x), len(centroids)), np.int64)
    for k, c in enumerate(centroids):
        out[:, k] = np.square(x - c).sum(axis=1)
    return out


def first_centroids(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The vectors of the ``k`` smallest sha256 of ``seed:vec_id``, in that order; of equal ids the smaller vector first. Rows without an id are not chosen."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    chosen = rows.where(F.col("vec_id").isNotNull()).orderBy(h, "v").limit(k).select("v").collect()
    return np.array([r.v for r in chosen], np.int64)


def moved(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: of each that has vectors, the componentwise floor of their mean; the others as they were."""
    k, dims = centroids.shape
    shared = rows.sparkSession.sparkContext.broadcast(centroids)

    def sums(batches):
        count, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for b in batches:
            if len(b):
                x = np.stack(b["v"].to_numpy()).astype(np.int64)
                near = distances(x, shared.value).argmin(axis=1)
                count += np.bincount(near, minlength=k)
                for c in np.unique(near):
                    total[c] += x[near == c].sum(axis=0)
        has = np.flatnonzero(count)
        if len(has):
            yield pd.DataFrame({"cluster": has.astype(np.int32), "n": count[has], "total": list(total[has])})

    parts = rows.select("v").mapInPandas(sums, "cluster int, n long, total array<long>")
    merged = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[i]) for i in range(dims)]).alias("total")).collect()
    after = centroids.copy()
    for r in merged:
        after[r.cluster] = [t // r.n for t in r.total]
    return after


def assigned(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``(vec_id, cluster, distance)``: the nearest centroid of each row, of equally near ones the first."""
    shared = rows.sparkSession.sparkContext.broadcast(centroids)

    def nearest(batches):
        for b in batches:
            if len(b):
                d = distances(np.stack(b["v"].to_numpy()).astype(np.int64), shared.value)
                yield pd.DataFrame({"vec_id": b["vec_id"].astype("Int64"), "cluster": d.argmin(axis=1).astype(np.int32), "distance": d.min(axis=1)})

    return rows.mapInPandas(nearest, "vec_id long, cluster int, distance long")


def lloyd(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1) -> DataFrame:
    """``(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)``, a row for each row that :func:`quantised` keeps.

    ``vectors`` holds ``(vec_id, embedding)``; other columns are not used. It is
    read once a round, so a costly plan is to be cut before. ``k`` times ``dims``
    numbers are broadcast and come back to the driver in a round; both are
    parameters. With fewer than ``k`` rows that can be chosen there are as many
    centroids; without any, no row. Equally near centroids: the smaller number.
    """
    spark, rows = vectors.sparkSession, quantised(vectors, dims, scale)
    centroids = first_centroids(rows, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        centroids = moved(rows, centroids)
    found = durable(assigned(rows, centroids))
    inertia = {r.cluster: r.d for r in found.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    digest = lambda c: hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()
    per = spark.createDataFrame([(c, d, sum(inertia.values()), digest(c)) for c, d in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(per), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle_sql(k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1) -> str:
    """The same in DuckDB's SQL, a pair of steps for each round."""
    steps = [
        f"""v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v, row_number() OVER () AS r
    FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)""",
        f"""c0 AS (
    SELECT CAST(row_number() OVER (ORDER BY h, v) - 1 AS INTEGER) AS cluster, v AS c
    FROM (SELECT sha256('{seed}:' || vec_id) AS h, v FROM v WHERE vec_id IS NOT NULL ORDER BY h, v LIMIT {k})
)""",
    ]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS (
    SELECT r, any_value(vec_id) AS vec_id, any_value(v) AS v, min((d, cluster)) AS near
    FROM (SELECT r, vec_id, v, cluster, CAST(list_sum(list_transform(range(1, {dims} + 1), lambda i: (v[i] - c[i]) * (v[i] - c[i]))) AS BIGINT) AS d FROM v, c{i}) GROUP BY r
)""")
        if i < rounds:
            steps.append(f"""s{i} AS (
    SELECT cluster, list(CASE WHEN t % n < 0 THEN t // n - 1 ELSE t // n END ORDER BY p) AS c
    FROM (SELECT near[2] AS cluster, p, CAST(sum(x) AS BIGINT) AS t, count(*) AS n FROM (SELECT near, unnest(v) AS x, unnest(range({dims})) AS p FROM a{i}) GROUP BY ALL) GROUP BY cluster
), c{i + 1} AS (SELECT cluster, coalesce(s{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN s{i} USING (cluster))""")
    return (
        "WITH "
        + ", ".join(steps)
        + f"""
SELECT vec_id, near[2] AS cluster, near[1] AS distance, CAST(sum(near[1]) OVER (PARTITION BY near[2]) AS BIGINT) AS cluster_inertia,
       CAST(sum(near[1]) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON near[2] = cluster
"""
    )

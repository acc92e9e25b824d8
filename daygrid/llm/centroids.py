"""Centroid clustering of whole-number vectors, with lower bounds by Ptolemy's inequality.

The starting centroids are also the pivots, and stay so while the centroids move.
Every vector's distances to the pivots are computed once and written beside it. For
a pivot pair (p, s), a vector q and a centroid o, Ptolemy's inequality gives

    d(q, o) >= |d(q, p) d(o, s) - d(q, s) d(o, p)| / d(p, s),

so a round computes the distances of the few centroids to the pivots, bounds all
distances from what is cached, and computes exactly only those that the bounds, rounded
towards zero, leave possible. All exact distances and sums are whole numbers.

A round is one pass over the written vectors with partial sums per task; what comes
to the driver are the sums of at most ``k`` clusters. A repeated task gives the same.

Defined results: vectors that are null, hold null or non-finite components, or have
another length take no part, and neither does an empty table. A row without id is
clustered but starts no centroid. Repeated rows each count. Ids that come twice are
put in order by their vectors where centroids are chosen. With fewer vectors with an
id than ``k``, there are as many centroids. Components outside the longs are held at
their ends; a distance or sum that does not fit a long is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daygrid.llm.common import small_batches
from daygrid.llm.exact import LONG_END, exact_rows, finite, halves, matrix, scaled
from daygrid.session import stable

DIM = 64
CLUSTERS = 16
ROUNDS = 3
FACTOR = 64
# Bounds give way by this share of what was rounded, some units in the last place more than can add up.
SLACK = 32 * np.finfo(np.float64).eps


def squares(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows to one centre."""
    gap = x - centre
    return (gap * gap).sum(axis=1)


def pivot_pairs(pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbours in the ring of pivots that differ, with their distance."""
    first = np.arange(len(pivots))
    second = np.roll(first, -1)
    apart = np.array([float(d) ** 0.5 for d in (squares(pivots[[i]], pivots[j])[0] for i, j in zip(first, second, strict=True))])
    return first[apart > 0], second[apart > 0], apart[apart > 0]


def roots(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(np.float64))


def lower_bounds(gaps: np.ndarray, to_pivots: np.ndarray, pairs: tuple) -> np.ndarray:
    """Distances that rows can not fall below, rows x centroids, from distances to the pivots."""
    least = np.zeros((len(gaps), len(to_pivots)))
    for p, s, apart in zip(*pairs, strict=True):
        one, two = np.outer(gaps[:, p], to_pivots[:, s]), np.outer(gaps[:, s], to_pivots[:, p])
        bound = (np.abs(one - two) - SLACK * (one + two)) / apart * (1 - SLACK)
        np.maximum(least, bound, out=least)
    return least


def assign(x: np.ndarray, gaps: np.ndarray, centroids: np.ndarray, to_pivots: np.ndarray, pairs: tuple) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest centroid of each row (ties: the smaller number), its squared distance, and how many were computed."""
    least = lower_bounds(gaps, to_pivots, pairs)
    cluster = least.argmin(axis=1)
    best = np.empty(len(x), dtype=x.dtype)
    for j in np.unique(cluster):
        at = np.flatnonzero(cluster == j)
        best[at] = squares(x[at], centroids[j])
    first, made = cluster.copy(), len(x)
    for j in range(len(centroids)):
        reach = best.astype(np.float64) * (1 + SLACK)
        at = np.flatnonzero((least[:, j] ** 2 * (1 - SLACK) <= reach) & (first != j))
        d = squares(x[at], centroids[j])
        better = (d < best[at]) | ((d == best[at]) & (j < cluster[at]))
        best[at[better]], cluster[at[better]] = d[better], j
        made += len(at)
    return cluster, best, made


def fitting(total) -> int | None:
    return int(total) if total is not None and total <= LONG_END else None


def start(kept: DataFrame, k: int) -> list[list[int]]:
    """The k vectors with the smallest hash of their id, a bounded list."""
    order = F.sha2(F.concat(F.lit("1:"), F.col("id").cast("string")), 256)
    return [r["x"] for r in kept.filter("id IS NOT NULL").orderBy(order, "x").select("x").limit(k).collect()]


def rows_of(values: list[list[int]]) -> np.ndarray:
    """Integer rows for exact arithmetic."""
    return exact_rows(np.array(values, dtype=np.int64))


def with_pivot_distances(kept: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(id, x, gaps): each vector with its distances to the pivots."""
    kind = kept.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = exact_rows(matrix(batch.column(1), pivots.shape[1]))
            gaps = np.stack([roots(squares(x, p)) for p in pivots], axis=1) if len(x) else np.empty((0, len(pivots)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(pivots), pa.int32()), pa.array(gaps.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["id", "x", "gaps"])

    return stable(kept.select("id", "x").mapInArrow(run, f"id {kind}, x array<long>, gaps array<double>"), "pivot_distances")


def nearest_of(batch: pa.RecordBatch, centroids: np.ndarray, to_pivots: np.ndarray, pairs: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Components, cluster and squared distance of a batch of ``with_pivot_distances``."""
    x = matrix(batch.column(1), centroids.shape[1])
    gaps = matrix(batch.column(2), to_pivots.shape[1])
    exact = exact_rows(x)
    if exact.dtype != centroids.dtype:
        exact, centroids = exact.astype(object), centroids.astype(object)
    cluster, best, _ = assign(exact, gaps, centroids, to_pivots, pairs)
    return x, cluster, best


def moved(vectors: DataFrame, centroids: np.ndarray, pivots: np.ndarray, pairs: tuple) -> np.ndarray:
    """The centroids after one round."""
    to_pivots, k, dim = np.stack([roots(squares(centroids, p)) for p in pivots], axis=1), len(centroids), centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, high, low = np.zeros(k, np.int64), np.zeros((k, dim), np.int64), np.zeros((k, dim), np.int64)
        for batch in batches:
            x, cluster, _ = nearest_of(batch, centroids, to_pivots, pairs)
            for j in np.unique(cluster):
                mine = x[cluster == j]
                count[j] += len(mine)
                h, w = halves(mine)
                high[j] += h
                low[j] += w
        held = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(held, dim)),
                pa.array(np.tile(np.arange(dim), len(held))),
                pa.array(np.repeat(count[held], dim)),
                pa.array(high[held].ravel()),
                pa.array(low[held].ravel()),
            ],
            names=["cluster", "pos", "n", "high", "low"],
        )

    parts = vectors.mapInArrow(run, "cluster long, pos long, n long, high long, low long")
    whole = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    sums = parts.groupBy("cluster", "pos").agg(F.sum("n").alias("n"), whole("high"), whole("low"))
    after = centroids.astype(object)
    for r in sums.collect():  # at most k x dim rows
        after[r["cluster"], r["pos"]] = ((int(r["high"]) << 32) + int(r["low"])) // r["n"]
    return exact_rows(after.astype(np.int64))


def cluster(
    vectors: DataFrame,
    k: int = CLUSTERS,
    rounds: int = ROUNDS,
    dim: int = DIM,
    factor: int = FACTOR,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector of ``dim`` finite components."""
    spark = vectors.sparkSession
    small_batches(spark, 5000)
    fine = vectors.filter((F.size(vector_col) == dim) & finite(F.col(vector_col)))
    kept = fine.select(F.col(id_col).alias("id"), scaled(F.col(vector_col), factor).alias("x"))
    kind = kept.schema["id"].dataType.simpleString()
    seeds = start(kept, k)
    if not seeds:
        schema = f"`{id_col}` {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return spark.createDataFrame([], schema)
    pivots = centroids = rows_of(seeds)
    pairs = pivot_pairs(pivots)
    own = with_pivot_distances(kept, pivots)
    for _ in range(rounds):
        centroids = moved(own, centroids, pivots, pairs)
    to_pivots = np.stack([roots(squares(centroids, p)) for p in pivots], axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, nearest, d = nearest_of(batch, centroids, to_pivots, pairs)
            fits = pa.array([int(v) if v <= LONG_END else None for v in d], pa.int64()) if d.dtype == object else pa.array(d)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nearest.astype(np.int32)), fits], names=["id", "cluster", "distance"])

    found = stable(own.mapInArrow(run, f"id {kind}, cluster int, distance long"), "clusters")
    known = F.count("distance") == F.count("*")
    known = F.count("distance") == F.count("*")
    sums = found.groupBy("cluster").agg(F.when(known, F.sum(F.col("distance").cast("decimal(38,0)"))).alias("inertia")).collect()  # at most k rows
    inertia = {r["cluster"]: r["inertia"] for r in sums}
    total = None if None in inertia.values() else fitting(sum(inertia.values()))
    names = [sha256(",".join(map(str, map(int, c))).encode()).hexdigest() for c in centroids]
    facts = spark.createDataFrame(
        [(j, fitting(s), total, names[j]) for j, s in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    )
    return found.join(F.broadcast(facts), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def cluster_sql(k: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, factor: int = FACTOR) -> str:
    """The same in DuckDB, every distance computed."""
    steps = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda c: CAST(floor({factor} * CAST(c AS DOUBLE)) AS BIGINT)) AS x
            FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = {dim})""",
        f"l AS MATERIALIZED (SELECT r, unnest(x) AS x, unnest(range({dim})) AS p FROM v)",
        f"""s AS (SELECT x, row_number() OVER (ORDER BY sha256('1:' || vec_id), x) - 1 AS k FROM v WHERE vec_id IS NOT NULL
            QUALIFY row_number() OVER (ORDER BY sha256('1:' || vec_id), x) <= {k})""",
        f"c0 AS MATERIALIZED (SELECT k, unnest(x) AS x, unnest(range({dim})) AS p FROM s)",
    ]
    for i in range(rounds + 1):
        steps.append(
            f"""a{i} AS MATERIALIZED (SELECT r, arg_min(k, (d, k)) AS k, min(d) AS d FROM (
                SELECT r, k, CAST(sum((l.x - c.x) * (l.x - c.x)) AS BIGINT) AS d FROM l JOIN c{i} c USING (p) GROUP BY r, k) GROUP BY r)"""
        )
        if i < rounds:
            steps.append(
                f"""m{i} AS (SELECT k, p, CAST(sum(x) AS BIGINT) AS t, count(*) AS n FROM a{i} JOIN l USING (r) GROUP BY k, p),
                c{i + 1} AS MATERIALIZED (SELECT k, p, coalesce(CASE WHEN t % n < 0 THEN t // n - 1 ELSE t // n END, x) AS x FROM c{i} LEFT JOIN m{i} USING (k, p))"""
            )
    return f"""WITH {", ".join(steps)},
    h AS (SELECT k, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p)) AS centroid_sha256 FROM c{rounds} GROUP BY k),
    n AS (SELECT k, CAST(sum(d) AS BIGINT) AS cluster_inertia FROM a{rounds} GROUP BY k)
    SELECT vec_id, CAST(k AS INTEGER) AS cluster, d AS distance, cluster_inertia, CAST((SELECT sum(d) FROM a{rounds}) AS BIGINT) AS inertia, centroid_sha256
    FROM v JOIN a{rounds} USING (r) JOIN h USING (k) JOIN n USING (k)"""

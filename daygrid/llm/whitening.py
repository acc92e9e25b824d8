"""Embedding whitening: pivoted Cholesky of the centred scatter, one-sided Jacobi on its factor.

The fit list holds each distinct vector of whole numbers once, so a vector that a third
of all rows share weighs as one. Tasks keep count, mean and centred co-moments of what
they read and merge batch by batch with the difference of the means, never raw second
moments; their results are merged in groups and the groups once more, so that no task
holds all of them. Per-dimension sums are whole numbers.

The scatter A (dimensions x dimensions) is factored as A = G G' by Cholesky with the largest
remaining diagonal entry as pivot, G being the triangular factor with its rows put back
in order. One-sided Jacobi rotates the columns of G until they are orthogonal:
their squared norms are then the eigenvalues of A, and the columns divided by their
norms its eigenvectors. All components are found to double precision, small ones too, as
A is never squared.

Projection, exact deviation and the check of the whitened covariance are column
expressions and one more pass over the fit list.

Defined results: vectors that are null or hold null or non-finite components take no
part; neither do empty vectors. Vectors of each length are a fit of their own. Rows
without id and repeated rows are returned as they come. Components of no variance
(rank below four, a single distinct vector, equal vectors) have no rows. The
largest entry of a component is positive. Numbers outside the longs are held at
their ends before the fit; a deviation that does not fit a long is null.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daygrid.llm.common import bucket_of, small_batches
from daygrid.llm.exact import finite, halves, scaled
from daygrid.session import checked_broadcast, stable

FACTOR = 256
COMPONENTS = 4
SWEEPS = 60
HELD_ENTRIES = 4_000_000  # of co-moments in a task, reached only where vectors have very many lengths
PART = "dim int, n long, high array<long>, low array<long>, most double, mean array<double>, moments array<double>"


def merged(a: tuple, b: tuple) -> tuple:
    """Count, mean and centred co-moments of two disjoint parts together."""
    (n, mean, moments), (m, other, more) = a, b
    gap = other - mean
    return n + m, mean + gap * (m / (n + m)), moments + more + np.outer(gap, gap) * (n * m / (n + m))


def of_rows(x: np.ndarray) -> tuple:
    mean = x.mean(axis=0)
    gap = x - mean
    return len(x), mean, gap.T @ gap


def co_moments(vectors: DataFrame, column: str) -> DataFrame:
    """``PART`` rows of each task for the vectors of each length in ``column``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        size = 0

        def out() -> pa.RecordBatch:
            rows = [
                (d, part[0], high.tolist(), low.tolist(), most, part[1].tolist(), part[2].ravel().tolist()) for d, (part, high, low, most) in held.items()
            ]
            held.clear()
            kinds = [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64())]
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            names = ["dim", "n", "high", "low", "most", "mean", "moments"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            lists = batch.column(0)
            sizes = lists.value_lengths().to_numpy()
            for d in np.unique(sizes).tolist():
                x = lists.filter(pa.array(sizes == d)).flatten().to_numpy().reshape(-1, d)
                part, most = of_rows(x.astype(np.float64)), float(np.abs(x.astype(np.float64)).max())
                high, low = halves(x)
                if d in held:
                    before, h, w, m = held[d]
                    held[d] = merged(before, part), h + high, w + low, max(m, most)
                else:
                    held[d] = part, high, low, most
                    size += d * d
            if size > HELD_ENTRIES:
                yield out()
                size = 0
        yield out()

    return vectors.select(column).mapInArrow(run, PART)


def together(parts: DataFrame) -> DataFrame:
    """One ``PART`` row of each length; parts are merged in about as many groups as a group has parts."""

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        d = int(rows["dim"].iloc[0])
        total = None
        for n, mean, moments in zip(rows["n"], rows["mean"], rows["moments"], strict=True):
            part = int(n), np.asarray(mean), np.asarray(moments).reshape(d, d)
            total = part if total is None else merged(total, part)
        high, low = (sum(np.asarray(v, dtype=object) for v in rows[c]) for c in ("high", "low"))
        high, low = high + low // (1 << 32), low % (1 << 32)
        return pd.DataFrame(
            {"dim": [d], "n": [total[0]], "high": [high.tolist()], "low": [low.tolist()], "most": [rows["most"].max()], "mean": [total[1]], "moments": [total[2].ravel()]}
        )

    parts = stable(parts, "co_moments")
    groups = max(1, math.isqrt(parts.count()))
    grouped = parts.groupBy("dim", bucket_of(groups, "mean", "n").alias("group"))
    return grouped.applyInPandas(lambda _, rows: merge(rows), PART).groupBy("dim").applyInPandas(merge, PART)


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """G of full column rank with G G' = a, one column for each pivot above rounding."""
    rest, columns = a.astype(np.float64).copy(), []
    least = len(a) * np.finfo(np.float64).eps * rest.diagonal().max(initial=0.0)
    for _ in range(len(a)):
        p = int(rest.diagonal().argmax())
        if not rest[p, p] > least:
            break
        column = rest[:, p] / math.sqrt(rest[p, p])
        columns.append(column)
        rest -= np.outer(column, column)
        rest[p, :] = rest[:, p] = 0.0  # done: nothing of it is left
    return np.stack(columns, axis=1) if columns else np.empty((len(a), 0))


def one_sided_jacobi(g: np.ndarray, sweeps: int = SWEEPS) -> np.ndarray:
    """The columns of ``g`` rotated against each other until all are orthogonal; disjoint pairs turn at once."""
    g = g.copy()
    n = g.shape[1]
    ring = list(range(n + n % 2))
    close = np.finfo(np.float64).eps * max(1.0, math.sqrt(len(g)))
    for _ in range(sweeps if n > 1 else 0):
        turned = False
        for _ in range(len(ring) - 1):
            half = len(ring) // 2
            pairs = [(i, j) for i, j in zip(ring[:half], reversed(ring[half:]), strict=True) if max(i, j) < n]
            i, j = (np.array(x) for x in zip(*pairs, strict=True))
            x, y = g[:, i], g[:, j]
            a, b, c = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            off = np.abs(c) > close * np.sqrt(a * b)
            if off.any():
                turned = True
                i, j, x, y, a, b, c = i[off], j[off], x[:, off], y[:, off], a[off], b[off], c[off]
                z = (b - a) / (2 * c)
                t = np.where(z >= 0, 1.0, -1.0) / (np.abs(z) + np.hypot(1.0, z))
                cos = 1 / np.hypot(1.0, t)
                g[:, i], g[:, j] = cos * (x - t * y), cos * (t * x + y)
            ring = [ring[0], ring[-1], *ring[1:-1]]
        if not turned:
            break
    return g


def eigen(scatter: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues above zero, falling, and their unit vectors as rows."""
    g = one_sided_jacobi(pivoted_cholesky(scatter))
    norms = np.sqrt((g * g).sum(axis=0))
    order = [i for i in np.argsort(-norms, kind="stable")[:count] if norms[i] > 0]
    vectors = (g[:, order] / norms[order]).T
    signs = np.array([1.0 if v[np.abs(v).argmax()] > 0 else -1.0 for v in vectors]).reshape(-1, 1)
    return norms[order] ** 2, vectors * signs


def models(moments: DataFrame, count: int) -> DataFrame:
    """(dim, n, sums, small_sums, mean, small, values, shares, components) of each length; ``small`` where deviations stay in longs."""
    schema = "dim int, n long, sums array<decimal(38,0)>, small_sums array<long>, mean array<double>, small boolean, values array<double>, shares array<double>, components array<array<double>>"

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        from decimal import Decimal

        row = rows.iloc[0]
        d, n = int(row["dim"]), int(row["n"])
        sums = [(int(h) << 32) + int(w) for h, w in zip(row["high"], row["low"], strict=True)]
        cov = np.asarray(row["moments"]).reshape(d, d) / n
        values, vectors = eigen((cov + cov.T) / 2, count)
        reach = n * int(row["most"]) + max(map(abs, sums))
        small = reach * reach * d < 1 << 62
        return pd.DataFrame(
            {
                "dim": [d],
                "n": [n],
                "sums": [[Decimal(s) for s in sums]],
                "small_sums": [sums if small else []],
                "mean": [[s / n for s in sums]],
                "small": [small],
                "values": [values.tolist()],
                "shares": [(values / np.trace(cov)).tolist()],
                "components": [[v.tolist() for v in vectors]],
            }
        )

    return moments.groupBy("dim").applyInPandas(solve, schema)


PROJECTED = """transform(components, (v, k) -> aggregate(zip_with(gaps, v, (g, c) -> g * c), 0D, (t, p) -> t + p) / sqrt(values[k]))"""
# Whole numbers throughout; the second form for vectors so long or many that 64 bits could be too few.
DEVIATION = """CASE WHEN small THEN aggregate(zip_with(x, small_sums, (c, s) -> n * c - s), 0L, (t, g) -> t + g * g)
    ELSE try_cast(aggregate(zip_with(x, sums, (c, s) -> try_subtract(try_multiply(decimal(n), cast(c AS decimal(19, 0))), s)),
        cast(0 AS decimal(38, 0)), (t, g) -> try_add(t, cast(try_multiply(g, g) AS decimal(38, 0)))) AS bigint) END"""


def with_gaps(rows: DataFrame, model: DataFrame) -> DataFrame:
    """The rows (x, ...) with the model of their length and ``gaps``, the vector minus the mean."""
    return rows.withColumn("dim", F.size("x")).join(checked_broadcast(model), "dim").withColumn("gaps", F.expr("zip_with(x, mean, (c, m) -> c - m)"))


def whiten(
    vectors: DataFrame, components: int = COMPONENTS, factor: int = FACTOR, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of every usable row and its first components."""
    small_batches(vectors.sparkSession, 5000)
    usable = vectors.filter(finite(F.col(vector_col)) & (F.size(vector_col) > 0))
    kept = usable.select(F.col(id_col).alias("id"), scaled(F.col(vector_col), factor).alias("x"))
    listed = stable(kept.select("x").distinct(), "fit_list")
    model = stable(models(together(co_moments(listed, "x")), components), "whitening_models")
    scores = with_gaps(listed, model).select("dim", F.expr(PROJECTED).alias("scores"))
    errors = identity_errors(scores, components)
    full = stable(model.join(errors, "dim", "left"), "whitening")
    rows = with_gaps(kept, full).select("id", "n", F.expr(DEVIATION).alias("deviation"), "shares", "identity_error", F.posexplode(F.expr(PROJECTED)).alias("at", "whitened"))
    return rows.select(
        F.col("id").alias(id_col), (F.col("at") + 1).alias("component"), "n", "deviation", "whitened", F.expr("shares[at]").alias("explained"), "identity_error"
    )


def identity_errors(scores: DataFrame, components: int) -> DataFrame:
    """(dim, identity_error): the largest entry of the covariance of ``scores``, centred anew, minus the identity."""
    held = stable(scores, "whitened_list")
    means = held.groupBy("dim").agg(F.array(*[F.avg(F.get("scores", F.lit(i))) for i in range(components)]).alias("mean"))
    gaps = [F.get("scores", F.lit(i)) - F.get("mean", F.lit(i)) for i in range(components)]
    entries = [F.abs(F.avg(gaps[i] * gaps[j]) - float(i == j)) for i in range(components) for j in range(i, components)]
    both = held.join(checked_broadcast(stable(means, "whitened_means")), "dim")
    return both.groupBy("dim").agg(F.array_max(F.array(*entries)).alias("identity_error"))

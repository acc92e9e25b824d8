"""Linear models from distributed sufficient statistics.

Row data stays on the executors: every Arrow batch is reduced to the count, mean and
centred co-moments of its columns, which are merged pairwise with the difference of
the means (raw second moments would lose a small spread on a large level), and only
the p x p solve runs as one small pandas call per group. Passes that need
rows again (leave-one-out errors, fold errors) bring rows and model together
with a salted cogroup, so a large group is spread over many tasks and no model
travels through the driver.
"""

from __future__ import annotations

import hashlib
import math
import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daygrid.config import SearchSettings
from daygrid.session import stable

# The helpers below run inside tasks. Sent by value, they need no copy of this
# package on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

RANK_CUTOFF = 1e-10
ROWS_PER_TASK = 50_000
FLUSH_GROUPS = 256
MERGE_PARTS = 64  # parts of a group that are merged before the last merge

# 30 log-spaced penalties from 1e-2 to 1e4.
ALPHA_GRID = [10 ** (-2 + 6 * i / 29) for i in range(30)]


def _key_fields(df: DataFrame, keys: Sequence[str]) -> list[T.StructField]:
    return [df.schema[k] for k in keys]


class CoMoments:
    """Count, mean and centred co-moments of some columns over some rows."""

    def __init__(self, n: float, mean: np.ndarray, co: np.ndarray):
        self.n, self.mean, self.co = n, mean, co

    @classmethod
    def of(cls, x: np.ndarray) -> CoMoments:
        mean = x.mean(axis=0)
        gap = x - mean
        return cls(float(len(x)), mean, gap.T @ gap)

    @classmethod
    def empty(cls, p: int) -> CoMoments:
        return cls(0.0, np.zeros(p), np.zeros((p, p)))

    def __add__(self, other: CoMoments) -> CoMoments:
        """The moments of both sets of rows together."""
        n = self.n + other.n
        if not self.n or not other.n:
            return self if self.n else other
        gap = other.mean - self.mean
        return CoMoments(n, self.mean + gap * (other.n / n), self.co + other.co + np.outer(gap, gap) * (self.n * other.n / n))


def _together(pdf: pd.DataFrame, p: int) -> CoMoments:
    """All parts of a group, in the order of their tasks, so that a retry gives the same bits."""
    total = CoMoments.empty(p)
    for r in pdf.sort_values("part").itertuples(index=False):
        total = total + CoMoments(r.n, np.asarray(r.mean, dtype=float), np.asarray(r.co, dtype=float).reshape(p, p))
    return total


def co_moments(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """(keys, part, n, mean, co): centred co-moments of ``cols``, at most ``MERGE_PARTS`` rows per group.

    Rows with a null are the caller's concern; a null would surface as NaN.
    """
    keys, cols = list(keys), list(cols)
    p = len(cols)
    vec = T.ArrayType(T.DoubleType())
    schema = T.StructType(
        [*_key_fields(df, keys), T.StructField("part", T.IntegerType()), T.StructField("n", T.DoubleType()), T.StructField("mean", vec), T.StructField("co", vec)]
    )

    def emit(store: dict, part: int) -> pd.DataFrame:
        return pd.DataFrame([[*key, part, m.n, m.mean, m.co.ravel()] for key, m in store.items()], columns=schema.names)

    def reduce_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store: dict = {}
        part = TaskContext.get().partitionId()
        for pdf in batches:
            for key, rows in pdf.groupby(keys, sort=False, dropna=False):
                m = CoMoments.of(rows[cols].to_numpy(float))
                store[key] = store[key] + m if key in store else m
            if len(store) >= FLUSH_GROUPS:
                yield emit(store, part)
                store = {}
        if store:
            yield emit(store, part)

    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return emit({key[:-1]: _together(pdf, p)}, key[-1])

    picked = df.select(*keys, *(F.col(c).cast("double").alias(c) for c in cols))
    partial = picked.mapInPandas(reduce_batches, schema)
    bucket = F.pmod("part", F.lit(MERGE_PARTS)).cast("int").alias("bucket")
    return partial.groupBy(*keys, bucket).applyInPandas(merge, schema)


class _Moments:
    """Standardised second moments read off the co-moments of [x..., y...]."""

    def __init__(self, total: CoMoments, x: Sequence[int], y: Sequence[int]):
        self.n = total.n
        x, y = list(x), list(y)
        var = np.diag(total.co)[x] / self.n
        raw = var + total.mean[x] ** 2
        # A constant leaves only what rounding its mean leaves.
        self.scale = np.where(var > 1e-28 * np.maximum(raw, 1e-300), np.sqrt(np.maximum(var, 0)), 1.0)
        self.x_mean, self.y_mean = total.mean[x], total.mean[y]
        self.zz = total.co[np.ix_(x, x)] / np.outer(self.scale, self.scale)
        self.zy = total.co[np.ix_(x, y)] / self.scale[:, None]
        self.values, self.basis = np.linalg.eigh(self.zz)
        self.values = np.maximum(self.values, 0.0)
        self.proj = self.basis.T @ self.zy

    def least_squares(self) -> np.ndarray:
        keep = self.values > RANK_CUTOFF * max(self.values.max(), 1e-300)
        inv = np.where(keep, 1.0 / np.where(keep, self.values, 1.0), 0.0)
        return self.basis @ (inv[:, None] * self.proj)

    def ridge(self, alpha: float) -> np.ndarray:
        d = self.values + alpha
        return self.basis @ (self.proj / d[:, None])

    def raw(self, beta: np.ndarray) -> np.ndarray:
        """[intercept, coefficients] on the original column scale, one column per target."""
        b = beta / self.scale[:, None]
        return np.vstack([self.y_mean - self.x_mean @ b, b])


def fit_ols(df: DataFrame, keys: Sequence[str], specs: dict[str, Sequence[str]], train: Column) -> DataFrame:
    """Least squares of every target on an intercept and its columns, per group.

    ``specs`` maps target to columns; all fits share one pass over the train rows. Rank-deficient designs get the minimum-norm solution. One row
    per group with an array ``coef_<target>`` of intercept and coefficients.
    """
    keys = list(keys)
    cols = list(dict.fromkeys([*(x for xs in specs.values() for x in xs), *specs]))
    vec = T.ArrayType(T.DoubleType())
    out = T.StructType([*_key_fields(df, keys), *(T.StructField(f"coef_{y}", vec) for y in specs)])

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        total, fitted = _together(pdf, len(cols)), []
        for y, xs in specs.items():
            m = _Moments(total, [cols.index(x) for x in xs], [cols.index(y)])
            fitted.append(m.raw(m.least_squares())[:, 0].tolist())
        return pd.DataFrame([[*key, *fitted]], columns=out.names)

    parts = co_moments(df.filter(train), keys, cols)
    return stable(parts.groupBy(*keys).applyInPandas(solve, out), "ols")


def linear_value(xs: Sequence[str], coef: str) -> Column:
    """Intercept plus dot product with an array column, as one codegen expression."""
    value = F.col(coef)[0]
    for i, x in enumerate(xs):
        value = value + F.col(x) * F.col(coef)[i + 1]
    return value


def residuals(
    df: DataFrame, keys: Sequence[str], specs: dict[str, Sequence[str]], train: Column, names: dict[str, str]
) -> DataFrame:
    """Add y - fitted(y) under ``names[y]`` for every target; fitted on train rows only."""
    models = fit_ols(df, keys, specs, train)
    joined = df.join(models, list(keys))
    return joined.select(
        *df.columns, *((F.col(y) - linear_value(xs, f"coef_{y}")).alias(names[y]) for y, xs in specs.items())
    )


def _apart(df: DataFrame, used: Sequence[str]) -> list[str]:
    """Columns that tell rows apart which agree in all model columns."""
    return [c for c in ("date", "zone") if c in df.columns and c not in used]


def _salted(rows: DataFrame, models: DataFrame, keys: Sequence[str], largest: float) -> tuple:
    """Rows and models grouped by key and salt; the largest group is cut to about ROWS_PER_TASK rows.

    The salt is the hash of all other columns, so rows that agree in some still spread.
    """
    salts = max(1, math.ceil(largest / ROWS_PER_TASK))
    salt = F.pmod(F.xxhash64(*[c for c in rows.columns if c not in keys]), F.lit(salts)).cast("int")
    left = rows.withColumn("_salt", salt).groupBy(*keys, "_salt")
    right = models.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).groupBy(*keys, "_salt")
    return left, right


def ridge_systems(
    df: DataFrame, keys: Sequence[str], conditions: dict[str, Sequence[str]], y: str, train: Column
) -> DataFrame:
    """Eigen-decomposed normal equations per (group, condition), all from one pass over the train rows."""
    keys = list(keys)
    union = list(dict.fromkeys(c for cols in conditions.values() for c in cols))
    vec = T.ArrayType(T.DoubleType())
    out = T.StructType(
        [
            *_key_fields(df, keys),
            T.StructField("condition", T.StringType()),
            T.StructField("n", T.DoubleType()),
            T.StructField("y_mean", T.DoubleType()),
            *(T.StructField(c, vec) for c in ("x_mean", "scale", "values", "basis", "proj")),
        ]
    )

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        total, rows = _together(pdf, len(union) + 1), []
        for name, cols in conditions.items():
            m = _Moments(total, [union.index(c) for c in cols], [len(union)])
            arrays = (m.x_mean, m.scale, m.values, m.basis.ravel(), m.proj[:, 0])
            rows.append([*key, name, m.n, m.y_mean[0], *(a.tolist() for a in arrays)])
        return pd.DataFrame(rows, columns=out.names)

    parts = co_moments(df.filter(train), keys, [*union, y])
    return stable(parts.groupBy(*keys).applyInPandas(solve, out), "ridge")


def loo_errors(
    df: DataFrame, systems: DataFrame, keys: Sequence[str], conditions: dict[str, Sequence[str]], y: str, train: Column, alphas: Sequence[float] = ALPHA_GRID
) -> DataFrame:
    """Mean squared leave-one-out error of every alpha, in one pass over train rows.

    The error of row i without refitting is e_i / (1 - h_i), with the hat value
    h_i = 1/n + z_i' (Z'Z + alpha I)^-1 z_i. Returns (keys, condition, a, alpha, loo_mse).
    """
    keys, alphas = list(keys), list(alphas)
    union = list(dict.fromkeys(c for cols in conditions.values() for c in cols))
    grid = np.asarray(alphas)
    out = T.StructType(
        [
            *_key_fields(df, keys),
            T.StructField("condition", T.StringType()),
            T.StructField("a", T.IntegerType()),
            T.StructField("sse", T.DoubleType()),
            T.StructField("rows", T.DoubleType()),
        ]
    )

    def score(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        parts = []
        if len(left) and len(right):
            truth = left[y].to_numpy(float)
            for model in right.itertuples(index=False):
                cols = list(conditions[model.condition])
                z = (left[cols].to_numpy(float) - np.asarray(model.x_mean)) / np.asarray(model.scale)
                u = z @ np.asarray(model.basis).reshape(len(cols), len(cols))
                inv = 1.0 / (np.asarray(model.values)[:, None] + grid)
                fitted = model.y_mean + u @ (np.asarray(model.proj)[:, None] * inv)
                hat = 1.0 / model.n + (u * u) @ inv
                err = (truth[:, None] - fitted) / (1.0 - hat)
                cell = pd.DataFrame({"a": np.arange(len(grid), dtype="int32"), "sse": (err * err).sum(0)})
                cell["rows"] = float(len(truth))
                cell["condition"] = model.condition
                for name, value in zip(keys, key):
                    cell[name] = value
                parts.append(cell[out.names])
        return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=out.names)

    rows = df.filter(train).select(*keys, y, *union, *_apart(df, [*keys, y, *union]))
    largest = systems.agg(F.max("n").alias("n")).first().n or 0
    left, right = _salted(rows, systems, keys, largest)
    partial = left.cogroup(right).applyInPandas(score, out)
    alpha = F.array(*(F.lit(a) for a in alphas))[F.col("a")]
    return partial.groupBy(*keys, "condition", "a").agg(
        alpha.alias("alpha"), (F.sum("sse") / F.sum("rows")).alias("loo_mse")
    )


def best_by(df: DataFrame, keys: Sequence[str], score: str, order: str) -> DataFrame:
    """The row with the lowest score per key, first in ``order`` on ties (grouped, no sort)."""
    cols = [c for c in df.columns if c not in keys]
    best = F.min(F.struct(F.col(score), F.col(order), *(c for c in cols if c not in (score, order)))).alias("_b")
    return df.groupBy(*keys).agg(best).select(*keys, "_b.*")


def ridge_coefficients(
    systems: DataFrame, chosen: DataFrame, keys: Sequence[str], conditions: dict[str, Sequence[str]]
) -> DataFrame:
    """Models at the chosen alpha: raw and standardised coefficients over the union columns."""
    keys = list(keys)
    union = list(dict.fromkeys(c for cols in conditions.values() for c in cols))
    vec = T.ArrayType(T.DoubleType())
    fields = [*_key_fields(systems, keys), *(T.StructField(c, t) for c, t in (("condition", T.StringType()), ("alpha", T.DoubleType()), ("coef", vec), ("std_coef", vec)))]
    out = T.StructType(fields)

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for m in pdf.itertuples(index=False):
                cols = list(conditions[m.condition])
                basis = np.asarray(m.basis).reshape(len(cols), len(cols))
                beta = basis @ (np.asarray(m.proj) / (np.asarray(m.values) + m.alpha))
                raw = beta / np.asarray(m.scale)
                wide, std = np.zeros(len(union) + 1), np.zeros(len(union))
                at = [union.index(c) for c in cols]
                std[at] = beta
                wide[0] = m.y_mean - np.asarray(m.x_mean) @ raw
                wide[[a + 1 for a in at]] = raw
                rows.append([*(getattr(m, k) for k in keys), m.condition, m.alpha, wide.tolist(), std.tolist()])
            yield pd.DataFrame(rows, columns=out.names)

    joined = systems.join(chosen.select(*keys, "condition", "alpha"), [*keys, "condition"])
    return stable(joined.mapInPandas(finish, out), "coef")


def fit_ridge_loo(
    df: DataFrame, keys: Sequence[str], conditions: dict[str, Sequence[str]], y: str, train: Column
) -> DataFrame:
    """Ridge on standardised columns with alpha chosen by leave-one-out error, per (group, condition)."""
    systems = ridge_systems(df, keys, conditions, y, train)
    errors = loo_errors(df, systems, keys, conditions, y, train)
    chosen = best_by(errors, [*keys, "condition"], "loo_mse", "a")
    return ridge_coefficients(systems, chosen, keys, conditions)


def fit_ridge(
    df: DataFrame, keys: Sequence[str], conditions: dict[str, Sequence[str]], y: str, train: Column, alpha: float
) -> DataFrame:
    """Ridge on standardised columns at a fixed alpha; the intercept is not penalised."""
    systems = ridge_systems(df, keys, conditions, y, train)
    chosen = systems.select(*keys, "condition", F.lit(float(alpha)).alias("alpha"))
    return ridge_coefficients(systems, chosen, keys, conditions)


def predict(df: DataFrame, models: DataFrame, keys: Sequence[str], conditions: dict[str, Sequence[str]], out: str = "pred") -> DataFrame:
    """One row per (row, condition) with the prediction of that condition's model."""
    union = list(dict.fromkeys(c for cols in conditions.values() for c in cols))
    joined = df.join(models.select(*keys, "condition", "coef"), list(keys))
    return joined.select(*df.columns, "condition", linear_value(union, "coef").alias(out))


def standardized_coefficients(models: DataFrame, keys: Sequence[str], conditions: dict[str, Sequence[str]]) -> DataFrame:
    """(keys, condition, alpha, feature, std_coef, abs) for the columns of each condition."""
    union = list(dict.fromkeys(c for cols in conditions.values() for c in cols))
    used = F.create_map(*(x for n, cols in conditions.items() for x in (F.lit(n), F.array(*(F.lit(c) for c in cols)))))
    names = F.array(*(F.lit(c) for c in union))
    pairs = F.explode(F.arrays_zip(names.alias("feature"), F.col("std_coef").alias("std_coef")))
    rows = models.select(*keys, "condition", "alpha", pairs.alias("_p"))
    rows = rows.select(*keys, "condition", "alpha", F.col("_p.feature").alias("feature"), F.col("_p.std_coef").alias("std_coef"))
    return rows.filter(F.array_contains(used[F.col("condition")], F.col("feature"))).withColumn("abs", F.abs("std_coef"))


def hashed_uniform(seed: int, *parts: int | str) -> float:
    """Uniform number in [0, 1) from a text hash: the same on every engine and run."""
    text = ":".join(str(p) for p in (seed, *parts))
    return int(hashlib.md5(text.encode()).hexdigest()[:12], 16) / 16**12


def log_uniform(u: float, low: float, high: float) -> float:
    return math.exp(math.log(low) + u * (math.log(high) - math.log(low)))


def drawn_alphas(draws: int, seed: int, alpha_range: tuple[float, float]) -> list[float]:
    return [log_uniform(hashed_uniform(seed, d), *alpha_range) for d in range(draws)]


def search_errors(
    df: DataFrame,
    keys: Sequence[str],
    conditions: dict[str, Sequence[str]],
    y: str,
    train: Column,
    alphas: Sequence[float],
    folds: int,
) -> DataFrame:
    """Mean absolute error of every (condition, draw, fold) ridge.

    One pass for the moments and one row pass serve all of them. Train rows carry the
    index of the date block they fall in; the moments merged over the blocks before a
    fold are that fold's train moments, scaler included.
    Returns (keys, condition, draw, alpha, fold, mae).
    """
    keys, alphas = list(keys), list(alphas)
    union = list(dict.fromkeys(c for cols in conditions.values() for c in cols))
    p = len(union)
    by = [*keys, "block"]
    blocked = stable(with_fold_block(df.filter(train), keys, folds).select(*by, y, *union, *_apart(df, [*by, y, *union])), "blocks")
    parts = co_moments(blocked, by, [*union, y])
    vec = T.ArrayType(T.DoubleType())
    head = [*_key_fields(df, keys), T.StructField("block", T.IntegerType()), T.StructField("condition", T.StringType()), T.StructField("draw", T.IntegerType())]
    model_schema = T.StructType([*head, T.StructField("coef", vec)])
    score_schema = T.StructType([*head, T.StructField("sae", T.DoubleType()), T.StructField("rows", T.DoubleType())])

    def fold_models(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        total, rows = CoMoments.empty(p + 1), []
        for block in range(folds + 1):
            if total.n > 1:
                for name, cols in conditions.items():
                    at = [union.index(c) for c in cols]
                    m = _Moments(total, at, [p])
                    for d, a in enumerate(alphas):
                        wide = np.zeros(p + 1)
                        wide[[0, *(i + 1 for i in at)]] = m.raw(m.ridge(a))[:, 0]
                        rows.append([*key, block, name, d, wide.tolist()])
            total = total + _together(pdf[pdf["block"] == block], p + 1)
        return pd.DataFrame(rows, columns=model_schema.names)

    def score(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame(columns=score_schema.names)
        coef = np.vstack(right["coef"].to_numpy())
        fitted = coef[:, 0] + left[union].to_numpy(float) @ coef[:, 1:].T
        cell = right[[*by, "condition", "draw"]].copy()
        cell["sae"] = np.abs(left[y].to_numpy(float)[:, None] - fitted).sum(0)
        cell["rows"] = float(len(left))
        return cell[score_schema.names]

    models = parts.groupBy(*keys).applyInPandas(fold_models, model_schema)
    largest = blocked.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    left, right = _salted(blocked, models, by, largest)
    partial = left.cogroup(right).applyInPandas(score, score_schema)
    fold = (F.col("block") - 1).alias("fold")
    return partial.groupBy(*keys, "condition", "draw", fold).agg((F.sum("sae") / F.sum("rows")).alias("mae")).withColumn(
        "alpha", F.array(*(F.lit(a) for a in alphas))[F.col("draw")]
    )


def with_fold_block(df: DataFrame, keys: Sequence[str], folds: int) -> DataFrame:
    """Add ``block``: 0 before the first test fold, i + 1 inside the test days of fold i.

    Blocks are cut on the unique days of each group, so no day is split.
    """
    days = df.select(*keys, "date").distinct()
    w = Window.partitionBy(*keys)
    size = F.expr(f"_n div {folds + 1}")
    ranked = days.withColumn("_pos", F.row_number().over(w.orderBy("date")) - 1).withColumn(
        "_n", F.count(F.lit(1)).over(w).cast("int")
    )
    from_first = F.col("_pos") - (F.col("_n") - size * folds)
    block = F.when(from_first < 0, F.lit(0)).otherwise(F.floor(F.try_divide(from_first, size)) + 1).cast("int")
    return df.join(ranked.select(*keys, "date", block.alias("block")), [*keys, "date"])


def search_ridge(
    df: DataFrame,
    keys: Sequence[str],
    conditions: dict[str, Sequence[str]],
    y: str,
    train: Column,
    search: SearchSettings,
    alpha_range: tuple[float, float],
) -> DataFrame:
    """Random alpha search by mean fold error, then a refit on all train rows, per condition."""
    alphas = drawn_alphas(search.draws, search.seed, alpha_range)
    errors = search_errors(df, keys, conditions, y, train, alphas, search.folds)
    mean = errors.groupBy(*keys, "condition", "draw", "alpha").agg(F.avg("mae").alias("cv_mae"))
    chosen = best_by(mean, [*keys, "condition"], "cv_mae", "draw")
    return ridge_coefficients(ridge_systems(df, keys, conditions, y, train), chosen, keys, conditions)


def distorted(df: DataFrame, keys: Sequence[str], cols: Sequence[str], y: str, folds: int) -> DataFrame:
    """Each row as it is and distorted in ``cols`` and ``y`` (column ``bent``), with its fold ``block``."""
    blocked = with_fold_block(df, keys, folds)
    both = blocked.withColumn("bent", F.explode(F.array(F.lit(False), F.lit(True))))
    return both.withColumns({c: F.when(F.col("bent"), F.col(c) * 10 + F.col("block") * 7 + 500).otherwise(F.col(c)) for c in (*cols, y)})


def moved_fold_models(
    df: DataFrame, keys: Sequence[str], cols: Sequence[str], y: str, alpha: float, folds: int, tol: float = 1e-9
) -> DataFrame:
    """(keys, distorted, fold, scaler): fold models that move when the test days of one fold are distorted.

    ``df`` comes from ``distorted``. One pass keyed by block gives the moments of each
    block, true and distorted; any mixture of blocks is merged from them, so no fit
    reads rows again. ``scaler`` is ``fold`` for models that see their fold's train days only and
    ``all_days`` for the control, whose scale comes from all blocks.
    """
    keys, cols = list(keys), list(cols)
    p = len(cols)
    fields = [("distorted", T.IntegerType()), ("fold", T.IntegerType()), ("scaler", T.StringType())]
    out = T.StructType([*_key_fields(df, keys), *(T.StructField(n, k) for n, k in fields)])

    def models(blocks: list[CoMoments]) -> dict[tuple[int, str], np.ndarray]:
        found, whole = {}, sum(blocks, CoMoments.empty(p + 1))
        wide = _Moments(whole, range(p), [p])
        for fold in range(folds):
            m = _Moments(sum(blocks[: fold + 1], CoMoments.empty(p + 1)), range(p), [p])
            found[fold, "fold"] = m.raw(m.ridge(alpha))[:, 0]
            # The same ridge on columns that are scaled by what all days say.
            ratio = m.scale / wide.scale
            beta = np.linalg.solve(m.zz * np.outer(ratio, ratio) + alpha * np.eye(p), m.zy[:, 0] * ratio)
            found[fold, "all_days"] = np.concatenate(([m.y_mean[0] - m.x_mean @ (beta / wide.scale)], beta / wide.scale))
        return found

    def compare(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        parts = {bent: [_together(pdf[(pdf["block"] == b) & (pdf["bent"] == bent)], p + 1) for b in range(folds + 1)] for bent in (False, True)}
        true, rows = models(parts[False]), []
        for f in range(folds):
            mixed = [parts[b == f + 1][b] for b in range(folds + 1)]
            for (fold, scaler), coef in models(mixed).items():
                if (np.abs(coef - true[fold, scaler]) > tol * np.maximum(1.0, np.abs(true[fold, scaler]))).any():
                    rows.append([*key, f, fold, scaler])
        return pd.DataFrame(rows, columns=out.names)

    moments = co_moments(df, [*keys, "block", "bent"], [*cols, y])
    return moments.groupBy(*keys).applyInPandas(compare, out)

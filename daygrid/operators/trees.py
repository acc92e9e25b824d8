"""Tree regressions with forward-fold search, on Spark ML."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.ml.feature import VectorAssembler, VectorSlicer
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daygrid.config import SearchSettings
from daygrid.operators.linear import hashed_uniform, log_uniform, with_fold_block
from daygrid.session import scratch, stable
from daygrid.sources.readers import union_all

Space = dict[str, tuple[float, float]]


def _whole(u: float, low: float, high: float) -> int:
    return int(low + math.floor(u * (high - low + 1)))


def boosted_draw(space: Space, seed: int, draw: int) -> dict:
    """Parameters of one boosted-tree draw. Spark's trees have no L1 / L2 leaf penalty."""
    return {
        "maxIter": _whole(hashed_uniform(seed, draw, "trees"), *space["trees"]),
        "maxDepth": _whole(hashed_uniform(seed, draw, "depth"), *space["depth"]),
        "stepSize": log_uniform(hashed_uniform(seed, draw, "rate"), *space["rate"]),
        "subsamplingRate": _between(hashed_uniform(seed, draw, "rows"), *space["share"]),
        "featureSubsetStrategy": f"{_between(hashed_uniform(seed, draw, 'cols'), *space['share']):.4f}",
    }


def forest_draw(space: Space, seed: int, draw: int) -> dict:
    return {
        "numTrees": _whole(hashed_uniform(seed, draw, "trees"), *space["trees"]),
        "maxDepth": _whole(hashed_uniform(seed, draw, "depth"), *space["depth"]),
        "minInstancesPerNode": _whole(hashed_uniform(seed, draw, "leaf"), *space["leaf"]),
        "featureSubsetStrategy": "all",
    }


def _between(u: float, low: float, high: float) -> float:
    return low + u * (high - low)


def boosted(params: dict, y: str, seed: int) -> GBTRegressor:
    return GBTRegressor(featuresCol="_features", labelCol=y, predictionCol="pred", seed=seed, **params)


def forest(params: dict, y: str, seed: int) -> RandomForestRegressor:
    return RandomForestRegressor(featuresCol="_features", labelCol=y, predictionCol="pred", seed=seed, **params)


@dataclass(frozen=True)
class Search:
    """One search: a name that is its own in the ledger, the columns, and the rows as a SQL condition."""

    name: str
    cols: tuple[str, ...]
    where: str = "true"


LEDGER = "search string, draw int, mae double, rows long, fit string, fold int"  # fit and fold are folders


def vector_table(df: DataFrame, cols: Sequence[str], keys: Sequence[str], train: Column, folds: int) -> DataFrame:
    """The rows with one vector of all ``cols`` and the fold block of train rows, written once for all fits."""
    inside = with_fold_block(df.filter(train).withColumn("_whole", F.lit(1)), ["_whole", *keys], folds).drop("_whole")
    outside = df.filter(~F.coalesce(train, F.lit(False))).withColumn("block", F.lit(None).cast("int"))
    both = inside.unionByName(outside.select(*inside.columns))
    return stable(VectorAssembler(inputCols=list(cols), outputCol="_all").transform(both), "vectors")


def sliced(vectors: DataFrame, every: Sequence[str], cols: Sequence[str]) -> DataFrame:
    at = [list(every).index(c) for c in cols]
    return VectorSlicer(inputCol="_all", outputCol="_features", indices=at).transform(vectors)


def _fit_id(search: Search, params: dict, y: str, settings: SearchSettings, family: str) -> str:
    """What a fold error depends on, but for the data: an error in the ledger is used again only for the same."""
    text = json.dumps([family, search.name, search.cols, search.where, params, y, settings.folds, settings.seed])
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def _finished(df: DataFrame, ledger: str) -> DataFrame:
    spark = df.sparkSession
    try:
        return spark.read.schema(LEDGER).parquet(ledger)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def search_trees(
    df: DataFrame,
    searches: Sequence[Search],
    keys: Sequence[str],
    y: str,
    train: Column,
    build: Callable[[dict, str, int], object],
    draw: Callable[[Space, int, int], dict],
    space: Space,
    settings: SearchSettings,
    ledger: str | None = None,
    parallelism: int = 4,
) -> DataFrame:
    """Rows of every search with the prediction ``pred`` of its best draw, in column ``search``.

    A draw is judged by its mean error over forward folds of train days, then refitted on
    all train rows. All fits read one written table: the vector of all columns and the
    fold block of each row; a search slices its columns from it. Spark ML trains each
    tree level over all partitions, so a fit scales with the data; the fits are independent
    jobs, ``parallelism`` at a time, each search in a scheduler pool of its own.

    Every fold error is written to the ``ledger`` folder when its fit ends. After a lost
    driver the same call with the same folder goes on with the fits that are missing;
    what the ledger holds for other parameters, columns or rows is left alone. The
    folder belongs to one state of the data. A single draw needs no folds.
    """
    every = list(dict.fromkeys(c for s in searches for c in s.cols))
    vectors = vector_table(df, every, keys, train, settings.folds)
    ledger = ledger or scratch(df.sparkSession, "ledger")
    params = [draw(space, settings.seed, d) for d in range(settings.draws)]
    family = build.__name__
    ids = {(s.name, d): _fit_id(s, p, y, settings, family) for s in searches for d, p in enumerate(params)}
    sc = df.sparkSession.sparkContext

    if len(params) > 1:
        known = {(r["fit"], r["fold"]) for r in _finished(df, ledger).select("fit", "fold").distinct().collect()}
        tasks = [(s, d, f) for s in searches for d in range(len(params)) for f in range(1, settings.folds + 1) if (ids[s.name, d], f) not in known]

        def fold_error(task: tuple[Search, int, int]) -> None:
            search, d, fold = task
            sc.setLocalProperty("spark.scheduler.pool", search.name)
            mine = sliced(vectors.filter(search.where), every, search.cols)
            model = build(params[d], y, settings.seed).fit(mine.filter(F.col("block") < fold))
            held = model.transform(mine.filter(F.col("block") == fold))
            error = held.agg(F.avg(F.abs(F.col(y) - F.col("pred"))).alias("mae"), F.count(F.lit(1)).alias("rows"))
            row = error.select(F.lit(search.name).alias("search"), F.lit(d).alias("draw"), "mae", "rows")
            # A folder of its own, as writes to one folder at the same time undo each other.
            row.coalesce(1).write.mode("overwrite").parquet(f"{ledger}/fit={ids[search.name, d]}/fold={fold}")

        if tasks:
            in_parallel(fold_error, tasks, parallelism)
    best = {s.name: 0 for s in searches}
    if len(params) > 1:
        mine = _finished(df, ledger).filter(F.col("fit").isin(list(ids.values())))
        means = mine.groupBy("search", "draw").agg(F.avg("mae").alias("mae"))
        chosen = means.groupBy("search").agg(F.min(F.struct("mae", "draw")).alias("best"))
        best = {r["search"]: r["best"]["draw"] for r in chosen.collect()}  # one row per search

    def refit(search: Search) -> DataFrame:
        sc.setLocalProperty("spark.scheduler.pool", search.name)
        mine = sliced(vectors.filter(search.where), every, search.cols)
        model = build(params[best[search.name]], y, settings.seed).fit(mine.filter("block IS NOT NULL"))
        return model.transform(mine).withColumn("search", F.lit(search.name)).drop("_all", "_features", "block")

    return union_all(in_parallel(refit, list(searches), parallelism))


def fit_tree(df: DataFrame, cols: Sequence[str], y: str, train: Column, model: GBTRegressor | RandomForestRegressor) -> DataFrame:
    """Fit ``model`` on the train rows and predict every row."""
    assembled = VectorAssembler(inputCols=list(cols), outputCol="_features").transform(df)
    return model.fit(assembled.filter(train)).transform(assembled).drop("_features")


def fitted(train: DataFrame, cols: Sequence[str], model: GBTRegressor | RandomForestRegressor):
    """``model`` fitted on all rows of ``train``."""
    return model.fit(VectorAssembler(inputCols=list(cols), outputCol="_features").transform(train))


def in_parallel(fn: Callable, tasks: Sequence, parallelism: int) -> list:
    """Submit independent Spark jobs from a few threads, as Spark ML's own tuning does."""
    with ThreadPool(min(parallelism, len(tasks))) as pool:
        return pool.map(inheritable_thread_target(fn), tasks)


def permutation_importance(
    df: DataFrame, model, keys: Sequence[str], row_key: Sequence[str], cols: Sequence[str], y: str, repeats: int, seed: int
) -> DataFrame:
    """(keys, column, importance, spread): how much the squared error grows when one column is permuted.

    ``df`` holds the rows of one split, ``row_key`` tells them apart within a group of
    ``keys``, and ``model`` is a fitted Spark ML model on ``cols``. In repeat r a row at
    place i takes the column's value of the row whose hash of (seed, r, row key) has rank i, a
    permutation that is the same on every run and cluster. All (column, repeat) pairs
    are scored in one pass over the unfolded rows.
    """
    keys, cols = list(keys), list(cols)
    base = df.select(*keys, *row_key, F.col(y).cast("double").alias("_y"), F.struct(*(F.col(c).cast("double").alias(c) for c in cols)).alias("_own"))
    w = Window.partitionBy(*keys)
    text = F.concat_ws(":", F.lit(seed), "_rep", *(F.col(c).cast("string") for c in row_key))
    placed = base.withColumn("_at", F.row_number().over(w.orderBy(*row_key)))
    each = placed.withColumn("_rep", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    hashed = each.withColumn("_hash", F.md5(text.cast("binary")))
    ranked = hashed.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys, "_rep").orderBy("_hash", *row_key)))
    donors = ranked.select(*keys, "_rep", F.col("_rank").alias("_at"), F.col("_own").alias("_other"))
    pairs = each.join(donors, [*keys, "_rep", "_at"])
    which = F.explode(F.array(*(F.lit(c) for c in ("", *cols)))).alias("column")  # "" is the row as it is
    unfolded = pairs.select(*keys, "_rep", "_y", "_own", "_other", which)
    values = [F.when(F.col("column") == c, F.col("_other").getField(c)).otherwise(F.col("_own").getField(c)).alias(c) for c in cols]
    rows = VectorAssembler(inputCols=cols, outputCol="_features").transform(unfolded.select(*keys, "_rep", "column", "_y", *values))
    error = F.col("_y") - F.col(model.getPredictionCol())
    scored = model.transform(rows).groupBy(*keys, "_rep", "column").agg(F.avg(error * error).alias("_mse"))
    alone = F.max(F.when(F.col("column") == "", F.col("_mse"))).over(Window.partitionBy(*keys, "_rep"))
    grown = scored.withColumn("_grown", F.col("_mse") - alone).filter("column <> ''")
    return grown.groupBy(*keys, "column").agg(F.avg("_grown").alias("importance"), F.stddev_pop("_grown").alias("spread"))

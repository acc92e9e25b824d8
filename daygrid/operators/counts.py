"""Counting and roll-up operators."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count_rows(df: DataFrame, keys: Sequence[str | Column], out: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(out))


def resum(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Merge partial results; rows of one key may come from several inputs."""
    return df.groupBy(*keys).agg(F.sum(value).alias(value))


def distinct_per(df: DataFrame, key: str, ident: str, out: str = "event_count") -> DataFrame:
    """Distinct ids per key. Duplicates fall on the (key, id) pair before any
    per-key shuffle, so one heavy key does not meet one task."""
    return df.groupBy(key, ident).agg(F.lit(1).alias("_one")).groupBy(key).agg(F.count("_one").alias(out))


def pivot_types(df: DataFrame, types: Sequence[str], value: str = "n") -> DataFrame:
    """One column per type, missing ones filled with 0, and the row total."""
    wide = df.groupBy("date").pivot("member_casual", list(types)).agg(F.sum(value))
    wide = wide.fillna(0, subset=list(types))
    return wide.withColumn("total", reduce(lambda a, b: a + b, (F.col(t) for t in types)))


def panel_to_total(df: DataFrame, value: str, carried: Sequence[str]) -> DataFrame:
    """Sum a panel to one system total per day; per-day variables are constant
    inside a day, so ``max`` returns them without depending on row order."""
    return df.groupBy("date").agg(F.sum(value).alias("y"), *(F.max(c).alias(c) for c in carried))


def type_share(df: DataFrame, part: str, whole: str) -> DataFrame:
    return df.agg((F.sum(part) / F.sum(whole)).alias("share"))


def summarize(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(value).alias("days"), F.avg(value).alias("mean_per_day"))


def within_day_variance(df: DataFrame, value: str) -> DataFrame:
    """Sample variance across zones inside each day (0 for a single zone)."""
    return df.groupBy("date").agg(F.coalesce(F.var_samp(value), F.lit(0.0)).alias("variance"))


def top_keys(df: DataFrame, key: str, value: str, last_train_day, n: int, exclude: Sequence[int] = ()) -> DataFrame:
    """The ``n`` keys with the largest train-period total, ties to the lower key.

    The ranking runs over one row per key.
    """
    kept = df.filter(F.col("date") <= F.lit(last_train_day))
    if exclude:
        kept = kept.filter(~F.col(key).isin(list(exclude)))
    totals = kept.groupBy(key).agg(F.sum(value).alias("total"))
    return totals.orderBy(F.desc("total"), key).limit(n)

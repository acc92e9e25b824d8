"""Data-quality and leakage checks. Each returns one row per violation or finding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")


def null_report(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column_name, nulls, rows): all columns in one aggregation."""
    counted = df.agg(
        F.count(F.lit(1)).alias("rows"), *(F.count_if(F.col(c).isNull()).alias(c) for c in cols)
    )
    return counted.unpivot("rows", list(cols), "column_name", "nulls").select("column_name", "nulls", "rows")


def require_no_nulls(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    bad = null_report(df, cols).filter("nulls > 0").collect()
    if bad:
        raise ValueError(f"null values: { {r.column_name: r.nulls for r in bad} }")
    return df


def row_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """Row counts around a join and whether it kept them."""
    b = before.agg(F.count(F.lit(1)).alias("rows")).withColumn("side", F.lit("before"))
    a = after.agg(F.count(F.lit(1)).alias("rows")).withColumn("side", F.lit("after"))
    pair = b.unionByName(a).agg(
        F.max(F.when(F.col("side") == "before", F.col("rows"))).alias("rows_before"),
        F.max(F.when(F.col("side") == "after", F.col("rows"))).alias("rows_after"),
    )
    return pair.withColumn("kept", F.col("rows_before") == F.col("rows_after"))


def require_one_to_one(df: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    if duplicate_keys(df, keys).limit(1).collect():
        raise ValueError(f"{label}: key {list(keys)} is not unique")
    return df


def require_rows(df: DataFrame, label: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"{label} is empty")
    return df


def grid_report(df: DataFrame, days: int, zone: str = "zone", value: str = "demand") -> DataFrame:
    """Row count against days x zones, and the number of negative cells."""
    seen = df.groupBy(zone).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(value) < 0).alias("neg"))
    return seen.agg(
        F.sum("n").alias("rows"), (F.count(F.lit(1)) * days).alias("expected"), F.sum("neg").alias("negative")
    ).withColumn("complete", F.col("rows") == F.col("expected"))


def split_ranges(df: DataFrame, split: Column) -> DataFrame:
    return df.groupBy(split.alias("split")).agg(
        F.min("date").alias("first_day"), F.max("date").alias("last_day"), F.count(F.lit(1)).alias("rows")
    )


def require_split_order(df: DataFrame, split: Column) -> DataFrame:
    found = {r.split: r for r in split_ranges(df, split).collect()}
    empty = [s for s in ("train", "val", "test") if s not in found]
    if empty:
        raise ValueError(f"empty split: {empty}")
    if not found["train"].last_day < found["val"].first_day <= found["val"].last_day < found["test"].first_day:
        raise ValueError("splits overlap in time")
    return df


def wrong_lags(df: DataFrame, key: str, value: str, lag_col: str, k: int) -> DataFrame:
    """Rows whose lag differs from the value k days earlier, proved by a self join on the date."""
    past = df.select(key, F.date_add("date", k).alias("date"), F.col(value).alias("_past"))
    return (
        df.select(key, "date", lag_col)
        .join(past, [key, "date"], "left")
        .filter(~F.col(lag_col).eqNullSafe(F.col("_past")))
    )


def wrong_rolling(df: DataFrame, key: str, value: str, roll_col: str, size: int) -> DataFrame:
    """Rows whose rolling mean differs from the mean of the ``size`` days before, today excluded.

    Each value is sent to the days it may influence, an equi-join by (key, date).
    """
    offset = F.explode(F.sequence(F.lit(1), F.lit(size)))
    sent = df.select(key, "date", F.col(value).alias("_v"), offset.alias("_k"))
    sent = sent.groupBy(key, F.date_add(F.col("date"), F.col("_k")).alias("date")).agg(
        F.avg("_v").alias("_mean"), F.count("_v").alias("_n")
    )
    expected = F.when(F.col("_n") == size, F.col("_mean"))
    off = F.abs(F.col(roll_col) - expected) > 1e-9 * F.greatest(F.lit(1.0), F.abs(expected))
    return (
        df.select(key, "date", roll_col)
        .join(sent, [key, "date"], "left")
        .filter((F.col(roll_col).isNull() != expected.isNull()) | F.coalesce(off, F.lit(False)))
    )


def differing(a: DataFrame, b: DataFrame, keys: Sequence[str], cols: Sequence[str], tol: float = 1e-9) -> DataFrame:
    """Keys whose values differ between two runs by more than the relative tolerance, or that one run lacks."""
    left = a.select(*keys, *cols, F.lit(True).alias("_in_a"))
    right = b.select(*keys, *(F.col(c).alias(f"_{c}") for c in cols), F.lit(True).alias("_in_b"))
    bad = F.col("_in_a").isNull() | F.col("_in_b").isNull()
    for c in cols:
        gap = F.abs(F.col(c) - F.col(f"_{c}")) > tol * F.greatest(F.lit(1.0), F.abs(c))
        bad = bad | F.coalesce(gap, ~F.col(c).eqNullSafe(F.col(f"_{c}")))
    return left.join(right, list(keys), "full").filter(bad).select(*keys)


def weight_sums(df: DataFrame, tol: float = 1e-9) -> DataFrame:
    total = df.groupBy("precinct").agg(F.sum("weight").alias("total"))
    return total.withColumn("ok", F.abs(F.col("total") - 1.0) < tol)

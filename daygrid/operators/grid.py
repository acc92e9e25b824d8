"""Complete grids and joins to daily dimensions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daygrid.config import Period
from daygrid.functions.calendar import day_range
from daygrid.session import bounded


def complete_grid(zones: DataFrame, period: Period, zone: str = "zone") -> DataFrame:
    """Every day of the period for every zone: each zone row unfolds its own days."""
    days = F.sequence(F.lit(period.start), F.lit(period.end), F.expr("interval 1 day"))
    return zones.select(zone).distinct().select(F.explode(days).alias("date"), zone)


def fill_grid(grid: DataFrame, facts: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Left join facts onto the grid; a missing cell is a true zero."""
    return grid.join(facts.select(*keys, value), list(keys), "left").fillna(0, subset=[value])


def join_daily(df: DataFrame, daily: DataFrame, period: Period) -> DataFrame:
    """Many-to-one left join to a per-date table with one row per day; a second row for a day is an error.

    Cut to the period and grouped by day, the table has at most ``period.days``
    rows, which is the bound its broadcast rests on.
    """
    rest = [c for c in daily.columns if c != "date"]
    once = daily.filter(day_range(F.col("date"), period)).groupBy("date").agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*rest)).alias("_row"))
    one = F.expr("IF(_n > 1, CAST(raise_error('a day has several rows') AS DATE), date)")
    inside = once.select(one.alias("date"), *(F.col("_row").getField(c).alias(c) for c in rest))
    return df.join(bounded(inside, period.days), "date", "left")


def join_zone_events(df: DataFrame, events: DataFrame, value: str = "event_count_zone") -> DataFrame:
    """Left join on (date, zone) with both zone keys brought to one type; no row means 0."""
    left = df.withColumn("zone", F.col("zone").cast("int"))
    right = events.select("date", F.col("zone").cast("int").alias("zone"), value)
    return left.join(right, ["date", "zone"], "left").fillna(0.0, subset=[value])


def missing_days(spine: DataFrame, df: DataFrame) -> DataFrame:
    return spine.join(df.select("date").distinct(), "date", "left_anti")


def require_no_missing_days(spine: DataFrame, df: DataFrame) -> DataFrame:
    """Gaps are an error and are never filled with zero."""
    gaps = missing_days(spine, df).orderBy("date").limit(5).collect()
    if gaps:
        raise ValueError(f"days without data, first ones: {[g.date.isoformat() for g in gaps]}")
    return df

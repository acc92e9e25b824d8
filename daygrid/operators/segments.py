"""Overlapping daily segments from one pass over the facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daygrid.config import TimeWindows
from daygrid.functions.stats import half_even

# Segment names and the leisure / commute pair of each axis.
COMMUTE, LEISURE = "time_wdAM", "time_weMID"
AXES = (
    ("roundtrip", "rt_round", "rt_point"),
    ("time", LEISURE, COMMUTE),
    ("user", "user_casual", "user_member"),
)


def time_slot(ts: Column, windows: TimeWindows) -> Column:
    return slot_at(F.weekday(ts), F.hour(ts), windows)


def slot_at(weekday: Column, hour: Column, windows: TimeWindows) -> Column:
    """``time_wdAM`` on weekday mornings, ``time_weMID`` around weekend noon, else null.

    The only definition of the time windows; every mode goes through it.
    """
    weekend = weekday >= 5
    return F.when(~weekend & hour.isin(list(windows.weekday_morning)), F.lit(COMMUTE)).when(
        weekend & hour.isin(list(windows.weekend_midday)), F.lit(LEISURE)
    )


def is_roundtrip(start: Column, end: Column) -> Column:
    """Same station at both ends; an unknown station is not a round trip."""
    return F.coalesce(start == end, F.lit(False))


def trip_rules(slot: Column) -> list[Column]:
    """The segments one trip belongs to; null entries are dropped by the caller."""
    round_trip = is_roundtrip(F.col("start_station_id"), F.col("end_station_id"))
    user = F.col("member_casual")
    return [
        F.lit("all"),
        F.when(round_trip, F.lit("rt_round")).otherwise(F.lit("rt_point")),
        F.when(user == "member", F.lit("user_member")).when(user == "casual", F.lit("user_casual")),
        slot,
    ]


def hour_rules(ts: Column, windows: TimeWindows) -> list[Column]:
    return [F.lit("all"), time_slot(ts, windows)]


def _unfold(df: DataFrame, rules: list[Column], *keep: Column) -> DataFrame:
    return df.select(*keep, F.explode(F.array_compact(F.array(*rules))).alias("segment"))


def count_segments(df: DataFrame, rules: list[Column], weight: str | None = None) -> DataFrame:
    """(date, segment, n): each row feeds all of its segments, counted map-side first."""
    measure = F.col(weight) if weight else F.lit(1)
    return (
        _unfold(df, rules, F.col("date"), measure.cast("long").alias("_w"))
        .groupBy("date", "segment")
        .agg(F.sum("_w").alias("n"))
    )


def sum_segments(df: DataFrame, ts: str, value: str, windows: TimeWindows) -> DataFrame:
    """(date, segment, n) from hourly sums, rounded half to even. Rows whose time is no time are dropped."""
    if isinstance(df.schema[ts].dataType, T.StringType):
        df = df.withColumn(ts, F.try_to_timestamp(ts))
    rules = hour_rules(F.col(ts), windows)
    return (
        _unfold(df.filter(F.col(ts).isNotNull()), rules, F.to_date(ts).alias("date"), F.col(value).alias("_v"))
        .groupBy("date", "segment")
        .agg(half_even(F.sum("_v")).cast("long").alias("n"))
    )

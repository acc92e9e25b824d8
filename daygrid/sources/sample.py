"""The sample star schema seen as trips, permits, hourly counts and daily variables.

Only the joins a caller needs are made, and facts are reduced to counts per
join key before they meet a dimension: a supplier or customer that owns a
third of all rows arrives at the join as a handful of counted rows.
"""

from __future__ import annotations

import math
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daygrid.config import PanelSettings, Period, SeriesSettings, TimeWindows
from daygrid.functions.calendar import date_spine, within
from daygrid.operators.segments import count_segments, slot_at, sum_segments, trip_rules
from daygrid.session import bounded, planned_bytes
from daygrid.sources.readers import read_table

SAMPLE_PERIOD = Period(date(1996, 1, 1), date(2000, 12, 31), date(1999, 12, 31), date(2000, 6, 30))
SAMPLE_PANEL = PanelSettings(SAMPLE_PERIOD, exclude=(13, 18))
SAMPLE_SERIES = SeriesSettings(SAMPLE_PERIOD)
SAMPLE_WINDOWS = TimeWindows()
EXO_REGRESSORS = ["exo_sum", "exo_high", "exo_low", "exo_count"]
MIN_AREA_SHARE = 0.03
PART_BYTES = 8 << 20  # of the lines' files, to a part whose rows are sorted and grouped in one task


def lines(spark: SparkSession, folder: str, period: Period | None = None) -> DataFrame:
    df = read_table(spark, folder, "lineitem")
    return df.filter(within(F.col("l_shipdate"), period.start, period.end)) if period else df


def user_type() -> Column:
    return F.when(F.col("l_linestatus") == "O", F.lit("member")).otherwise(F.lit("casual"))


def trip_hour() -> Column:
    """Hour of day of a line, taken from its keys, as ship days carry no time."""
    return (F.col("l_orderkey") + F.col("l_linenumber") * 5) % 24


def day_zone_counts(spark: SparkSession, folder: str, period: Period | None = None) -> DataFrame:
    """(date, zone, demand). The lines meet their zone first; the map-side count leaves days x zones rows a task.

    Where the suppliers are no broadcast, adaptive execution can split a hot
    supplier's partition, as the count has a shuffle of its own.
    """
    zones = read_table(spark, folder, "supplier").select("s_suppkey", F.col("s_nationkey").alias("zone"))
    raw = lines(spark, folder, period).select("l_suppkey", F.to_date("l_shipdate").alias("date"))
    return (
        raw.join(zones, raw.l_suppkey == zones.s_suppkey)
        .groupBy("date", "zone")
        .agg(F.count(F.lit(1)).cast("double").alias("demand"))
    )


def day_type_counts(spark: SparkSession, folder: str, period: Period | None = None) -> DataFrame:
    return (
        lines(spark, folder, period)
        .groupBy(F.to_date("l_shipdate").alias("date"), user_type().alias("member_casual"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _trip_groups(
    spark: SparkSession, folder: str, period: Period | None, facets: dict[str, Column]
) -> DataFrame:
    """Lines counted per (date, supplier nation, customer nation, facets).

    Orders meet customers first (the smaller pair); the lines are joined on the
    supplier and on the order key and are then counted once.
    """
    orders = read_table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    homes = read_table(spark, folder, "customer").select("c_custkey", F.col("c_nationkey").alias("origin"))
    origin = orders.join(homes, orders.o_custkey == homes.c_custkey).select("o_orderkey", "origin")
    raw = lines(spark, folder, period).select(
        "l_orderkey", "l_suppkey", F.to_date("l_shipdate").alias("date"), *(c.alias(n) for n, c in facets.items())
    )
    zones = read_table(spark, folder, "supplier").select("s_suppkey", F.col("s_nationkey").alias("zone"))
    return (
        raw.join(zones, raw.l_suppkey == zones.s_suppkey)
        .join(origin, raw.l_orderkey == origin.o_orderkey)
        .groupBy("date", "zone", "origin", *facets)
        .agg(F.count(F.lit(1)).alias("n"))
    )


def routes(spark: SparkSession, folder: str, period: Period | None = None) -> DataFrame:
    """Identical trips with their number ``n``: user type, time slot and both stations."""
    facets = {
        "member_casual": user_type(),
        "slot": slot_at(F.weekday("l_shipdate"), trip_hour(), SAMPLE_WINDOWS),
        "known": F.col("l_orderkey") % 97 != 0,
    }
    groups = _trip_groups(spark, folder, period, facets)

    def station(c: str) -> Column:
        return F.when(F.col("known"), F.col(c).cast("string"))

    return groups.select(
        "date",
        "member_casual",
        "slot",
        station("origin").alias("start_station_id"),
        station("zone").alias("end_station_id"),
        "n",
    )


def flows(spark: SparkSession, folder: str, period: Period | None = None) -> DataFrame:
    """(date, zone, origin, n): at most days x zones x zones rows, however many lines."""
    groups = _trip_groups(spark, folder, period, {})
    return groups.groupBy("date", "zone", "origin").agg(F.sum("n").cast("double").alias("n"))


def trip_segments(spark: SparkSession, folder: str, period: Period = SAMPLE_PERIOD) -> DataFrame:
    """(date, segment, n) for the seven trip segments, from one pass over the lines."""
    return count_segments(routes(spark, folder, period), trip_rules(F.col("slot")), weight="n")


def order_hours(spark: SparkSession, folder: str, period: Period | None = None) -> DataFrame:
    """Second mode: hourly sums of order values."""
    orders = read_table(spark, folder, "orders")
    if period:
        orders = orders.filter(within(F.col("o_orderdate"), period.start, period.end))
    hour = (F.col("o_orderkey") % 24).cast("int")
    ts = F.col("o_orderdate") + F.make_dt_interval(F.lit(0), hour)
    return orders.groupBy(ts.alias("transit_timestamp")).agg(
        F.sum(F.col("o_totalprice") / 1000.0).alias("ridership")
    )


def order_segments(spark: SparkSession, folder: str, period: Period = SAMPLE_PERIOD) -> DataFrame:
    return sum_segments(order_hours(spark, folder, period), "transit_timestamp", "ridership", SAMPLE_WINDOWS)


def exo_days(spark: SparkSession, folder: str, period: Period | None = None) -> DataFrame:
    """Daily outside variables of the days that have orders.

    The mean divides the sum in whole cents, so it does not depend on row order.
    """
    day = F.to_date("o_orderdate").alias("date")

    def tally(priority: str, name: str) -> Column:
        return F.count_if(F.col("o_orderpriority") == priority).cast("double").alias(name)

    orders = read_table(spark, folder, "orders")
    if period:
        orders = orders.filter(within(F.col("o_orderdate"), period.start, period.end))
    return orders.groupBy(day).agg(
        (F.round(F.sum("o_totalprice"), 2) / F.count(F.lit(1))).alias("exo_mean"),
        F.max("o_totalprice").alias("exo_max"),
        F.min("o_totalprice").alias("exo_min"),
        tally("1-URGENT", "exo_sum"),
        tally("2-HIGH", "exo_high"),
        tally("5-LOW", "exo_low"),
        F.count(F.lit(1)).cast("double").alias("exo_count"),
    )


def exo_daily(spark: SparkSession, folder: str, period: Period = SAMPLE_PERIOD) -> DataFrame:
    """Daily outside variables on a complete day spine.

    Counts are 0 on days without orders; the price statistics stay null there.
    """
    spine = date_spine(spark, period.start, period.end)
    joined = spine.join(bounded(exo_days(spark, folder, period), period.days), "date", "left")
    return joined.fillna(0.0, subset=EXO_REGRESSORS)


def zone_lookup(spark: SparkSession, folder: str) -> DataFrame:
    nation = read_table(spark, folder, "nation")
    region = read_table(spark, folder, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("n_nationkey").alias("LocationID"), F.col("r_name").alias("Borough")
    )


def permit_rows(spark: SparkSession, folder: str, period: Period | None = None) -> DataFrame:
    """(event_id, day, police_precinct): one row per order, its suppliers' nations as a comma list.

    The set of an order holds each nation once, in ascending order, and is bounded
    by the nations. Lines are reduced to distinct (order, nation) pairs, dealt by both,
    before they meet the orders, however many lines an order has. The parts grow with
    the lines read, so that what a task sorts and groups stays the same.
    """
    orders = read_table(spark, folder, "orders")
    if period:
        orders = orders.filter(within(F.col("o_orderdate"), period.start, period.end))
    lines_read = read_table(spark, folder, "lineitem")
    n = max(spark.sparkContext.defaultParallelism, math.ceil(planned_bytes(lines_read) / PART_BYTES))
    orders = orders.select("o_orderkey", F.to_date("o_orderdate").alias("day")).repartition(n, "o_orderkey")
    raw = lines_read.select("l_orderkey", "l_suppkey")
    zones = read_table(spark, folder, "supplier").select("s_suppkey", "s_nationkey")
    pairs = raw.join(zones, raw.l_suppkey == zones.s_suppkey).select("l_orderkey", "s_nationkey")
    pairs = pairs.repartition(n, "l_orderkey", "s_nationkey").distinct().repartition(n, "l_orderkey")
    sets = (
        pairs.join(orders, pairs.l_orderkey == orders.o_orderkey)
        .groupBy("l_orderkey", "day")
        .agg(F.array_sort(F.collect_set("s_nationkey")).alias("ids"))
    )
    listed = F.concat(F.array_join(F.transform("ids", lambda i: i.cast("string")), ","), F.lit(","))
    return sets.select(F.col("l_orderkey").alias("event_id"), "day", listed.alias("police_precinct"))


def overlap_areas(spark: SparkSession, folder: str) -> DataFrame:
    """(precinct, LocationID, area): lines shared by a supplier and a customer nation."""
    return flow_areas(flows(spark, folder))


def flow_areas(counted: DataFrame) -> DataFrame:
    return counted.groupBy(F.col("zone").alias("precinct"), F.col("origin").alias("LocationID")).agg(
        F.sum("n").cast("double").alias("area")
    )


def hourly_events(spark: SparkSession, folder: str) -> DataFrame:
    ts = F.col("ts")
    full_hour = F.to_date(ts).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.hour(ts))
    events = read_table(spark, folder, "events")
    return events.groupBy(full_hour.alias("transit_timestamp")).agg(F.sum("value").alias("ridership"))


__all__ = [
    "EXO_REGRESSORS",
    "MIN_AREA_SHARE",
    "SAMPLE_PANEL",
    "SAMPLE_PERIOD",
    "SAMPLE_SERIES",
    "SAMPLE_WINDOWS",
    "day_type_counts",
    "day_zone_counts",
    "exo_daily",
    "exo_days",
    "flow_areas",
    "flows",
    "hourly_events",
    "lines",
    "order_hours",
    "order_segments",
    "overlap_areas",
    "permit_rows",
    "routes",
    "trip_hour",
    "trip_segments",
    "user_type",
    "zone_lookup",
]

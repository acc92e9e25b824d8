"""Permit events: collapse, precinct lists, area weights and the three encodings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daygrid.functions.text import parse_id_list
from daygrid.operators.counts import distinct_per
from daygrid.session import checked_broadcast


def collapse_events(df: DataFrame) -> DataFrame:
    return df.select("event_id", "day", "police_precinct").distinct()


def city_events(df: DataFrame, out: str = "event_count") -> DataFrame:
    return distinct_per(df.withColumnRenamed("day", "date"), "date", "event_id", out)


def area_weights(areas: DataFrame, minimum: float = 1e-4) -> DataFrame:
    """Share of each precinct's area per zone; slivers are dropped, the rest sums to 1.

    ``areas`` has one row per (precinct, zone), so a window holds at most the
    zones of one precinct; both totals share one shuffle.
    """
    w = Window.partitionBy("precinct")
    share = areas.withColumn("_share", F.col("area") / F.sum("area").over(w)).filter(F.col("_share") >= minimum)
    return share.select("precinct", "LocationID", (F.col("_share") / F.sum("_share").over(w)).alias("weight"))


def precinct_pairs(df: DataFrame) -> DataFrame:
    """Distinct (event, day, precinct); an event counts fully in every precinct it names."""
    return df.select(
        "event_id", F.col("day").alias("date"), F.explode(parse_id_list("police_precinct")).alias("precinct")
    ).distinct()


def zone_event_mass(df: DataFrame, weights: DataFrame, out: str = "event_count") -> DataFrame:
    """Expected events per (date, zone), only positive cells.

    Events are counted per (date, precinct) before they meet the weights, so
    the weight join handles days x precincts rows whatever the event volume.
    The weights are a written lookup table, broadcast only if it is small.
    """
    counted = precinct_pairs(df).groupBy("date", "precinct").agg(F.count(F.lit(1)).alias("_n"))
    return (
        counted.join(checked_broadcast(weights), "precinct")
        .groupBy("date", F.col("LocationID").alias("zone"))
        .agg(F.sum(F.col("_n") * F.col("weight")).alias(out))
        .filter(F.col(out) > 0)
    )


def with_daily_total(df: DataFrame, value: str, out: str) -> DataFrame:
    """Day total of a zone column on every row of the day (panel rows: one per zone)."""
    return df.withColumn(out, F.sum(value).over(Window.partitionBy("date")))

"""Shared intermediate tables of the queries, built from the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daygrid.functions.calendar import calendar_block, calendar_names, date_spine, harmonic_names
from daygrid.functions.stats import tidy
from daygrid.operators.counts import pivot_types, top_keys
from daygrid.operators.events import area_weights, city_events, with_daily_total, zone_event_mass
from daygrid.operators.features import panel_features, series_lag_columns, split_label
from daygrid.operators.grid import complete_grid, fill_grid, join_daily, join_zone_events
from daygrid.operators.linear import residuals
from daygrid.session import bounded, stable
from daygrid.sources import sample
from daygrid.sources.readers import union_all

PERIOD = sample.SAMPLE_PERIOD
PANEL = sample.SAMPLE_PANEL
SERIES = sample.SAMPLE_SERIES
EXO = sample.EXO_REGRESSORS
RAIN_SUM, RAIN_HOURS = "exo_sum", "exo_count"
TARGETS = ("total", "member", "casual")
BASELINE = calendar_names(holiday=False)
CLIMATE = harmonic_names()
ANOMALIES = [f"anom_{v}" for v in EXO]


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column, so that results compare across engines."""
    return df.select(
        *(
            tidy(F.col(f.name), digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
            for f in df.schema.fields
        )
    )


def is_train(day: str = "date") -> Column:
    return F.col(day) <= F.lit(PERIOD.train_end)


def is_test(day: str = "date") -> Column:
    return F.col(day) > F.lit(PERIOD.val_end)


def spine(spark: SparkSession) -> DataFrame:
    return date_spine(spark, PERIOD.start, PERIOD.end)


def zone_counts(spark: SparkSession, d: str) -> DataFrame:
    """Sparse (date, zone, demand), written once: zone choice and grid both read it."""
    return stable(sample.day_zone_counts(spark, d, PERIOD), "zone-counts")


def demand_panel(spark: SparkSession, d: str) -> DataFrame:
    return grid_of(zone_counts(spark, d))


def grid_of(counts: DataFrame) -> DataFrame:
    """Complete date x zone grid of the top zones by train demand."""
    top = top_keys(counts, "zone", "demand", PERIOD.train_end, PANEL.top_n, PANEL.exclude).select("zone")
    return fill_grid(complete_grid(top, PERIOD), counts, ["date", "zone"], "demand")


def crosswalk(spark: SparkSession, d: str) -> DataFrame:
    """The weight lookup, written once: a small table that outlives the raw lines."""
    return stable(area_weights(sample.overlap_areas(spark, d), sample.MIN_AREA_SHARE), "weights")


def permits(spark: SparkSession, d: str) -> DataFrame:
    """Permit rows of the period. Duplicates are left to the distinct counts that follow."""
    return sample.permit_rows(spark, d, PERIOD)


def merged_panel(spark: SparkSession, d: str) -> DataFrame:
    """Panel with daily variables and the three event encodings."""
    # One pass over the lines serves both the demand and the area weights.
    flows = stable(sample.flows(spark, d), "flows")
    inside = flows.filter(F.col("date").between(F.lit(PERIOD.start), F.lit(PERIOD.end)))
    counts = inside.groupBy("date", "zone").agg(F.sum("n").alias("demand"))
    weights = stable(area_weights(sample.flow_areas(flows), sample.MIN_AREA_SHARE), "weights")
    rows = stable(permits(spark, d), "permits")
    zone_events = zone_event_mass(rows, weights, "event_count_zone")
    panel = join_daily(grid_of(counts), sample.exo_daily(spark, d).select("date", *EXO), PERIOD)
    panel = join_daily(panel, city_events(rows), PERIOD).withColumn(
        "event_count", F.coalesce(F.col("event_count"), F.lit(0)).cast("long")
    )
    return with_daily_total(join_zone_events(panel, zone_events), "event_count_zone", "event_count_manhattan")


def panel_table(spark: SparkSession, d: str) -> DataFrame:
    """Feature table of the panel: computed once, conditions select columns from it."""
    return panel_features(merged_panel(spark, d), PANEL)


def daily_series(spark: SparkSession, d: str) -> DataFrame:
    """(date, member, casual, total) on the complete spine."""
    wide = pivot_types(sample.day_type_counts(spark, d, PERIOD), ["member", "casual"])
    return spine(spark).join(bounded(wide, PERIOD.days), "date", "left").fillna(0)


def target_series(spark: SparkSession, d: str) -> DataFrame:
    """(date, target, y), long."""
    wide = daily_series(spark, d).select("date", *(F.col(t).cast("double").alias(t) for t in TARGETS))
    return wide.unpivot("date", list(TARGETS), "target", "y")


def with_calendar(df: DataFrame) -> DataFrame:
    return df.select(*df.columns, *calendar_block(F.col("date"), PERIOD.start))


def anomalies(spark: SparkSession, d: str) -> DataFrame:
    """(date, anom_*): outside variables minus their train day-of-year climate."""
    exo = stable(with_calendar(sample.exo_daily(spark, d).select("date", *EXO, F.lit(1).alias("g"))), "exo")
    out = residuals(exo, ["g"], dict.fromkeys(EXO, CLIMATE), is_train(), {v: f"anom_{v}" for v in EXO})
    return out.select("date", *ANOMALIES)


def series_table(spark: SparkSession, d: str) -> DataFrame:
    """Feature table of the three target series, written once."""
    y = target_series(spark, d)
    lagged = y.select(*y.columns, *series_lag_columns(SERIES, "target"))
    joined = with_calendar(lagged).join(bounded(anomalies(spark, d), PERIOD.days), "date")
    return stable(joined, "series")


def trip_segment_table(spark: SparkSession, d: str) -> DataFrame:
    """(date, segment, n, exo..., cal_...) of the seven trip segments, written once."""
    seg = sample.trip_segments(spark, d)
    return stable(with_calendar(join_daily(seg, sample.exo_daily(spark, d).select("date", *EXO), PERIOD)), "segments")


def mode_segment_table(spark: SparkSession, d: str) -> DataFrame:
    """Both modes' segments with daily variables and calendar columns, written once."""
    trips = sample.trip_segments(spark, d).withColumn("mode", F.lit("trips"))
    orders = sample.order_segments(spark, d).withColumn("mode", F.lit("orders"))
    both = union_all([trips, orders])
    return stable(with_calendar(join_daily(both, sample.exo_daily(spark, d).select("date", *EXO), PERIOD)), "modes")


def with_residuals(df: DataFrame, keys: list[str], y: str, exo: list[str] = EXO) -> DataFrame:
    """Add ``resid`` (y minus its calendar baseline) and ``anom_*``, fitted per group on train rows."""
    base = df.withColumn("y", F.col(y).cast("double"))
    specs = {"y": BASELINE, **dict.fromkeys(exo, CLIMATE)}
    return residuals(base, keys, specs, is_train(), {"y": "resid", **{v: f"anom_{v}" for v in exo}})


def with_split(df: DataFrame) -> DataFrame:
    return df.withColumn("split", split_label(F.col("date"), PERIOD))


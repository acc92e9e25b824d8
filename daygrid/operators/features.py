"""Lag, rolling, split, panel and series feature operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from daygrid.config import PanelSettings, Period, SeriesSettings
from daygrid.functions.calendar import cyclic_calendar, is_holiday


def by_day(key: str) -> WindowSpec:
    """One series per key: at most one row per day of the period."""
    return Window.partitionBy(key).orderBy("date")


def lags(value: str, steps: Sequence[int], w: WindowSpec, prefix: str) -> list[Column]:
    return [F.lag(value, k).over(w).alias(f"{prefix}{k}") for k in steps]


def rolling_means(value: str, sizes: Sequence[int], w: WindowSpec, prefix: str) -> list[Column]:
    """Mean of the ``size`` rows before the current one; null until that many exist."""
    out = []
    for size in sizes:
        frame = w.rowsBetween(-size, -1)
        full = F.count(value).over(frame) == size
        out.append(F.when(full, F.avg(value).over(frame)).alias(f"{prefix}{size}"))
    return out


def split_label(day: Column, period: Period) -> Column:
    return (
        F.when(day <= F.lit(period.train_end), F.lit("train"))
        .when(day <= F.lit(period.val_end), F.lit("val"))
        .otherwise(F.lit("test"))
    )


def panel_features(df: DataFrame, settings: PanelSettings) -> DataFrame:
    """All zone features from one shared window: one shuffle and one sort by zone."""
    w = by_day("zone")
    day = F.col("date")
    return df.select(
        *df.columns,
        *lags("demand", settings.lags, w, "demand_lag_"),
        *rolling_means("demand", settings.rolling, w, "demand_rolling_mean_"),
        *cyclic_calendar(day),
        is_holiday(day).cast("int").alias("is_holiday"),
    )


# Feature groups added to the base columns per panel condition.
PANEL_GROUPS = {
    "A": (),
    "B": ("exo",),
    "C": ("event_count",),
    "Cprime": ("event_count_manhattan",),
    "D": ("exo", "event_count"),
    "E": ("event_count_zone",),
}
SERIES_PREFIXES = {
    "A": ("cal_",),
    "B": ("cal_", "anom_"),
    "C": ("cal_", "lag_"),
    "D": ("cal_", "anom_", "lag_"),
}
FEATURE_GROUPS = {"cal": "calendar", "anom": "weather_anom", "lag": "lag"}
PANEL_KEYS = ("date", "zone", "demand")


def panel_conditions(columns: Sequence[str], exo: Sequence[str]) -> dict[str, list[str]]:
    """Feature columns per condition, for the conditions whose inputs are present."""
    extra = [c for c in columns if c in exo]
    scalars = {"event_count", "event_count_manhattan", "event_count_zone"}
    base = [c for c in columns if c not in exo and c not in scalars and c not in PANEL_KEYS]
    out = {}
    for name, groups in PANEL_GROUPS.items():
        wanted = [g for g in groups if g != "exo"]
        if all(g in columns for g in wanted) and ("exo" not in groups or extra):
            out[name] = base + (extra if "exo" in groups else []) + wanted
    return out


def series_conditions(columns: Sequence[str]) -> dict[str, list[str]]:
    return {
        name: [c for p in prefixes for c in columns if c.startswith(p)]
        for name, prefixes in SERIES_PREFIXES.items()
    }


def check_nested(conditions: dict[str, list[str]]) -> None:
    """Condition A must be part of every other condition."""
    base = set(conditions["A"])
    for name, cols in conditions.items():
        if not base <= set(cols):
            raise ValueError(f"condition {name} lacks columns of condition A")


def series_lag_columns(settings: SeriesSettings, key: str, y: str = "y") -> list[Column]:
    w = by_day(key)
    return [*lags(y, settings.lags, w, "lag_y_"), *rolling_means(y, settings.rolling, w, "lag_roll_mean_")]


def train_moments(df: DataFrame, cols: Sequence[str], is_train: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Mean and population deviation of every column on train rows; 0 deviation becomes 1."""
    aggs = []
    for c in cols:
        sd = F.stddev_pop(c)
        aggs += [F.avg(c).alias(f"mean_{c}"), F.when(sd > 0, sd).otherwise(F.lit(1.0)).alias(f"std_{c}")]
    return df.filter(is_train).groupBy(*keys).agg(*aggs)


def standardize(df: DataFrame, cols: Sequence[str], is_train: Column) -> DataFrame:
    """(x - mean) / std with train statistics; they are one row, joined as such."""
    m = train_moments(df, cols, is_train).withColumn("_k", F.lit(1))
    joined = df.withColumn("_k", F.lit(1)).join(F.broadcast(m), "_k")
    kept = [c for c in df.columns if c not in cols]
    return joined.select(
        *kept, *(((F.col(c) - F.col(f"mean_{c}")) / F.col(f"std_{c}")).alias(c) for c in cols)
    )


def zone_indicators(categories: Sequence[int], zone: str = "zone") -> list[Column]:
    """One column per train zone but the first; an unknown zone is zero everywhere."""
    return [(F.col(zone) == z).cast("double").alias(f"zone_{z}") for z in sorted(categories)[1:]]


def date_blocks(df: DataFrame, folds: int) -> DataFrame:
    """Forward folds over unique days, as (date, fold, role).

    Fold i of k tests ``n // (k + 1)`` days and trains on every day before them.
    The window runs over the distinct days only, whatever the row count of ``df``.
    """
    whole = Window.partitionBy(F.lit(0))
    ranked = df.select("date").distinct().select(
        "date",
        (F.row_number().over(whole.orderBy("date")) - 1).alias("pos"),
        F.count(F.lit(1)).over(whole).cast("int").alias("n_days"),
    )
    size = F.expr(f"n_days div {folds + 1}")
    left = folds - F.col("fold")
    return (
        ranked.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
        .withColumn("lo", F.col("n_days") - left * size)
        .withColumn("hi", F.col("n_days") - (left - 1) * size)
        .filter(F.col("pos") < F.col("hi"))
        .select("date", "fold", F.when(F.col("pos") >= F.col("lo"), F.lit("test")).otherwise(F.lit("train")).alias("role"))
    )


def shock_days(df: DataFrame, value: str, quantile: float, keys: Sequence[str]) -> DataFrame:
    """Flag days whose absolute change of ``value`` reaches the given exact quantile."""
    w = Window.partitionBy(*keys).orderBy("date")
    change = df.withColumn("change", F.abs(F.col(value) - F.lag(value).over(w)))
    cut = change.groupBy(*keys).agg(F.percentile("change", F.lit(quantile)).alias("threshold"))
    return change.join(cut, list(keys)).withColumn(
        "is_shock", F.coalesce(F.col("change") >= F.col("threshold"), F.lit(False))
    )

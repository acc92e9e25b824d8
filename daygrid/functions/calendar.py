"""Calendar expressions over a date column. Everything stays in JVM codegen."""

from __future__ import annotations

from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daygrid.config import Period

YEAR_DAYS = 365.25
WEEKDAYS = range(1, 7)  # Tuesday .. Sunday; Monday is the reference level

# Public holidays of the United States.
# (month, day, first year) for dates observed on the nearest weekday.
FIXED_HOLIDAYS = ((1, 1, 0), (6, 19, 2021), (7, 4, 0), (11, 11, 0), (12, 25, 0))
# (month, weekday with Monday = 0, first and last day of month it can fall on).
FLOATING_HOLIDAYS = (
    (1, 0, 15, 21),
    (2, 0, 15, 21),
    (5, 0, 25, 31),
    (9, 0, 1, 7),
    (10, 0, 8, 14),
    (11, 3, 22, 28),
)


def day_of(c: Column | str) -> Column:
    """Calendar day of a timestamp or a text; text that is no timestamp gives null."""
    return (F.col(c) if isinstance(c, str) else c).try_cast("timestamp").cast("date")


def day_of_text(c: Column | str) -> Column:
    return F.to_date(F.try_to_timestamp(F.col(c) if isinstance(c, str) else c))


def within(ts: Column, start: date, end: date) -> Column:
    """Closed day range on a timestamp, as two comparisons the scan can use."""
    low = F.lit(start.isoformat()).cast("timestamp_ntz")
    high = F.lit((end + timedelta(days=1)).isoformat()).cast("timestamp_ntz")
    return (ts >= low) & (ts < high)


def day_range(day: Column, period: Period) -> Column:
    return day.between(F.lit(period.start), F.lit(period.end))


def weekday(day: Column) -> Column:
    return F.weekday(day)


def is_weekend(day: Column) -> Column:
    return F.weekday(day) >= 5


def day_index(day: Column, start: date) -> Column:
    return F.date_diff(day, F.lit(start)).cast("double")


def weekday_dummies(day: Column, prefix: str = "cal_dow_") -> list[Column]:
    return [(F.weekday(day) == d).cast("double").alias(f"{prefix}{d}") for d in WEEKDAYS]


def annual_harmonics(day: Column, order: int = 3, prefix: str = "cal_") -> list[Column]:
    angle = F.dayofyear(day) * F.lit(2.0) * F.pi() / F.lit(YEAR_DAYS)
    out = []
    for k in range(1, order + 1):
        out.append(F.sin(angle * k).alias(f"{prefix}sin_{k}"))
        out.append(F.cos(angle * k).alias(f"{prefix}cos_{k}"))
    return out


def cyclic_calendar(day: Column) -> list[Column]:
    week = F.weekday(day) * F.lit(2.0) * F.pi() / F.lit(7.0)
    month = F.month(day) * F.lit(2.0) * F.pi() / F.lit(12.0)
    return [
        F.sin(week).alias("dow_sin"),
        F.cos(week).alias("dow_cos"),
        F.sin(month).alias("month_sin"),
        F.cos(month).alias("month_cos"),
        is_weekend(day).cast("int").alias("is_weekend"),
    ]


def is_holiday(day: Column) -> Column:
    """Holiday or its observed weekday, decided from the date alone.

    No calendar table and no join: a fixed-date holiday that falls on a
    Saturday also marks the Friday before, on a Sunday the Monday after.
    """

    def on(d: Column, month: int, dom: int, since: int) -> Column:
        return (F.month(d) == month) & (F.dayofmonth(d) == dom) & (F.year(d) >= since)

    rules = []
    before, after = F.date_add(day, -1), F.date_add(day, 1)
    for month, dom, since in FIXED_HOLIDAYS:
        rules.append(on(day, month, dom, since))
        rules.append((F.weekday(day) == 4) & on(after, month, dom, since))
        rules.append((F.weekday(day) == 0) & on(before, month, dom, since))
    for month, wd, first, last in FLOATING_HOLIDAYS:
        rules.append(
            (F.month(day) == month)
            & (F.weekday(day) == wd)
            & F.dayofmonth(day).between(first, last)
        )
    return reduce(lambda a, b: a | b, rules)


def calendar_block(day: Column, start: date, order: int = 3) -> list[Column]:
    """Trend, weekday, season and holiday columns with the ``cal_`` prefix."""
    return [
        day_index(day, start).alias("cal_trend"),
        *weekday_dummies(day),
        *annual_harmonics(day, order),
        is_holiday(day).cast("double").alias("cal_is_holiday"),
    ]


def calendar_names(order: int = 3, holiday: bool = True) -> list[str]:
    names = ["cal_trend", *(f"cal_dow_{d}" for d in WEEKDAYS), *harmonic_names(order)]
    return names + ["cal_is_holiday"] if holiday else names


def harmonic_names(order: int = 3) -> list[str]:
    return [f"cal_{f}_{k}" for k in range(1, order + 1) for f in ("sin", "cos")]


def date_spine(spark: SparkSession, start: date, end: date) -> DataFrame:
    """One row per day of the closed range."""
    return spark.range(1).select(
        F.explode(F.sequence(F.lit(start), F.lit(end), F.expr("interval 1 day"))).alias("date")
    )

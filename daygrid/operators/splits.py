"""Periods and split boundaries as a table: each group has its own.

Rows that carry ``train_end`` and ``val_end`` are split by comparing columns, so that
one pass fits groups whose training ends on different days.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daygrid.config import Period
from daygrid.operators.quality import require_one_to_one
from daygrid.session import checked_broadcast, stable

EDGES = ["first_day", "last_day", "train_end", "val_end"]


def boundaries(spark: SparkSession, periods: dict[tuple, Period], names: Sequence[str]) -> DataFrame:
    """(names, first_day, last_day, train_end, val_end), one row for each key of ``periods``."""
    schema = ", ".join([*(f"{n} string" for n in names), *(f"{e} date" for e in EDGES)])
    return spark.createDataFrame([(*key, p.start, p.end, p.train_end, p.val_end) for key, p in periods.items()], schema)


def within_boundaries(df: DataFrame, bounds: DataFrame, on: Sequence[str], unique: Sequence[str] | None = None) -> DataFrame:
    """Rows inside the period of each group, with its columns of ``bounds``.

    A series that several groups share (``unique`` names the groups' own key) comes
    out once for each. Boundaries that are repeated or out of order raise; a group
    without boundaries has no rows.
    """
    bounds = stable(require_one_to_one(bounds, list(unique or on), "boundaries"), "boundaries")
    order = "first_day <= train_end AND train_end < val_end AND val_end <= last_day"
    wrong = bounds.filter(f"NOT coalesce({order}, false)").select(*(unique or on)).take(3)
    if wrong:
        raise ValueError(f"split dates are not ordered inside the period: {[tuple(r) for r in wrong]}")
    return df.join(checked_broadcast(bounds), list(on)).filter("date BETWEEN first_day AND last_day")


def in_train() -> Column:
    return F.col("date") <= F.col("train_end")


def in_test() -> Column:
    return F.col("date") > F.col("val_end")


def split_of() -> Column:
    return F.when(in_train(), F.lit("train")).when(in_test(), F.lit("test")).otherwise(F.lit("val"))

"""Exact quantiles of groups of any size by distributed selection.

``percentile`` keeps every distinct value of a group in one buffer. Here a group is
only ever counted: its range is cut into bins, the bin that holds the wanted rank is
known from the counts, and the rows of that bin are all that the next pass reads. A bin
also reports its least and largest value, so a pass ends for a group as soon as its bin
holds one value, however often. The first pass cuts on the logarithm of the
distance from zero, the later ones evenly, so that a few values of another magnitude
cost one pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daygrid.session import checked_broadcast, stable

BINS = 1024
SMALLEST_LOG = 745.0  # above minus the logarithm of the smallest double


def _stretched(x: Column) -> Column:
    """Grows with x, evenly in the logarithm of its distance from zero."""
    return F.when(x == 0, F.lit(0.0)).otherwise(F.signum(x) * (F.ln(F.abs(x)) + SMALLEST_LOG))


def _bin(x: Column, low: Column, high: Column, bins: int) -> Column:
    place = F.try_divide(x - low, high - low) * bins
    return F.when(high > low, F.least(F.floor(place), F.lit(bins - 1))).otherwise(F.lit(0)).cast("int")


def _narrowed(rows: DataFrame, open_: DataFrame, bins: int, stretched: bool) -> DataFrame:
    """(g, n, h, rank, low, high, before): the bin of each open group that holds its rank."""
    scale = _stretched if stretched else (lambda c: c)
    binned = rows.join(open_, "g").withColumn("bin", _bin(scale(F.col("v")), scale(F.col("low")), scale(F.col("high")), bins))
    counted = binned.groupBy("g", "n", "h", "rank", "before", "bin").agg(F.count(F.lit(1)).alias("held"), F.min("v").alias("low"), F.max("v").alias("high"))
    w = Window.partitionBy("g").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # at most ``bins`` rows of a group
    placed = counted.withColumn("before", F.col("before") + F.coalesce(F.sum("held").over(w), F.lit(0)))
    inside = (F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("held"))
    return placed.filter(inside).select("g", "n", "h", "rank", "low", "high", "before")


def exact_quantile(df: DataFrame, keys: Sequence[str], value: str, q: float, out: str = "quantile", bins: int = BINS) -> DataFrame:
    """(keys, out): the ``q`` quantile of each group, interpolated between the two neighbours of its rank.

    Values that are null, NaN or infinite are left out; a group of nothing else has a
    null. Rows whose keys are null are a group like any other. A pass is one grouping with
    map-side combine, its rows at most ``bins`` for each group and task, whatever share of
    all rows a group holds.
    """
    x = F.col(value).cast("double")
    usable = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    every = df.select(F.struct(*keys).alias("g"), F.when(usable, x).alias("v"))
    groups = every.groupBy("g").agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    h = (F.col("n") - 1) * F.lit(float(q))
    groups = stable(groups.select("g", "n", h.alias("h"), F.floor(h).alias("rank"), "low", "high", F.lit(0).cast("long").alias("before")), "ranks")
    rows = every = every.filter("v IS NOT NULL")
    done, open_ = groups.filter("n > 0 AND low = high"), groups.filter("low < high")
    stretched = True
    while not open_.isEmpty():
        found = stable(_narrowed(rows, checked_broadcast(open_), bins, stretched), "narrowed")
        done, open_ = done.unionByName(found.filter("low = high")), found.filter("low < high")
        inside = rows.join(checked_broadcast(open_.select("g", "low", "high")), "g").filter("v BETWEEN low AND high")
        rows, stretched = stable(inside.select("g", "v"), "rows_inside"), False

    # The value at the rank is known; the next one differs only if no equal value follows.
    found = stable(done.select("g", "h", "rank", F.col("low").alias("value")), "ranked_values")
    above = F.min(F.when(F.col("v") > F.col("value"), F.col("v")))
    upto = F.count_if(F.col("v") <= F.col("value"))
    facts = every.join(checked_broadcast(found), "g").groupBy("g", "h", "rank", "value").agg(above.alias("above"), upto.alias("upto"))
    after = F.when((F.col("upto") > F.col("rank") + 1) | (F.col("h") == F.col("rank")), F.col("value")).otherwise(F.col("above"))
    ends = facts.select("g", (F.col("value") + (F.col("h") - F.col("rank")) * (after - F.col("value"))).alias(out))
    return ends.union(groups.filter("n = 0").select("g", F.lit(None).cast("double"))).select("g.*", out)

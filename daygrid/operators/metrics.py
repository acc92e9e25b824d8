"""Model scores, residual correlations and effect tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daygrid.functions.stats import r2_from, safe_corr
from daygrid.operators.features import FEATURE_GROUPS
from daygrid.operators.segments import AXES, COMMUTE, LEISURE


def score_columns(y: str, pred: str, when: Column | None = None, prefix: str = "") -> list[Column]:
    """mae, rmse and r2, optionally over the rows where ``when`` holds."""

    def only(c: Column) -> Column:
        return F.when(when, c) if when is not None else c

    err = only(F.col(y) - F.col(pred))
    mse = F.avg(err * err)
    return [
        F.avg(F.abs(err)).alias(f"{prefix}mae"),
        F.sqrt(mse).alias(f"{prefix}rmse"),
        r2_from(mse, F.var_pop(only(F.col(y)))).alias(f"{prefix}r2"),
    ]


def score(df: DataFrame, keys: Sequence[str], y: str, pred: str) -> DataFrame:
    return df.groupBy(*keys).agg(*score_columns(y, pred))


def score_splits(df: DataFrame, keys: Sequence[str], y: str, pred: str, split: str = "split") -> DataFrame:
    """val_* and test_* scores side by side, in one aggregation."""
    cols = []
    for part in ("val", "test"):
        cols += score_columns(y, pred, F.col(split) == part, f"{part}_")
    return df.groupBy(*keys).agg(*cols)


def score_zone_mean(df: DataFrame, keys: Sequence[str], y: str, pred: str, split: str = "split") -> DataFrame:
    """Scores per zone, then their unweighted mean over zones."""
    per_zone = score_splits(df, [*keys, "zone"], y, pred, split)
    names = [f"{p}_{m}" for p in ("val", "test") for m in ("mae", "rmse", "r2")]
    return per_zone.groupBy(*keys).agg(*(F.avg(c).alias(c) for c in names))


def correlations(df: DataFrame, keys: Sequence[str], resid: str, others: dict[str, str]) -> DataFrame:
    """corr(resid, column) per key, null on a constant column."""
    return df.groupBy(*keys).agg(*(safe_corr(F.col(resid), F.col(c)).alias(name) for name, c in others.items()))


def fit_line(df: DataFrame, keys: Sequence[str], y: str, x: str) -> DataFrame:
    slope = F.when(F.var_pop(x) > 0, F.regr_slope(y, x))
    return df.groupBy(*keys).agg(
        slope.alias("slope"), F.when(F.var_pop(x) > 0, F.regr_intercept(y, x)).alias("intercept")
    )


def mode_table(df: DataFrame, value: str) -> DataFrame:
    """mode x segment values as one row per mode with commute and leisure columns."""
    label = F.when(F.col("segment") == COMMUTE, "commute").when(F.col("segment") == LEISURE, "leisure")
    kept = df.withColumn("cell", label).filter("cell is not null")
    return kept.groupBy("mode").pivot("cell", ["commute", "leisure"]).agg(F.max(value))


def effects(table: DataFrame, modes: tuple[str, str]) -> DataFrame:
    """Column effect per mode, row effect per segment, direction agreement and which is larger.

    ``table`` is a mode_table; everything is one aggregation over its two rows.
    """
    a, b = modes

    def cell(mode: str, seg: str) -> Column:
        return F.max(F.when(F.col("mode") == mode, F.col(seg)))

    wide = table.agg(
        (cell(a, "leisure") - cell(a, "commute")).alias(f"column_{a}"),
        (cell(b, "leisure") - cell(b, "commute")).alias(f"column_{b}"),
        (cell(b, "commute") - cell(a, "commute")).alias("row_commute"),
        (cell(b, "leisure") - cell(a, "leisure")).alias("row_leisure"),
    )
    ca, cb = F.col(f"column_{a}"), F.col(f"column_{b}")
    max_col = F.greatest(F.abs(ca), F.abs(cb))
    max_row = F.greatest(F.abs("row_commute"), F.abs("row_leisure"))
    return wide.select(
        "*",
        ((ca < 0) == (cb < 0)).alias("same_direction"),
        max_col.alias("max_column"),
        max_row.alias("max_row"),
        (max_row > max_col).alias("row_exceeds_column"),
    )


def axis_verdicts(df: DataFrame, value: str) -> DataFrame:
    """Per axis: does the leisure side react more negatively than the commute side?"""
    sides = df.sparkSession.createDataFrame(
        [(axis, seg, side) for axis, leisure, commute in AXES for side, seg in (("leisure", leisure), ("commute", commute))],
        "axis string, segment string, side string",
    )
    wide = (
        df.join(F.broadcast(sides), "segment")
        .groupBy("axis")
        .agg(
            F.max(F.when(F.col("side") == "leisure", F.col(value))).alias("w_leisure"),
            F.max(F.when(F.col("side") == "commute", F.col(value))).alias("w_commute"),
        )
    )
    return wide.withColumn(
        "verdict", F.when(F.col("w_leisure") < F.col("w_commute"), "support").otherwise("against")
    )


def overall_verdict(verdicts: DataFrame) -> DataFrame:
    agree = F.count_if(F.col("verdict") == "support")
    n = F.count(F.lit(1))
    return verdicts.agg(
        F.when(agree == n, "supported").when(agree == 0, "rejected").otherwise("mixed").alias("overall")
    )


def coefficient_summary(coefs: DataFrame, keys: Sequence[str], named: dict[str, str]) -> DataFrame:
    """(keys, max_<group>..., named coefficients) from standardised coefficients; one grouping."""
    prefix = F.split("feature", "_")[0]
    largest = [F.max(F.when(prefix == p, F.col("abs"))).alias(f"max_{g}") for p, g in FEATURE_GROUPS.items()]
    single = [F.max(F.when(F.col("feature") == c, F.col("std_coef"))).alias(n) for n, c in named.items()]
    return coefs.groupBy(*keys).agg(*largest, *single)

"""Data-quality and leakage checks, and the incremental counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daygrid.config import SearchSettings
from daygrid.functions.calendar import harmonic_names
from daygrid.operators import features, grid, linear, quality
from daygrid.plans import tables as t
from daygrid.plans.registry import query
from daygrid.plans.sqltext import BASELINE, TRAIN_END, VAL_END, with_ctes
from daygrid.session import scratch, stable
from daygrid.sources import sample
from daygrid.sources.readers import read_table, write_parquet
from daygrid.streaming.daily_counts import update_counts


@query(
    "dq_row_count",
    with_ctes(["panel", "exo"], "SELECT a.n AS rows_before, b.n AS rows_after, a.n = b.n AS kept FROM (SELECT count(*) AS n FROM panel) a, (SELECT count(*) AS n FROM panel LEFT JOIN exo USING (date)) b"),
)
def dq_row_count(spark: SparkSession, d: str) -> DataFrame:
    panel = stable(t.demand_panel(spark, d), "panel")
    joined = grid.join_daily(panel, sample.exo_daily(spark, d).select("date", "exo_sum"), t.PERIOD)
    return quality.row_counts(panel, joined)


@query("dq_unique_key", "SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def dq_unique_key(spark: SparkSession, d: str) -> DataFrame:
    return quality.duplicate_keys(read_table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


_NULLS = ["exo_mean", "exo_max", "exo_min", "exo_sum", "exo_high", "exo_low", "exo_count"]


@query(
    "dq_null_report",
    with_ctes(["exo"], " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS nulls, count(*) AS rows FROM exo" for c in _NULLS)),
)
def dq_null_report(spark: SparkSession, d: str) -> DataFrame:
    return quality.null_report(sample.exo_daily(spark, d), _NULLS)


@query(
    "dq_grid",
    with_ctes(["panel"], f"SELECT count(*) AS rows, CAST(count(DISTINCT zone) * {t.PERIOD.days} AS BIGINT) AS expected, count(*) FILTER (WHERE demand < 0) AS negative, count(*) = count(DISTINCT zone) * {t.PERIOD.days} AS complete FROM panel"),
)
def dq_grid(spark: SparkSession, d: str) -> DataFrame:
    return quality.grid_report(t.demand_panel(spark, d), t.PERIOD.days)


@query(
    "dq_split_order",
    with_ctes(["panel"], f"SELECT CASE WHEN date <= DATE '{TRAIN_END}' THEN 'train' WHEN date <= DATE '{VAL_END}' THEN 'val' ELSE 'test' END AS split, min(date) AS first_day, max(date) AS last_day, count(*) AS rows FROM panel GROUP BY 1"),
)
def dq_split_order(spark: SparkSession, d: str) -> DataFrame:
    return quality.split_ranges(t.demand_panel(spark, d), features.split_label(F.col("date"), t.PERIOD))


# A control beside each proof: features that are known to leak must be found.
_ROLLED = "avg(demand) OVER (PARTITION BY zone ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"


@query(
    "leak_lag",
    with_ctes(
        ["panel"],
        " UNION ALL ".join(
            f"SELECT zone, date, {k} AS lag, '{source}' AS source FROM (SELECT a.zone, a.date, a.shifted, b.demand AS past FROM "
            f"(SELECT zone, date, lag(demand, {k - less}) OVER (PARTITION BY zone ORDER BY date) AS shifted FROM panel) a "
            f"LEFT JOIN panel b ON a.zone = b.zone AND b.date = a.date - {k}) WHERE shifted IS DISTINCT FROM past"
            for k in t.PANEL.lags
            for source, less in (("features", 0), ("control", 1))
        ),
    ),
)
def leak_lag(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose lag is not the value so many days before; the control's lags are one day short."""
    table = stable(t.demand_panel(spark, d), "panel")
    w = features.by_day("zone")
    short = [F.lag("demand", k - 1).over(w).alias(f"short_{k}") for k in t.PANEL.lags]
    lagged = stable(table.select("*", *features.lags("demand", t.PANEL.lags, w, "demand_lag_"), *short), "lagged")
    wrong = [
        quality.wrong_lags(lagged, "zone", "demand", f"{prefix}{k}", k).select("zone", "date", F.lit(k).alias("lag"), F.lit(source).alias("source"))
        for k in t.PANEL.lags
        for source, prefix in (("features", "demand_lag_"), ("control", "short_"))
    ]
    return reduce(DataFrame.union, wrong)


@query(
    "leak_rolling",
    with_ctes(
        ["feats"],
        f"""SELECT zone, date, source FROM (SELECT a.zone, a.date, a.source, max(a.rolled) AS rolled, count(b.date) AS n, avg(b.demand) AS mean FROM
        (SELECT zone, date, demand_rolling_mean_7 AS rolled, 'features' AS source FROM feats UNION ALL
        SELECT zone, date, {_ROLLED} AS rolled, 'control' AS source FROM panel) a
        LEFT JOIN feats b ON a.zone = b.zone AND b.date BETWEEN a.date - 7 AND a.date - 1 GROUP BY a.zone, a.date, a.source)
        WHERE (n = 7) <> (rolled IS NOT NULL) OR (n = 7 AND abs(rolled - mean) > 1e-6)""",
    ),
)
def leak_rolling(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose rolling mean is not that of the seven days before; the control's mean sees today."""
    table = stable(t.demand_panel(spark, d), "panel")
    w = features.by_day("zone")
    today = F.avg("demand").over(w.rowsBetween(-6, 0)).alias("today_7")
    rolled = stable(table.select("*", *features.rolling_means("demand", (7,), w, "roll_"), today), "rolled")
    wrong = [
        quality.wrong_rolling(rolled, "zone", "demand", c, 7).select("zone", "date", F.lit(source).alias("source"))
        for source, c in (("features", "roll_7"), ("control", "today_7"))
    ]
    return wrong[0].union(wrong[1])


_FOLDS = SearchSettings().folds


@query(
    "leak_fold",
    with_ctes(
        ["series"],
        f"""SELECT target, CAST(f.range AS INTEGER) AS distorted, CAST(m.range AS INTEGER) AS fold, scaler FROM (SELECT DISTINCT target FROM series),
        range({_FOLDS}) f, range({_FOLDS}) m, (VALUES ('fold'), ('all_days')) v(scaler) WHERE scaler = 'all_days' OR f.range < m.range""",
    ),
)
def leak_fold(spark: SparkSession, d: str) -> DataFrame:
    """Which folds' models move when the test days of one fold are distorted.

    A fold trains on the days before its own, so the distortion of fold f may reach the
    models of later folds only. The control takes its scaler from all train days, and
    every model of it moves.
    """
    rows = stable(t.series_table(spark, d).dropna(), "clean")
    inputs = linear.distorted(rows.filter(t.is_train()), ["target"], [*t.ANOMALIES, "lag_y_1", "lag_y_7"], "y", _FOLDS)
    return linear.moved_fold_models(inputs, ["target"], [*BASELINE, *t.ANOMALIES, "lag_y_1", "lag_y_7"], "y", 10.0, _FOLDS)


@query("leak_fit", with_ctes(["series"], "SELECT date, target, 'all_days' AS fitted_on FROM series"))
def leak_fit(spark: SparkSession, d: str) -> DataFrame:
    """Days whose baseline moves when val and test values are distorted, by what the fit may see.

    Fits on train days must not move, so they give no row. Fits that see all days
    are the control: every day of theirs moves. All predict the same undistorted days.
    """
    series = stable(t.with_calendar(t.target_series(spark, d)), "series")
    distorted = series.withColumn("y", F.when(t.is_train(), F.col("y")).otherwise(F.col("y") * 10 + 500))
    moved = []
    for name, days in (("train", t.is_train()), ("all_days", F.lit(True))):
        parts = []
        for source in (series, distorted):
            models = linear.fit_ols(source, ["target"], {"y": BASELINE}, days)
            parts.append(series.join(models, "target").select("target", "date", linear.linear_value(BASELINE, "coef_y").alias("fit")))
        moved.append(quality.differing(parts[0], parts[1], ["date", "target"], ["fit"]).withColumn("fitted_on", F.lit(name)))
    return moved[0].union(moved[1])


@query("leak_climate", with_ctes(["exo"], "SELECT date, 'all_days' AS fitted_on FROM exo"))
def leak_climate(spark: SparkSession, d: str) -> DataFrame:
    """The same proof for the climate of the outside variables."""
    exo = stable(t.with_calendar(sample.exo_daily(spark, d).select("date", *t.EXO, F.lit(1).alias("g"))), "exo")
    distorted = exo.withColumns({v: F.when(t.is_train(), F.col(v)).otherwise(F.col(v) * 10 + 500) for v in t.EXO})
    moved = []
    for name, days in (("train", t.is_train()), ("all_days", F.lit(True))):
        parts = []
        for source in (exo, distorted):
            models = linear.fit_ols(source, ["g"], dict.fromkeys(t.EXO, harmonic_names()), days)
            fits = [linear.linear_value(harmonic_names(), f"coef_{v}").alias(v) for v in t.EXO]
            parts.append(exo.drop(*t.EXO).join(models, "g").select("date", *fits))
        moved.append(quality.differing(parts[0], parts[1], ["date"], t.EXO).withColumn("fitted_on", F.lit(name)))
    return moved[0].union(moved[1])


@query("dq_weight_sum", with_ctes(["cw"], "SELECT precinct, round(sum(weight), 6) + 0.0 AS total, abs(sum(weight) - 1) < 1e-9 AS ok FROM cw GROUP BY 1"))
def dq_weight_sum(spark: SparkSession, d: str) -> DataFrame:
    return t.rounded(quality.weight_sums(t.crosswalk(spark, d)))


@query("stream_daily_counts", "SELECT CAST(l_shipdate AS DATE) AS date, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2")
def stream_daily_counts(spark: SparkSession, d: str) -> DataFrame:
    """Lines dropped in two portions; the second run reads only the new files."""
    lines = read_table(spark, d, "lineitem").select("l_shipdate", "l_suppkey", "l_orderkey")
    root = scratch(spark, "stream")
    first = F.col("l_orderkey") % 4 != 0
    run = lambda: update_counts(
        spark, f"{root}/drop", lines.schema, f"{root}/table", f"{root}/state", ["date", "l_suppkey"],
        lambda df: df.select(F.to_date("l_shipdate").alias("date"), "l_suppkey"),
    )
    write_parquet(lines.filter(first), f"{root}/drop/part=1")
    run()
    write_parquet(lines.filter(~first), f"{root}/drop/part=2")
    return run()

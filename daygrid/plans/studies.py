"""The studies end to end, on raw input tables of any size.

Each function takes DataFrames as they come from the readers and returns
DataFrames; the caller writes them with the sinks. Raw rows are reduced to
daily counts in the first aggregation; everything after works on days.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daygrid.config import (
    PANEL_BOOSTED,
    PANEL_RIDGE_ALPHA,
    SERIES_BOOSTED,
    SERIES_FOREST,
    SERIES_RIDGE_ALPHA,
    PanelSettings,
    Period,
    SearchSettings,
    SeriesSettings,
    TimeWindows,
)
from daygrid.functions.calendar import day_of, calendar_block, calendar_names, date_spine, day_range, harmonic_names
from daygrid.functions.stats import safe_corr
from daygrid.operators import bootstrap, counts, events, features, grid, linear, metrics, quality, segments, splits, trees
from daygrid.session import stable
from daygrid.sources.readers import require_columns, union_all

USER_TYPES = ("member", "casual")


@dataclass(frozen=True)
class Panel:
    """Feature table of the zone panel and its conditions."""

    table: DataFrame
    conditions: dict[str, list[str]]
    zones: list[int]


def zone_panel(
    trips: DataFrame,
    weather: DataFrame,
    permits: DataFrame,
    weights: DataFrame,
    settings: PanelSettings,
    zones: DataFrame | None = None,
) -> Panel:
    """Trips (pickup_ts, zone) to the feature table of the busiest zones.

    ``zones`` limits the candidates, e.g. to one borough. ``weather`` has one row
    per day, ``permits`` (event_id, day, police_precinct) and ``weights``
    (precinct, LocationID, weight) give the event columns.
    """
    period = settings.period
    require_columns(trips, ["pickup_ts", "zone"])
    quality.require_one_to_one(weather, ["date"], "weather")
    daily = trips.select(day_of("pickup_ts").alias("date"), F.col("zone").cast("int").alias("zone"))
    daily = daily.filter(day_range(F.col("date"), period)).groupBy("date", "zone").agg(F.count(F.lit(1)).cast("double").alias("demand"))
    if zones is not None:
        daily = daily.join(zones.select(F.col("zone").cast("int").alias("zone")).distinct(), "zone", "left_semi")
    daily = quality.require_rows(stable(daily, "demand"), "demand")
    top = counts.top_keys(daily, "zone", "demand", period.train_end, settings.top_n, settings.exclude)
    # At most top_n zone ids; they become column names of the indicators.
    ids = sorted(r.zone for r in top.collect())
    frame = daily.sparkSession.createDataFrame([(z,) for z in ids], "zone int")
    panel = grid.fill_grid(grid.complete_grid(frame, period), daily, ["date", "zone"], "demand")
    inside = stable(permits.filter(day_range(F.col("day"), period)), "permits")
    merged = grid.join_daily(panel, weather, period)
    merged = grid.join_daily(merged, events.city_events(inside), period).fillna(0, subset=["event_count"])
    mass = events.zone_event_mass(inside, weights, "event_count_zone")
    merged = events.with_daily_total(grid.join_zone_events(merged, mass), "event_count_zone", "event_count_manhattan")
    table = stable(features.panel_features(merged, settings), "panel")
    exo = [c for c in weather.columns if c != "date"]
    quality.require_no_nulls(table, exo)
    conditions = features.panel_conditions(table.columns, exo)
    features.check_nested(conditions)
    quality.require_split_order(table, features.split_label(F.col("date"), period))
    return Panel(table, conditions, ids)


def panel_scores(panel: Panel, settings: PanelSettings, search: SearchSettings = SearchSettings()) -> DataFrame:
    """Seasonal-naive and ridge rows of the ablation table, one per condition, zone-mean scores."""
    period = settings.period
    split = features.split_label(F.col("date"), period)
    indicators = [c.alias(f"zone_{z}") for z, c in zip(panel.zones[1:], features.zone_indicators(panel.zones))]
    rows = stable(panel.table.dropna().select("*", *indicators, split.alias("split"), F.lit(1).alias("g")), "rows")
    names = [f"zone_{z}" for z in panel.zones[1:]]
    conditions = {n: [*cols, *names] for n, cols in panel.conditions.items()}
    train = F.col("date") <= F.lit(period.train_end)
    held = rows.filter(~train)
    models = linear.search_ridge(rows, ["g"], conditions, "demand", train, search, PANEL_RIDGE_ALPHA)
    keep = ["condition", "model", "zone", "split", "demand", "pred"]
    ridge = linear.predict(held, models, ["g"], conditions).withColumn("model", F.lit("Ridge")).select(*keep)
    each = F.explode(F.array(*(F.lit(n) for n in conditions))).alias("condition")
    naive = held.select(each, F.lit("SeasonalNaive").alias("model"), "zone", "split", "demand", F.col("demand_lag_7").alias("pred"))
    return metrics.score_zone_mean(ridge.unionByName(naive), ["condition", "model"], "demand", "pred")


def panel_tree_scores(panel: Panel, settings: PanelSettings, search: SearchSettings = SearchSettings(), ledger: str | None = None) -> DataFrame:
    """Boosted-tree rows of the ablation table, one per condition, zone-mean scores; ``ledger`` lets a lost run go on."""
    period = settings.period
    split = features.split_label(F.col("date"), period)
    names = [f"zone_{z}" for z in panel.zones[1:]]
    indicators = [c.alias(n) for n, c in zip(names, features.zone_indicators(panel.zones))]
    rows = panel.table.dropna().select("*", *indicators, split.alias("split"))
    train = F.col("date") <= F.lit(period.train_end)
    searches = [trees.Search(n, (*cols, *names)) for n, cols in panel.conditions.items()]
    pred = trees.search_trees(rows, searches, [], "demand", train, trees.boosted, trees.boosted_draw, PANEL_BOOSTED, search, ledger, 3)
    kept = pred.filter(~train).select(F.col("search").alias("condition"), F.lit("Boosted").alias("model"), "zone", "split", "demand", "pred")
    return metrics.score_zone_mean(kept, ["condition", "model"], "demand", "pred")


def series_tree_scores(study: SeriesStudy, settings: SeriesSettings, search: SearchSettings = SearchSettings(), ledger: str | None = None) -> DataFrame:
    """Random-forest and boosted-tree rows for every target and condition; ``ledger`` lets a lost run go on."""
    train = F.col("date") <= F.lit(settings.period.train_end)
    conditions = features.series_conditions(study.features.columns)
    families = (("RandomForest", trees.forest, trees.forest_draw, SERIES_FOREST), ("Boosted", trees.boosted, trees.boosted_draw, SERIES_BOOSTED))
    targets = [r.target for r in study.features.select("target").distinct().orderBy("target").collect()]
    searches = [trees.Search(f"{y}:{c}", tuple(cols), f"target = '{y}'") for y in targets for c, cols in conditions.items()]
    parts = []
    for model, build, draw, space in families:
        pred = trees.search_trees(study.features, searches, ["target"], "y", train, build, draw, space, search, ledger, 3)
        label = F.element_at(F.split("search", ":"), -1)
        parts.append(pred.filter(~train).select("target", label.alias("condition"), F.lit(model).alias("model"), "split", "y", "pred"))
    return metrics.score_splits(union_all(parts), ["target", "condition", "model"], "y", "pred")


def type_series(trips: DataFrame, period: Period) -> DataFrame:
    """Trips (started_at, member_casual) to (date, member, casual, total). A day without trips is an error."""
    require_columns(trips, ["started_at", "member_casual"])
    daily = trips.select(day_of("started_at").alias("date"), "member_casual").filter(day_range(F.col("date"), period))
    wide = stable(counts.pivot_types(counts.count_rows(daily, ["date", "member_casual"]), USER_TYPES), "daily")
    return grid.require_no_missing_days(date_spine(trips.sparkSession, period.start, period.end), wide)


def _joined(daily: DataFrame, weather: DataFrame, period: Period) -> DataFrame:
    exo = [c for c in weather.columns if c != "date"]
    quality.require_one_to_one(weather, ["date"], "weather")
    merged = grid.join_daily(daily, weather, period)
    merged = stable(merged.select("*", *calendar_block(F.col("date"), period.start)), "merged")
    return quality.require_no_nulls(merged, exo)


def _residualized(df: DataFrame, keys: list[str], y: str, exo: Sequence[str], train: Column, order: int) -> DataFrame:
    specs = {"y": calendar_names(order, holiday=False), **dict.fromkeys(exo, harmonic_names(order))}
    names = {"y": "resid", **{v: f"anom_{v}" for v in exo}}
    return stable(linear.residuals(df.withColumn("y", F.col(y).cast("double")), keys, specs, train, names), "residuals")


@dataclass(frozen=True)
class SeriesStudy:
    features: DataFrame
    scores: DataFrame
    coefficients: DataFrame
    correlations: DataFrame
    shocks: DataFrame


def series_study(
    daily: DataFrame,
    weather: DataFrame,
    settings: SeriesSettings,
    shock_variable: str,
    targets: Sequence[str] = ("total", "member", "casual"),
    search: SearchSettings = SearchSettings(),
) -> SeriesStudy:
    """Daily target columns to features, ablation scores, coefficients, residual correlations and shock errors."""
    period = settings.period
    train = F.col("date") <= F.lit(period.train_end)
    exo = [c for c in weather.columns if c != "date"]
    long = daily.select("date", *(F.col(t).cast("double").alias(t) for t in targets)).unpivot("date", list(targets), "target", "y")
    rows = _residualized(_joined(long, weather, period), ["target"], "y", exo, train, settings.harmonics)
    table = rows.drop("resid", *exo).select("*", *features.series_lag_columns(settings, "target"))
    clean = stable(table.dropna().withColumn("split", features.split_label(F.col("date"), period)), "features")
    conditions = features.series_conditions(clean.columns)
    base_names = calendar_names(settings.harmonics, holiday=False)
    fitted = stable(linear.residuals(clean, ["target"], {"y": base_names}, train, {"y": "resid"}), "baseline")

    models = linear.search_ridge(clean, ["target"], conditions, "y", train, search, SERIES_RIDGE_ALPHA)
    pred = linear.predict(clean.filter(~train), models, ["target"], conditions).withColumn("model", F.lit("Linear"))
    cols = ["target", "condition", "model", "split", "y", "pred"]
    base = fitted.filter(~train).select(
        "target", F.lit("BASE").alias("condition"), F.lit("Baseline").alias("model"), "split", "y", (F.col("y") - F.col("resid")).alias("pred")
    )
    scores = metrics.score_splits(pred.select(*cols).unionByName(base), ["target", "condition", "model"], "y", "pred")

    loo = linear.fit_ridge_loo(clean, ["target"], {c: conditions[c] for c in ("C", "D")}, "y", train)
    only_d = linear.standardized_coefficients(loo, ["target"], {c: conditions[c] for c in ("C", "D")}).filter("condition = 'D'")
    anoms = [f"anom_{v}" for v in exo]
    corr = metrics.correlations(fitted, ["target"], "resid", {a: a for a in anoms}).unpivot("target", anoms, "anomaly", "corr_with_residual")

    test = clean.filter(F.col("date") > F.lit(period.val_end))
    flagged = features.shock_days(test, f"anom_{shock_variable}", settings.shock_quantile, ["target"])
    held = linear.predict(flagged, loo, ["target"], {c: conditions[c] for c in ("C", "D")})
    err = F.abs(F.col("y") - F.col("pred"))
    shocks = held.groupBy("target", "condition").agg(
        F.avg(err).alias("mae_all"), F.avg(F.when(F.col("is_shock"), err)).alias("mae_shock"), F.count_if("is_shock").alias("n_shock")
    )
    return SeriesStudy(clean, scores, only_d, corr, shocks)


def trip_segments(trips: DataFrame, period: Period, windows: TimeWindows = TimeWindows()) -> DataFrame:
    """Trips (started_at, member_casual, start_station_id, end_station_id) to (date, segment, n)."""
    require_columns(trips, ["started_at", "member_casual", "start_station_id", "end_station_id"])
    trips = trips.withColumn("started_at", F.col("started_at").try_cast("timestamp"))
    dated = trips.withColumn("date", day_of("started_at")).filter(day_range(F.col("date"), period))
    return segments.count_segments(dated, segments.trip_rules(segments.time_slot(F.col("started_at"), windows)))


def hourly_segments(hourly: DataFrame, period: Period, windows: TimeWindows = TimeWindows()) -> DataFrame:
    """Hourly sums (transit_timestamp, ridership) to (date, segment, n)."""
    require_columns(hourly, ["transit_timestamp", "ridership"])
    hourly = hourly.withColumn("transit_timestamp", F.col("transit_timestamp").try_cast("timestamp"))
    inside = hourly.filter(day_range(F.to_date("transit_timestamp"), period))
    return segments.sum_segments(inside, "transit_timestamp", "ridership", windows)


@dataclass(frozen=True)
class SegmentStudy:
    residuals: DataFrame
    sensitivity: DataFrame


def segment_study(segs: DataFrame, weather: DataFrame, settings: SeriesSettings) -> SegmentStudy:
    """Sensitivity row of every segment: residual correlations with each anomaly and test R2 without and with them."""
    period = settings.period
    train = F.col("date") <= F.lit(period.train_end)
    exo = [c for c in weather.columns if c != "date"]
    rows = _residualized(_joined(segs, weather, period), ["segment"], "n", exo, train, settings.harmonics)
    corr = rows.groupBy("segment").agg(
        F.count(F.lit(1)).alias("n_days"),
        F.floor(F.avg("y")).alias("mean_per_day"),
        *(safe_corr(F.col("resid"), F.col(f"anom_{v}")).alias(f"corr_{v}") for v in exo),
    )
    cal = calendar_names(settings.harmonics)
    conditions = {"A": cal, "B": [*cal, *(f"anom_{v}" for v in exo)]}
    models = linear.fit_ridge_loo(rows, ["segment"], conditions, "y", train)
    pred = linear.predict(rows.filter(F.col("date") > F.lit(period.val_end)), models, ["segment"], conditions)
    r2 = metrics.score(pred, ["segment", "condition"], "y", "pred")
    wide = r2.groupBy("segment").agg(*(F.max(F.when(F.col("condition") == c, F.col("r2"))).alias(f"r2{c}_test") for c in ("A", "B")))
    wide = wide.withColumn("delta_r2", F.col("r2B_test") - F.col("r2A_test"))
    return SegmentStudy(rows, corr.join(wide, "segment", "left"))


@dataclass(frozen=True)
class ContrastStudy:
    residuals: DataFrame
    contrast: DataFrame
    coefficients: DataFrame


def contrast_study(series: DataFrame, weather: DataFrame, bounds: DataFrame, settings: SeriesSettings, named: dict[str, str]) -> ContrastStudy:
    """One method on several systems, each with the period and split that ``bounds`` gives it.

    ``series`` is (series, date, y) and ``bounds`` (system, series, first_day, last_day, train_end,
    val_end), so that one series can be studied in several periods. Per system: residual
    correlations with each anomaly, test R2 without and with them, the largest standardised
    coefficient of each feature group and those of ``named`` (name to feature).
    """
    exo = [c for c in weather.columns if c != "date"]
    quality.require_one_to_one(weather, ["date"], "weather")
    rows = splits.within_boundaries(series, bounds, ["series"], ["system"]).join(weather, "date", "left")
    merged = stable(rows.select("*", *calendar_block(F.col("date"), settings.period.start)), "systems")
    quality.require_no_nulls(merged, exo)
    res = _residualized(merged, ["system"], "y", exo, splits.in_train(), settings.harmonics)
    corr = res.groupBy("system").agg(F.count(F.lit(1)).alias("n_days"), *(safe_corr(F.col("resid"), F.col(f"anom_{v}")).alias(f"corr_{v}") for v in exo))
    anoms = [f"anom_{v}" for v in exo]
    cal = calendar_names(settings.harmonics)
    nested = {"A": cal, "B": [*cal, *anoms]}
    models = linear.fit_ridge_loo(res, ["system"], nested, "y", splits.in_train())
    pred = linear.predict(res.filter(splits.in_test()), models, ["system"], nested)
    r2 = metrics.score(pred, ["system", "condition"], "y", "pred")
    wide = r2.groupBy("system").agg(*(F.max(F.when(F.col("condition") == c, F.col("r2"))).alias(f"r2{c}_test") for c in nested))
    wide = wide.withColumn("delta_r2", F.col("r2B_test") - F.col("r2A_test"))
    lagged = stable(res.select("*", *features.series_lag_columns(settings, "system")).dropna(), "lagged")
    lags = [*(f"lag_y_{k}" for k in settings.lags), *(f"lag_roll_mean_{k}" for k in settings.rolling)]
    full = {"D": [*cal, *anoms, *lags]}
    coefs = linear.standardized_coefficients(linear.fit_ridge_loo(lagged, ["system"], full, "y", splits.in_train()), ["system"], full)
    return ContrastStudy(res, corr.join(wide, "system", "left"), metrics.coefficient_summary(coefs, ["system"], named))


def study_cells(residuals: DataFrame, name: str, variable: str) -> DataFrame:
    """(cell, date, x, y): anomaly of ``variable`` and residual, one cell for each value of the column ``name``."""
    cells = residuals.select(F.col(name).cast("string").alias("cell"), "date", F.col(f"anom_{variable}").alias("x"), F.col("resid").alias("y"))
    return stable(cells, "cells")


def two_mode_cells(first: SegmentStudy, second: SegmentStudy, variable: str, modes: tuple[str, str]) -> DataFrame:
    """(mode, segment, cell, date, x, y) of the commute and leisure cells of two modes, written once."""
    parts = []
    for study, mode in zip((first, second), modes):
        kept = study.residuals.filter(F.col("segment").isin(segments.COMMUTE, segments.LEISURE))
        label = F.when(F.col("segment") == segments.COMMUTE, "commute").otherwise("leisure")
        parts.append(
            kept.select(
                F.lit(mode).alias("mode"), "segment", F.concat_ws("-", F.lit(mode), label).alias("cell"),
                "date", F.col(f"anom_{variable}").alias("x"), F.col("resid").alias("y"),
            )
        )
    return stable(parts[0].unionByName(parts[1]), "cells")


def cell_report(cells: DataFrame, seed: int = 42, reps: int = 5000, block: int = 14) -> DataFrame:
    """W, interval, n and effective n per cell."""
    ci = bootstrap.corr_interval(cells, ["cell"], "x", "y", F.lit(seed), reps, block)
    return ci.join(bootstrap.effective_size(cells, ["cell"], "y").select("cell", "n_eff"), "cell")


def paired_report(cells: DataFrame, pairs: Sequence[tuple[str, str, str]], seed: int = 42, reps: int = 5000, block: int = 14) -> DataFrame:
    """(test, diff, interval) of ``a - b`` for cells of the same days, both taken on the same resampled days."""
    wanted = cells.sparkSession.createDataFrame([tuple(p) for p in pairs], "test string, a string, b string")
    first = cells.select(F.col("cell").alias("a"), "date", "x", F.col("y").alias("ya"))
    second = cells.select(F.col("cell").alias("b"), "date", F.col("y").alias("yb"))
    both = F.broadcast(wanted).join(first, "a").join(second, ["b", "date"]).select("test", "date", "x", "ya", "yb")
    return bootstrap.paired_corr_difference(stable(both, "pairs"), ["test"], "x", "ya", "yb", F.lit(seed), reps, block)


def difference_report(cells: DataFrame, pairs: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Fisher-z tests of ``a - b`` for cells without common days, with effective sample sizes."""
    w = bootstrap.corr_points(cells, ["cell"], "x", ["y"]).withColumnRenamed("r_y", "w")
    table = stable(w.join(bootstrap.effective_size(cells, ["cell"], "y").select("cell", "n_eff"), "cell"), "cell_sizes")
    return bootstrap.compare_cells(table, pairs, "cell", "w", "n_eff")


def effect_report(cells: DataFrame, pairs: Sequence[tuple[str, str, str]], seeds: dict[str, int], reps: int = 5000, block: int = 14) -> DataFrame:
    """Effects ``a - b`` with intervals: replicates of independent cells, each with its own seed, subtracted by index."""
    seed = F.create_map(*(F.lit(v) for kv in seeds.items() for v in kv))[F.col("cell")]
    boots = stable(bootstrap.corr_replicates(cells, ["cell"], "x", ["y"], seed, reps, block), "replicates")
    return bootstrap.replicate_effects(boots, pairs, "cell", "r_y")


def effect_pairs(modes: tuple[str, str]) -> list[tuple[str, str, str]]:
    a, b = modes
    return [
        (f"column {a}", f"{a}-leisure", f"{a}-commute"),
        (f"column {b}", f"{b}-leisure", f"{b}-commute"),
        ("row commute", f"{b}-commute", f"{a}-commute"),
        ("row leisure", f"{b}-leisure", f"{a}-leisure"),
    ]

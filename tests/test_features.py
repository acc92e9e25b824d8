from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from daygrid.config import PanelSettings, Period, TimeWindows
from daygrid.operators import counts, events, features, grid, metrics, segments


def days(n, start=date(2022, 1, 1)):
    return [start + timedelta(d) for d in range(n)]


@pytest.fixture
def panel(spark):
    rows = [(d, z, float(100 + i + 10 * z)) for i, d in enumerate(days(60)) for z in (1, 2, 3)]
    return spark.createDataFrame(rows, "date date, zone int, demand double")


def test_panel_features_values(panel):
    period = Period(date(2022, 1, 1), date(2022, 3, 1), date(2022, 1, 31), date(2022, 2, 10))
    rows = {(r.date, r.zone): r for r in features.panel_features(panel, PanelSettings(period)).collect()}
    first = days(60)
    assert rows[first[6], 2].demand_rolling_mean_7 is None
    assert rows[first[7], 2].demand_rolling_mean_7 == pytest.approx(123.0)  # days 0..6, today left out
    assert rows[first[6], 2].demand_lag_7 is None
    assert rows[first[7], 2].demand_lag_7 == 120.0
    assert rows[first[14], 3].demand_lag_14 == 130.0
    assert rows[date(2022, 1, 1), 1].is_weekend == 1 and rows[date(2022, 1, 1), 1].is_holiday == 1


def test_split_labels(spark):
    period = Period(date(2022, 1, 1), date(2022, 1, 9), date(2022, 1, 3), date(2022, 1, 6))
    df = spark.createDataFrame([(d,) for d in days(9)], "date date")
    got = [r.s for r in df.select(features.split_label(F.col("date"), period).alias("s")).collect()]
    assert got == ["train"] * 3 + ["val"] * 3 + ["test"] * 3


def test_period_rejects_unordered_splits():
    with pytest.raises(ValueError):
        Period(date(2022, 1, 1), date(2022, 1, 9), date(2022, 1, 7), date(2022, 1, 6))


def test_forward_folds_of_eleven_days(spark):
    df = spark.createDataFrame([(d, z) for d in days(11) for z in (1, 2)], "date date, zone int")
    rows = features.date_blocks(df, 5).collect()
    test = {r.fold: r.date for r in rows if r.role == "test"}
    assert [test[f] for f in range(5)] == days(11)[6:]
    assert sum(r.role == "train" for r in rows if r.fold == 0) == 6
    for f in range(5):
        assert max(r.date for r in rows if r.fold == f and r.role == "train") < test[f]


def test_zone_indicators_drop_the_first_and_zero_the_unknown(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (9,)], "zone int")
    got = [tuple(r) for r in df.select(*features.zone_indicators([3, 1, 2])).collect()]
    assert got == [(0.0, 0.0), (1.0, 0.0), (0.0, 1.0), (0.0, 0.0)]


def test_standardize_uses_train_population_deviation(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0), (1, 3.0, 5.0), (0, 9.0, 6.0)], "tr int, x double, c double")
    rows = features.standardize(df, ["x", "c"], F.col("tr") == 1).orderBy("x").collect()
    assert [r.x for r in rows] == [-1.0, 1.0, 7.0]
    assert [r.c for r in rows] == [0.0, 0.0, 1.0]


def test_top_keys_break_ties_by_key_and_respect_exclusion(spark):
    rows = [(date(2022, 1, 1), z, v) for z, v in ((5, 9.0), (4, 9.0), (3, 50.0), (2, 1.0))] + [(date(2022, 2, 1), 2, 500.0)]
    df = spark.createDataFrame(rows, "date date, zone int, demand double")
    got = counts.top_keys(df, "zone", "demand", date(2022, 1, 31), 2, (3,)).collect()
    assert [r.zone for r in got] == [4, 5]


def test_shock_days_first_row_is_none(spark):
    df = spark.createDataFrame([("a", d, float(v)) for d, v in zip(days(5), (50, 0, 1, 1, 30))], "k string, date date, v double")
    rows = features.shock_days(df, "v", 0.75, ["k"]).orderBy("date").collect()
    assert [r.is_shock for r in rows] == [False, True, False, False, False] or rows[0].change is None
    assert rows[0].change is None and not rows[0].is_shock
    assert rows[1].is_shock


def test_grid_fills_zero_and_joins_keys_of_other_types(spark):
    period = Period(date(2022, 1, 1), date(2022, 1, 4), date(2022, 1, 2), date(2022, 1, 3))
    zones = spark.createDataFrame([(1,), (2,), (2,)], "zone int")
    facts = spark.createDataFrame([(date(2022, 1, 2), 1, 7.0)], "date date, zone int, demand double")
    full = grid.fill_grid(grid.complete_grid(zones, period), facts, ["date", "zone"], "demand")
    assert full.count() == 8 and full.agg(F.sum("demand")).first()[0] == 7.0
    ev = spark.createDataFrame([(date(2022, 1, 2), 1, 0.5)], "date date, zone long, event_count_zone double")
    joined = grid.join_zone_events(full, ev)
    assert joined.agg(F.sum("event_count_zone")).first()[0] == 0.5
    assert joined.filter("event_count_zone is null").isEmpty()


def test_gaps_raise(spark):
    spine = spark.createDataFrame([(d,) for d in days(3)], "date date")
    df = spark.createDataFrame([(days(3)[0],), (days(3)[2],)], "date date")
    with pytest.raises(ValueError, match="2022-01-02"):
        grid.require_no_missing_days(spine, df)


def test_one_trip_feeds_all_of_its_segments(spark):
    rows = [
        (date(2022, 1, 3), "member", "1", "1", 8),
        (date(2022, 1, 3), "casual", "1", "2", 12),
        (date(2022, 1, 8), "casual", None, None, 12),
    ]
    df = spark.createDataFrame(rows, "date date, member_casual string, start_station_id string, end_station_id string, hour int")
    slot = segments.slot_at(F.weekday("date"), F.col("hour"), TimeWindows())
    got = {(r.date.day, r.segment): r.n for r in segments.count_segments(df, segments.trip_rules(slot)).collect()}
    assert got == {
        (3, "all"): 2, (3, "rt_round"): 1, (3, "rt_point"): 1, (3, "user_member"): 1, (3, "user_casual"): 1, (3, "time_wdAM"): 1,
        (8, "all"): 1, (8, "rt_point"): 1, (8, "user_casual"): 1, (8, "time_weMID"): 1,
    }


def test_event_in_two_precincts_counts_fully_in_both(spark):
    areas = spark.createDataFrame([(6, 1, 3.0), (6, 2, 1.0), (9, 2, 5.0), (9, 3, 1e-6)], "precinct int, LocationID int, area double")
    weights = events.area_weights(areas)
    assert {(r.precinct, r.LocationID): r.weight for r in weights.collect()} == {(6, 1): 0.75, (6, 2): 0.25, (9, 2): 1.0}
    rows = [(1, date(2022, 1, 1), "6,9,"), (1, date(2022, 1, 1), "6,9,"), (2, date(2022, 1, 2), "77,")]
    ev = spark.createDataFrame(rows, "event_id int, day date, police_precinct string")
    mass = {(r.date.day, r.zone): r.event_count for r in events.zone_event_mass(ev, weights).collect()}
    assert mass == {(1, 1): 0.75, (1, 2): 1.25}
    assert [tuple(r) for r in events.city_events(ev).orderBy("date").collect()] == [(date(2022, 1, 1), 1), (date(2022, 1, 2), 1)]


def test_conditions_and_nesting():
    cols = ["date", "zone", "demand", "lag", "rain", "event_count", "event_count_zone"]
    got = features.panel_conditions(cols, ["rain"])
    assert got == {"A": ["lag"], "B": ["lag", "rain"], "C": ["lag", "event_count"], "D": ["lag", "rain", "event_count"], "E": ["lag", "event_count_zone"]}
    features.check_nested(got)
    with pytest.raises(ValueError):
        features.check_nested({"A": ["x"], "B": ["y"]})
    assert features.series_conditions(["cal_a", "anom_b", "lag_c"])["D"] == ["cal_a", "anom_b", "lag_c"]


def test_zone_mean_is_unweighted(spark):
    rows = [(1, "test", 1.0, 2.0)] + [(2, "test", 1.0, 4.0)] * 3 + [(1, "val", 1.0, 1.0), (2, "val", 1.0, 1.0)]
    df = spark.createDataFrame(rows, "zone int, split string, y double, p double").withColumn("m", F.lit("x"))
    got = metrics.score_zone_mean(df, ["m"], "y", "p").first()
    assert got.test_mae == 2.0 and got.val_r2 == 1.0 and got.test_r2 == 0.0


def test_effects_and_verdicts(spark):
    cells = [("a", "time_wdAM", -0.4), ("a", "time_weMID", -0.6), ("b", "time_wdAM", 0.1), ("b", "time_weMID", -0.5)]
    df = spark.createDataFrame(cells, "mode string, segment string, w double")
    e = metrics.effects(metrics.mode_table(df, "w"), ("a", "b")).first()
    assert (e.column_a, e.column_b, e.row_commute) == (pytest.approx(-0.2), pytest.approx(-0.6), pytest.approx(0.5))
    assert e.same_direction and not e.row_exceeds_column
    w = [("rt_round", -0.1), ("rt_point", -0.3), ("time_weMID", -0.6), ("time_wdAM", -0.4), ("user_casual", -0.5), ("user_member", -0.6)]
    v = metrics.axis_verdicts(spark.createDataFrame(w, "segment string, w double"), "w")
    assert {r.axis: r.verdict for r in v.collect()} == {"roundtrip": "against", "time": "support", "user": "against"}
    assert metrics.overall_verdict(v).first().overall == "mixed"

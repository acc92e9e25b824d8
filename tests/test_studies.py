"""The studies on raw files of the real input shapes: CSV trips, JSON weather and permits."""

import json
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from daygrid.config import PanelSettings, Period, SearchSettings, SeriesSettings, TimeWindows
from daygrid.functions.calendar import day_of_text
from daygrid.operators import splits
from daygrid.operators.events import area_weights
from daygrid.operators.segments import sum_segments
from daygrid.plans import studies
from daygrid.sources import readers

PERIOD = Period(date(2022, 1, 1), date(2022, 12, 31), date(2022, 9, 30), date(2022, 11, 15))
DAYS = [date(2022, 1, 1) + timedelta(i) for i in range(365)]
SEARCH = SearchSettings(draws=3, folds=3)
WEATHER_VARS = ["rain", "warmth"]


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    root = tmp_path_factory.mktemp("raw")
    rng = np.random.default_rng(5)
    rain = np.clip(rng.gamma(0.5, 3, 365) - 1, 0, None)
    warmth = 10 * np.sin(2 * np.pi * np.arange(365) / 365) + rng.normal(0, 3, 365)
    (root / "weather.json").write_text(json.dumps({"daily": {"time": [d.isoformat() for d in DAYS], "rain": rain.tolist(), "warmth": warmth.tolist()}}))
    lines, permits = ["started_at,member_casual,start_station_id,end_station_id,zone"], []
    for i, d in enumerate(DAYS):
        for _ in range(int(max(18 - 1.5 * rain[i] + rng.normal(0, 2), 6))):
            ts = datetime(d.year, d.month, d.day) + timedelta(minutes=int(rng.integers(0, 1440)))
            a, b = rng.integers(0, 4, 2)
            end = "" if rng.random() < 0.05 else str(b)
            lines.append(f"{ts},{'member' if rng.random() < 0.7 else 'casual'},{a},{end},{rng.integers(1, 6)}")
        for k in range(int(rng.integers(0, 3))):
            permits.append({"event_id": str(i * 10 + k), "start_date_time": f"{d}T10:00:00.000", "police_precinct": "1, 2," if k else "1,"})
    lines.append("broken,member,1,1,1")
    (root / "trips.csv").write_text("\n".join(lines) + "\n")
    (root / "permits.json").write_text(json.dumps(permits))
    return root


@pytest.fixture(scope="module")
def trips(spark, files):
    schema = "started_at string, member_casual string, start_station_id string, end_station_id string, zone int"
    raw = readers.read_csv(spark, str(files / "trips.csv"), schema)
    return raw.withColumn("started_at", F.try_to_timestamp(F.col("started_at"))).dropna(subset=["started_at"]).cache()


@pytest.fixture(scope="module")
def weather(spark, files):
    return readers.read_columnar_json(spark, str(files / "weather.json"), WEATHER_VARS).cache()


def test_zone_panel_to_scores(spark, files, trips, weather, tmp_path):
    raw = readers.read_json_records(spark, str(files / "permits.json"), ["event_id", "start_date_time", "police_precinct"])
    permits = raw.select("event_id", day_of_text("start_date_time").alias("day"), "police_precinct")
    areas = spark.createDataFrame([(1, 1, 2.0), (1, 2, 2.0), (2, 3, 1.0)], "precinct int, LocationID int, area double")
    readers.write_parquet(area_weights(areas), str(tmp_path / "weights"))
    settings = PanelSettings(PERIOD, top_n=3, exclude=(5,))
    panel = studies.zone_panel(
        trips.withColumnRenamed("started_at", "pickup_ts"), weather, permits, spark.read.parquet(str(tmp_path / "weights")), settings
    )
    assert panel.table.count() == 3 * 365 and len(panel.zones) == 3 and 5 not in panel.zones
    assert list(panel.conditions) == ["A", "B", "C", "Cprime", "D", "E"]
    total = permits.select("event_id").distinct().count()
    assert panel.table.filter(F.col("zone") == panel.zones[0]).agg(F.sum("event_count")).first()[0] == total
    scores = studies.panel_scores(panel, settings, SEARCH)
    rows = {(r.condition, r.model): r for r in scores.collect()}
    assert len(rows) == 12
    assert len({round(rows[c, "SeasonalNaive"].test_mae, 9) for c in panel.conditions}) == 1
    readers.write_result_csv(scores.orderBy("condition", "model"), str(tmp_path / "csv"), ["condition", "model", "test_mae"])
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 12


def test_series_study(trips, weather):
    daily = studies.type_series(trips, PERIOD)
    assert daily.agg(F.sum("total")).first()[0] == trips.count()
    study = studies.series_study(daily, weather, SeriesSettings(PERIOD), "rain", search=SEARCH)
    scores = {(r.target, r.condition): r for r in study.scores.collect()}
    assert len(scores) == 15
    assert scores["total", "B"].test_mae < scores["total", "A"].test_mae  # rain drives the fixture
    corr = {(r.target, r.anomaly): r.corr_with_residual for r in study.correlations.collect()}
    assert corr["total", "anom_rain"] < -0.5 < corr["total", "anom_warmth"]
    assert study.coefficients.filter("target = 'total'").count() == 14 + 2 + 4
    shock = {(r.target, r.condition): r for r in study.shocks.collect()}
    assert shock["total", "D"].n_shock == shock["total", "C"].n_shock > 0
    assert shock["total", "D"].mae_shock < shock["total", "C"].mae_shock


def test_missing_day_is_an_error(trips):
    with pytest.raises(ValueError, match="2022-03-04"):
        studies.type_series(trips.filter("to_date(started_at) <> DATE'2022-03-04'"), PERIOD)


def test_weather_gaps_are_an_error(trips, weather):
    with pytest.raises(ValueError, match="rain"):
        studies.segment_study(studies.trip_segments(trips, PERIOD), weather.filter("date <> DATE'2022-02-02'"), SeriesSettings(PERIOD))


def test_segment_and_two_mode_studies(spark, trips, weather):
    settings = SeriesSettings(PERIOD)
    first = studies.segment_study(studies.trip_segments(trips, PERIOD), weather, settings)
    sens = {r.segment: r for r in first.sensitivity.collect()}
    assert set(sens) == {"all", "rt_round", "rt_point", "user_member", "user_casual", "time_wdAM", "time_weMID"}

    # The same numbers by a direct least-squares fit.
    pdf = first.residuals.filter("segment = 'all'").orderBy("date").toPandas()
    doy = np.array([d.timetuple().tm_yday for d in pdf.date])
    har = [f(2 * np.pi * k * doy / 365.25) for k in (1, 2, 3) for f in (np.sin, np.cos)]
    dow = np.array([d.weekday() for d in pdf.date])
    base = np.column_stack([np.ones(len(pdf)), np.arange(len(pdf)), *(dow == k for k in range(1, 7)), *har])
    clim = np.column_stack([np.ones(len(pdf)), *har])
    tr = (pdf.date <= PERIOD.train_end).to_numpy()

    def left(x, y):
        return y - x @ np.linalg.lstsq(x[tr], y[tr], rcond=None)[0]

    w = np.corrcoef(left(base, pdf.y.to_numpy()), left(clim, pdf.rain.to_numpy()))[0, 1]
    assert sens["all"].corr_rain == pytest.approx(w, abs=1e-9)
    assert sens["all"].delta_r2 > 0 and sens["all"].n_days == 365

    hourly = trips.groupBy(F.date_trunc("hour", "started_at").alias("transit_timestamp")).agg(F.count("*").cast("double").alias("ridership"))
    second = studies.segment_study(studies.hourly_segments(hourly, PERIOD), weather, settings)
    cells = studies.two_mode_cells(first, second, "rain", ("bike", "rail"))
    report = {r.cell: r for r in studies.cell_report(cells, reps=100).collect()}
    assert set(report) == {"bike-commute", "bike-leisure", "rail-commute", "rail-leisure"}
    # Both modes count the same trips here, so the cells agree.
    assert report["bike-commute"].point == pytest.approx(report["rail-commute"].point)
    assert report["bike-commute"].ci_lo <= report["bike-commute"].point <= report["bike-commute"].ci_hi


def test_contrast_of_systems_with_own_splits(spark, trips, weather):
    daily = studies.type_series(trips, PERIOD)
    series = daily.select("date", F.lit("bike").alias("series"), F.col("total").cast("double").alias("y"))
    early = Period(PERIOD.start, date(2022, 11, 30), date(2022, 8, 31), date(2022, 10, 15))
    bounds = splits.boundaries(spark, {("whole", "bike"): PERIOD, ("early", "bike"): early}, ["system", "series"])
    study = studies.contrast_study(series, weather, bounds, SeriesSettings(PERIOD), {"coef_rain": "anom_rain", "coef_lag1": "lag_y_1"})
    rows = {r.system: r for r in study.contrast.collect()}
    assert rows["whole"].n_days == 365 and rows["early"].n_days == early.days
    # The same system studied alone gives the same numbers.
    alone = studies.series_study(daily.select("date", "total"), weather, SeriesSettings(PERIOD), "rain", ("total",), SEARCH)
    d = {r.feature: r.std_coef for r in alone.coefficients.collect()}
    coefs = {r.system: r for r in study.coefficients.collect()}
    assert coefs["whole"].coef_rain == pytest.approx(d["anom_rain"]) and coefs["whole"].coef_lag1 == pytest.approx(d["lag_y_1"])
    assert coefs["whole"].max_weather_anom == pytest.approx(max(abs(v) for c, v in d.items() if c.startswith("anom_")))
    # Studied without the other one, the early system gives the same numbers, and they are not those of the whole.
    only = splits.boundaries(spark, {("early", "bike"): early}, ["system", "series"])
    again = studies.contrast_study(series, weather, only, SeriesSettings(PERIOD), {"coef_rain": "anom_rain"}).contrast.first()
    assert rows["early"].corr_rain == pytest.approx(again.corr_rain) and rows["early"].r2B_test == pytest.approx(again.r2B_test)
    assert rows["early"].corr_rain != pytest.approx(rows["whole"].corr_rain, abs=1e-3)


def test_inference_steps(spark, trips, weather):
    segs = studies.segment_study(studies.trip_segments(trips, PERIOD), weather, SeriesSettings(PERIOD))
    cells = studies.study_cells(segs.residuals, "segment", "rain")
    paired = {r.test: r for r in studies.paired_report(cells, [("route", "rt_round", "rt_point"), ("same", "all", "all")], reps=100).collect()}
    point = {r.segment: r.corr_rain for r in segs.sensitivity.collect()}
    held = cells.toPandas()
    both = held[held.cell == "rt_round"].merge(held[held.cell == "rt_point"], on="date")  # days with trips of both kinds
    gap = np.corrcoef(both.x_x, both.y_x)[0, 1] - np.corrcoef(both.x_x, both.y_y)[0, 1]
    assert paired["route"].n == len(both) and paired["route"].diff == pytest.approx(gap)
    assert paired["same"].diff == 0 and not paired["same"].excludes_0
    pair = [("time", "time_weMID", "time_wdAM")]
    test = studies.difference_report(cells, pair).first()
    assert test.diff == pytest.approx(point["time_weMID"] - point["time_wdAM"]) and 0 <= test.p <= 1
    effect = studies.effect_report(cells, pair, {"time_weMID": 1, "time_wdAM": 2}, reps=200).first()
    assert effect.ci_lo < effect.point < effect.ci_hi and effect.reps == 200
    assert [p[0] for p in studies.effect_pairs(("bike", "rail"))] == ["column bike", "column rail", "row commute", "row leisure"]


def test_bad_hour_texts_are_dropped(spark):
    rows = [("2022-01-03 08:00:00", 2.0), ("not a time", 5.0), (None, 1.0), ("2022-01-08 12:00:00", 3.0)]
    hourly = spark.createDataFrame(rows, "transit_timestamp string, ridership double")
    for out in (sum_segments(hourly, "transit_timestamp", "ridership", TimeWindows()), studies.hourly_segments(hourly, PERIOD)):
        got = {(r.date.isoformat(), r.segment): r.n for r in out.collect()}
        assert got == {("2022-01-03", "all"): 2, ("2022-01-03", "time_wdAM"): 2, ("2022-01-08", "all"): 3, ("2022-01-08", "time_weMID"): 3}


def test_tree_rows(monkeypatch, trips, weather):
    monkeypatch.setattr(studies, "SERIES_FOREST", {"trees": (3, 4), "depth": (2, 3), "leaf": (1, 3)})
    monkeypatch.setattr(studies, "SERIES_BOOSTED", {"trees": (3, 4), "depth": (2, 3), "rate": (0.1, 0.3), "share": (0.6, 1.0)})
    study = studies.series_study(
        studies.type_series(trips, PERIOD).select("date", "total"), weather, SeriesSettings(PERIOD), "rain", ("total",), SEARCH
    )
    rows = studies.series_tree_scores(study, SeriesSettings(PERIOD), SearchSettings(draws=1)).collect()
    assert len(rows) == 8 and all(r.test_mae > 0 for r in rows)

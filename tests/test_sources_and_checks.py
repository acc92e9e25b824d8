import json
from datetime import date, timedelta
from pathlib import Path

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from daygrid.functions.calendar import calendar_names
from daygrid.operators import features, quality
from daygrid.sources import readers
from daygrid.streaming import daily_counts as counts
from daygrid.streaming.daily_counts import update_counts

ROOT = Path(__file__).resolve().parents[1]


def test_csv_with_padded_header_and_bad_cells(spark, tmp_path):
    (tmp_path / "a.csv").write_text("LocationID , Borough\n1,North\nx,South\n")
    df = readers.trim_names(readers.read_csv(spark, str(tmp_path / "a.csv"), "`LocationID ` int, ` Borough` string"))
    assert df.columns == ["LocationID", "Borough"]
    assert [tuple(r) for r in df.collect()] == [(1, "North"), (None, "South")]


def test_columnar_json(spark, tmp_path):
    body = {"daily": {"time": ["2022-01-01", "2022-01-02"], "rain": [0.5, None], "wind": [3, 4]}}
    (tmp_path / "w.json").write_text(json.dumps(body, indent=1))
    rows = readers.read_columnar_json(spark, str(tmp_path / "w.json"), ["rain", "wind"]).orderBy("date").collect()
    assert [tuple(r) for r in rows] == [(date(2022, 1, 1), 0.5, 3.0), (date(2022, 1, 2), None, 4.0)]


@pytest.mark.parametrize("rain", [[0.5], [0.5, 1.0, 2.0], None])
def test_ragged_columnar_json_raises_with_path_and_variable(spark, tmp_path, rain):
    body = {"daily": {"time": ["2022-01-01", "2022-01-02"], "wind": [3, 4], **({} if rain is None else {"rain": rain})}}
    (tmp_path / "ragged.json").write_text(json.dumps(body, indent=1))
    with pytest.raises(Exception, match=r"(?s)daily\.rain is absent or not as long.*ragged\.json"):
        readers.read_columnar_json(spark, str(tmp_path / "ragged.json"), ["rain", "wind"]).collect()


def test_json_records_as_array(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps([{"day": "2022-01-01", "cnt": "3"}, {"day": "x", "cnt": None}]))
    rows = readers.read_json_records(spark, str(tmp_path / "r.json"), ["day", "cnt"]).collect()
    assert [tuple(r) for r in rows] == [("2022-01-01", "3"), ("x", None)]


def test_result_csv_is_one_rounded_file(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.12345, 7)], "name string, v double, n int")
    readers.write_result_csv(df, str(tmp_path / "out"), ["v", "name"])
    files = list((tmp_path / "out").glob("*.csv"))
    assert len(files) == 1 and files[0].read_text() == "v,name\n0.123,a\n"


def test_missing_columns_raise(spark):
    with pytest.raises(ValueError, match="zone"):
        readers.require_columns(spark.range(1), ["id", "zone"])


def test_cached_counts_read_each_file_once_and_add_up(spark, tmp_path):
    def drop(name, rows):
        spark.createDataFrame(rows, "date date").coalesce(1).write.parquet(f"{tmp_path}/{name}")

    d1, d2 = date(2022, 1, 1), date(2022, 1, 2)
    drop("jan", [(d1,), (d1,), (d2,)])
    args = (str(tmp_path / "cache"), ["date"])
    first = readers.cached_counts(spark, [f"{tmp_path}/jan"], *args)
    assert dict(tuple(r) for r in first.collect()) == {d1: 2, d2: 1}
    drop("feb", [(d1,)])  # a late row of an old day
    again = readers.cached_counts(spark, [f"{tmp_path}/jan", f"{tmp_path}/feb"], *args)
    assert dict(tuple(r) for r in again.collect()) == {d1: 3, d2: 1}
    assert spark.read.parquet(f"{args[0]}/partials").agg(F.sum("n")).first()[0] == 4


def put(spark, path, days):
    """One file of a given name, written anew if it is there."""
    spark.createDataFrame([(d,) for d in days], "date date").toPandas().to_parquet(path)


def total(df):
    return sum(r.n for r in df.collect())


def test_cached_counts_take_a_changed_file_as_it_is_now(spark, tmp_path):
    d1, d2 = date(2022, 1, 1), date(2022, 1, 2)
    drop, cache = tmp_path / "in", str(tmp_path / "cache")
    drop.mkdir()
    put(spark, drop / "a b%.parquet", [d1] * 3)
    put(spark, drop / "c.parquet", [d1, d2])
    run = lambda: dict(tuple(r) for r in readers.cached_counts(spark, [str(drop)], cache, ["date"]).collect())
    assert run() == {d1: 4, d2: 1}
    put(spark, drop / "a b%.parquet", [d2] * 5)
    assert run() == {d1: 1, d2: 6} == run()
    assert spark.read.parquet(f"{cache}/manifest").count() == 3


def test_cached_counts_remember_files_without_rows(spark, tmp_path):
    d1, d2 = date(2022, 1, 1), date(2022, 1, 2)
    drop, cache = tmp_path / "in", str(tmp_path / "cache")
    drop.mkdir()
    put(spark, drop / "a.parquet", [d1] * 3)
    kept = lambda df: df.filter(F.col("date") > F.lit(d1))
    run = lambda: total(readers.cached_counts(spark, [str(drop)], cache, ["date"], kept))
    assert run() == 0 == run()
    assert spark.read.parquet(f"{cache}/manifest").count() == 1
    put(spark, drop / "b.parquet", [d1, d2])
    assert run() == 1
    put(spark, drop / "b.parquet", [d1])  # what it held before must not stay
    assert run() == 0


def test_cached_counts_repeat_a_run_that_died(spark, tmp_path, monkeypatch):
    d1 = date(2022, 1, 1)
    drop, cache = tmp_path / "in", str(tmp_path / "cache")
    drop.mkdir()
    for i in range(5):
        put(spark, drop / f"{i}.parquet", [d1] * (i + 1))
    run = lambda: total(readers.cached_counts(spark, [str(drop)], cache, ["date"]))
    whole = DataFrameWriter.parquet

    def dying(self, path, *args, **kwargs):
        if path.endswith("/manifest") and dying.left == 0:
            raise OSError("the driver died")
        dying.left -= path.endswith("/manifest")
        return whole(self, path, *args, **kwargs)

    dying.left = 1
    monkeypatch.setattr(DataFrameWriter, "parquet", dying)
    monkeypatch.setattr(readers, "FILES_IN_BATCH", 2)
    with pytest.raises(OSError, match="died"):
        run()
    monkeypatch.setattr(DataFrameWriter, "parquet", whole)
    assert run() == 15 == run()
    assert spark.read.parquet(f"{cache}/manifest").select("file_key").distinct().count() == 5


def test_cached_counts_raise_other_faults(spark, tmp_path):
    put(spark, tmp_path / "a.parquet", [date(2022, 1, 1)])
    (tmp_path / "cache" / "manifest").mkdir(parents=True)
    (tmp_path / "cache" / "manifest" / "x.parquet").write_text("no parquet")
    with pytest.raises(Exception, match="x.parquet"):
        readers.cached_counts(spark, [str(tmp_path / "a.parquet")], str(tmp_path / "cache"), ["date"]).collect()


def test_stream_counts_new_files_only_and_survives_a_rerun(spark, tmp_path):
    d1, d2 = date(2022, 1, 1), date(2022, 1, 2)
    schema = spark.createDataFrame([], "date date, zone int").schema

    def drop(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/drop")

    def run():
        out = update_counts(spark, f"{tmp_path}/drop", schema, f"{tmp_path}/t", f"{tmp_path}/c", ["date", "zone"])
        return {(r.date, r.zone): r.n for r in out.collect()}

    drop([(d1, 1), (d1, 1), (d2, 1)])
    assert run() == {(d1, 1): 2, (d2, 1): 1}
    assert run() == {(d1, 1): 2, (d2, 1): 1}
    drop([(d1, 1), (d2, 2)])
    assert run() == {(d1, 1): 3, (d2, 1): 1, (d2, 2): 1}


def test_compaction_leaves_few_folders_and_replays_are_harmless(spark, tmp_path):
    schema = spark.createDataFrame([], "date date, zone int").schema
    table, keys = str(tmp_path / "t"), ["date", "zone"]
    d1 = date(2022, 1, 1)
    batch = lambda i: spark.createDataFrame([(d1, i % 3, i)], "date date, zone int, n long")

    def store(i):
        batch(i).coalesce(1).write.mode("overwrite").parquet(f"{table}/batches/batch={i}")

    for i in range(50):
        store(i)
        counts.compact(spark, table, keys, 8)
    want = {(d1, z): sum(i for i in range(50) if i % 3 == z) for z in range(3)}
    read = lambda: {(r.date, r.zone): r.n for r in counts.read_counts(spark, table, keys).collect()}
    assert read() == want
    assert len(list((tmp_path / "t" / "batches").glob("batch=*"))) <= 16
    assert len(list((tmp_path / "t" / "bases").glob("base=*"))) <= 2
    store(3)  # a replay of a batch that the base holds
    store(49)
    assert read() == want
    batch(7).write.parquet(f"{table}/bases/base=60")  # a base that was never named
    assert read() == want
    counts.compact(spark, table, keys, 1)
    assert read() == want
    assert schema.names == keys


def test_stream_with_compaction_survives_a_rerun(spark, tmp_path):
    schema = spark.createDataFrame([], "date date, zone int").schema
    d1 = date(2022, 1, 1)
    for i in range(7):
        spark.createDataFrame([(d1, i % 2)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/drop")
        for _ in range(2):
            out = update_counts(spark, f"{tmp_path}/drop", schema, f"{tmp_path}/t", f"{tmp_path}/c", ["date", "zone"], compact_after=3)
            assert sum(r.n for r in out.collect()) == i + 1
    assert counts.base_ids(spark, f"{tmp_path}/t") == [2, 5]


@pytest.fixture
def panel(spark):
    rows = [(date(2022, 1, 1) + timedelta(i), z, float(i * z % 11)) for i in range(40) for z in (1, 2)]
    return spark.createDataFrame(rows, "date date, zone int, demand double")


def test_leakage_checks_accept_the_features_and_catch_a_leak(panel):
    w = features.by_day("zone")
    good = panel.select("*", *features.lags("demand", (7,), w, "lag_"), *features.rolling_means("demand", (7,), w, "roll_"))
    assert quality.wrong_lags(good, "zone", "demand", "lag_7", 7).isEmpty()
    assert quality.wrong_rolling(good, "zone", "demand", "roll_7", 7).isEmpty()
    leaky = panel.select(
        "*", F.lag("demand", 6).over(w).alias("lag_7"), F.avg("demand").over(w.rowsBetween(-6, 0)).alias("roll_7")
    )
    assert quality.wrong_lags(leaky, "zone", "demand", "lag_7", 7).count() > 50
    assert quality.wrong_rolling(leaky, "zone", "demand", "roll_7", 7).count() > 50


def test_quality_findings(spark, panel):
    assert quality.duplicate_keys(panel, ["date", "zone"]).isEmpty()
    assert quality.duplicate_keys(panel, ["date"]).count() == 40
    report = quality.grid_report(panel, 40).first()
    assert report.complete and report.negative == 0
    assert not quality.grid_report(panel.filter("demand > 0"), 40).first().complete
    nulls = panel.withColumn("x", F.when(F.col("zone") == 1, F.lit(1)))
    assert {r.column_name: r.nulls for r in quality.null_report(nulls, ["x", "zone"]).collect()} == {"x": 40, "zone": 0}
    with pytest.raises(ValueError, match="x"):
        quality.require_no_nulls(nulls, ["x"])
    with pytest.raises(ValueError, match="unique"):
        quality.require_one_to_one(panel, ["date"], "panel")
    with pytest.raises(ValueError, match="empty"):
        quality.require_rows(panel.filter("false"), "panel")
    with pytest.raises(ValueError, match="empty split"):
        quality.require_split_order(panel, F.lit("train"))
    with pytest.raises(ValueError, match="overlap"):
        labels = F.when(F.dayofmonth("date") % 3 == 0, "train").when(F.dayofmonth("date") % 3 == 1, "val").otherwise("test")
        quality.require_split_order(panel, labels)


def test_calendar_names_hold_no_outside_variable():
    assert all(n.startswith("cal_") for n in calendar_names())


def test_no_random_split_and_one_window_definition():
    source = "\n".join(p.read_text() for p in (ROOT / "daygrid").rglob("*.py"))
    for banned in ("randomSplit", "train_test_split", "localCheckpoint", ".sample("):
        assert banned not in source
    assert source.count("windows.weekday_morning") == 1

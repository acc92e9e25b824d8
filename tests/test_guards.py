"""Cases that must be caught: ids of any size, empty runs, doubled days, bad texts, zero-heavy groups."""

from datetime import date

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from daygrid.config import Period
from daygrid.functions.calendar import day_of
from daygrid.operators import grid, linear, quality
from daygrid.plans import studies
from daygrid.sources import sample


def test_permits_keep_ids_of_any_size(spark, tmp_path):
    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")

    put("lineitem", [(1, 1), (1, 2), (1, 3), (2, 2), (1, 1)], "l_orderkey long, l_suppkey long")
    put("supplier", [(1, 67), (2, 30), (3, 7)], "s_suppkey long, s_nationkey int")
    put("orders", [(1, "1996-01-02"), (2, "1996-01-03")], "o_orderkey long, o_orderdate string")
    rows = {r["event_id"]: r["police_precinct"] for r in sample.permit_rows(spark, str(tmp_path)).collect()}
    assert rows == {1: "7,30,67,", 2: "30,"}


def test_an_empty_run_is_reported(spark):
    a = spark.createDataFrame([(1, 2.0), (2, None)], "k int, v double")
    assert quality.differing(a, a, ["k"], ["v"]).count() == 0
    assert quality.differing(a, a.limit(0), ["k"], ["v"]).count() == 2
    assert quality.differing(a.limit(0), a, ["k"], ["v"]).count() == 2


def test_a_day_with_two_rows_is_an_error(spark):
    days = spark.createDataFrame([(date(1996, 1, 1), 1.0), (date(1996, 1, 1), 2.0)], "date date, x double")
    period = Period(date(1996, 1, 1), date(1996, 1, 9), date(1996, 1, 3), date(1996, 1, 5))
    assert grid.join_daily(days.select("date"), days.limit(1), period).count() == 2
    with pytest.raises(PySparkException):
        grid.join_daily(days.select("date"), days, period).collect()


def test_text_that_is_no_time_is_dropped(spark):
    period = Period(date(2022, 1, 1), date(2022, 1, 9), date(2022, 1, 3), date(2022, 1, 5))
    trips = spark.createDataFrame(
        [("2022-01-01 08:00:00", "member", "a", "b"), ("bad", "member", "a", "b")],
        "started_at string, member_casual string, start_station_id string, end_station_id string",
    )
    assert trips.filter(day_of("started_at").isNull()).count() == 1
    found = studies.trip_segments(trips, period).collect()
    assert found and {r["date"] for r in found} == {date(2022, 1, 1)}


def test_rows_that_agree_in_some_columns_spread(spark):
    rows = spark.range(40_000).select(F.lit(1).alias("g"), *(F.lit(0.0).alias(c) for c in "abcd"), F.col("id").alias("e"))
    left, _ = linear._salted(rows, rows.limit(1).select("g"), ["g"], 8 * linear.ROWS_PER_TASK)
    counts = [r["count"] for r in left.count().collect()]
    assert len(counts) == 8 and max(counts) < 2 * min(counts)


def test_parts_of_permits_grow_with_the_lines(spark, sample_dir, monkeypatch):
    """What a task sorts and groups is bounded by the parts, not by the shuffle setting; the rows stay the same."""
    whole = {tuple(r) for r in sample.permit_rows(spark, sample_dir).collect()}
    size = sample.planned_bytes(sample.read_table(spark, sample_dir, "lineitem"))
    monkeypatch.setattr(sample, "PART_BYTES", size // 23)
    cut = sample.permit_rows(spark, sample_dir)
    assert cut.rdd.getNumPartitions() >= 23
    assert {tuple(r) for r in cut.collect()} == whole

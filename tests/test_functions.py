import math
from datetime import date

import pytest
from pyspark.sql import functions as F

from daygrid.functions import calendar as cal
from daygrid.functions import stats, text
from daygrid.operators.segments import is_roundtrip


def test_unparsable_timestamp_is_dropped_without_error(spark):
    df = spark.createDataFrame([("2022-01-03 10:00:00",), ("not a time",), (None,)], "ts string")
    days = df.select(cal.day_of_text("ts").alias("d")).dropna().collect()
    assert [r.d for r in days] == [date(2022, 1, 3)]


def test_unknown_station_is_no_round_trip(spark):
    df = spark.createDataFrame([("1", "1"), ("1", "2"), (None, "1"), (None, None)], "a string, b string")
    got = [r.x for r in df.select(is_roundtrip(F.col("a"), F.col("b")).alias("x")).collect()]
    assert got == [True, False, False, False]


def test_half_even_rounding(spark):
    df = spark.createDataFrame([(2.5,), (3.5,), (-0.5,), (0.1 + 0.2 + 2.2,)], "x double")
    assert [r.x for r in df.select(stats.half_even(F.col("x")).alias("x")).collect()] == [2.0, 4.0, 0.0, 2.0]


def test_id_list(spark):
    df = spark.createDataFrame([("17,",), ("17, 18,x,,",), ("",), (None,)], "s string")
    got = [r.x for r in df.select(text.parse_id_list("s").alias("x")).collect()]
    assert got == [[17], [17, 18], [], None]
    assert df.select(F.explode(text.parse_id_list("s"))).count() == 3


def test_lenient_numbers(spark):
    df = spark.createDataFrame([("5",), ("x",), (None,)], "s string")
    assert [r.x for r in df.select(text.number_or_zero(F.col("s")).alias("x")).collect()] == [5, 0, 0]


@pytest.mark.parametrize(
    "day,flag",
    [
        (date(2021, 12, 31), True),  # Friday before a Saturday January 1
        (date(2022, 1, 1), True),
        (date(2022, 1, 3), False),
        (date(2022, 1, 17), True),
        (date(2022, 6, 19), True),
        (date(2022, 6, 20), True),  # Monday after a Sunday
        (date(2020, 6, 19), False),
        (date(2023, 5, 29), True),
        (date(2023, 11, 23), True),
        (date(2023, 11, 24), False),
        (date(2022, 12, 26), True),
    ],
)
def test_holidays(spark, day, flag):
    df = spark.createDataFrame([(day,)], "d date")
    assert df.select(cal.is_holiday(F.col("d")).alias("h")).first().h is flag


def test_weekday_starts_on_monday(spark):
    df = spark.createDataFrame([(date(2022, 1, 3),), (date(2022, 1, 9),)], "d date")
    assert [r.x for r in df.select(cal.weekday(F.col("d")).alias("x")).collect()] == [0, 6]


def test_erf_matches_the_library(spark):
    xs = [-4.0, -1.3, 0.0, 1e-9, 0.3, 1.0, 2.5, 5.9, 9.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for x, r in zip(xs, df.select(stats.erf(F.col("x")).alias("e")).collect()):
        assert r.e == pytest.approx(math.erf(x), abs=1e-14)


def test_fisher_z_needs_more_than_three(spark):
    df = spark.createDataFrame([(0.5, 50.0, 0.1, 60.0), (0.5, 3.0, 0.1, 60.0)], "a double, n double, b double, m double")
    rows = df.select(*stats.fisher_z_columns(F.col("a"), F.col("n"), F.col("b"), F.col("m"))).collect()
    se = math.sqrt(1 / 47 + 1 / 57)
    z = (math.atanh(0.5) - math.atanh(0.1)) / se
    assert rows[0].z == pytest.approx(z)
    assert rows[0].p == pytest.approx(2 * (1 - 0.5 * (1 + math.erf(abs(z) / math.sqrt(2)))))
    assert rows[1].z is None and rows[1].p is None


def test_correlation_of_a_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (1.0, 5.0)], "x double, y double")
    assert df.agg(stats.safe_corr(F.col("x"), F.col("y")).alias("r")).first().r is None
    assert df.agg(stats.safe_corr(F.col("y"), F.col("y")).alias("r")).first().r == pytest.approx(1.0)


def test_r2_of_a_constant_truth(spark):
    df = spark.createDataFrame([(0.0, 0.0), (2.0, 0.0), (2.0, 8.0)], "sse double, sst double")
    assert [r.x for r in df.select(stats.r2_from(F.col("sse"), F.col("sst")).alias("x")).collect()] == [1.0, 0.0, 0.75]


def test_effective_n_ignores_negative_autocorrelation(spark):
    df = spark.createDataFrame([(100.0, -0.4), (100.0, 0.5), (100.0, 1.0)], "n double, r double")
    got = [r.x for r in df.select(stats.effective_n(F.col("n"), F.col("r")).alias("x")).collect()]
    assert got == [100.0, pytest.approx(100 / 3), pytest.approx(100 * 0.01 / 1.99)]

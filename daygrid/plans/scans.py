"""Sources, projections, predicates and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from daygrid.functions import calendar as cal
from daygrid.functions.stats import half_even
from daygrid.functions.text import number_or_zero, parse_id_list
from daygrid.operators.counts import count_rows, resum
from daygrid.operators.events import precinct_pairs
from daygrid.operators.features import split_label
from daygrid.operators.segments import is_roundtrip
from daygrid.plans import tables as t
from daygrid.plans.registry import query
from daygrid.plans.sqltext import P0, P1, TRAIN_END, VAL_END, calendar_select, r6, r6_all, with_ctes
from daygrid.session import scratch
from daygrid.sources import sample
from daygrid.sources.readers import (
    cached_counts,
    read_columnar_json,
    read_csv,
    read_json_records,
    read_table,
    trim_names,
    union_all,
    write_parquet,
    write_result_csv,
)


@query("scan_pruned", "SELECT l_suppkey, l_quantity, l_linestatus FROM lineitem WHERE l_quantity > 45")
def scan_pruned(spark: SparkSession, d: str) -> DataFrame:
    lines = read_table(spark, d, "lineitem")
    return lines.filter("l_quantity > 45").select("l_suppkey", "l_quantity", "l_linestatus")


@query(
    "csv_scan",
    """SELECT CAST(l_shipdate AS DATE) AS date, l_linestatus AS kind, count(*) AS n
    FROM lineitem GROUP BY 1, 2""",
)
def csv_scan(spark: SparkSession, d: str) -> DataFrame:
    """Lines written as CSV with padded header names, read back with a declared schema."""
    path = scratch(spark, "csv")
    raw = read_table(spark, d, "lineitem").select("l_shipdate", "l_linestatus", "l_orderkey")
    padded = raw.withColumnsRenamed({"l_linestatus": " l_linestatus "})
    padded.write.option("header", True).option("ignoreTrailingWhiteSpace", False).csv(path)
    back = trim_names(read_csv(spark, path, "l_shipdate timestamp_ntz, ` l_linestatus ` string, l_orderkey bigint"))
    return count_rows(back, [F.to_date("l_shipdate").alias("date"), F.col("l_linestatus").alias("kind")])


@query(
    "parquet_sink",
    "SELECT year(l_shipdate) AS year, l_returnflag, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS numbers FROM lineitem GROUP BY 1, 2",
)
def parquet_sink(spark: SparkSession, d: str) -> DataFrame:
    """All lines through the partitioned sink, written twice over itself and read back."""
    path = scratch(spark, "sink")
    lines = read_table(spark, d, "lineitem").select(F.year("l_shipdate").alias("year"), "l_returnflag", "l_linenumber")
    for _ in range(2):
        write_parquet(lines, path, ["year"])
    back = spark.read.parquet(path)
    return back.groupBy("year", "l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("l_linenumber").alias("numbers"))


@query(
    "csv_sink",
    """SELECT l_suppkey, round_even(avg(l_quantity), 3) AS mean_quantity, count(*) AS n FROM lineitem GROUP BY 1""",
)
def csv_sink(spark: SparkSession, d: str) -> DataFrame:
    """A result table of all lines through the one-file sink with fixed columns and rounded numbers, read back."""
    path = scratch(spark, "result")
    table = read_table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.avg("l_quantity").alias("mean_quantity"), F.count(F.lit(1)).alias("n"))
    write_result_csv(table, path, ["l_suppkey", "mean_quantity", "n"])
    return read_csv(spark, path, "l_suppkey bigint, mean_quantity double, n bigint")


@query(
    "json_columnar_unpack",
    """SELECT CAST(o_orderdate AS DATE) AS date, round(sum(o_totalprice), 2) / count(*) AS exo_mean, max(o_totalprice) AS exo_max,
    CAST(count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS DOUBLE) AS exo_sum FROM orders GROUP BY 1""",
)
def json_columnar_unpack(spark: SparkSession, d: str) -> DataFrame:
    """Daily variables of all orders held as one multi-line document of parallel arrays per month, unpacked to rows.

    A month bounds every array, however long the history is.
    """
    names = ["exo_mean", "exo_max", "exo_sum"]
    item = F.struct(F.col("date").cast("string").alias("time"), *names)
    days = sample.exo_days(spark, d)
    month = days.groupBy(F.date_format("date", "yyyy-MM").alias("month")).agg(F.array_sort(F.collect_list(item)).alias("r"))
    block = F.struct(*(F.col(f"r.{c}").alias(c) for c in ["time", *names])).alias("daily")
    path = scratch(spark, "json")
    documents = month.select("month", F.to_json(F.struct(block), {"pretty": "true"}).alias("value"))
    documents.write.partitionBy("month").text(path)
    return read_columnar_json(spark, path, names)


@query(
    "json_records_coerce",
    """SELECT event_id, CAST(ts AS DATE) AS day, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER), 0) AS k,
    coalesce(TRY_CAST(event_type AS INTEGER), 0) AS bad FROM events""",
)
def json_records_coerce(spark: SparkSession, d: str) -> DataFrame:
    """Events written as JSON objects of text fields, numbers coerced on the way back."""
    path = scratch(spark, "records")
    ev = read_table(spark, d, "events")
    k = F.get_json_object("props", "$.k")
    ev.select(
        F.col("event_id").cast("string").alias("event_id"), F.col("ts").cast("string").alias("ts"), k.alias("k"), "event_type"
    ).write.json(path)
    raw = read_json_records(spark, path, ["event_id", "ts", "k", "event_type"], multi_line=False)
    return raw.select(
        F.col("event_id").cast("long").alias("event_id"),
        cal.day_of_text("ts").alias("day"),
        number_or_zero(F.col("k")).alias("k"),
        number_or_zero(F.col("event_type")).alias("bad"),
    )


@query(
    "union_inputs",
    """SELECT month, count(*) AS n FROM (SELECT date_trunc('month', l_shipdate)::DATE AS month FROM lineitem
    UNION ALL SELECT date_trunc('month', o_orderdate)::DATE AS month FROM orders) GROUP BY month""",
)
def union_inputs(spark: SparkSession, d: str) -> DataFrame:
    a = read_table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("date"))
    b = read_table(spark, d, "orders").select(F.to_date("o_orderdate").alias("date"))
    return count_rows(union_all([a, b]), [F.trunc("date", "month").alias("month")])


@query(
    "agg_cache_reuse",
    """SELECT CAST(l_shipdate AS DATE) AS date, CASE WHEN l_linestatus = 'O' THEN 'member' ELSE 'casual' END AS member_casual,
    count(*) AS n FROM lineitem GROUP BY 1, 2""",
)
def agg_cache_reuse(spark: SparkSession, d: str) -> DataFrame:
    """Three runs over files of which one arrives and one is written anew in between."""
    drop, cache = scratch(spark, "drop"), scratch(spark, "cache")
    lines = read_table(spark, d, "lineitem").select("l_shipdate", "l_linestatus", "l_orderkey")
    part = F.col("l_orderkey") % 3

    def shape(df: DataFrame) -> DataFrame:
        return df.select("source", F.to_date("l_shipdate").alias("date"), sample.user_type().alias("member_casual"))

    def run(*parts: int) -> DataFrame:
        return cached_counts(spark, [f"{drop}/part={i}" for i in parts], cache, ["date", "member_casual"], shape)

    write_parquet(lines.filter(part == 0), f"{drop}/part=0")
    write_parquet(lines.filter((part == 1) & (F.col("l_orderkey") % 2 == 0)), f"{drop}/part=1")
    run(0, 1)
    write_parquet(lines.filter(part == 2), f"{drop}/part=2")
    run(0, 1, 2)
    write_parquet(lines.filter(part == 1), f"{drop}/part=1")
    return run(0, 1, 2)


@query(
    "day_truncate",
    """SELECT day, count(*) AS n FROM (SELECT TRY_CAST(txt AS TIMESTAMP)::DATE AS day FROM (
    SELECT CASE WHEN event_id % 10 = 0 THEN 'bad ' || event_type ELSE CAST(ts AS VARCHAR) END AS txt FROM events))
    WHERE day IS NOT NULL GROUP BY day""",
)
def day_truncate(spark: SparkSession, d: str) -> DataFrame:
    txt = F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("bad "), "event_type")).otherwise(F.col("ts").cast("string"))
    days = read_table(spark, d, "events").select(cal.day_of_text(txt).alias("day"))
    return count_rows(days.dropna(subset=["day"]), ["day"])


@query(
    "period_filter",
    f"""SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS date FROM lineitem
    WHERE CAST(l_shipdate AS DATE) BETWEEN DATE '{P0}' AND DATE '{P1}'""",
)
def period_filter(spark: SparkSession, d: str) -> DataFrame:
    return sample.lines(spark, d, t.PERIOD).select("l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("date"))


@query(
    "zone_membership",
    """SELECT s_suppkey, s_nationkey AS zone FROM supplier WHERE s_nationkey NOT IN (13, 18)
    AND s_nationkey IN (SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE'))""",
)
def zone_membership(spark: SparkSession, d: str) -> DataFrame:
    inside = sample.zone_lookup(spark, d).filter(F.col("Borough").isin("ASIA", "EUROPE"))
    supp = read_table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("zone"))
    kept = supp.filter(~F.col("zone").isin(list(t.PANEL.exclude)))
    return kept.join(inside, kept.zone == inside.LocationID, "left_semi")


@query(
    "time_parts",
    """SELECT event_id, CAST(hour(ts) AS INTEGER) AS hour, CAST(isodow(ts) - 1 AS INTEGER) AS dow, isodow(ts) >= 6 AS weekend FROM events""",
)
def time_parts(spark: SparkSession, d: str) -> DataFrame:
    ts = F.col("ts")
    return read_table(spark, d, "events").select(
        "event_id", F.hour(ts).alias("hour"), cal.weekday(ts).alias("dow"), cal.is_weekend(ts).alias("weekend")
    )


@query(
    "roundtrip_flag",
    with_ctes(
        ["trips"],
        """SELECT date, coalesce(start_station_id = end_station_id, false) AS round_trip, count(*) AS n,
        count(*) FILTER (WHERE start_station_id IS NULL) AS unknown FROM trips GROUP BY 1, 2""",
    ),
)
def roundtrip_flag(spark: SparkSession, d: str) -> DataFrame:
    trips = sample.routes(spark, d)
    flag = is_roundtrip(F.col("start_station_id"), F.col("end_station_id"))
    unknown = F.when(F.col("start_station_id").isNull(), F.col("n")).otherwise(F.lit(0))
    return trips.groupBy("date", flag.alias("round_trip")).agg(F.sum("n").alias("n"), F.sum(unknown).alias("unknown"))


@query(
    "drop_incomplete",
    with_ctes(
        ["feats"],
        """SELECT date, zone, demand_lag_14, demand_lag_7 FROM feats
        WHERE demand_lag_14 IS NOT NULL AND demand_rolling_mean_7 IS NOT NULL""",
    ),
)
def drop_incomplete(spark: SparkSession, d: str) -> DataFrame:
    return t.panel_table(spark, d).dropna().select("date", "zone", "demand_lag_14", "demand_lag_7")


@query(
    "half_even_round",
    "SELECT l_orderkey, l_linenumber, CAST(round_even(l_quantity / 2, 0) AS BIGINT) AS half_qty, round_even(l_quantity / 8, 2) AS eighth_qty FROM lineitem",
)
def half_even_round(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("l_quantity")
    return read_table(spark, d, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        half_even(q / 2).cast("long").alias("half_qty"),
        half_even(q / 8, 2).alias("eighth_qty"),
    )


@query(
    "parse_id_list",
    with_ctes(
        ["permits_all"],
        """SELECT event_id, len(ids) AS n_ids, list_sum(ids)::BIGINT AS id_sum FROM (SELECT event_id,
        list_transform(list_filter(string_split(police_precinct, ','), lambda x: regexp_full_match(trim(x), '[0-9]+')),
        lambda x: CAST(trim(x) AS INTEGER)) AS ids FROM permits_all)""",
    ),
)
def parse_ids(spark: SparkSession, d: str) -> DataFrame:
    ids = sample.permit_rows(spark, d).select("event_id", parse_id_list("police_precinct").alias("ids"))
    total = F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x)
    return ids.select("event_id", F.size("ids").cast("long").alias("n_ids"), total.alias("id_sum"))


@query(
    "explode_ids",
    with_ctes(
        ["permits_all"],
        """SELECT DISTINCT event_id, day AS date, CAST(trim(tok) AS INTEGER) AS precinct
        FROM (SELECT event_id, day, unnest(string_split(police_precinct, ',')) AS tok FROM permits_all) WHERE regexp_full_match(trim(tok), '[0-9]+')""",
    ),
)
def explode_ids(spark: SparkSession, d: str) -> DataFrame:
    return precinct_pairs(sample.permit_rows(spark, d))


def _order_days(spark: SparkSession, d: str) -> DataFrame:
    """Order counts per day: the base of the calendar queries, which grow with the orders read."""
    return count_rows(read_table(spark, d, "orders"), [F.to_date("o_orderdate").alias("date")])


_DAYS_SQL = ("days", "SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS n FROM orders GROUP BY 1")


@query(
    "cyclic_calendar",
    with_ctes(
        [],
        f"""SELECT date, n, {r6('sin(2*pi()*(isodow(date)-1)/7)', 'dow_sin')}, {r6('cos(2*pi()*(isodow(date)-1)/7)', 'dow_cos')},
        {r6('sin(2*pi()*month(date)/12)', 'month_sin')}, {r6('cos(2*pi()*month(date)/12)', 'month_cos')},
        CAST(isodow(date) >= 6 AS INTEGER) AS is_weekend FROM days""",
        [_DAYS_SQL],
    ),
)
def cyclic(spark: SparkSession, d: str) -> DataFrame:
    return t.rounded(_order_days(spark, d).select("date", "n", *cal.cyclic_calendar(F.col("date"))))


@query(
    "annual_harmonics",
    with_ctes(
        [],
        "SELECT date, n, " + r6_all([f"cal_{f}_{k}" for k in (1, 2, 3) for f in ("sin", "cos")])
        + f" FROM (SELECT date, n, {calendar_select(holiday=False)} FROM days)",
        [_DAYS_SQL],
    ),
)
def harmonics(spark: SparkSession, d: str) -> DataFrame:
    return t.rounded(_order_days(spark, d).select("date", "n", *cal.annual_harmonics(F.col("date"))))


@query(
    "weekday_dummies",
    with_ctes(
        [],
        "SELECT date, n, " + ", ".join(f"cal_dow_{i}" for i in range(1, 7))
        + f" FROM (SELECT date, n, {calendar_select(holiday=False)} FROM days)",
        [_DAYS_SQL],
    ),
)
def dummies(spark: SparkSession, d: str) -> DataFrame:
    return _order_days(spark, d).select("date", "n", *cal.weekday_dummies(F.col("date")))


@query(
    "holiday_flag",
    with_ctes(["hol"], "SELECT date, n, date IN (SELECT date FROM hol) AS is_holiday FROM days", [_DAYS_SQL]),
)
def holiday_flag(spark: SparkSession, d: str) -> DataFrame:
    return _order_days(spark, d).select("date", "n", cal.is_holiday(F.col("date")).alias("is_holiday"))


@query(
    "date_spine",
    with_ctes(
        [],
        """SELECT CAST(s AS DATE) AS date, last_day(CAST(s AS DATE)) AS month_end, coalesce(n, 0) AS n
        FROM (SELECT unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS s FROM (SELECT min(date) AS lo, max(date) AS hi FROM days))
        LEFT JOIN days ON CAST(s AS DATE) = days.date""",
        [_DAYS_SQL],
    ),
)
def spine_of_orders(spark: SparkSession, d: str) -> DataFrame:
    """Every day between the first and the last order, with its month end and order count."""
    days = _order_days(spark, d)
    edge = days.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    full = edge.select(F.explode(F.sequence("lo", "hi", F.expr("interval 1 day"))).alias("date"))
    joined = full.join(days, "date", "left")
    return joined.select("date", F.last_day("date").alias("month_end"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query(
    "day_index",
    "SELECT o_orderpriority AS series, CAST(o_orderdate AS DATE) AS date, CAST(date_diff('day', min(CAST(o_orderdate AS DATE)) "
    "OVER (PARTITION BY o_orderpriority), CAST(o_orderdate AS DATE)) AS INTEGER) AS day_index, count(*) AS n FROM orders "
    "GROUP BY o_orderpriority, o_orderdate",
)
def day_index(spark: SparkSession, d: str) -> DataFrame:
    daily = count_rows(
        read_table(spark, d, "orders"), [F.col("o_orderpriority").alias("series"), F.to_date("o_orderdate").alias("date")]
    )
    first = F.min("date").over(Window.partitionBy("series"))
    return daily.withColumn("day_index", F.date_diff("date", first))


@query(
    "split_label",
    f"""SELECT CASE WHEN CAST(l_shipdate AS DATE) <= DATE '{TRAIN_END}' THEN 'train'
    WHEN CAST(l_shipdate AS DATE) <= DATE '{VAL_END}' THEN 'val' ELSE 'test' END AS split, CAST(l_shipdate AS DATE) AS date, count(*) AS n
    FROM lineitem GROUP BY 1, 2""",
)
def split_labels(spark: SparkSession, d: str) -> DataFrame:
    days = count_rows(read_table(spark, d, "lineitem"), [F.to_date("l_shipdate").alias("date")])
    return days.withColumn("split", split_label(F.col("date"), t.PERIOD))


@query(
    "resum_spill_rows",
    """SELECT date, zone, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CAST(l_shipdate AS DATE) AS date, s_nationkey AS zone, l_returnflag AS src, count(*) AS n
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3) GROUP BY 1, 2""",
)
def resum_spill_rows(spark: SparkSession, d: str) -> DataFrame:
    """Partial counts per input (return flag stands for the file) merged per (date, zone)."""
    lines = read_table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("date"), "l_suppkey", "l_returnflag")
    zones = read_table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("zone"))
    partial = count_rows(lines.join(zones, lines.l_suppkey == zones.s_suppkey), ["date", "zone", "l_returnflag"])
    return resum(partial, ["date", "zone"], "n")

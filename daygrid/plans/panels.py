"""Joins, aggregations, windows and feature tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daygrid.functions.calendar import calendar_block
from daygrid.operators import counts, events, features, grid, metrics, quality, selection
from daygrid.operators.segments import sum_segments
from daygrid.plans import tables as t
from daygrid.plans.registry import query
from daygrid.plans.sqltext import CALENDAR, EXO, TRAIN_END, calendar_select, lag_select, r6, r6_all, with_ctes
from daygrid.session import stable
from daygrid.sources import sample
from daygrid.sources.readers import read_table


@query("join_exog_date", with_ctes(["panel", "exo"], "SELECT p.date, zone, demand, exo_mean, exo_sum FROM panel p LEFT JOIN exo USING (date)"))
def join_exog_date(spark: SparkSession, d: str) -> DataFrame:
    exo = sample.exo_daily(spark, d).select("date", "exo_mean", "exo_sum")
    return grid.join_daily(t.demand_panel(spark, d), exo, t.PERIOD)


@query("join_zone_events", with_ctes(["merged"], f"SELECT date, zone, demand, {r6('event_count_zone')} FROM merged"))
def join_zone_events(spark: SparkSession, d: str) -> DataFrame:
    mass = events.zone_event_mass(t.permits(spark, d), t.crosswalk(spark, d), "event_count_zone")
    wide_key = mass.withColumn("zone", F.col("zone").cast("long"))
    return t.rounded(grid.join_zone_events(t.demand_panel(spark, d), wide_key))


@query("join_one_to_one", with_ctes(["wide", "exo"], "SELECT date, member, casual, total, exo_sum, exo_count FROM wide JOIN exo USING (date)"))
def join_one_to_one(spark: SparkSession, d: str) -> DataFrame:
    daily = quality.require_one_to_one(t.daily_series(spark, d), ["date"], "daily demand")
    exo = quality.require_one_to_one(sample.exo_daily(spark, d).select("date", "exo_sum", "exo_count"), ["date"], "exo")
    return grid.join_daily(daily, exo, t.PERIOD)


@query("join_segments_exog", with_ctes(["seg", "exo"], "SELECT date, segment, n, exo_sum, exo_count FROM seg LEFT JOIN exo USING (date)"))
def join_segments_exog(spark: SparkSession, d: str) -> DataFrame:
    exo = sample.exo_daily(spark, d).select("date", "exo_sum", "exo_count")
    return grid.join_daily(sample.trip_segments(spark, d), exo, t.PERIOD)


@query(
    "crosswalk_join",
    with_ctes(["pairs", "cw"], f"SELECT date, precinct, LocationID AS zone, count(*) AS n, {r6('max(weight)', 'weight')} FROM pairs JOIN cw USING (precinct) GROUP BY 1, 2, 3"),
)
def crosswalk_join(spark: SparkSession, d: str) -> DataFrame:
    counted = counts.count_rows(events.precinct_pairs(t.permits(spark, d)), ["date", "precinct"])
    joined = counted.join(t.crosswalk(spark, d), "precinct")
    return t.rounded(joined.select("date", "precinct", F.col("LocationID").alias("zone"), "n", "weight"))


@query("complete_grid", with_ctes(["spine"], "SELECT date, n_nationkey AS zone FROM spine, nation"))
def complete_grid(spark: SparkSession, d: str) -> DataFrame:
    zones = sample.zone_lookup(spark, d).select(F.col("LocationID").alias("zone"))
    return grid.complete_grid(zones, t.PERIOD)


@query(
    "grid_zero_fill",
    with_ctes(["spine", "zcounts"], "SELECT g.date, g.zone, coalesce(demand, 0.0) AS demand FROM (SELECT date, n_nationkey AS zone FROM spine, nation) g LEFT JOIN zcounts z ON g.date = z.date AND g.zone = z.zone"),
)
def grid_zero_fill(spark: SparkSession, d: str) -> DataFrame:
    zones = sample.zone_lookup(spark, d).select(F.col("LocationID").alias("zone"))
    return grid.fill_grid(grid.complete_grid(zones, t.PERIOD), t.zone_counts(spark, d), ["date", "zone"], "demand")


@query(
    "pair_segments",
    with_ctes(["seg"], "SELECT a.date, a.n AS n_round, b.n AS n_point FROM seg a JOIN seg b ON a.date = b.date WHERE a.segment = 'rt_round' AND b.segment = 'rt_point'"),
)
def pair_segments(spark: SparkSession, d: str) -> DataFrame:
    """Days on which both segments occur; one grouped pass instead of a self join."""
    pair = {"rt_round": "n_round", "rt_point": "n_point"}
    seg = sample.trip_segments(spark, d).filter(F.col("segment").isin(list(pair)))
    wide = seg.groupBy("date").agg(*(F.max(F.when(F.col("segment") == s, F.col("n"))).alias(n) for s, n in pair.items()))
    return wide.dropna()


@query("daily_zone_counts", with_ctes(["trips"], "SELECT date, zone, CAST(count(*) AS DOUBLE) AS demand FROM trips GROUP BY 1, 2"))
def daily_zone_counts(spark: SparkSession, d: str) -> DataFrame:
    return sample.day_zone_counts(spark, d)


@query("daily_type_counts", with_ctes(["trips"], "SELECT date, member_casual, count(*) AS n FROM trips GROUP BY 1, 2"))
def daily_type_counts(spark: SparkSession, d: str) -> DataFrame:
    return sample.day_type_counts(spark, d)


@query("distinct_events_per_day", "SELECT CAST(o_orderdate AS DATE) AS date, count(DISTINCT o_orderkey) AS event_count FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def distinct_events_per_day(spark: SparkSession, d: str) -> DataFrame:
    """Distinct ordered keys per day. Lines are reduced to keys before the join."""
    keys = read_table(spark, d, "lineitem").select("l_orderkey").distinct()
    orders = read_table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("date"))
    return counts.distinct_per(keys.join(orders, keys.l_orderkey == orders.o_orderkey), "date", "o_orderkey")


@query("collapse_event_rows", with_ctes(["permits_all"], "SELECT DISTINCT event_id, day, police_precinct FROM permits_all"))
def collapse_event_rows(spark: SparkSession, d: str) -> DataFrame:
    return events.collapse_events(sample.permit_rows(spark, d))


@query("zone_event_mass", with_ctes(["zmass"], f"SELECT date, zone, {r6('event_count')} FROM zmass"))
def zone_event_mass(spark: SparkSession, d: str) -> DataFrame:
    return t.rounded(events.zone_event_mass(t.permits(spark, d), t.crosswalk(spark, d)))


@query("hourly_sum", f"SELECT CAST(date_trunc('hour', ts) AS DATE) AS date, CAST(hour(ts) AS INTEGER) AS hour, {r6('sum(value)', 'ridership')} FROM events GROUP BY 1, 2")
def hourly_sum(spark: SparkSession, d: str) -> DataFrame:
    ts = F.col("transit_timestamp")
    hourly = sample.hourly_events(spark, d)
    return t.rounded(hourly.select(F.to_date(ts).alias("date"), F.hour(ts).alias("hour"), "ridership"))


@query("segment_counts", with_ctes(["seg"], "SELECT date, segment, n FROM seg"))
def segment_counts(spark: SparkSession, d: str) -> DataFrame:
    return sample.trip_segments(spark, d)


_HOURLY = ("hours", "SELECT CAST(ts AS DATE) AS date, hour(ts) AS hour, sum(value) AS ridership FROM events GROUP BY 1, 2")


@query(
    "segment_sums",
    with_ctes(
        [],
        """SELECT date, segment, CAST(round_even(round(sum(ridership), 6), 0) AS BIGINT) AS n FROM (SELECT date, ridership,
        unnest(['all', CASE WHEN isodow(date) < 6 AND hour IN (7, 8, 9) THEN 'time_wdAM'
        WHEN isodow(date) >= 6 AND hour IN (11, 12, 13, 14, 15) THEN 'time_weMID' END]) AS segment FROM hours)
        WHERE segment IS NOT NULL GROUP BY 1, 2""",
        [_HOURLY],
    ),
)
def segment_sums(spark: SparkSession, d: str) -> DataFrame:
    return sum_segments(sample.hourly_events(spark, d), "transit_timestamp", "ridership", sample.SAMPLE_WINDOWS)


@query("segment_sums_orders", with_ctes(["oseg"], "SELECT date, segment, n FROM oseg"))
def segment_sums_orders(spark: SparkSession, d: str) -> DataFrame:
    return sample.order_segments(spark, d)


@query("pivot_types", with_ctes(["wide"], "SELECT date, member, casual, total FROM wide"))
def pivot_types(spark: SparkSession, d: str) -> DataFrame:
    return t.daily_series(spark, d)


@query("panel_to_total", with_ctes(["panel", "exo"], "SELECT p.date, sum(demand) AS y, max(exo_sum) AS exo_sum FROM panel p JOIN exo USING (date) GROUP BY 1"))
def panel_to_total(spark: SparkSession, d: str) -> DataFrame:
    exo = sample.exo_daily(spark, d).select("date", "exo_sum")
    return counts.panel_to_total(grid.join_daily(t.demand_panel(spark, d), exo, t.PERIOD), "demand", ["exo_sum"])


@query("segment_summary", with_ctes(["seg"], f"SELECT segment, count(*) AS days, {r6('avg(n)', 'mean_per_day')} FROM seg GROUP BY 1"))
def segment_summary(spark: SparkSession, d: str) -> DataFrame:
    return t.rounded(counts.summarize(sample.trip_segments(spark, d), "segment", "n"))


@query("type_share", with_ctes(["wide"], f"SELECT {r6('sum(member) / sum(total)', 'share')} FROM wide"))
def type_share(spark: SparkSession, d: str) -> DataFrame:
    return t.rounded(counts.type_share(t.daily_series(spark, d), "member", "total"))


@query("within_day_variance", with_ctes(["merged"], f"SELECT date, {r6('coalesce(var_samp(event_count_zone), 0.0)', 'variance')} FROM merged GROUP BY 1"))
def within_day_variance(spark: SparkSession, d: str) -> DataFrame:
    return t.rounded(counts.within_day_variance(t.merged_panel(spark, d), "event_count_zone"))


@query("exact_quantile", with_ctes(["seg"], f"SELECT segment, {r6('quantile_cont(n, 0.9)', 'q90')}, {r6('quantile_cont(n, 0.025)', 'q025')} FROM seg GROUP BY 1"))
def exact_quantile(spark: SparkSession, d: str) -> DataFrame:
    """Exact quantiles of the daily counts of each segment (one value per day and segment)."""
    q = F.percentile("n", F.array(F.lit(0.9), F.lit(0.025)))
    out = sample.trip_segments(spark, d).groupBy("segment").agg(q.alias("q"))
    return t.rounded(out.select("segment", F.col("q")[0].alias("q90"), F.col("q")[1].alias("q025")))


@query(
    "line_quantiles",
    """SELECT l_returnflag, l_linestatus, round(quantile_cont(l_extendedprice, 0.5), 6) + 0.0 AS median_price,
    round(quantile_cont(l_extendedprice, 0.975), 6) + 0.0 AS high_price FROM lineitem GROUP BY 1, 2""",
)
def line_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Exact quantiles of all line prices by flag and status: four groups that hold all lines."""
    keys = ["l_returnflag", "l_linestatus"]
    lines = read_table(spark, d, "lineitem").select(*keys, "l_extendedprice")
    half = selection.exact_quantile(lines, keys, "l_extendedprice", 0.5, "median_price")
    return t.rounded(half.join(selection.exact_quantile(lines, keys, "l_extendedprice", 0.975, "high_price"), keys))


@query("fit_line", with_ctes(["series", "exo"], f"SELECT target, {r6('regr_slope(y, exo_count)', 'slope')}, {r6('regr_intercept(y, exo_count)', 'intercept')} FROM series JOIN exo USING (date) GROUP BY 1"))
def fit_line(spark: SparkSession, d: str) -> DataFrame:
    exo = sample.exo_daily(spark, d).select("date", "exo_count")
    return t.rounded(metrics.fit_line(grid.join_daily(t.target_series(spark, d), exo, t.PERIOD), ["target"], "y", "exo_count"))


@query("profile_table", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, min(CAST(l_shipdate AS DATE)) AS first_day, max(CAST(l_shipdate AS DATE)) AS last_day, max(l_quantity) AS max_qty FROM lineitem GROUP BY 1")
def profile_table(spark: SparkSession, d: str) -> DataFrame:
    """Run summary per return flag; lines fall to (flag, supplier) rows first, so a heavy flag stays small."""
    day = F.to_date("l_shipdate")
    per = read_table(spark, d, "lineitem").groupBy("l_returnflag", "l_suppkey").agg(
        F.min(day).alias("lo"), F.max(day).alias("hi"), F.max("l_quantity").alias("q")
    )
    return per.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("suppliers"), F.min("lo").alias("first_day"), F.max("hi").alias("last_day"), F.max("q").alias("max_qty")
    )


@query("lag_features", with_ctes(["feats"], "SELECT date, zone, demand_lag_1, demand_lag_2, demand_lag_3, demand_lag_7, demand_lag_14 FROM feats"))
def lag_features(spark: SparkSession, d: str) -> DataFrame:
    w = features.by_day("zone")
    return t.demand_panel(spark, d).select("date", "zone", *features.lags("demand", t.PANEL.lags, w, "demand_lag_"))


@query("series_lags", with_ctes(["series"], f"SELECT date, target, lag_y_1, lag_y_7, lag_y_14 FROM (SELECT date, target, {lag_select('target')} FROM series)"))
def series_lags(spark: SparkSession, d: str) -> DataFrame:
    w = features.by_day("target")
    return t.target_series(spark, d).select("date", "target", *features.lags("y", t.SERIES.lags, w, "lag_y_"))


@query("rolling_mean_prev", with_ctes(["feats"], f"SELECT date, zone, {r6('demand_rolling_mean_7')} FROM feats"))
def rolling_mean_prev(spark: SparkSession, d: str) -> DataFrame:
    w = features.by_day("zone")
    out = t.demand_panel(spark, d).select("date", "zone", *features.rolling_means("demand", t.PANEL.rolling, w, "demand_rolling_mean_"))
    return t.rounded(out)


@query("abs_diff", with_ctes(["series"], "SELECT date, target, abs(y - lag(y) OVER (PARTITION BY target ORDER BY date)) AS change FROM series"))
def abs_diff(spark: SparkSession, d: str) -> DataFrame:
    w = features.by_day("target")
    return t.target_series(spark, d).select("date", "target", F.abs(F.col("y") - F.lag("y").over(w)).alias("change"))


@query("broadcast_daily_total", with_ctes(["panel"], "SELECT date, zone, demand, sum(demand) OVER (PARTITION BY date) AS day_total FROM panel"))
def broadcast_daily_total(spark: SparkSession, d: str) -> DataFrame:
    return events.with_daily_total(t.demand_panel(spark, d), "demand", "day_total")


@query("top_zones_train", with_ctes(["top"], "SELECT zone, total FROM top"))
def top_zones_train(spark: SparkSession, d: str) -> DataFrame:
    p = t.PANEL
    return counts.top_keys(sample.day_zone_counts(spark, d, t.PERIOD), "zone", "demand", t.PERIOD.train_end, p.top_n, p.exclude)


@query("event_mass_share", with_ctes(["zmass"], f"SELECT zone, {r6('sum(event_count)', 'mass')}, {r6('sum(event_count) / sum(sum(event_count)) OVER ()', 'share')} FROM zmass GROUP BY zone"))
def event_mass_share(spark: SparkSession, d: str) -> DataFrame:
    """Share of the event mass that falls on each zone (one row per zone)."""
    mass = events.zone_event_mass(t.permits(spark, d), t.crosswalk(spark, d))
    per_zone = stable(mass.groupBy("zone").agg(F.sum("event_count").alias("mass")), "mass")
    whole = per_zone.agg(F.sum("mass").alias("whole")).withColumn("_k", F.lit(1))
    shared = per_zone.withColumn("_k", F.lit(1)).join(F.broadcast(whole), "_k")
    return t.rounded(shared.select("zone", "mass", (F.col("mass") / F.col("whole")).alias("share")))


@query(
    "panel_features",
    with_ctes(
        ["feats"],
        """SELECT date, zone, demand, exo_sum, exo_high, exo_low, exo_count, event_count, demand_lag_1, demand_lag_2, demand_lag_3,
        demand_lag_7, demand_lag_14, is_weekend, is_holiday, """
        + r6_all(["event_count_zone", "event_count_manhattan", "demand_rolling_mean_7", "dow_sin", "dow_cos", "month_sin", "month_cos"])
        + " FROM feats",
    ),
)
def panel_features(spark: SparkSession, d: str) -> DataFrame:
    return t.rounded(t.panel_table(spark, d))


@query(
    "calendar_block",
    with_ctes(["seg", "hol"], f"SELECT date, segment, n, {r6_all(CALENDAR)} FROM (SELECT date, segment, n, {calendar_select()} FROM seg)"),
)
def calendar_columns(spark: SparkSession, d: str) -> DataFrame:
    seg = sample.trip_segments(spark, d)
    return t.rounded(seg.select(*seg.columns, *calendar_block(F.col("date"), t.PERIOD.start)))


@query(
    "ablation_columns",
    with_ctes(
        ["feats"],
        """SELECT condition, CAST(base + extra AS BIGINT) AS n_columns, (SELECT count(*) FROM feats WHERE demand_lag_14 IS NOT NULL) AS n_rows
        FROM (VALUES ('A', 12, 0), ('B', 12, 4), ('C', 12, 1), ('Cprime', 12, 1), ('D', 12, 5), ('E', 12, 1)) v(condition, base, extra)""",
    ),
)
def ablation_columns(spark: SparkSession, d: str) -> DataFrame:
    """Column and complete-row count per condition, all from one scan of one feature table."""
    table = t.panel_table(spark, d)
    conditions = features.panel_conditions(table.columns, EXO)
    features.check_nested(conditions)
    complete = {n: sum((F.col(c).isNull().cast("int") for c in cols), F.lit(0)) == 0 for n, cols in conditions.items()}
    counted = table.agg(*(F.count_if(ok).alias(n) for n, ok in complete.items()))
    long = counted.unpivot([], list(conditions), "condition", "n_rows")
    sizes = F.create_map(*(x for n, cols in conditions.items() for x in (F.lit(n), F.lit(len(cols)).cast("long"))))
    return long.select("condition", sizes[F.col("condition")].alias("n_columns"), "n_rows")


@query(
    "event_encodings",
    with_ctes(["merged"], f"SELECT date, zone, event_count, {r6('event_count_zone')}, {r6('event_count_manhattan')} FROM merged"),
)
def event_encodings(spark: SparkSession, d: str) -> DataFrame:
    return t.rounded(t.merged_panel(spark, d).select("date", "zone", "event_count", "event_count_zone", "event_count_manhattan"))


@query("crosswalk_weights", with_ctes(["cw"], f"SELECT precinct, LocationID, {r6('weight')} FROM cw"))
def crosswalk_weights(spark: SparkSession, d: str) -> DataFrame:
    return t.rounded(t.crosswalk(spark, d))


_STD = ["demand_lag_1", "demand_lag_7", "demand_rolling_mean_7", "exo_sum", "exo_count"]


@query(
    "standardize_train",
    with_ctes(
        ["feats"],
        "SELECT date, zone, "
        + ", ".join(r6(f"(f.{c} - m_{c}) / s_{c}", c) for c in _STD)
        + " FROM feats f, (SELECT "
        + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in _STD)
        + f" FROM feats WHERE date <= DATE '{TRAIN_END}' AND demand_lag_14 IS NOT NULL) m WHERE demand_lag_14 IS NOT NULL",
    ),
)
def standardize_train(spark: SparkSession, d: str) -> DataFrame:
    table = stable(t.panel_table(spark, d).dropna().select("date", "zone", *_STD), "panel")
    return t.rounded(features.standardize(table, _STD, t.is_train()))


@query(
    "zone_onehot",
    with_ctes(
        ["panel"],
        f"""SELECT p.date, p.zone, list_sum(list_transform(cats, lambda c: CAST(c = p.zone AS INTEGER)))::BIGINT AS ones,
        CAST(coalesce(list_position(cats, p.zone), 0) AS BIGINT) AS position
        FROM panel p, (SELECT (list(DISTINCT zone ORDER BY zone))[2:] AS cats FROM panel WHERE date <= DATE '{TRAIN_END}') c""",
    ),
)
def zone_onehot(spark: SparkSession, d: str) -> DataFrame:
    """Indicator block of the panel: sum of the indicators and position of the one that is set."""
    panel = stable(t.demand_panel(spark, d), "panel")
    cats = zone_categories(panel)
    cols = features.zone_indicators(cats)
    block = panel.select("date", "zone", F.array(*(c.cast("long") for c in cols)).alias("x"))
    ones = F.aggregate("x", F.lit(0).cast("long"), lambda a, v: a + v)
    place = F.array_position("x", F.lit(1).cast("long"))
    return block.select("date", "zone", ones.alias("ones"), place.alias("position"))


def zone_categories(panel: DataFrame) -> list[int]:
    """Train zones of the panel, which become column names; more than top_n of them are an error."""
    rows = panel.filter(t.is_train()).select("zone").distinct().orderBy("zone").limit(t.PANEL.top_n + 1).collect()
    if len(rows) > t.PANEL.top_n:
        raise ValueError(f"the panel has more than {t.PANEL.top_n} zones")
    return [r.zone for r in rows]


@query(
    "missing_days",
    with_ctes([], """SELECT CAST(s AS DATE) AS date FROM (SELECT unnest(generate_series((SELECT CAST(min(l_shipdate) AS DATE) FROM lineitem),
    (SELECT CAST(max(l_shipdate) AS DATE) FROM lineitem), INTERVAL 1 DAY)) AS s) WHERE CAST(s AS DATE) NOT IN
    (SELECT DISTINCT CAST(o_orderdate AS DATE) FROM orders)"""),
)
def missing_days(spark: SparkSession, d: str) -> DataFrame:
    """Days of the ship-date range on which nothing was ordered."""
    day = F.to_date("l_shipdate")
    edge = read_table(spark, d, "lineitem").agg(F.min(day).alias("lo"), F.max(day).alias("hi"))
    full = edge.select(F.explode(F.sequence("lo", "hi", F.expr("interval 1 day"))).alias("date"))
    return grid.missing_days(full, read_table(spark, d, "orders").select(F.to_date("o_orderdate").alias("date")))

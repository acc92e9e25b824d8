"""Baselines, anomalies, linear and tree models, metrics and effect tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from daygrid.config import PANEL_RIDGE_ALPHA, SERIES_RIDGE_ALPHA, SearchSettings
from daygrid.functions.stats import safe_corr
from daygrid.operators import features, grid, linear, metrics, trees
from daygrid.operators.segments import AXES
from daygrid.plans import panels
from daygrid.plans import tables as t
from daygrid.plans.registry import query
from daygrid.plans.sqltext import (
    ALPHA_ROWS,
    BASELINE,
    CALENDAR,
    EXO,
    LAGS,
    TRAIN_END,
    VAL_END,
    corr_expr,
    hash_uniform,
    lag_select,
    orthogonalize,
    r6,
    r6_all,
    residual_ctes,
    ridge,
    ridge_search,
    with_ctes,
)
from daygrid.session import stable
from daygrid.sources import sample
from daygrid.sources.readers import union_all

FIXED_ALPHA = 10.0
ANOM = [f"anom_{v}" for v in EXO]
CONDITION_COLUMNS = {"A": CALENDAR, "B": [*CALENDAR, *ANOM], "C": [*CALENDAR, *LAGS], "D": [*CALENDAR, *ANOM, *LAGS]}

# ---- SQL relations shared by the checks of this family -------------------------------------
_SERIES_EXO = ("sx", "SELECT date, target, y, exo_sum, exo_high, exo_low, exo_count FROM series JOIN exo USING (date)")
_SERIES_RES = [_SERIES_EXO, *residual_ctes("sx", ["target"])]
_SEG_EXO = ("gx_in", "SELECT date, segment, CAST(n AS DOUBLE) AS y, exo_sum, exo_high, exo_low, exo_count FROM seg JOIN exo USING (date)")
_SEG_RES = [_SEG_EXO, *residual_ctes("gx_in", ["segment"])]
_MODE_EXO = ("mx_in", "SELECT date, mode, segment, CAST(n AS DOUBLE) AS y, exo_sum, exo_high, exo_low, exo_count FROM modes JOIN exo USING (date)")
_MODE_RES = [_MODE_EXO, *residual_ctes("mx_in", ["mode", "segment"])]
# Series feature table: calendar, anomalies and lags.
_FEATURES = [
    *_SERIES_RES,
    ("lagged", f"SELECT date, target, {lag_select('target')} FROM series"),
    (
        "sf",
        f"SELECT res.*, CAST(res.date IN (SELECT date FROM hol) AS DOUBLE) AS cal_is_holiday, {', '.join(LAGS)} "
        "FROM res JOIN lagged USING (date, target)",
    ),
    ("sfc", "SELECT * FROM sf WHERE lag_y_14 IS NOT NULL"),
]
_FEATURE_NEEDS = ["series", "exo", "hol"]


def _ridge_at(prefix: str, source: str, keys: list[str], xs: list[str], alpha: float) -> list[tuple[str, str]]:
    return ridge(prefix, source, keys, xs, "y", f"(SELECT 0 AS a, CAST({alpha} AS DOUBLE) AS alpha)")


def _loo(prefix: str, source: str, keys: list[str], xs: list[str]) -> list[tuple[str, str]]:
    """Leave-one-out ridge: ``<prefix>_loo`` per alpha and ``<prefix>_best`` rows at the chosen one."""
    k = ", ".join(keys)
    return [
        (f"{prefix}_al", ALPHA_ROWS),
        *ridge(prefix, source, keys, xs, "y", f"{prefix}_al"),
        (
            f"{prefix}_loo",
            f"SELECT {k}, a, avg(power(o.y / (1 - o.hat - 1.0 / t.n), 2)) AS loo_mse FROM {prefix}_out o "
            f"JOIN {prefix}_st t USING ({k}) WHERE kind = 0 AND is_train GROUP BY {k}, a",
        ),
        (f"{prefix}_pick", f"SELECT {k}, arg_min(a, (loo_mse, a)) AS a FROM {prefix}_loo GROUP BY {k}"),
        (f"{prefix}_best", f"SELECT o.* FROM {prefix}_out o JOIN {prefix}_pick p USING ({k}, a)"),
    ]


def _test_r2(prefix: str, source: str, keys: list[str], test: str = f"date > DATE '{VAL_END}'") -> tuple[str, str]:
    """Test R2 of the chosen ridge; data rows hold y - fitted."""
    k = ", ".join(keys)
    return (
        f"{prefix}_r2",
        f"SELECT {k}, 1 - sum(o.y * o.y) / (var_pop(s.y) * count(*)) AS r2 FROM {prefix}_best o JOIN {source} s USING ({k}, date) "
        f"WHERE kind = 0 AND {test} GROUP BY {k}",
    )


# ---- baselines ------------------------------------------------------------------------------
@query("calendar_residual", with_ctes(["series", "exo"], f"SELECT date, target, {r6('resid')} FROM res", _SERIES_RES))
def calendar_residual(spark: SparkSession, d: str) -> DataFrame:
    series = stable(t.with_calendar(t.target_series(spark, d)), "series")
    out = linear.residuals(series, ["target"], {"y": BASELINE}, t.is_train(), {"y": "resid"})
    return t.rounded(out.select("date", "target", "resid"))


@query(
    "exog_anomaly",
    with_ctes(["series", "exo"], f"SELECT date, {r6_all(ANOM)} FROM res WHERE target = 'total'", _SERIES_RES),
)
def exog_anomaly(spark: SparkSession, d: str) -> DataFrame:
    return t.rounded(t.anomalies(spark, d))


@query(
    "weekday_mean_baseline",
    with_ctes(
        ["series"],
        f"""SELECT date, target, round(avg(y) FILTER (WHERE date <= DATE '{TRAIN_END}') OVER (PARTITION BY target, isodow(date)), 6) + 0.0 AS baseline
        FROM series""",
    ),
)
def weekday_mean_baseline(spark: SparkSession, d: str) -> DataFrame:
    y = stable(t.target_series(spark, d).withColumn("dow", F.weekday("date")), "series")
    mean = y.filter(t.is_train()).groupBy("target", "dow").agg(F.avg("y").alias("baseline"))
    return t.rounded(y.join(mean, ["target", "dow"], "left").select("date", "target", "baseline"))


@query("seasonal_naive", with_ctes(["feats"], "SELECT date, zone, demand, demand_lag_7 AS pred FROM feats WHERE demand_lag_14 IS NOT NULL"))
def seasonal_naive(spark: SparkSession, d: str) -> DataFrame:
    w = features.by_day("zone")
    lagged = t.demand_panel(spark, d).select("date", "zone", "demand", *features.lags("demand", (1, 7, 14), w, "demand_lag_"))
    pred = F.col(naive_column(lagged.columns))
    return lagged.dropna().select("date", "zone", "demand", pred.alias("pred"))


def naive_column(columns: list[str]) -> str:
    """The 7-day lag, or the 1-day lag where it is absent."""
    for name in ("demand_lag_7", "demand_lag_1"):
        if name in columns:
            return name
    raise ValueError("seasonal naive needs demand_lag_7 or demand_lag_1")


_SPLIT = f"CASE WHEN date <= DATE '{TRAIN_END}' THEN 'train' WHEN date <= DATE '{VAL_END}' THEN 'val' ELSE 'test' END"


def _score_sql(split: str, y: str = "y", pred: str = "pred") -> str:
    f = f"FILTER (WHERE split = '{split}')"
    mse = f"avg(({y} - {pred}) * ({y} - {pred})) {f}"
    sst = f"var_pop({y}) {f}"
    r2 = f"CASE WHEN {sst} > 0 THEN 1 - {mse} / ({sst}) WHEN {mse} = 0 THEN 1.0 ELSE 0.0 END"
    return f"avg(abs({y} - {pred})) {f} AS {split}_mae, sqrt({mse}) AS {split}_rmse, {r2} AS {split}_r2"


_SCORES = [f"{p}_{m}" for p in ("val", "test") for m in ("mae", "rmse", "r2")]


@query(
    "series_metrics",
    with_ctes(
        ["series"],
        f"SELECT target, {r6_all(_SCORES)} FROM (SELECT target, {_score_sql('val')}, {_score_sql('test')} FROM "
        f"(SELECT target, y, lag(y, 7) OVER (PARTITION BY target ORDER BY date) AS pred, {_SPLIT} AS split FROM series) GROUP BY 1)",
    ),
)
def series_metrics(spark: SparkSession, d: str) -> DataFrame:
    w = features.by_day("target")
    y = t.with_split(t.target_series(spark, d).withColumn("pred", F.lag("y", 7).over(w)))
    return t.rounded(metrics.score_splits(y, ["target"], "y", "pred"))


_ZONE_SCORES = [
    ("zs", f"SELECT zone, demand AS y, demand_lag_7 AS pred, {_SPLIT} AS split FROM feats WHERE demand_lag_14 IS NOT NULL"),
    ("zm", f"SELECT zone, {_score_sql('val')}, {_score_sql('test')} FROM zs GROUP BY zone"),
]


@query(
    "zone_mean_metrics",
    with_ctes(
        ["feats"],
        "SELECT 'SeasonalNaive' AS model, " + ", ".join(r6(f"avg({c})", c) for c in _SCORES) + " FROM zm",
        _ZONE_SCORES,
    ),
)
def zone_mean_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: trips to complete zone panel, lags, seasonal-naive forecast, zone-mean scores."""
    scored = t.with_split(seasonal_naive(spark, d).withColumn("model", F.lit("SeasonalNaive")))
    return t.rounded(metrics.score_zone_mean(scored, ["model"], "demand", "pred"))


# ---- series features and correlations ---------------------------------------------------------
@query(
    "series_features",
    with_ctes(_FEATURE_NEEDS, f"SELECT date, target, y, {r6_all([*CALENDAR, *ANOM, *LAGS])} FROM sf", _FEATURES),
)
def series_features(spark: SparkSession, d: str) -> DataFrame:
    return t.rounded(t.series_table(spark, d))


def _clean(spark: SparkSession, d: str) -> DataFrame:
    return t.series_table(spark, d).dropna()


_CLEAN_RES = [
    *_FEATURES,
    ("cd", f"SELECT target, date, is_train, y, 1.0 AS one, {', '.join([*BASELINE, *ANOM])} FROM sfc"),
    *orthogonalize("gc", "cd", ["target"], ["one", *BASELINE], ["y"], ["date", *ANOM]),
]


@query(
    "resid_anom_corr",
    with_ctes(
        _FEATURE_NEEDS,
        " UNION ALL ".join(f"SELECT target, '{a}' AS anomaly, {r6(corr_expr(a, 'y'), 'corr_with_residual')} FROM gc_out GROUP BY target" for a in ANOM),
        _CLEAN_RES,
    ),
)
def resid_anom_corr(spark: SparkSession, d: str) -> DataFrame:
    rows = stable(_clean(spark, d), "clean")
    res = linear.residuals(rows, ["target"], {"y": BASELINE}, t.is_train(), {"y": "resid"})
    wide = metrics.correlations(res, ["target"], "resid", {a: a for a in ANOM})
    return t.rounded(wide.unpivot("target", ANOM, "anomaly", "corr_with_residual"))


_SHOCK = [
    ("ts", f"SELECT date, target, anom_exo_sum, abs(anom_exo_sum - lag(anom_exo_sum) OVER (PARTITION BY target ORDER BY date)) AS change FROM sfc WHERE date > DATE '{VAL_END}'"),
    ("shock", "SELECT t.date, t.target, t.change, c.cut AS threshold, coalesce(t.change >= c.cut, false) AS is_shock FROM ts t JOIN (SELECT target, quantile_cont(change, 0.9) AS cut FROM ts GROUP BY target) c USING (target)"),
]


@query(
    "shock_days",
    with_ctes(_FEATURE_NEEDS, f"SELECT date, target, {r6('change')}, {r6('threshold')}, is_shock FROM shock", [*_FEATURES, *_SHOCK]),
)
def shock_days(spark: SparkSession, d: str) -> DataFrame:
    test = stable(_clean(spark, d).filter(t.is_test()).select("date", "target", "anom_exo_sum"), "test")
    flagged = features.shock_days(test, "anom_exo_sum", t.SERIES.shock_quantile, ["target"])
    return t.rounded(flagged.select("date", "target", "change", "threshold", "is_shock"))


# ---- ridge -------------------------------------------------------------------------------------
@query(
    "ridge_fixed_alpha",
    with_ctes(
        _FEATURE_NEEDS,
        f"SELECT o.date, o.target, 'D' AS condition, {r6('s.y - o.y', 'pred')} FROM rd_out o JOIN sfc s USING (date, target) WHERE kind = 0",
        [*_FEATURES, *_ridge_at("rd", "sfc", ["target"], CONDITION_COLUMNS["D"], FIXED_ALPHA)],
    ),
)
def ridge_fixed_alpha(spark: SparkSession, d: str) -> DataFrame:
    rows = stable(_clean(spark, d), "clean")
    conditions = {"D": CONDITION_COLUMNS["D"]}
    models = linear.fit_ridge(rows, ["target"], conditions, "y", t.is_train(), FIXED_ALPHA)
    return t.rounded(linear.predict(rows, models, ["target"], conditions).select("date", "target", "condition", "pred"))


_LOO_D = [*_FEATURES, *_loo("ld", "sfc", ["target"], CONDITION_COLUMNS["D"])]


@query(
    "ridge_loo",
    with_ctes(
        _FEATURE_NEEDS,
        f"SELECT target, 'D' AS condition, l.a, {r6('b.alpha', 'alpha')}, {r6('loo_mse')} FROM ld_loo l JOIN ld_al b USING (a)",
        _LOO_D,
    ),
)
def ridge_loo(spark: SparkSession, d: str) -> DataFrame:
    """Leave-one-out error of all 30 penalties for every target."""
    rows = stable(_clean(spark, d), "clean")
    conditions = {"D": CONDITION_COLUMNS["D"]}
    systems = linear.ridge_systems(rows, ["target"], conditions, "y", t.is_train())
    return t.rounded(linear.loo_errors(rows, systems, ["target"], conditions, "y", t.is_train()))


_COEFS = (
    "coefs",
    "SELECT target, CASE probe " + " ".join(f"WHEN {j} THEN '{c}'" for j, c in enumerate(CONDITION_COLUMNS["D"]))
    + " END AS feature, CASE probe " + " ".join(
        f"WHEN {j} THEN '{features.FEATURE_GROUPS[c.split('_')[0]]}'" for j, c in enumerate(CONDITION_COLUMNS["D"]))
    + " END AS feature_group, -y AS std_coef FROM ld_best WHERE kind = 2",
)


def _coefficients(spark: SparkSession, d: str) -> DataFrame:
    rows = stable(_clean(spark, d), "clean")
    conditions = {"D": CONDITION_COLUMNS["D"]}
    models = linear.fit_ridge_loo(rows, ["target"], conditions, "y", t.is_train())
    out = linear.standardized_coefficients(models, ["target"], conditions)
    group = F.create_map(*(F.lit(x) for kv in features.FEATURE_GROUPS.items() for x in kv))
    return out.select("target", "feature", group[F.split("feature", "_")[0]].alias("feature_group"), "std_coef", "abs")


@query("standardized_coefs", with_ctes(_FEATURE_NEEDS, f"SELECT target, feature, feature_group, {r6('std_coef')}, {r6('abs(std_coef)', 'abs')} FROM coefs", [*_LOO_D, _COEFS]))
def standardized_coefs(spark: SparkSession, d: str) -> DataFrame:
    return t.rounded(_coefficients(spark, d))


@query(
    "top_coefs",
    with_ctes(
        _FEATURE_NEEDS,
        f"""SELECT target, rank, feature, {r6('std_coef')} FROM (SELECT *, CAST(row_number() OVER (PARTITION BY target
        ORDER BY abs(std_coef) DESC, feature) AS INTEGER) AS rank FROM coefs) WHERE rank <= 6""",
        [*_LOO_D, _COEFS],
    ),
)
def top_coefs(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("target").orderBy(F.desc("abs"), "feature")
    ranked = _coefficients(spark, d).withColumn("rank", F.row_number().over(w)).filter("rank <= 6")
    return t.rounded(ranked.select("target", "rank", "feature", "std_coef"))


@query("group_max_coefs", with_ctes(_FEATURE_NEEDS, f"SELECT target, feature_group, {r6('max(abs(std_coef))', 'max_abs')} FROM coefs GROUP BY 1, 2", [*_LOO_D, _COEFS]))
def group_max_coefs(spark: SparkSession, d: str) -> DataFrame:
    return t.rounded(_coefficients(spark, d).groupBy("target", "feature_group").agg(F.max("abs").alias("max_abs")))


@query(
    "alpha_grid",
    with_ctes(
        ["series"],
        f"""SELECT target, a, {r6('alpha')}, {r6('szy / (n + alpha)', 'coef')} FROM (SELECT target, count(*) AS n,
        covar_pop(prev, y) * count(*) / stddev_pop(prev) AS szy FROM (SELECT *, lag(y) OVER (PARTITION BY target ORDER BY date) AS prev FROM series)
        WHERE date <= DATE '{TRAIN_END}' AND prev IS NOT NULL GROUP BY target), al""",
        [("al", ALPHA_ROWS)],
    ),
)
def alpha_grid(spark: SparkSession, d: str) -> DataFrame:
    """Shrinkage path of the one-day lag over the penalty grid."""
    w = features.by_day("target")
    y = t.target_series(spark, d).withColumn("prev", F.lag("y").over(w)).filter(t.is_train() & F.col("prev").isNotNull())
    n = F.count(F.lit(1))
    stat = y.groupBy("target").agg(n.alias("n"), (F.covar_pop("prev", "y") * n / F.stddev_pop("prev")).alias("szy"))
    grid_rows = F.posexplode(F.array(*(F.lit(a) for a in linear.ALPHA_GRID))).alias("a", "alpha")
    path = stat.select("target", "n", "szy", grid_rows)
    return t.rounded(path.select("target", "a", "alpha", (F.col("szy") / (F.col("n") + F.col("alpha"))).alias("coef")))


@query(
    "shock_mae",
    with_ctes(
        _FEATURE_NEEDS,
        " UNION ALL ".join(
            f"""SELECT target, '{c}' AS condition, {r6('avg(abs(o.y))', 'mae_all')}, {r6('avg(abs(o.y)) FILTER (WHERE is_shock)', 'mae_shock')},
            count(*) FILTER (WHERE is_shock) AS n_shock FROM l{c.lower()}_best o JOIN shock USING (date, target) WHERE kind = 0 GROUP BY target"""
            for c in ("C", "D")
        ),
        [*_FEATURES, *_SHOCK, *_loo("lc", "sfc", ["target"], CONDITION_COLUMNS["C"]), *_loo("ld", "sfc", ["target"], CONDITION_COLUMNS["D"])],
    ),
)
def shock_mae(spark: SparkSession, d: str) -> DataFrame:
    """Error on all test days and on shock days, without (C) and with (D) the outside variables."""
    rows = stable(_clean(spark, d), "clean")
    conditions = {c: CONDITION_COLUMNS[c] for c in ("C", "D")}
    models = linear.fit_ridge_loo(rows, ["target"], conditions, "y", t.is_train())
    test = features.shock_days(rows.filter(t.is_test()), "anom_exo_sum", t.SERIES.shock_quantile, ["target"])
    pred = linear.predict(test, models, ["target"], conditions)
    err = F.abs(F.col("y") - F.col("pred"))
    return t.rounded(
        pred.groupBy("target", "condition").agg(
            F.avg(err).alias("mae_all"),
            F.avg(F.when(F.col("is_shock"), err)).alias("mae_shock"),
            F.count_if("is_shock").alias("n_shock"),
        )
    )


@query(
    "date_block_folds",
    with_ctes(
        ["panel"],
        f"""SELECT f.fold, CASE WHEN pos >= lo THEN 'test' ELSE 'train' END AS role, min(date) AS first_day, max(date) AS last_day, count(*) AS n_days
        FROM (SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos FROM (SELECT DISTINCT date FROM panel WHERE date <= DATE '{TRAIN_END}')) d,
        (SELECT i AS fold, n - (5 - i) * (n // 6) AS lo, n - (4 - i) * (n // 6) AS hi FROM
        (SELECT count(DISTINCT date) AS n FROM panel WHERE date <= DATE '{TRAIN_END}') c, (SELECT CAST(range AS INTEGER) AS i FROM range(5)) r) f
        WHERE pos < hi GROUP BY 1, 2""",
    ),
)
def date_block_folds(spark: SparkSession, d: str) -> DataFrame:
    train = t.demand_panel(spark, d).filter(t.is_train())
    folds = features.date_blocks(train, SearchSettings().folds)
    return folds.groupBy("fold", "role").agg(
        F.min("date").alias("first_day"), F.max("date").alias("last_day"), F.count(F.lit(1)).alias("n_days")
    )


_SEED_TEXT = "'42:' || range"
_LOG_RANGE = f"exp(ln({SERIES_RIDGE_ALPHA[0]}) + {hash_uniform(_SEED_TEXT)} * (ln({SERIES_RIDGE_ALPHA[1]}) - ln({SERIES_RIDGE_ALPHA[0]})))"
_SEARCH = [
    *_FEATURES,
    ("dr", f"SELECT CAST(range AS INTEGER) AS a, {_LOG_RANGE} AS alpha FROM range(20)"),
    ("pos", f"SELECT date, target, row_number() OVER (PARTITION BY target ORDER BY date) - 1 AS pos, count(*) OVER (PARTITION BY target) AS n FROM sfc WHERE date <= DATE '{TRAIN_END}'"),
    (
        "folded",
        f"SELECT s.* EXCLUDE (is_train), f.fold, p.pos < p.n - (5 - f.fold) * (p.n // 6) AS is_train FROM sfc s JOIN pos p USING (date, target), "
        "(SELECT CAST(range AS INTEGER) AS fold FROM range(5)) f WHERE p.pos < p.n - (4 - f.fold) * (p.n // 6)",
    ),
    *ridge("rs", "folded", ["target", "fold"], CONDITION_COLUMNS["D"], "y", "dr"),
    ("foldmae", "SELECT target, fold, a, avg(abs(y)) AS mae FROM rs_out WHERE kind = 0 AND NOT is_train GROUP BY 1, 2, 3"),
]


@query(
    "ridge_search",
    with_ctes(
        _FEATURE_NEEDS,
        f"SELECT target, 'D' AS condition, a AS draw, fold, {r6('mae')}, {r6('alpha')} FROM foldmae JOIN dr USING (a)",
        _SEARCH,
    ),
)
def ridge_search_errors(spark: SparkSession, d: str) -> DataFrame:
    """Fold errors of 20 seeded penalties on 5 forward folds, scaler refitted per fold."""
    rows = stable(_clean(spark, d), "clean")
    search = SearchSettings()
    alphas = linear.drawn_alphas(search.draws, search.seed, SERIES_RIDGE_ALPHA)
    conditions = {"D": CONDITION_COLUMNS["D"]}
    return t.rounded(linear.search_errors(rows, ["target"], conditions, "y", t.is_train(), alphas, search.folds))


# ---- segment sensitivity -------------------------------------------------------------------------
_SEG_FEATURES = [
    *_SEG_RES,
    ("gf", "SELECT *, CAST(date IN (SELECT date FROM hol) AS DOUBLE) AS cal_is_holiday FROM res"),
    *_loo("la", "gf", ["segment"], CONDITION_COLUMNS["A"]),
    *_loo("lb", "gf", ["segment"], CONDITION_COLUMNS["B"]),
    _test_r2("la", "gf", ["segment"]),
    _test_r2("lb", "gf", ["segment"]),
]


def _r2_table(rows: DataFrame, keys: list[str], train: Column | None = None, test: Column | None = None) -> DataFrame:
    """Test R2 of condition A and B per group and their difference."""
    conditions = {c: CONDITION_COLUMNS[c] for c in ("A", "B")}
    models = linear.fit_ridge_loo(rows, keys, conditions, "y", t.is_train() if train is None else train)
    pred = linear.predict(rows.filter(t.is_test() if test is None else test), models, keys, conditions)
    r2 = metrics.score(pred, [*keys, "condition"], "y", "pred")
    wide = r2.groupBy(*keys).agg(*(F.max(F.when(F.col("condition") == c, F.col("r2"))).alias(f"r2{c}_test") for c in ("A", "B")))
    return wide.withColumn("delta_r2", F.col("r2B_test") - F.col("r2A_test"))


def _segment_rows(spark: SparkSession, d: str) -> DataFrame:
    return stable(t.with_residuals(t.trip_segment_table(spark, d), ["segment"], "n"), "residuals")


@query(
    "incremental_r2",
    with_ctes(
        ["seg", "exo", "hol"],
        f"SELECT segment, {r6('la_r2.r2', 'r2A_test')}, {r6('lb_r2.r2', 'r2B_test')}, {r6('lb_r2.r2 - la_r2.r2', 'delta_r2')} FROM la_r2 JOIN lb_r2 USING (segment)",
        _SEG_FEATURES,
    ),
)
def incremental_r2(spark: SparkSession, d: str) -> DataFrame:
    return t.rounded(_r2_table(_segment_rows(spark, d), ["segment"]))


_SENS = {"corr_exo_count": "anom_exo_count", "corr_exo_sum": "anom_exo_sum", "corr_exo_high": "anom_exo_high"}


@query(
    "segment_sensitivity",
    with_ctes(
        ["seg", "exo", "hol"],
        "SELECT segment, n_days, mean_per_day, " + r6_all(list(_SENS)) + f", {r6('la_r2.r2', 'r2A_test')}, {r6('lb_r2.r2', 'r2B_test')}, {r6('lb_r2.r2 - la_r2.r2', 'delta_r2')} FROM "
        "(SELECT segment, count(*) AS n_days, CAST(floor(avg(y)) AS BIGINT) AS mean_per_day, "
        + ", ".join(f"{corr_expr('resid', a)} AS {n}" for n, a in _SENS.items())
        + " FROM gf GROUP BY segment) JOIN la_r2 USING (segment) JOIN lb_r2 USING (segment)",
        _SEG_FEATURES,
    ),
)
def segment_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    """One row per segment: residual correlations with three anomalies and test R2 without and with them."""
    rows = _segment_rows(spark, d)
    corr = rows.groupBy("segment").agg(
        F.count(F.lit(1)).alias("n_days"),
        F.floor(F.avg("y")).alias("mean_per_day"),
        *(safe_corr(F.col("resid"), F.col(a)).alias(n) for n, a in _SENS.items()),
    )
    return t.rounded(corr.join(_r2_table(rows, ["segment"]), "segment"))


_SEG_W = [*_SEG_RES, ("sw", f"SELECT segment, {corr_expr('resid', 'anom_exo_count')} AS w FROM res GROUP BY segment")]


@query(
    "axis_verdict",
    with_ctes(
        ["seg", "exo"],
        f"""SELECT axis, {r6('l.w', 'w_leisure')}, {r6('c.w', 'w_commute')}, CASE WHEN l.w < c.w THEN 'support' ELSE 'against' END AS verdict,
        (SELECT CASE WHEN bool_and(l2.w < c2.w) THEN 'supported' WHEN NOT bool_or(l2.w < c2.w) THEN 'rejected' ELSE 'mixed' END
        FROM ax a2 JOIN sw l2 ON a2.ls = l2.segment JOIN sw c2 ON a2.cs = c2.segment) AS overall
        FROM ax JOIN sw l ON ls = l.segment JOIN sw c ON cs = c.segment""",
        [*_SEG_W, ("ax", "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{ls}', '{cs}')" for a, ls, cs in AXES) + ") v(axis, ls, cs)")],
    ),
)
def axis_verdict(spark: SparkSession, d: str) -> DataFrame:
    res = t.with_residuals(t.trip_segment_table(spark, d), ["segment"], "n", ["exo_count"])
    w = metrics.correlations(res, ["segment"], "resid", {"w": "anom_exo_count"})
    verdicts = stable(metrics.axis_verdicts(w, "w"), "verdicts")
    both = verdicts.withColumn("_k", F.lit(1)).join(F.broadcast(metrics.overall_verdict(verdicts).withColumn("_k", F.lit(1))), "_k")
    return t.rounded(both.drop("_k"))


# ---- two modes -------------------------------------------------------------------------------------
_MODE_W = [
    *_MODE_RES,
    ("mw", f"SELECT mode, segment, {corr_expr('resid', 'anom_exo_count')} AS w FROM res WHERE segment IN ('time_wdAM', 'time_weMID') GROUP BY 1, 2"),
    ("mt", "SELECT mode, max(w) FILTER (WHERE segment = 'time_wdAM') AS commute, max(w) FILTER (WHERE segment = 'time_weMID') AS leisure FROM mw GROUP BY mode"),
]


def _mode_w(spark: SparkSession, d: str) -> DataFrame:
    res = t.with_residuals(t.mode_segment_table(spark, d), ["mode", "segment"], "n", ["exo_count"])
    return metrics.mode_table(metrics.correlations(res, ["mode", "segment"], "resid", {"w": "anom_exo_count"}), "w")


@query("mode_segment_2x2", with_ctes(["modes", "exo"], f"SELECT mode, {r6('commute')}, {r6('leisure')} FROM mt", _MODE_W))
def mode_segment_2x2(spark: SparkSession, d: str) -> DataFrame:
    return t.rounded(_mode_w(spark, d))


_AM, _MID = "'time_wdAM'", "'time_weMID'"
_MODE_R2 = [
    *_MODE_RES,
    ("gf", "SELECT *, CAST(date IN (SELECT date FROM hol) AS DOUBLE) AS cal_is_holiday FROM res WHERE segment <> 'all' AND segment LIKE 'time%'"),
    *_loo("la", "gf", ["mode", "segment"], CONDITION_COLUMNS["A"]),
    *_loo("lb", "gf", ["mode", "segment"], CONDITION_COLUMNS["B"]),
    _test_r2("la", "gf", ["mode", "segment"]),
    _test_r2("lb", "gf", ["mode", "segment"]),
    ("dr2", "SELECT mode, segment, lb_r2.r2 - la_r2.r2 AS g FROM la_r2 JOIN lb_r2 USING (mode, segment)"),
]


@query(
    "mode_segment_delta_r2",
    with_ctes(
        ["modes", "exo", "hol"],
        f"SELECT mode, {r6('max(g) FILTER (WHERE segment = ' + _AM + ')', 'commute')}, "
        f"{r6('max(g) FILTER (WHERE segment = ' + _MID + ')', 'leisure')} FROM dr2 GROUP BY mode",
        _MODE_R2,
    ),
)
def mode_segment_delta_r2(spark: SparkSession, d: str) -> DataFrame:
    table = t.mode_segment_table(spark, d).filter(F.col("segment").startswith("time"))
    rows = stable(t.with_residuals(table, ["mode", "segment"], "n"), "residuals")
    return t.rounded(metrics.mode_table(_r2_table(rows, ["mode", "segment"]), "delta_r2"))


@query(
    "effects_2x2",
    with_ctes(
        ["modes", "exo"],
        f"""SELECT {r6('ct', 'column_trips')}, {r6('co', 'column_orders')}, {r6('rc', 'row_commute')}, {r6('rl', 'row_leisure')},
        (ct < 0) = (co < 0) AS same_direction, {r6('greatest(abs(ct), abs(co))', 'max_column')}, {r6('greatest(abs(rc), abs(rl))', 'max_row')},
        greatest(abs(rc), abs(rl)) > greatest(abs(ct), abs(co)) AS row_exceeds_column FROM (SELECT a.leisure - a.commute AS ct,
        b.leisure - b.commute AS co, b.commute - a.commute AS rc, b.leisure - a.leisure AS rl FROM mt a, mt b WHERE a.mode = 'trips' AND b.mode = 'orders')""",
        _MODE_W,
    ),
)
def effects_2x2(spark: SparkSession, d: str) -> DataFrame:
    return t.rounded(metrics.effects(_mode_w(spark, d), ("trips", "orders")))


_SYSTEMS = [
    ("tot", "SELECT date, 'panel' AS system, sum(demand) AS y FROM panel GROUP BY date UNION ALL SELECT date, 'trips' AS system, CAST(total AS DOUBLE) AS y FROM wide"),
    ("tx", "SELECT date, system, y, exo_sum, exo_high, exo_low, exo_count FROM tot JOIN exo USING (date)"),
    *residual_ctes("tx", ["system"]),
    ("gf", "SELECT *, CAST(date IN (SELECT date FROM hol) AS DOUBLE) AS cal_is_holiday FROM res"),
    *_loo("la", "gf", ["system"], CONDITION_COLUMNS["A"]),
    *_loo("lb", "gf", ["system"], CONDITION_COLUMNS["B"]),
    _test_r2("la", "gf", ["system"]),
    _test_r2("lb", "gf", ["system"]),
]


@query(
    "system_contrast",
    with_ctes(
        ["panel", "wide", "exo", "hol"],
        f"""SELECT system, n_days, {r6_all([f'corr_{v}' for v in EXO])}, {r6('la_r2.r2', 'r2A_test')}, {r6('lb_r2.r2', 'r2B_test')},
        {r6('lb_r2.r2 - la_r2.r2', 'delta_r2')} FROM (SELECT system, count(*) AS n_days, """
        + ", ".join(f"{corr_expr('resid', 'anom_' + v)} AS corr_{v}" for v in EXO)
        + " FROM gf GROUP BY system) JOIN la_r2 USING (system) JOIN lb_r2 USING (system)",
        _SYSTEMS,
    ),
)
def system_contrast(spark: SparkSession, d: str) -> DataFrame:
    """The same method on two systems: the zone panel rolled up to one total, and the whole trip series."""
    panel = t.demand_panel(spark, d).groupBy("date").agg(F.sum("demand").alias("y")).withColumn("system", F.lit("panel"))
    trips = t.daily_series(spark, d).select("date", F.col("total").cast("double").alias("y"), F.lit("trips").alias("system"))
    exo = sample.exo_daily(spark, d).select("date", *EXO)
    table = stable(t.with_calendar(grid.join_daily(panel.unionByName(trips), exo, t.PERIOD)), "systems")
    rows = stable(t.with_residuals(table, ["system"], "y"), "residuals")
    corr = rows.groupBy("system").agg(
        F.count(F.lit(1)).alias("n_days"), *(safe_corr(F.col("resid"), F.col(f"anom_{v}")).alias(f"corr_{v}") for v in EXO)
    )
    return t.rounded(corr.join(_r2_table(rows, ["system"]), "system"))


# ---- trees and the ablation tables -------------------------------------------------------------------
# Plain fits inside the ranges of ``config.py``; the searches over those ranges are run by the studies.
FIXED_FOREST = {"numTrees": 100, "maxDepth": 6, "minInstancesPerNode": 5, "featureSubsetStrategy": "all"}
FIXED_BOOSTED = {"maxIter": 50, "maxDepth": 3, "stepSize": 0.1, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8"}
TREE_SEED = SearchSettings().seed


def _panel_rows(spark: SparkSession, d: str) -> tuple[DataFrame, list[str]]:
    """Complete panel rows with zone indicators; a constant key groups the pooled models."""
    table = stable(t.panel_table(spark, d).dropna(), "panel")
    indicators = features.zone_indicators(panels.zone_categories(table))
    names = [f"zone_{z}" for z in panels.zone_categories(table)[1:]]
    return stable(t.with_split(table.select(*table.columns, *indicators, F.lit(1).alias("g"))), "panel"), names


@query("forest_model")
def forest_model(spark: SparkSession, d: str) -> DataFrame:
    """Random forest at fixed parameters, every target and condition, val and test scores."""
    rows = stable(t.with_split(_clean(spark, d)), "clean")

    def one(task: tuple[str, str]) -> DataFrame:
        target, condition = task
        mine = rows.filter(F.col("target") == target)
        pred = trees.fit_tree(mine, CONDITION_COLUMNS[condition], "y", t.is_train(), trees.forest(FIXED_FOREST, "y", TREE_SEED))
        tags = {"condition": F.lit(condition), "model": F.lit("ForestFixed")}
        return pred.filter(~t.is_train()).withColumns(tags).select("target", "condition", "model", "split", "y", "pred")

    parts = trees.in_parallel(one, [(y, c) for y in t.TARGETS for c in CONDITION_COLUMNS], 4)
    return t.rounded(metrics.score_splits(union_all(parts), ["target", "condition", "model"], "y", "pred"))


def _boosted_predictions(rows: DataFrame, conditions: dict[str, list[str]]) -> DataFrame:
    """Boosted trees at fixed parameters for every condition, held rows."""
    searches = [trees.Search(n, tuple(cols)) for n, cols in conditions.items()]
    single = SearchSettings(draws=1)
    pred = trees.search_trees(rows, searches, [], "demand", t.is_train(), trees.boosted, lambda *_: FIXED_BOOSTED, {}, single)
    held = pred.filter(~t.is_train())
    return held.withColumns({"condition": F.col("search"), "model": F.lit("BoostedFixed")}).select(*_PANEL_KEEP)


# The searches of the studies over small ranges, 3 draws x 3 folds, so that the whole of it is registered and scored.
SMALL_FOREST = {"trees": (3, 8), "depth": (2, 4), "leaf": (1, 19)}
SMALL_SEARCH = SearchSettings(draws=3, folds=3)


@query("forest_search")
def forest_search(spark: SparkSession, d: str) -> DataFrame:
    """Searched forests of every target and condition, val and test scores."""
    rows = t.with_split(_clean(spark, d))
    searches = [trees.Search(f"{y}:{c}", tuple(cols), f"target = '{y}'") for y in t.TARGETS for c, cols in CONDITION_COLUMNS.items()]
    pred = trees.search_trees(rows, searches, ["target"], "y", t.is_train(), trees.forest, trees.forest_draw, SMALL_FOREST, SMALL_SEARCH, parallelism=8)
    label = F.element_at(F.split("search", ":"), -1)
    held = pred.filter(~t.is_train()).select("target", label.alias("condition"), F.lit("ForestSearched").alias("model"), "split", "y", "pred")
    return t.rounded(metrics.score_splits(held, ["target", "condition", "model"], "y", "pred"))


@query("boosted_model")
def boosted_model(spark: SparkSession, d: str) -> DataFrame:
    """Boosted trees at fixed parameters, all six panel conditions, zone-mean scores."""
    rows, conditions = _panel_setup(spark, d)
    pred = _boosted_predictions(rows, conditions)
    return t.rounded(metrics.score_zone_mean(pred, ["condition", "model"], "demand", "pred"))


# One tree of depth two on two-valued columns: both levels can be listed in SQL.
TWO_VALUED = [*(f"cal_dow_{i}" for i in range(1, 7)), "cal_is_holiday"]


def _gain(x: str, y: str = "y") -> str:
    sides = (f"power(sum({y}) FILTER (WHERE {cond}), 2) / count(*) FILTER (WHERE {cond})" for cond in (x, f"NOT {x}"))
    return " + ".join(sides)


_SHALLOW = [
    *_FEATURES,
    ("flag", " UNION ALL ".join(f"SELECT target, date, is_train, y, {k} AS k, {c} > 0.5 AS x FROM sfc" for k, c in enumerate(TWO_VALUED))),
    ("rg", f"SELECT target, k, {_gain('x')} AS gain FROM flag WHERE is_train GROUP BY 1, 2 HAVING bool_or(x) AND NOT bool_and(x)"),
    ("root", "SELECT target, arg_min(k, (-gain, k)) AS k FROM rg GROUP BY 1"),
    ("side", "SELECT target, date, is_train, y, x AS side FROM flag JOIN root USING (target, k)"),
    (
        "cg",
        f"SELECT target, side, k, {_gain('x', 's.y')} AS gain FROM side s JOIN flag f USING (target, date) WHERE s.is_train "
        "GROUP BY 1, 2, 3 HAVING bool_or(x) AND NOT bool_and(x)",
    ),
    ("child", "SELECT target, side, arg_min(k, (-gain, k)) AS k FROM cg GROUP BY 1, 2"),
    (
        "leafed",
        "SELECT s.*, coalesce(f.x, false) AS leaf FROM side s LEFT JOIN child c USING (target, side) "
        "LEFT JOIN flag f ON f.target = s.target AND f.date = s.date AND f.k = c.k",
    ),
]


@query(
    "shallow_tree",
    with_ctes(
        _FEATURE_NEEDS,
        f"SELECT target, date, {r6('avg(y) FILTER (WHERE is_train) OVER (PARTITION BY target, side, leaf)', 'pred')} FROM leafed",
        _SHALLOW,
    ),
)
def shallow_tree(spark: SparkSession, d: str) -> DataFrame:
    """One tree of depth two on weekday and holiday flags, its prediction for every day of every target."""
    rows = stable(_clean(spark, d), "clean")
    params = {"numTrees": 1, "maxDepth": 2, "bootstrap": False, "featureSubsetStrategy": "all"}

    def one(target: str) -> DataFrame:
        mine = rows.filter(F.col("target") == target)
        return trees.fit_tree(mine, TWO_VALUED, "y", t.is_train(), trees.forest(params, "y", TREE_SEED)).select("target", "date", "pred")

    return t.rounded(union_all(trees.in_parallel(one, list(t.TARGETS), 3)))


IMPORTANCE_REPEATS = 5
_PERM = [
    *_SHALLOW,
    ("fitted", "SELECT target, side, leaf, avg(y) AS pred FROM leafed WHERE is_train GROUP BY 1, 2, 3"),
    ("held", f"SELECT target, date, any_value(y) AS y, map(list(k ORDER BY k), list(x ORDER BY k)) AS own FROM flag WHERE date > DATE '{VAL_END}' GROUP BY 1, 2"),
    ("each", f"SELECT * FROM held, (SELECT range AS rep FROM range({IMPORTANCE_REPEATS})) r"),
    ("spot", "SELECT target, date, rep, y, own, dense_rank() OVER (PARTITION BY target, rep ORDER BY date) AS place, "
     f"row_number() OVER (PARTITION BY target, rep ORDER BY md5('{TREE_SEED}:' || rep || ':' || date)) AS rank FROM each"),
    (
        "moved",
        f"""SELECT a.target, a.rep, a.y, c.range AS col, a.own, b.own AS other FROM spot a JOIN spot b ON a.target = b.target AND a.rep = b.rep AND a.place = b.rank,
        (SELECT range FROM range(-1, {len(TWO_VALUED)})) c""",
    ),
    ("sided", "SELECT m.*, CASE WHEN col = r.k THEN other[r.k] ELSE own[r.k] END AS side FROM moved m JOIN root r USING (target)"),
    ("ended", "SELECT s.*, coalesce(CASE WHEN col = c.k THEN other[c.k] ELSE own[c.k] END, false) AS leaf FROM sided s LEFT JOIN child c USING (target, side)"),
    ("mses", "SELECT target, rep, col, avg(power(y - pred, 2)) AS mse FROM ended JOIN fitted USING (target, side, leaf) GROUP BY 1, 2, 3"),
    ("grown", "SELECT a.target, a.col, a.rep, a.mse - b.mse AS g FROM mses a JOIN mses b ON a.target = b.target AND a.rep = b.rep AND b.col = -1 WHERE a.col >= 0"),
]


@query(
    "permutation_importance",
    with_ctes(
        _FEATURE_NEEDS,
        "SELECT target, CASE col " + " ".join(f"WHEN {k} THEN '{c}'" for k, c in enumerate(TWO_VALUED)) + f" END AS column, {r6('avg(g)', 'importance')}, {r6('stddev_pop(g)', 'spread')} FROM grown GROUP BY target, col",
        _PERM,
    ),
)
def permutation_importance(spark: SparkSession, d: str) -> DataFrame:
    """How much each flag of the tree of depth two matters on the test days of every target."""
    rows = stable(_clean(spark, d), "clean")
    params = {"numTrees": 1, "maxDepth": 2, "bootstrap": False, "featureSubsetStrategy": "all"}

    def one(target: str) -> DataFrame:
        mine = rows.filter(F.col("target") == target)
        model = trees.fitted(mine.filter(t.is_train()), TWO_VALUED, trees.forest(params, "y", TREE_SEED))
        return trees.permutation_importance(mine.filter(t.is_test()), model, ["target"], ["date"], TWO_VALUED, "y", IMPORTANCE_REPEATS, TREE_SEED)

    return t.rounded(union_all(trees.in_parallel(one, list(t.TARGETS), 3)))


_ABL_NEEDS = _FEATURE_NEEDS


def _condition_search(c: str) -> list[tuple[str, str]]:
    k, cols = c.lower(), CONDITION_COLUMNS[c]
    return [
        *ridge(f"s{k}", "folded", ["target", "fold"], cols, "y", "dr"),
        (f"m{k}", f"SELECT target, fold, a, avg(abs(y)) AS mae FROM s{k}_out WHERE kind = 0 AND NOT is_train GROUP BY 1, 2, 3"),
        (f"p{k}", f"SELECT target, a, alpha FROM (SELECT target, arg_min(a, (cv, a)) AS a FROM (SELECT target, a, avg(mae) AS cv FROM m{k} GROUP BY 1, 2) GROUP BY 1) JOIN dr USING (a)"),
        *ridge(f"f{k}", "sfc", ["target"], cols, "y", f"p{k}", alpha_keys=["target"]),
        (f"e{k}", f"SELECT o.target, '{c}' AS condition, 'Linear' AS model, s.y, s.y - o.y AS pred, date FROM f{k}_out o JOIN sfc s USING (target, date) WHERE kind = 0"),
    ]


@query(
    "series_ablation",
    with_ctes(
        _ABL_NEEDS,
        f"SELECT target, condition, model, {r6_all(_SCORES)} FROM (SELECT target, condition, model, {_score_sql('val')}, {_score_sql('test')} FROM "
        f"(SELECT *, {_SPLIT} AS split FROM (SELECT * FROM ea UNION ALL SELECT * FROM eb UNION ALL SELECT * FROM ec UNION ALL SELECT * FROM ed "
        "UNION ALL SELECT g.target, 'BASE', 'Baseline', s.y, s.y - g.y, date FROM gc_out g JOIN sfc s USING (target, date))) GROUP BY 1, 2, 3)",
        [*_SEARCH[:-2], *[x for c in "ABCD" for x in _condition_search(c)], *_CLEAN_RES[len(_FEATURES):]],
    ),
)
def series_ablation(spark: SparkSession, d: str) -> DataFrame:
    """Calendar baseline and searched ridge for every target and condition, val and test scores."""
    rows = stable(t.with_split(_clean(spark, d)), "clean")
    models = linear.search_ridge(rows, ["target"], CONDITION_COLUMNS, "y", t.is_train(), SearchSettings(), SERIES_RIDGE_ALPHA)
    pred = linear.predict(rows.filter(~t.is_train()), models, ["target"], CONDITION_COLUMNS).withColumn("model", F.lit("Linear"))
    base = linear.residuals(rows, ["target"], {"y": BASELINE}, t.is_train(), {"y": "resid"}).filter(~t.is_train())
    base = base.select("target", "split", "y", F.lit("BASE").alias("condition"), (F.col("y") - F.col("resid")).alias("pred"), F.lit("Baseline").alias("model"))
    both = pred.select(*base.columns).unionByName(base)
    return t.rounded(metrics.score_splits(both, ["target", "condition", "model"], "y", "pred"))


_PANEL_BASE = [
    *(f"demand_lag_{k}" for k in (1, 2, 3, 7, 14)),
    "demand_rolling_mean_7",
    "dow_sin",
    "dow_cos",
    "month_sin",
    "month_cos",
    "is_weekend",
    "is_holiday",
]
_PANEL_KEEP = ["condition", "model", "zone", "split", "demand", "pred"]
_PANEL_ZONES = [f"zr_{k}" for k in range(2, 11)]
_PANEL_SETS = {
    "A": [],
    "B": EXO,
    "C": ["event_count"],
    "Cprime": ["event_count_manhattan"],
    "D": [*EXO, "event_count"],
    "E": ["event_count_zone"],
}
_PANEL_DRAWS = (
    "pdr",
    f"SELECT CAST(range AS INTEGER) AS a, exp(ln({PANEL_RIDGE_ALPHA[0]}) + {hash_uniform(_SEED_TEXT)} * (ln({PANEL_RIDGE_ALPHA[1]}) - ln({PANEL_RIDGE_ALPHA[0]}))) AS alpha FROM range(20)",
)
_PANEL_RIDGE = [
    ("ranked", "SELECT *, dense_rank() OVER (ORDER BY zone) AS zr FROM feats WHERE demand_lag_14 IS NOT NULL"),
    (
        "blocks",
        f"""SELECT date, CASE WHEN pos < n - 5 * (n // 6) THEN 0 ELSE (pos - n + 5 * (n // 6)) // (n // 6) + 1 END AS block FROM
        (SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM ranked WHERE date <= DATE '{TRAIN_END}'))""",
    ),
    ("pr", "SELECT ranked.*, block, " + ", ".join(f"CAST(zr = {k} AS DOUBLE) AS zr_{k}" for k in range(2, 11)) + " FROM ranked LEFT JOIN blocks USING (date)"),
    _PANEL_DRAWS,
    *ridge_search("ps", "pr", {c: [*_PANEL_BASE, *extra, *_PANEL_ZONES] for c, extra in _PANEL_SETS.items()}, "demand", "pdr", 5, ("date", "zone")),
    (
        "pall",
        "SELECT condition, 'Ridge' AS model, zone, date, demand AS y, pred FROM ps_pred JOIN pr USING (date, zone) UNION ALL "
        + " UNION ALL ".join(f"SELECT '{c}', 'SeasonalNaive', zone, date, demand, demand_lag_7 FROM pr WHERE block IS NULL" for c in _PANEL_SETS),
    ),
    ("pzone", f"SELECT condition, model, zone, {_score_sql('val')}, {_score_sql('test')} FROM (SELECT *, {_SPLIT} AS split FROM pall) GROUP BY 1, 2, 3"),
]


def _panel_setup(spark: SparkSession, d: str) -> tuple[DataFrame, dict[str, list[str]]]:
    rows, zones = _panel_rows(spark, d)
    inputs = [c for c in rows.columns if not c.startswith("zone_") and c not in ("g", "split")]
    return rows, {n: [*cols, *zones] for n, cols in features.panel_conditions(inputs, EXO).items()}


def _panel_predictions(held: DataFrame, models: DataFrame, conditions: dict[str, list[str]]) -> DataFrame:
    """Ridge and seasonal-naive predictions of every condition, stacked."""
    fitted = linear.predict(held, models, ["g"], conditions).withColumn("model", F.lit("Ridge")).select(*_PANEL_KEEP)
    names = F.explode(F.array(*(F.lit(n) for n in conditions))).alias("condition")
    naive = held.select(names, F.lit("SeasonalNaive").alias("model"), "zone", "split", "demand", F.col("demand_lag_7").alias("pred"))
    return fitted.unionByName(naive)


@query(
    "panel_ablation",
    with_ctes(
        ["feats"],
        "SELECT condition, model, " + ", ".join(r6(f"avg({c})", c) for c in _SCORES) + " FROM pzone GROUP BY 1, 2",
        _PANEL_RIDGE,
    ),
)
def panel_ablation(spark: SparkSession, d: str) -> DataFrame:
    """Pooled ridge with zone indicators, penalty searched over 20 draws x 5 folds, and seasonal naive, all six conditions."""
    rows, conditions = _panel_setup(spark, d)
    models = linear.search_ridge(rows, ["g"], conditions, "demand", t.is_train(), SearchSettings(), PANEL_RIDGE_ALPHA)
    pred = _panel_predictions(rows.filter(~t.is_train()), models, conditions)
    return t.rounded(metrics.score_zone_mean(pred, ["condition", "model"], "demand", "pred"))


@query("ablation_table")
def ablation_table(spark: SparkSession, d: str) -> DataFrame:
    """Panel conditions x {seasonal naive, searched ridge, boosted trees at fixed parameters}: zone-mean scores."""
    rows, conditions = _panel_setup(spark, d)
    models = linear.search_ridge(rows, ["g"], conditions, "demand", t.is_train(), SearchSettings(), PANEL_RIDGE_ALPHA)
    out = _panel_predictions(rows.filter(~t.is_train()), models, conditions).unionByName(_boosted_predictions(rows, conditions))
    return t.rounded(metrics.score_zone_mean(out, ["condition", "model"], "demand", "pred"))


@query(
    "feature_pair_corr",
    with_ctes(
        ["series", "exo"],
        f"SELECT {r6(corr_expr('anom_exo_sum', 'anom_exo_count'), 'sum_count')}, {r6(corr_expr('anom_exo_high', 'anom_exo_low'), 'high_low')} FROM res WHERE target = 'total'",
        _SERIES_RES,
    ),
)
def feature_pair_corr(spark: SparkSession, d: str) -> DataFrame:
    """Correlation of two pairs of anomalies."""
    a = t.anomalies(spark, d)
    return t.rounded(
        a.agg(
            safe_corr(F.col("anom_exo_sum"), F.col("anom_exo_count")).alias("sum_count"),
            safe_corr(F.col("anom_exo_high"), F.col("anom_exo_low")).alias("high_low"),
        )
    )

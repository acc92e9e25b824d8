"""Systems and modes with their own periods and splits, read from a boundary table."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daygrid.config import Period
from daygrid.functions.calendar import harmonic_names
from daygrid.functions.stats import safe_corr
from daygrid.operators import bootstrap as bs
from daygrid.operators import features, grid, linear, metrics, splits
from daygrid.operators.segments import COMMUTE, LEISURE
from daygrid.plans import tables as t
from daygrid.plans.inference import (
    _CELL,
    _CELL_SEED,
    _EFF,
    BLOCK,
    COLUMN_ROW_PAIRS,
    REPS,
    SEED,
    _cell_seed,
    _ci,
    _corr_draws,
    _fisher_sql,
)
from daygrid.plans.registry import query
from daygrid.plans.regression import CONDITION_COLUMNS, _loo, _r2_table, _test_r2
from daygrid.plans.sqltext import BASELINE, EXO, LAGS, corr_expr, lag_select, r6, r6_all, residual_ctes, with_ctes
from daygrid.session import stable
from daygrid.sources import sample

# The panel is studied in the period of the trips, which ends earlier, and in its own.
SHORT = Period(date(1996, 1, 1), date(1998, 12, 31), date(1998, 3, 31), date(1998, 7, 31))
LATE = Period(date(1998, 6, 1), date(2000, 8, 31), date(2000, 3, 31), date(2000, 5, 31))
SYSTEMS = {("trips", "trips"): SHORT, ("panel", "panel"): SHORT, ("panel_own", "panel"): t.PERIOD}
MODES = {("trips",): SHORT, ("orders",): LATE}
NAMED = {"coef_rain": "anom_exo_sum", "coef_lag1": "lag_y_1"}


def _edges(periods: dict[tuple, Period], names: tuple[str, ...]) -> str:
    rows = ", ".join(
        "(" + ", ".join([*(f"'{k}'" for k in key), *(f"DATE '{d}'" for d in (p.start, p.end, p.train_end, p.val_end))]) + ")"
        for key, p in periods.items()
    )
    return f"SELECT * FROM (VALUES {rows}) v({', '.join(names)}, first_day, last_day, train_end, val_end)"


_OWN = "date <= train_end"
_SYS = [
    ("tot", "SELECT date, 'panel' AS series, sum(demand) AS y FROM panel GROUP BY date UNION ALL SELECT date, 'trips' AS series, CAST(total AS DOUBLE) AS y FROM wide"),
    ("edges", _edges(SYSTEMS, ("system", "series"))),
    (
        "tx",
        """SELECT date, system, y, exo_sum, exo_high, exo_low, exo_count, train_end, val_end
        FROM tot JOIN edges USING (series) JOIN exo USING (date) WHERE date BETWEEN first_day AND last_day""",
    ),
    *residual_ctes("tx", ["system"], train=_OWN),
    ("gf", "SELECT res.*, e.val_end, CAST(date IN (SELECT date FROM hol) AS DOUBLE) AS cal_is_holiday FROM res JOIN edges e USING (system)"),
]


def _systems(spark: SparkSession, d: str) -> DataFrame:
    """Residuals, anomalies and calendar of each system, inside its period and fitted on its own train days."""
    panel = t.demand_panel(spark, d).groupBy("date").agg(F.sum("demand").alias("y")).withColumn("series", F.lit("panel"))
    trips = t.daily_series(spark, d).select("date", F.col("total").cast("double").alias("y"), F.lit("trips").alias("series"))
    bounds = splits.boundaries(spark, SYSTEMS, ["system", "series"])
    rows = splits.within_boundaries(panel.unionByName(trips), bounds, ["series"], ["system"])
    exo = sample.exo_daily(spark, d).select("date", *EXO)
    table = stable(t.with_calendar(grid.join_daily(rows, exo, t.PERIOD)), "systems")
    specs = {"y": BASELINE, **dict.fromkeys(EXO, harmonic_names())}
    out = linear.residuals(table, ["system"], specs, splits.in_train(), {"y": "resid", **{v: f"anom_{v}" for v in EXO}})
    return stable(out, "system_residuals")


@query(
    "system_own_split",
    with_ctes(
        ["panel", "wide", "exo", "hol"],
        f"""SELECT system, n_days, {r6_all([f'corr_{v}' for v in EXO])}, {r6('la_r2.r2', 'r2A_test')}, {r6('lb_r2.r2', 'r2B_test')},
        {r6('lb_r2.r2 - la_r2.r2', 'delta_r2')} FROM (SELECT system, count(*) AS n_days, """
        + ", ".join(f"{corr_expr('resid', 'anom_' + v)} AS corr_{v}" for v in EXO)
        + " FROM gf GROUP BY system) JOIN la_r2 USING (system) JOIN lb_r2 USING (system)",
        [
            *_SYS,
            *_loo("la", "gf", ["system"], CONDITION_COLUMNS["A"]),
            *_loo("lb", "gf", ["system"], CONDITION_COLUMNS["B"]),
            _test_r2("la", "gf", ["system"], "date > s.val_end"),
            _test_r2("lb", "gf", ["system"], "date > s.val_end"),
        ],
    ),
)
def system_own_split(spark: SparkSession, d: str) -> DataFrame:
    """The same method on three systems, each with its own period and split: residual correlations and test R2."""
    rows = _systems(spark, d)
    corr = rows.groupBy("system").agg(
        F.count(F.lit(1)).alias("n_days"), *(safe_corr(F.col("resid"), F.col(f"anom_{v}")).alias(f"corr_{v}") for v in EXO)
    )
    return t.rounded(corr.join(_r2_table(rows, ["system"], splits.in_train(), splits.in_test()), "system"))


_D = CONDITION_COLUMNS["D"]
_GROUPS = {label: [c for c in _D if c.split("_")[0] == prefix] for prefix, label in features.FEATURE_GROUPS.items()}


@query(
    "system_coefs",
    with_ctes(
        ["panel", "wide", "exo", "hol"],
        "SELECT system, "
        + ", ".join(r6(f"max(abs(y)) FILTER (WHERE probe IN ({', '.join(str(_D.index(c)) for c in cols)}))", f"max_{g}") for g, cols in _GROUPS.items())
        + ", " + ", ".join(r6(f"max(-y) FILTER (WHERE probe = {_D.index(c)})", n) for n, c in NAMED.items())
        + " FROM ld_best WHERE kind = 2 GROUP BY system",
        [
            *_SYS,
            ("lagged", f"SELECT date, system, {lag_select('system')} FROM tx"),
            ("gfl", f"SELECT gf.*, {', '.join(LAGS)} FROM gf JOIN lagged USING (date, system) WHERE lag_y_14 IS NOT NULL"),
            *_loo("ld", "gfl", ["system"], _D),
        ],
    ),
)
def system_coefs(spark: SparkSession, d: str) -> DataFrame:
    """Largest standardised coefficient of each feature group and two named ones, per system."""
    rows = _systems(spark, d)
    lagged = stable(rows.select("*", *features.series_lag_columns(t.SERIES, "system")).dropna(), "lagged")
    conditions = {"D": _D}
    models = linear.fit_ridge_loo(lagged, ["system"], conditions, "y", splits.in_train())
    coefs = linear.standardized_coefficients(models, ["system"], conditions)
    return t.rounded(metrics.coefficient_summary(coefs, ["system"], NAMED))


# ---- modes -----------------------------------------------------------------------------------------
_OWN_CELLS = [
    ("edges", _edges(MODES, ("mode",))),
    (
        "mx_in",
        """SELECT date, mode, segment, CAST(n AS DOUBLE) AS y, exo_sum, exo_high, exo_low, exo_count, train_end
        FROM modes JOIN edges USING (mode) JOIN exo USING (date) WHERE date BETWEEN first_day AND last_day""",
    ),
    *residual_ctes("mx_in", ["mode", "segment"], train=_OWN),
    ("cells", f"SELECT {_CELL} AS cell, date, anom_exo_count AS x, resid AS y FROM res WHERE segment IN ('{COMMUTE}', '{LEISURE}')"),
]


def _own_cells(spark: SparkSession, d: str) -> DataFrame:
    """(cell, date, x, y) of the four mode x segment cells, each mode in its own period with its own train end."""
    table = t.mode_segment_table(spark, d).filter(F.col("segment").isin(COMMUTE, LEISURE))
    rows = splits.within_boundaries(table, splits.boundaries(spark, MODES, ["mode"]), ["mode"])
    specs = {"y": BASELINE, "exo_count": harmonic_names()}
    res = linear.residuals(rows.withColumn("y", F.col("n").cast("double")), ["mode", "segment"], specs, splits.in_train(), {"y": "resid", "exo_count": "x"})
    name = F.concat_ws("-", "mode", F.when(F.col("segment") == COMMUTE, "commute").otherwise("leisure"))
    return stable(res.select(name.alias("cell"), "date", "x", F.col("resid").alias("y")), "cells")


@query(
    "mode_own_split",
    with_ctes(
        ["modes", "exo"],
        f"""SELECT * FROM (SELECT cell, {_ci('r_y')} FROM bs_rep GROUP BY cell) JOIN (SELECT cell, {r6(corr_expr('x', 'y'), 'point')} FROM cells GROUP BY cell) USING (cell)
        JOIN (SELECT cell, n, {r6('n_eff')} FROM eff) USING (cell)""",
        [*_OWN_CELLS, _EFF, ("bs_in", f"SELECT *, {SEED} AS seed FROM cells"), *_corr_draws("cell", ["y"])],
    ),
)
def mode_own_split(spark: SparkSession, d: str) -> DataFrame:
    """Correlation, interval, days and effective days of the cells of two modes with different periods and train ends."""
    cells = _own_cells(spark, d)
    ci = bs.corr_interval(cells, ["cell"], "x", "y", F.lit(SEED), REPS, BLOCK)
    return t.rounded(ci.join(bs.effective_size(cells, ["cell"], "y").select("cell", "n_eff"), "cell"))


@query(
    "mode_own_tests",
    with_ctes(
        ["modes", "exo"],
        f"""SELECT test, a, b, {r6('ra - rb', 'diff')}, {_fisher_sql('ra', 'na', 'rb', 'nb')} FROM (SELECT test, a, b, wa.w AS ra, wb.w AS rb, wa.n_eff AS na, wb.n_eff AS nb
        FROM (VALUES {', '.join(str(p) for p in COLUMN_ROW_PAIRS)}) v(test, a, b) JOIN cw_ wa ON wa.cell = a JOIN cw_ wb ON wb.cell = b)))""",
        [*_OWN_CELLS, _EFF, ("cw_", f"SELECT cell, {corr_expr('x', 'y')} AS w, any_value(n_eff) AS n_eff FROM cells JOIN eff USING (cell) GROUP BY cell")],
    ),
)
def mode_own_tests(spark: SparkSession, d: str) -> DataFrame:
    """Fisher-z tests of the column and row effects between modes of different periods."""
    cells = _own_cells(spark, d)
    w = bs.corr_points(cells, ["cell"], "x", ["y"]).withColumnRenamed("r_y", "w")
    table = stable(w.join(bs.effective_size(cells, ["cell"], "y").select("cell", "n_eff"), "cell"), "cells")
    return t.rounded(bs.compare_cells(table, COLUMN_ROW_PAIRS, "cell", "w", "n_eff"))


@query(
    "mode_own_effects",
    with_ctes(
        ["modes", "exo"],
        f"""SELECT * FROM (SELECT effect, {r6('avg(a.r_y - b.r_y)', 'point')}, {_ci('(a.r_y - b.r_y)')} FROM
        (VALUES {', '.join(str(p) for p in COLUMN_ROW_PAIRS)}) v(effect, ca, cb) JOIN bs_rep a ON a.cell = ca JOIN bs_rep b ON b.cell = cb AND a.rep = b.rep GROUP BY effect)""",
        [*_OWN_CELLS, ("bs_in", f"SELECT *, {_CELL_SEED} AS seed FROM cells"), *_corr_draws("cell", ["y"])],
    ),
)
def mode_own_effects(spark: SparkSession, d: str) -> DataFrame:
    """Column and row effects with intervals between modes of different periods."""
    boots = stable(bs.corr_replicates(_own_cells(spark, d), ["cell"], "x", ["y"], _cell_seed(), REPS, BLOCK), "replicates")
    return t.rounded(bs.replicate_effects(boots, COLUMN_ROW_PAIRS, "cell", "r_y"))

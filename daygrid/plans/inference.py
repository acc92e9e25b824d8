"""Bootstrap intervals, effective sample sizes and tests of correlations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daygrid.config import BOOTSTRAP_BLOCK, BOOTSTRAP_REPS
from daygrid.functions.stats import fisher_z_columns, safe_corr
from daygrid.operators import bootstrap as bs
from daygrid.operators.grid import join_daily
from daygrid.operators.segments import COMMUTE, LEISURE
from daygrid.plans import tables as t
from daygrid.plans.registry import query
from daygrid.plans.regression import _MODE_RES, _SEG_RES, _SERIES_RES
from daygrid.plans.sqltext import corr_expr, r6, with_ctes
from daygrid.session import stable
from daygrid.sources import sample

SEED = 42
REPS, BLOCK = BOOTSTRAP_REPS, BOOTSTRAP_BLOCK
# Seeds of the four independent cells.
CELL_SEEDS = {"trips-commute": 1, "trips-leisure": 2, "orders-commute": 3, "orders-leisure": 4}
COLUMN_ROW_PAIRS = (
    ("column trips", "trips-leisure", "trips-commute"),
    ("column orders", "orders-leisure", "orders-commute"),
    ("row commute", "orders-commute", "trips-commute"),
    ("row leisure", "orders-leisure", "trips-leisure"),
)

# ---- SQL ---------------------------------------------------------------------------------------


def _draws(keys: str, reps: int = REPS) -> list[tuple[str, str]]:
    """From ``bs_in`` (keys, date, seed, x, y...) to ``bs_rows``: one row per drawn day."""
    return [
        ("bs_pos", f"SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY date) - 1 AS pos FROM bs_in"),
        ("bs_n", f"SELECT {keys}, count(*) AS n, max(seed) AS seed FROM bs_in GROUP BY {keys}"),
        (
            "bs_idx",
            f"""SELECT {keys}, rep, b, ('0x' || substr(md5(seed || ':' || rep || ':' || b), 1, 12))::BIGINT % (n - {BLOCK - 1}) AS start,
            least({BLOCK}, n - b * {BLOCK}) AS length FROM bs_n, (SELECT range AS rep FROM range({reps})) r, LATERAL (SELECT range AS b FROM
            range(CAST(ceil(n / {float(BLOCK)}) AS BIGINT))) l""",
        ),
    ]


def _corr_draws(keys: str, ys: list[str], reps: int = REPS) -> list[tuple[str, str]]:
    """Replicate correlations ``bs_rep`` from window sums per block start."""
    terms = {"sx": "x", "sxx": "x * x"} | {k: v for y in ys for k, v in ((f"s{y}", y), (f"s{y}{y}", f"{y} * {y}"), (f"sx{y}", f"x * {y}"))}
    sums = ", ".join(f"sum({e}) AS {n}" for n, e in terms.items())
    corr = ", ".join(
        f"""(sum(sx{y}) - sum(sx) * sum(s{y}) / sum(length)) / sqrt((sum(sxx) - sum(sx) * sum(sx) / sum(length)) *
        (sum(s{y}{y}) - sum(s{y}) * sum(s{y}) / sum(length))) AS r_{y}"""
        for y in ys
    )
    return [
        *_draws(keys, reps),
        ("bs_want", f"SELECT DISTINCT {keys}, start, length FROM bs_idx"),
        (
            "bs_sum",
            f"""SELECT {keys}, start, length, {sums} FROM (SELECT {keys}, start, length, start + i AS pos FROM bs_want,
            LATERAL (SELECT range AS i FROM range(length)) l) w JOIN bs_pos USING ({keys}, pos) GROUP BY {keys}, start, length""",
        ),
        ("bs_rep", f"SELECT {keys}, rep, {corr} FROM bs_idx JOIN bs_sum USING ({keys}, start, length) GROUP BY {keys}, rep"),
    ]


def _ci(value: str) -> str:
    lo, hi = f"quantile_cont({value}, 0.025)", f"quantile_cont({value}, 0.975)"
    return f"{r6(lo, 'ci_lo')}, {r6(hi, 'ci_hi')}, count({value}) AS reps, ({lo} > 0 OR {hi} < 0) AS excludes_0"


_CORR_IN = ("bs_in", f"SELECT target, date, {SEED} AS seed, anom_exo_sum AS x, resid AS y FROM res")


def _target_residuals(spark: SparkSession, d: str) -> DataFrame:
    """(date, target, y, resid, anom_exo_sum), written once."""
    exo = sample.exo_daily(spark, d).select("date", t.RAIN_SUM)
    table = stable(t.with_calendar(join_daily(t.target_series(spark, d), exo, t.PERIOD)), "targets")
    res = t.with_residuals(table, ["target"], "y", [t.RAIN_SUM])
    return stable(res.select("date", "target", "y", "resid", F.col("anom_exo_sum").alias("x")), "residuals")


@query(
    "block_bootstrap_index",
    with_ctes(
        ["series"],
        f"SELECT target, rep, count(*) AS blocks, CAST(sum(start) AS BIGINT) AS start_sum, CAST(sum(length) AS BIGINT) AS days, min(start) AS lo, max(start) AS hi FROM bs_idx GROUP BY 1, 2",
        [("bs_in", f"SELECT target, date, {SEED} AS seed FROM series"), *_draws("target")],
    ),
)
def block_bootstrap_index(spark: SparkSession, d: str) -> DataFrame:
    """Drawn blocks of every series, summed per replicate."""
    pos = bs.with_position(t.target_series(spark, d), ["target"])
    drawn = bs.block_draws(bs.series_cells(pos, ["target"], F.lit(SEED)), ["target"], REPS, BLOCK)
    return drawn.groupBy("target", "rep").agg(
        F.count(F.lit(1)).alias("blocks"),
        F.sum("start").alias("start_sum"),
        F.sum("length").cast("long").alias("days"),
        F.min("start").alias("lo"),
        F.max("start").alias("hi"),
    )


@query(
    "bootstrap_corr_ci",
    with_ctes(
        ["series", "exo"],
        f"SELECT * FROM (SELECT target, {_ci('r_y')} FROM bs_rep GROUP BY target) JOIN (SELECT target, count(*) AS n, {r6(corr_expr('x', 'y'), 'point')} FROM bs_in GROUP BY target) USING (target)",
        [*_SERIES_RES, _CORR_IN, *_corr_draws("target", ["y"])],
    ),
)
def bootstrap_corr_ci(spark: SparkSession, d: str) -> DataFrame:
    rows = _target_residuals(spark, d).drop("y")
    return t.rounded(bs.corr_interval(rows, ["target"], "x", "resid", F.lit(SEED), REPS, BLOCK))


@query(
    "bootstrap_stat_ci",
    with_ctes(
        ["series"],
        f"""SELECT target, {_ci('value')}, (SELECT round(avg(y), 6) + 0.0 FROM bs_in i WHERE i.target = r.target) AS point FROM (SELECT target, rep, sum(s) / sum(length) AS value FROM bs_idx
        JOIN (SELECT target, start, length, sum(y) AS s FROM (SELECT target, start, length, start + i AS pos FROM (SELECT DISTINCT target, start, length FROM bs_idx),
        LATERAL (SELECT range AS i FROM range(length)) l) JOIN bs_pos USING (target, pos) GROUP BY 1, 2, 3) USING (target, start, length) GROUP BY 1, 2) r GROUP BY target""",
        [("bs_in", f"SELECT target, date, {SEED} AS seed, y FROM series"), *_draws("target", REPS)],
    ),
)
def bootstrap_stat_ci(spark: SparkSession, d: str) -> DataFrame:
    rows = stable(t.target_series(spark, d), "series")
    return t.rounded(bs.stat_interval(rows, ["target"], F.avg("y"), F.lit(SEED), REPS, BLOCK))


_PAIR_IN = (
    "bs_in",
    f"""SELECT 'round-point' AS pair, a.date, {SEED} AS seed, a.anom_exo_count AS x, a.resid AS ya, b.resid AS yb FROM res a JOIN res b ON a.date = b.date
    WHERE a.segment = 'rt_round' AND b.segment = 'rt_point' UNION ALL
    SELECT 'member-casual' AS pair, a.date, {SEED} AS seed, a.anom_exo_count AS x, a.resid AS ya, b.resid AS yb FROM res a JOIN res b ON a.date = b.date
    WHERE a.segment = 'user_member' AND b.segment = 'user_casual'""",
)


@query(
    "paired_corr_diff_ci",
    with_ctes(
        ["seg", "exo"],
        f"""SELECT * FROM (SELECT pair, {_ci('(r_ya - r_yb)')} FROM bs_rep GROUP BY pair) JOIN
        (SELECT pair, count(*) AS n, {r6(corr_expr('x', 'ya') + ' - ' + corr_expr('x', 'yb'), 'diff')} FROM bs_in GROUP BY pair) USING (pair)""",
        [*_SEG_RES, _PAIR_IN, *_corr_draws("pair", ["ya", "yb"])],
    ),
)
def paired_corr_diff_ci(spark: SparkSession, d: str) -> DataFrame:
    """Difference of two segments' correlations with both taken on the same resampled days."""
    res = t.with_residuals(t.trip_segment_table(spark, d), ["segment"], "n", ["exo_count"])
    side = {
        "rt_round": ("round-point", "a"),
        "rt_point": ("round-point", "b"),
        "user_member": ("member-casual", "a"),
        "user_casual": ("member-casual", "b"),
    }
    lookup = F.create_map(*(x for s, (p, r) in side.items() for x in (F.lit(s), F.struct(F.lit(p).alias("pair"), F.lit(r).alias("role")))))
    tagged = res.filter(F.col("segment").isin(list(side))).select("date", "resid", "anom_exo_count", lookup[F.col("segment")].alias("s"))
    pairs = tagged.groupBy(F.col("s.pair").alias("pair"), "date").agg(
        F.max(F.when(F.col("s.role") == "a", F.col("resid"))).alias("ya"),
        F.max(F.when(F.col("s.role") == "b", F.col("resid"))).alias("yb"),
        F.max(F.when(F.col("s.role") == "a", F.col("anom_exo_count"))).alias("x"),
    )
    rows = stable(pairs.dropna(), "pairs")
    return t.rounded(bs.paired_corr_difference(rows, ["pair"], "x", "ya", "yb", F.lit(SEED), REPS, BLOCK))


_CELL = "mode || '-' || CASE segment WHEN 'time_wdAM' THEN 'commute' ELSE 'leisure' END"
_CELL_SEED = "CASE cell " + " ".join(f"WHEN '{c}' THEN {s}" for c, s in CELL_SEEDS.items()) + " END"
_CELLS = [
    *_MODE_RES,
    ("cells", f"SELECT {_CELL} AS cell, date, anom_exo_count AS x, resid AS y FROM res WHERE segment IN ('{COMMUTE}', '{LEISURE}')"),
]
_EFF = (
    "eff",
    """SELECT *, n * (1 - r) / (1 + r) AS n_eff FROM (SELECT cell, n, lag1, least(greatest(lag1, 0.0), 0.99) AS r FROM
    (SELECT cell, count(*) AS n, CASE WHEN sum(c * c) > 0 THEN sum(c * p) / sum(c * c) ELSE 0.0 END AS lag1 FROM
    (SELECT *, lag(c) OVER (PARTITION BY cell ORDER BY date) AS p FROM (SELECT *, y - avg(y) OVER (PARTITION BY cell) AS c FROM cells)) GROUP BY cell))""",
)


def _cells(spark: SparkSession, d: str) -> DataFrame:
    """(cell, date, x, y): anomaly and residual of the four mode x segment cells, written once."""
    table = t.mode_segment_table(spark, d).filter(F.col("segment").isin(COMMUTE, LEISURE))
    res = t.with_residuals(table, ["mode", "segment"], "n", ["exo_count"])
    name = F.concat_ws("-", "mode", F.when(F.col("segment") == COMMUTE, "commute").otherwise("leisure"))
    return stable(res.select(name.alias("cell"), "date", F.col("anom_exo_count").alias("x"), F.col("resid").alias("y")), "cells")


def _cell_seed():
    return F.create_map(*(F.lit(v) for kv in CELL_SEEDS.items() for v in kv))[F.col("cell")]


@query(
    "effect_decomposition",
    with_ctes(
        ["modes", "exo"],
        f"""SELECT * FROM (SELECT effect, {r6('avg(a.r_y - b.r_y)', 'point')}, {_ci('(a.r_y - b.r_y)')} FROM
        (VALUES {', '.join(str(p) for p in COLUMN_ROW_PAIRS)}) v(effect, ca, cb) JOIN bs_rep a ON a.cell = ca JOIN bs_rep b ON b.cell = cb AND a.rep = b.rep GROUP BY effect)""",
        [*_CELLS, ("bs_in", f"SELECT *, {_CELL_SEED} AS seed FROM cells"), *_corr_draws("cell", ["y"])],
    ),
)
def effect_decomposition(spark: SparkSession, d: str) -> DataFrame:
    """Column and row effects with intervals: replicates of independent cells subtracted by index."""
    boots = stable(bs.corr_replicates(_cells(spark, d), ["cell"], "x", ["y"], _cell_seed(), REPS, BLOCK), "replicates")
    return t.rounded(bs.replicate_effects(boots, COLUMN_ROW_PAIRS, "cell", "r_y"))


@query("lag1_autocorr", with_ctes(["modes", "exo"], f"SELECT cell, n, {r6('lag1')} FROM eff", [*_CELLS, _EFF]))
def lag1_autocorr(spark: SparkSession, d: str) -> DataFrame:
    return t.rounded(bs.lag1_autocorrelation(_cells(spark, d), ["cell"], "y"))


@query("effective_n", with_ctes(["modes", "exo"], f"SELECT cell, n, {r6('lag1')}, {r6('n_eff')} FROM eff", [*_CELLS, _EFF]))
def effective_n(spark: SparkSession, d: str) -> DataFrame:
    return t.rounded(bs.effective_size(_cells(spark, d), ["cell"], "y"))


def _fisher_sql(a: str, na: str, b: str, nb: str) -> str:
    """z, p, se. The error function is summed as exp(-x^2) * sum_k x^(2k+1) / Gamma(k + 3/2)."""
    z = f"(atanh(greatest(least({a}, 0.999), -0.999)) - atanh(greatest(least({b}, 0.999), -0.999))) / se"
    x = "least(abs(z) / sqrt(2), 6.5)"
    erf = f"(SELECT sum(exp((2 * k.range + 1) * ln({x}) - {x} * {x} - lgamma(k.range + 1.5))) FROM range(200) k)"
    return f"{r6('z')}, {r6(f'1 - CASE WHEN z = 0 THEN 0.0 ELSE {erf} END', 'p')}, {r6('se')} FROM (SELECT *, {z} AS z FROM (SELECT *, CASE WHEN {na} > 3 AND {nb} > 3 THEN sqrt(1.0 / ({na} - 3) + 1.0 / ({nb} - 3)) END AS se"


@query(
    "fisher_z",
    with_ctes(
        ["wide", "exo"],
        f"SELECT {_fisher_sql('ra', 'n', 'rb', 'n')} FROM (SELECT {corr_expr('member', 'exo_count')} AS ra, {corr_expr('casual', 'exo_count')} AS rb, CAST(count(*) AS DOUBLE) AS n FROM wide JOIN exo USING (date))))",
    ),
)
def fisher_z(spark: SparkSession, d: str) -> DataFrame:
    """Test of two raw correlations with the day count as sample size."""
    exo = sample.exo_daily(spark, d).select("date", "exo_count")
    joined = join_daily(t.daily_series(spark, d), exo, t.PERIOD)
    x = F.col("exo_count")
    r = joined.agg(
        safe_corr(F.col("member").cast("double"), x).alias("ra"),
        safe_corr(F.col("casual").cast("double"), x).alias("rb"),
        F.count(F.lit(1)).cast("double").alias("n"),
    )
    return t.rounded(r.select(*fisher_z_columns(F.col("ra"), F.col("n"), F.col("rb"), F.col("n"))))


@query(
    "cell_inference",
    with_ctes(
        ["modes", "exo"],
        f"""SELECT * FROM (SELECT cell, {_ci('r_y')} FROM bs_rep GROUP BY cell) JOIN (SELECT cell, {r6(corr_expr('x', 'y'), 'point')} FROM cells GROUP BY cell) USING (cell)
        JOIN (SELECT cell, n, {r6('n_eff')} FROM eff) USING (cell)""",
        [*_CELLS, _EFF, ("bs_in", f"SELECT *, {SEED} AS seed FROM cells"), *_corr_draws("cell", ["y"])],
    ),
)
def cell_inference(spark: SparkSession, d: str) -> DataFrame:
    """W, interval, n and effective n of the four cells."""
    cells = _cells(spark, d)
    ci = bs.corr_interval(cells, ["cell"], "x", "y", F.lit(SEED), REPS, BLOCK)
    eff = bs.effective_size(cells, ["cell"], "y").select("cell", "n_eff")
    return t.rounded(ci.join(eff, "cell"))


@query(
    "cell_tests",
    with_ctes(
        ["modes", "exo"],
        f"""SELECT test, a, b, {r6('ra - rb', 'diff')}, {_fisher_sql('ra', 'na', 'rb', 'nb')} FROM (SELECT test, a, b, wa.w AS ra, wb.w AS rb, wa.n_eff AS na, wb.n_eff AS nb
        FROM (VALUES {', '.join(str(p) for p in COLUMN_ROW_PAIRS)}) v(test, a, b) JOIN cw_ wa ON wa.cell = a JOIN cw_ wb ON wb.cell = b)))""",
        [*_CELLS, _EFF, ("cw_", f"SELECT cell, {corr_expr('x', 'y')} AS w, any_value(n_eff) AS n_eff FROM cells JOIN eff USING (cell) GROUP BY cell")],
    ),
)
def cell_tests(spark: SparkSession, d: str) -> DataFrame:
    """Fisher-z tests of the column and row effects with effective sample sizes."""
    cells = _cells(spark, d)
    w = bs.corr_points(cells, ["cell"], "x", ["y"]).withColumnRenamed("r_y", "w")
    table = stable(w.join(bs.effective_size(cells, ["cell"], "y").select("cell", "n_eff"), "cell"), "cells")
    return t.rounded(bs.compare_cells(table, COLUMN_ROW_PAIRS, "cell", "w", "n_eff"))

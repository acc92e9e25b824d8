from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from daygrid.config import SearchSettings
from daygrid.functions.calendar import calendar_block, calendar_names
from daygrid.operators import linear

START = date(2022, 1, 1)
TRAIN_END = date(2022, 9, 30)
XS = calendar_names(holiday=False)


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(400):
        d = START + timedelta(i)
        y = 1000 + 300 * np.sin(2 * np.pi * d.timetuple().tm_yday / 365.25) + 5 * d.weekday() + rng.normal(0, 30)
        rows.append((d, "all", float(y)))
        rows.append((d, "weekday" if d.weekday() < 5 else "weekend", float(y)))
    df = spark.createDataFrame(rows, "date date, segment string, y double")
    return df.select(*df.columns, *calendar_block(F.col("date"), START)).cache()


def frame(series, segment):
    pdf = series.filter(F.col("segment") == segment).orderBy("date").toPandas()
    return pdf, (pdf["date"] <= TRAIN_END).to_numpy()


TRAIN = f"date <= DATE'{TRAIN_END}'"  # text, as columns need a running session


@pytest.mark.parametrize("segment", ["all", "weekday", "weekend"])
def test_residuals_equal_minimum_norm_least_squares(series, segment):
    out = linear.residuals(series, ["segment"], {"y": XS}, F.expr(TRAIN), {"y": "resid"})
    got = out.filter(F.col("segment") == segment).orderBy("date").toPandas()["resid"].to_numpy()
    pdf, tr = frame(series, segment)
    x = np.column_stack([np.ones(len(pdf)), pdf[XS].to_numpy()])
    beta, *_ = np.linalg.lstsq(x[tr], pdf["y"].to_numpy()[tr], rcond=None)
    assert np.allclose(got, pdf["y"].to_numpy() - x @ beta, atol=1e-7)


def standard(x, tr):
    sd = x[tr].std(0)
    return (x - x[tr].mean(0)) / np.where(sd > 0, sd, 1.0)


def ridge_fit(z, y, alpha):
    zc, yc = z - z.mean(0), y - y.mean()
    w = np.linalg.solve(zc.T @ zc + alpha * np.eye(z.shape[1]), zc.T @ yc)
    return w, y.mean() - z.mean(0) @ w


def test_fixed_ridge_equals_direct_solve(series):
    pdf, tr = frame(series, "all")
    z, y = standard(pdf[XS].to_numpy(), tr), pdf["y"].to_numpy()
    w, b = ridge_fit(z[tr], y[tr], 3.0)
    cond = {"A": XS}
    models = linear.fit_ridge(series, ["segment"], cond, "y", F.expr(TRAIN), 3.0)
    pred = linear.predict(series, models, ["segment"], cond)
    got = pred.filter("segment = 'all'").orderBy("date").toPandas()["pred"].to_numpy()
    assert np.allclose(got, z @ w + b, atol=1e-7)


def test_leave_one_out_equals_explicit_refits(series):
    pdf, tr = frame(series, "all")
    z, y = standard(pdf[XS].to_numpy(), tr)[tr], pdf["y"].to_numpy()[tr]
    cond = {"A": XS}
    systems = linear.ridge_systems(series, ["segment"], cond, "y", F.expr(TRAIN))
    rows = linear.loo_errors(series, systems, ["segment"], cond, "y", F.expr(TRAIN), [0.5, 20.0])
    got = {r.a: r.loo_mse for r in rows.filter("segment = 'all'").collect()}
    for a, alpha in enumerate([0.5, 20.0]):
        errs = []
        for i in range(len(y)):
            keep = np.arange(len(y)) != i
            # The scaler is fixed on all train rows; intercept and weights are refitted.
            w, b = ridge_fit(z[keep], y[keep], alpha)
            errs.append((y[i] - z[i] @ w - b) ** 2)
        assert got[a] == pytest.approx(np.mean(errs), rel=1e-9)


def test_search_errors_equal_explicit_folds(series):
    pdf, tr = frame(series, "all")
    x, y = pdf[XS].to_numpy()[tr], pdf["y"].to_numpy()[tr]
    alphas, folds = [0.1, 50.0], 3
    rows = linear.search_errors(series, ["segment"], {"A": XS}, "y", F.expr(TRAIN), alphas, folds)
    got = {(r.fold, r.draw): r.mae for r in rows.filter("segment = 'all'").collect()}
    size = len(y) // (folds + 1)
    for f in range(folds):
        lo = len(y) - (folds - f) * size
        sd = x[:lo].std(0)
        sd = np.where(sd > 0, sd, 1.0)
        z = (x - x[:lo].mean(0)) / sd
        for d, alpha in enumerate(alphas):
            w, b = ridge_fit(z[:lo], y[:lo], alpha)
            mae = np.abs(y[lo : lo + size] - z[lo : lo + size] @ w - b).mean()
            assert got[f, d] == pytest.approx(mae, rel=1e-8)


def test_search_picks_the_lowest_mean_error(series):
    cond = {"A": XS}
    search = SearchSettings(draws=4, folds=3)
    models = linear.search_ridge(series, ["segment"], cond, "y", F.expr(TRAIN), search, (1e-2, 1e4))
    alphas = linear.drawn_alphas(4, 42, (1e-2, 1e4))
    errors = linear.search_errors(series, ["segment"], cond, "y", F.expr(TRAIN), alphas, 3).toPandas()
    for r in models.collect():
        mean = errors[errors.segment == r.segment].groupby("alpha").mae.mean()
        assert r.alpha == pytest.approx(mean.idxmin())


def test_models_ignore_rows_outside_train(series):
    moved = series.withColumn("y", F.when(F.expr(TRAIN), F.col("y")).otherwise(F.col("y") * 9 + 1))
    cond = {"A": XS}
    for fit in (
        lambda df: linear.fit_ols(df, ["segment"], {"y": XS}, F.expr(TRAIN)).select("segment", F.col("coef_y").alias("coef")),
        lambda df: linear.fit_ridge_loo(df, ["segment"], cond, "y", F.expr(TRAIN)),
    ):
        a = {r.segment: r.coef for r in fit(series).collect()}
        b = {r.segment: r.coef for r in fit(moved).collect()}
        assert all(np.allclose(a[s], b[s], rtol=1e-9) for s in a)


def test_one_heavy_group_is_spread_over_tasks(spark, monkeypatch):
    """A group with most of the rows goes through the salted passes unchanged."""
    monkeypatch.setattr(linear, "ROWS_PER_TASK", 700)
    rng = np.random.default_rng(1)
    rows = [("hot" if i % 10 else f"k{i % 30}", START + timedelta(i % 300), float(rng.normal()), float(rng.normal())) for i in range(6000)]
    df = spark.createDataFrame(rows, "g string, date date, x double, y double").cache()
    systems = linear.ridge_systems(df, ["g"], {"A": ["x"]}, "y", F.lit(True))
    got = {r.g: r.loo_mse for r in linear.loo_errors(df, systems, ["g"], {"A": ["x"]}, "y", F.lit(True), [1.0]).collect()}
    pdf = df.toPandas()
    for g, part in pdf.groupby("g"):
        z = (part.x - part.x.mean()) / part.x.std(ddof=0)
        h = 1 / len(z) + z**2 / ((z**2).sum() + 1.0)
        e = part.y - part.y.mean() - z * (z * part.y).sum() / ((z**2).sum() + 1.0)
        assert got[g] == pytest.approx(((e / (1 - h)) ** 2).mean(), rel=1e-9)


def test_small_spread_on_a_large_level(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (2000, 3))
    y = x @ [1.0, -2.0, 0.5] + rng.normal(0, 0.1, 2000)
    rows = [(START + timedelta(i), "g", *(1e8 + x[i]).tolist(), float(1e8 + y[i])) for i in range(2000)]
    names = ["a", "b", "c"]
    df = spark.createDataFrame(rows, "date date, g string, a double, b double, c double, y double").repartition(7)
    held = df.toPandas()
    z, t = held[names].to_numpy() - 1e8, held["y"].to_numpy() - 1e8  # exact, as the level was added before
    zc, tc = z - z.mean(0), t - t.mean()
    beta = np.linalg.lstsq(zc, tc, rcond=None)[0]
    coef = linear.fit_ols(df, ["g"], {"y": names}, F.lit(True)).first()["coef_y"]
    assert np.allclose(coef[1:], beta, rtol=0, atol=1e-8)
    models = linear.fit_ridge(df, ["g"], {"D": names}, "y", F.lit(True), 10.0)
    std = linear.standardized_coefficients(models, ["g"], {"D": names}).toPandas().set_index("feature")["std_coef"]
    want, _ = ridge_fit(zc / zc.std(0), tc, 10.0)
    assert np.allclose([std[c] for c in names], want, rtol=0, atol=1e-8)
    constant = df.withColumn("k", F.lit(1e8) / 3)
    coef = linear.fit_ols(constant, ["g"], {"y": [*names, "k"]}, F.lit(True)).first()["coef_y"]
    assert np.allclose(coef[1:4], beta, rtol=0, atol=1e-8) and abs(coef[4]) < 1e-8


def test_merging_moments_in_any_cut_gives_the_whole():
    rng = np.random.default_rng(6)
    x = 1e6 + rng.normal(0, 1, (500, 4))
    whole = linear.CoMoments.of(x)
    for cuts in ([250], [1, 2, 499], [100, 200, 300, 400]):
        total = linear.CoMoments.empty(4)
        for part in np.split(x, cuts):
            total = total + linear.CoMoments.of(part)
        assert total.n == 500
        assert np.allclose(total.mean, whole.mean, rtol=1e-15) and np.allclose(total.co, whole.co, rtol=0, atol=1e-9 * np.trace(whole.co))

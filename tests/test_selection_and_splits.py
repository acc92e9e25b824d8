"""Distributed quantiles, split boundaries as a table, fold leakage, importance and the fit ledger."""

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from daygrid.config import Period, SearchSettings
from daygrid.operators import features, linear, splits, trees
from daygrid.operators.selection import exact_quantile

START = date(2022, 1, 1)


@pytest.mark.parametrize("q", [0.0, 0.025, 0.5, 0.9, 1.0])
def test_quantiles_equal_numpy(spark, q):
    rng = np.random.default_rng(1)
    groups = {
        "spread": rng.normal(0, 1, 3000).tolist(),
        "hot": [5.0] * 2000 + rng.normal(0, 1, 500).tolist(),
        "wide": (10.0 ** rng.uniform(-300, 300, 400) * rng.choice([-1, 1], 400)).tolist(),
        "close": [1.0 + i * 2.0**-52 for i in range(50)],
        "outlier": [*rng.uniform(0, 1, 300).tolist(), 1e300, -1e300],
        "one": [3.5],
        "two": [1.0, 2.0],
        "same": [0.0, -0.0, 0.0],
        None: [1.0, 4.0, 9.0],
    }
    rows = [(g, x) for g, xs in groups.items() for x in xs]
    odd = [("two", None), ("one", float("nan")), ("spread", float("inf")), ("nothing", None)]
    df = spark.createDataFrame(rows + odd, "g string, x double").withColumn("v", F.lit("clash")).repartition(6)
    got = {r["g"]: r["quantile"] for r in exact_quantile(df, ["g"], "x", q, bins=64).collect()}
    assert set(got) == {*groups, "nothing"} and got["nothing"] is None
    for g, xs in groups.items():
        assert got[g] == pytest.approx(np.quantile(xs, q), rel=1e-12, abs=1e-300), g


def test_quantiles_of_an_empty_table(spark):
    assert exact_quantile(spark.createDataFrame([], "g string, x double"), ["g"], "x", 0.5).collect() == []


def test_no_pass_keeps_a_group_together(spark):
    df = spark.range(20_000).select(F.lit(1).alias("g"), F.rand(3).alias("x"))
    plan = exact_quantile(df, ["g"], "x", 0.5)._jdf.queryExecution().toString()
    assert "percentile" not in plan and "collect_" not in plan


def series(spark, days=400):
    rng = np.random.default_rng(2)
    rows = [(START + timedelta(i), g, float(rng.normal(100 + 10 * k, 5)), float(i % 7)) for i in range(days) for k, g in enumerate("ab")]
    return spark.createDataFrame(rows, "date date, series string, y double, x double")


def test_groups_train_to_their_own_ends(spark):
    df = series(spark)
    periods = {
        ("a", "a"): Period(START, START + timedelta(199), START + timedelta(99), START + timedelta(149)),
        ("b", "b"): Period(START + timedelta(50), START + timedelta(399), START + timedelta(299), START + timedelta(349)),
        ("b_short", "b"): Period(START, START + timedelta(199), START + timedelta(99), START + timedelta(149)),
    }
    bounds = splits.boundaries(spark, periods, ["system", "series"])
    rows = splits.within_boundaries(df, bounds, ["series"], ["system"]).cache()
    seen = {r["system"]: (r["lo"], r["n"]) for r in rows.groupBy("system").agg(F.min("date").alias("lo"), F.count("*").alias("n")).collect()}
    assert seen == {"a": (START, 200), "b": (START + timedelta(50), 350), "b_short": (START, 200)}
    got = {r["system"]: r["coef_y"] for r in linear.fit_ols(rows, ["system"], {"y": ["x"]}, splits.in_train()).collect()}
    pdf = df.toPandas()
    for (system, name), p in periods.items():
        mine = pdf[(pdf["series"] == name) & (pdf["date"] >= p.start) & (pdf["date"] <= p.train_end)]
        slope, level = np.polyfit(mine["x"], mine["y"], 1)
        assert np.allclose(got[system], [level, slope])
    parts = {(r["system"], r["part"]): r["n"] for r in rows.groupBy("system", splits.split_of().alias("part")).agg(F.count("*").alias("n")).collect()}
    assert parts["a", "train"] == 100 and parts["a", "val"] == 50 and parts["a", "test"] == 50


def test_wrong_boundaries_raise(spark):
    df = series(spark, 10)
    day = START + timedelta(3)
    twice = spark.createDataFrame([("a", day, day, day, day)] * 2, "series string, first_day date, last_day date, train_end date, val_end date")
    with pytest.raises(ValueError, match="not unique"):
        splits.within_boundaries(df, twice, ["series"])
    with pytest.raises(ValueError, match="not ordered"):
        splits.within_boundaries(df, twice.limit(1), ["series"])
    with pytest.raises(ValueError, match="not ordered"):
        splits.within_boundaries(df, twice.limit(1).withColumn("val_end", F.lit(None).cast("date")), ["series"])


def test_distorted_folds_move_later_models_only(spark):
    df = series(spark, 240).filter("series = 'a'").withColumn("z", F.rand(7))
    moved = linear.moved_fold_models(linear.distorted(df, ["series"], ["x", "z"], "y", 4), ["series"], ["x", "z"], "y", 10.0, 4).collect()
    fold = {(r["distorted"], r["fold"]) for r in moved if r["scaler"] == "fold"}
    assert fold == {(f, m) for f in range(4) for m in range(4) if f < m}
    assert {(r["distorted"], r["fold"]) for r in moved if r["scaler"] == "all_days"} == {(f, m) for f in range(4) for m in range(4)}


def test_permuting_the_stronger_column_costs_more(spark):
    rng = np.random.default_rng(3)
    rows = [("g", i, float(a), float(b), float(10 * a + 2 * b)) for i, (a, b) in enumerate(rng.uniform(0, 1, (400, 2)))]
    df = spark.createDataFrame(rows, "k string, id long, a double, b double, y double").withColumn("c", F.lit(1.0))
    cols = ["a", "b", "c"]
    model = trees.fitted(df, cols, trees.forest({"numTrees": 1, "maxDepth": 6, "bootstrap": False, "featureSubsetStrategy": "all"}, "y", 1))
    score = lambda frame: {r["column"]: (r["importance"], r["spread"]) for r in trees.permutation_importance(frame, model, ["k"], ["id"], cols, "y", 4, 9).collect()}
    got = score(df.repartition(5))
    assert got["a"][0] > 5 * got["b"][0] > 0 and got["c"] == (0.0, 0.0)
    again = score(df.repartition(2, "b"))
    assert all(np.allclose(got[c], again[c]) for c in cols)  # the same permutations however the rows lie


class Counted:
    def __init__(self, most=None):
        self.most, self.made = most, 0

    def __call__(self, params, y, seed):
        self.made += 1
        if self.most is not None and self.made > self.most:
            raise RuntimeError("the driver is lost")
        return trees.forest({**params, "featureSubsetStrategy": "all"}, y, seed)

    __name__ = "forest"


def test_a_lost_search_goes_on_where_it_was(spark, tmp_path):
    df = features_frame(spark)
    settings = SearchSettings(draws=3, folds=2)
    space = {"trees": (2, 3), "depth": (2, 3), "leaf": (1, 3)}
    two = [trees.Search("A", ("x",)), trees.Search("D", ("x", "lag"))]
    train = F.col("date") <= F.lit(START + timedelta(199))

    def run(build, ledger):
        out = trees.search_trees(df, two, [], "y", train, build, trees.forest_draw, space, settings, ledger, 1)
        return {(r["search"], r["date"]): r["pred"] for r in out.collect()}

    ledger = str(tmp_path / "ledger")
    with pytest.raises(RuntimeError, match="lost"):
        run(Counted(5), ledger)
    assert spark.read.parquet(ledger).count() == 5
    rest = Counted()
    got = run(rest, ledger)
    assert rest.made == 12 - 5 + 2  # the missing folds and one refit for each search
    whole = Counted()
    assert run(whole, str(tmp_path / "other")) == got and whole.made == 12 + 2
    last = Counted()
    assert run(last, ledger) == got and last.made == 2
    assert len(got) == 2 * 250
    changed = Counted()
    settings = SearchSettings(draws=3, folds=2, seed=7)  # another search does not use these errors
    run(changed, ledger)
    assert changed.made == 12 + 2


def features_frame(spark):
    rng = np.random.default_rng(4)
    rows = [(START + timedelta(i), float(i % 7), float(rng.normal(0, 1)), float(3 * (i % 7) + rng.normal(0, 1))) for i in range(250)]
    return spark.createDataFrame(rows, "date date, x double, lag double, y double")


def test_split_of_agrees_with_one_period(spark):
    p = Period(START, START + timedelta(99), START + timedelta(59), START + timedelta(79))
    df = series(spark, 100).filter("series = 'a'")
    rows = splits.within_boundaries(df, splits.boundaries(spark, {("a",): p}, ["series"]), ["series"])
    assert rows.filter(splits.split_of() != features.split_label(F.col("date"), p)).isEmpty()

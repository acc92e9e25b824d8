import hashlib
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from daygrid.operators import bootstrap as bs


def drawn(n, block, rep, seed):
    idx = []
    for b in range(-(-n // block)):
        h = int(hashlib.md5(f"{seed}:{rep}:{b}".encode()).hexdigest()[:12], 16)
        s = h % (n - block + 1)
        idx += list(range(s, s + block))
    return np.array(idx[:n])


@pytest.fixture(scope="module")
def cells(spark):
    rng = np.random.default_rng(3)
    rows, data = [], {}
    for name, n in (("p", 73), ("q", 56)):  # 73 leaves a cut last block, 56 does not
        x = rng.normal(size=n).cumsum()
        y = 0.5 * x + rng.normal(size=n)
        data[name] = (x, y)
        rows += [(name, date(2022, 1, 1) + timedelta(i), float(x[i]), float(y[i])) for i in range(n)]
    return spark.createDataFrame(rows, "cell string, date date, x double, y double").cache(), data


def test_block_count_and_cut(spark):
    one = spark.createDataFrame([("a", 730, 42)], "cell string, n_rows int, seed int")
    rows = bs.block_draws(one, ["cell"], 3, 14).collect()
    per = [r for r in rows if r.rep == 1]
    assert len(per) == 53 and sum(r.length for r in per) == 730
    assert {r.block_no: r.length for r in per}[52] == 2
    assert all(0 <= r.start <= 730 - 14 for r in rows)
    assert len({r.start for r in per}) > 40


def test_replicates_equal_explicit_resampling(cells):
    df, data = cells
    got = {(r.cell, r.rep): r.r_y for r in bs.corr_replicates(df, ["cell"], "x", ["y"], F.lit(42), 20, 14).collect()}
    assert len(got) == 40
    for (cell, rep), r in got.items():
        x, y = data[cell]
        i = drawn(len(x), 14, rep, 42)
        assert r == pytest.approx(np.corrcoef(x[i], y[i])[0, 1], abs=1e-10)


def test_interval_of_any_statistic(cells):
    df, data = cells
    got = {r.cell: r for r in bs.stat_interval(df, ["cell"], F.max("y"), F.lit(7), 50, 14).collect()}
    for cell, (x, y) in data.items():
        reps = [y[drawn(len(y), 14, rep, 7)].max() for rep in range(50)]
        assert got[cell].point == pytest.approx(y.max())
        assert got[cell].ci_lo == pytest.approx(np.percentile(reps, 2.5))
        assert got[cell].ci_hi == pytest.approx(np.percentile(reps, 97.5))


def test_paired_difference_uses_one_resample(cells):
    df, data = cells
    both = df.withColumn("z", F.col("y") * 2 + 1)
    got = bs.paired_corr_difference(both, ["cell"], "x", "y", "z", F.lit(42), 30, 14).collect()
    for r in got:  # a scaled copy correlates the same on every resample
        assert abs(r["diff"]) < 1e-9 and abs(r.ci_lo) < 1e-9 and abs(r.ci_hi) < 1e-9


def test_degenerate_replicates_are_left_out(spark):
    rows = [("c", date(2022, 1, 1) + timedelta(i), float(i == 40), float(i % 7)) for i in range(60)]
    df = spark.createDataFrame(rows, "cell string, date date, x double, y double")
    r = bs.corr_interval(df, ["cell"], "x", "y", F.lit(1), 200, 14).first()
    assert 0 < r.reps < 200


def test_lag1_and_effective_size(cells):
    df, data = cells
    got = {r.cell: r for r in bs.effective_size(df, ["cell"], "x").collect()}
    for cell, (x, _) in data.items():
        c = x - x.mean()
        r1 = (c[1:] * c[:-1]).sum() / (c * c).sum()
        assert got[cell].lag1 == pytest.approx(r1)
        r1 = min(max(r1, 0.0), 0.99)
        assert got[cell].n_eff == pytest.approx(len(x) * (1 - r1) / (1 + r1))


def test_effects_subtract_replicate_by_replicate(cells):
    df, _ = cells
    boots = bs.corr_replicates(df, ["cell"], "x", ["y"], F.lit(42), 25, 14).cache()
    wide = boots.groupBy("rep").pivot("cell", ["p", "q"]).agg(F.max("r_y")).toPandas()
    gap = (wide["p"] - wide["q"]).to_numpy()
    r = bs.replicate_effects(boots, [("e", "p", "q")], "cell", "r_y").first()
    assert r.point == pytest.approx(gap.mean()) and r.ci_lo == pytest.approx(np.percentile(gap, 2.5))

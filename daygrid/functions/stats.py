"""Statistical expressions that are safe under ANSI arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ERF_TERMS = 200


def corr_from_sums(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    """Pearson correlation from sums; null when either side is constant."""
    vx = sxx - sx * sx / n
    vy = syy - sy * sy / n
    floor_x = F.greatest(sxx, F.lit(0.0)) * 1e-13
    floor_y = F.greatest(syy, F.lit(0.0)) * 1e-13
    return F.when((vx > floor_x) & (vy > floor_y), (sxy - sx * sy / n) / F.sqrt(vx * vy))


def safe_corr(x: Column, y: Column) -> Column:
    """Grouped Pearson correlation that is null on a constant column.

    ``corr`` itself raises DIVIDE_BY_ZERO there in ANSI mode.
    """
    spread = F.covar_pop(x, y)
    sx, sy = F.stddev_pop(x), F.stddev_pop(y)
    return F.when((sx > 0) & (sy > 0), F.try_divide(spread, sx * sy))


def erf(x: Column) -> Column:
    """Error function by its all-positive series, exact to double precision.

    erf(x) = 2/sqrt(pi) * exp(-x^2) * sum_k 2^k x^(2k+1) / (1*3*...*(2k+1)).
    """
    a = F.least(F.abs(x), F.lit(6.5))
    start = F.struct(a.alias("term"), a.alias("total"))

    def step(acc: Column, k: Column) -> Column:
        term = acc["term"] * a * a * F.lit(2.0) / (k * 2 + 1).cast("double")
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    total = F.aggregate(F.sequence(F.lit(1), F.lit(ERF_TERMS)), start, step, lambda acc: acc["total"])
    value = F.lit(2.0) / F.sqrt(F.pi()) * F.exp(-a * a) * total
    return F.when(x < 0, -value).when(x >= 0, value)


def two_sided_p(z: Column) -> Column:
    p = F.lit(1.0) - erf(F.abs(z) / F.sqrt(F.lit(2.0)))
    return F.when(p > 0, p).when(p <= 0, F.lit(0.0))


def fisher_z(r: Column) -> Column:
    """atanh of r held in [-0.999, 0.999]; ``least`` and ``greatest`` skip nulls, so a null is kept here."""
    return F.when(r.isNotNull(), F.atanh(F.greatest(F.least(r, F.lit(0.999)), F.lit(-0.999))))


def fisher_z_columns(r_a: Column, n_a: Column, r_b: Column, n_b: Column) -> list[Column]:
    """z, p and standard error of the difference of two independent correlations."""
    usable = (n_a > 3) & (n_b > 3)
    se = F.when(usable, F.sqrt(F.try_divide(F.lit(1.0), n_a - 3) + F.try_divide(F.lit(1.0), n_b - 3)))
    z = (fisher_z(r_a) - fisher_z(r_b)) / se
    return [z.alias("z"), two_sided_p(z).alias("p"), se.alias("se")]


def effective_n(n: Column, r1: Column) -> Column:
    """Sample size corrected for lag-1 autocorrelation, which is held in [0, 0.99]."""
    r = F.least(F.greatest(r1, F.lit(0.0)), F.lit(0.99))
    return F.when(r1.isNotNull(), n * (F.lit(1.0) - r) / (F.lit(1.0) + r))


def r2_from(sse: Column, sst: Column) -> Column:
    """1 - SSE/SST; a constant truth scores 1 when met exactly, otherwise 0."""
    flat = F.when(sse == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return F.when(sst > 0, F.lit(1.0) - F.try_divide(sse, sst)).otherwise(flat)


def half_even(x: Column, digits: int = 0) -> Column:
    """Round half to even. Summation noise is removed first, so ties are stable."""
    return F.bround(F.round(x, digits + 6), digits)


def tidy(x: Column, digits: int = 6) -> Column:
    return F.round(x, digits) + F.lit(0.0)

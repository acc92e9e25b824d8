"""Moving-block bootstrap and inference on correlations of daily series.

A replicate concatenates ceil(n / block) blocks with random starts, cut to n
rows. Block sums are computed once per start, so a replicate of n days costs
n / block rows. Starts come from a text hash: the same on every engine,
partitioning and retry, which makes a lost executor harmless.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daygrid.functions.stats import corr_from_sums, effective_n, fisher_z_columns, safe_corr
from daygrid.session import checked_broadcast, stable

HASH_DIGITS = 12


def with_position(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """0-based ``pos`` by day and series length ``n_rows`` per key."""
    w = Window.partitionBy(*keys)
    return df.withColumn("pos", F.row_number().over(w.orderBy("date")) - 1).withColumn(
        "n_rows", F.count(F.lit(1)).over(w).cast("int")
    )


def block_start(seed: Column, rep: Column, block_no: Column, n: Column, block: int) -> Column:
    text = F.concat_ws(":", seed.cast("string"), rep.cast("string"), block_no.cast("string"))
    digits = F.substring(F.md5(text.cast("binary")), 1, HASH_DIGITS)
    return F.conv(digits, 16, 10).cast("long") % (n - (block - 1))


def df_parallelism(df: DataFrame) -> int:
    spark = df.sparkSession
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def block_draws(cells: DataFrame, keys: Sequence[str], reps: int, block: int) -> DataFrame:
    """(keys, rep, block_no, start, length) from one row per series (keys, n_rows, seed).

    Replicates are spread over the cluster before they unfold into blocks, by
    the columns they are later grouped on. The number of partitions is given,
    as adaptive execution would merge the few input rows into one task.
    """
    tasks = df_parallelism(cells)
    per_rep = cells.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).repartition(tasks, *keys, "rep")
    n_blocks = F.ceil(F.col("n_rows") / F.lit(float(block))).cast("int")
    drawn = per_rep.withColumn("block_no", F.explode(F.sequence(F.lit(0), n_blocks - 1)))
    left = F.col("n_rows") - F.col("block_no") * block
    return drawn.select(
        *keys,
        "rep",
        "block_no",
        block_start(F.col("seed"), F.col("rep"), F.col("block_no"), F.col("n_rows"), block).alias("start"),
        F.least(left, F.lit(block)).cast("int").alias("length"),
    )


def series_cells(positioned: DataFrame, keys: Sequence[str], seed: Column) -> DataFrame:
    return positioned.groupBy(*keys).agg(F.max("n_rows").alias("n_rows")).withColumn("seed", seed)


def block_sums(positioned: DataFrame, keys: Sequence[str], terms: dict[str, Column], block: int) -> DataFrame:
    """Sums of ``terms`` over the block that begins at each start, full and cut.

    Every row adds itself to the starts whose block covers it. One row per
    (series, start, length), at most twice the days of the series.
    """
    tail = (F.col("n_rows") - 1) % block + 1
    covered = F.sequence(F.greatest(F.col("pos") - (block - 1), F.lit(0)), F.least(F.col("pos"), F.col("n_rows") - block))
    rows = positioned.filter(F.col("n_rows") >= block).select(
        *keys, "pos", tail.alias("tail"), *(t.alias(n) for n, t in terms.items()), F.explode(covered).alias("start")
    )
    lengths = F.array_distinct(F.array(F.lit(block), F.col("tail").cast("int")))
    unfolded = rows.withColumn("length", F.explode(lengths)).filter(F.col("pos") < F.col("start") + F.col("length"))
    return unfolded.groupBy(*keys, "start", "length").agg(*(F.sum(n).alias(n) for n in terms))


def pair_terms(x: str, ys: Sequence[str]) -> dict[str, Column]:
    cx = F.col(x)
    terms = {"s_n": F.lit(1.0), "s_x": cx, "s_xx": cx * cx}
    for y in ys:
        cy = F.col(y)
        terms |= {f"s_{y}": cy, f"s_{y}{y}": cy * cy, f"s_x{y}": cx * cy}
    return terms


def replicate_sums(
    positioned: DataFrame, keys: Sequence[str], terms: dict[str, Column], seed: Column, reps: int, block: int
) -> DataFrame:
    """(keys, rep, sums) from the drawn blocks.

    The block table is written and counted first: when it is small the draws
    meet it by broadcast and are grouped where they already are, without another
    shuffle. Every draw has its block, so the outer join drops nothing and only
    spares the hash from being computed once more for a null test.
    """
    sums = stable(block_sums(positioned, keys, terms, block), "blocks")
    cells = series_cells(positioned, keys, seed).filter(F.col("n_rows") >= block)
    drawn = block_draws(cells, keys, reps, block)
    joined = drawn.join(checked_broadcast(sums), [*keys, "start", "length"], "left")
    return joined.groupBy(*keys, "rep").agg(*(F.sum(n).alias(n) for n in terms))


def _pair_corr(y: str) -> Column:
    return corr_from_sums(*(F.col(c) for c in ("s_n", "s_x", f"s_{y}", "s_xx", f"s_{y}{y}", f"s_x{y}")))


def corr_replicates(
    df: DataFrame, keys: Sequence[str], x: str, ys: Sequence[str], seed: Column, reps: int, block: int
) -> DataFrame:
    """(keys, rep, r_<y>...): correlations of x with every y on the same resample."""
    terms = pair_terms(x, ys)
    w = Window.partitionBy(*keys)
    # A correlation does not depend on the level; without it the sums of squares keep their digits.
    centred = with_position(df, keys).withColumns({c: F.col(c) - F.avg(c).over(w) for c in (x, *ys)})
    sums = replicate_sums(centred, keys, terms, seed, reps, block)
    return sums.select(*keys, "rep", *(_pair_corr(y).alias(f"r_{y}") for y in ys))


def corr_points(df: DataFrame, keys: Sequence[str], x: str, ys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *(safe_corr(F.col(x), F.col(y)).alias(f"r_{y}") for y in ys))


def interval(df: DataFrame, keys: Sequence[str], value: Column) -> DataFrame:
    """Exact 2.5 / 97.5 percentiles of the replicates; degenerate (null) ones are left out."""
    bounds = F.percentile(value, F.array(F.lit(0.025), F.lit(0.975)))
    return df.groupBy(*keys).agg(bounds.alias("_b"), F.count(value).alias("reps")).select(
        *keys,
        F.col("_b")[0].alias("ci_lo"),
        F.col("_b")[1].alias("ci_hi"),
        "reps",
        ((F.col("_b")[0] > 0) | (F.col("_b")[1] < 0)).alias("excludes_0"),
    )


def corr_interval(df: DataFrame, keys: Sequence[str], x: str, y: str, seed: Column, reps: int, block: int) -> DataFrame:
    reps_df = corr_replicates(df, keys, x, [y], seed, reps, block)
    points = corr_points(df, keys, x, [y]).withColumnRenamed(f"r_{y}", "point")
    return points.join(interval(reps_df, keys, F.col(f"r_{y}")), list(keys))


def paired_corr_difference(
    df: DataFrame, keys: Sequence[str], x: str, y_a: str, y_b: str, seed: Column, reps: int, block: int
) -> DataFrame:
    """corr(x, y_a) - corr(x, y_b) with both taken on the same resampled days."""
    gap = F.col(f"r_{y_a}") - F.col(f"r_{y_b}")
    boots = corr_replicates(df, keys, x, [y_a, y_b], seed, reps, block)
    point = corr_points(df, keys, x, [y_a, y_b]).select(*keys, "n", gap.alias("diff"))
    return point.join(interval(boots, keys, gap), list(keys))


def stat_interval(
    df: DataFrame, keys: Sequence[str], statistic: Column, seed: Column, reps: int, block: int
) -> DataFrame:
    """Interval of any Spark aggregate over the resampled rows.

    The statistic is opaque, so rows are unfolded here instead of block sums.
    """
    pos = with_position(df, keys)
    cells = series_cells(pos, keys, seed).filter(F.col("n_rows") >= block)
    drawn = block_draws(cells, keys, reps, block)
    picked = drawn.withColumn("pos", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)))
    rows = checked_broadcast(stable(pos.drop("n_rows"), "rows"))
    boots = picked.join(rows, [*keys, "pos"], "left").groupBy(*keys, "rep").agg(statistic.alias("value"))
    point = df.groupBy(*keys).agg(statistic.alias("point"))
    return point.join(interval(boots, keys, F.col("value")), list(keys))


def lag1_autocorrelation(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Lag-1 product sum of the demeaned series over its square sum; 0 for a constant."""
    w = Window.partitionBy(*keys)
    centred = df.withColumn("_c", F.col(value) - F.avg(value).over(w))
    lagged = centred.withColumn("_p", F.lag("_c").over(w.orderBy("date")))
    square = F.sum(F.col("_c") * F.col("_c"))
    r1 = F.when(square > 0, F.try_divide(F.sum(F.col("_c") * F.col("_p")), square)).otherwise(F.lit(0.0))
    return lagged.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), r1.alias("lag1"))


def effective_size(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    r = lag1_autocorrelation(df, keys, value)
    return r.withColumn("n_eff", effective_n(F.col("n"), F.col("lag1")))


def compare_cells(cells: DataFrame, pairs: Sequence[tuple[str, str, str]], key: str, r: str, n_eff: str) -> DataFrame:
    """Fisher-z test of ``a - b`` for every (name, a, b) pair of independent cells."""
    wanted = cells.sparkSession.createDataFrame(list(pairs), "test string, a string, b string")
    a = cells.select(F.col(key).alias("a"), F.col(r).alias("r_a"), F.col(n_eff).alias("n_a"))
    b = cells.select(F.col(key).alias("b"), F.col(r).alias("r_b"), F.col(n_eff).alias("n_b"))
    both = F.broadcast(wanted).join(a, "a").join(b, "b")
    stats = fisher_z_columns(F.col("r_a"), F.col("n_a"), F.col("r_b"), F.col("n_b"))
    return both.select("test", "a", "b", (F.col("r_a") - F.col("r_b")).alias("diff"), *stats)


def replicate_effects(boots: DataFrame, pairs: Sequence[tuple[str, str, str]], key: str, r: str) -> DataFrame:
    """Difference of two independent cells, replicate by replicate.

    The reported point is the mean of the replicates.
    """
    wanted = boots.sparkSession.createDataFrame(list(pairs), "effect string, a string, b string")
    roles = F.explode(
        F.array(
            F.struct(F.col("a").alias(key), F.lit(1.0).alias("sign")),
            F.struct(F.col("b").alias(key), F.lit(-1.0).alias("sign")),
        )
    )
    signed = wanted.select("effect", roles.alias("_r")).select("effect", "_r.*")
    per_rep = (
        boots.join(F.broadcast(signed), key)
        .groupBy("effect", "rep")
        .agg(F.sum(F.col(r) * F.col("sign")).alias("gap"), F.count(r).alias("sides"))
        .filter(F.col("sides") == 2)
    )
    point = per_rep.groupBy("effect").agg(F.avg("gap").alias("point"))
    return point.join(interval(per_rep, ["effect"], F.col("gap")), "effect")

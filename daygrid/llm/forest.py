"""Nearest neighbours by a forest of hash prefixes.

Every tree gives each vector a long bit string (signs of projections that are
centred on the data). Sorted by its string, a tree is an array in which a prefix
is a contiguous run, so it can be cut into blocks of equal prefix of fixed depth.
A query descends in all trees at once to the longest prefix for which the runs
together hold enough candidates: counts of all prefix lengths are summed over the
trees and the length is the largest with a sufficient sum (the synchronous
ascent). Lengths up to the blocks' come from counts per block; queries for which a
whole block is still enough go on inside their blocks, down to the whole string.
The runs of the length found are then read block by block, with exact distances,
and the blocks' best are merged. Enough is a constant share of the vectors, so
recall does not fall as they grow.

Equal vectors are indexed once with their smallest ids. Blocks that hold more
vectors than planned are split by a salt. The centre is fitted on a bounded
sample; all vectors are indexed.

Defined results: vectors that are null, zero, or hold null or non-finite
components take no part; vectors are compared with those of equal length only;
ties go to the smaller id; an id that comes twice with the same vector counts
once, one that comes with several vectors asks with the smallest of them and is found at
its nearest. A query whose runs give fewer neighbours than asked for ascends again, so
with fewer candidates than that, all are returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from daygrid.llm.common import bucket_of, parts, small_batches
from daygrid.session import checked_broadcast, stable

TREES = 32
STRING_BITS = 48
BLOCK_ROWS = 2000
CANDIDATE_SHARE = 1.5  # of the vectors, summed over the trees, which read many of them more than once
SAMPLE_ROWS = 4000
NEAREST = 10


def usable(vector: F.Column) -> F.Column:
    """Not null, not zero, every component finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def planes(dim: int, trees: int = TREES, bits: int = STRING_BITS, seed: int = 17) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, trees * bits))


def codes(vectors: np.ndarray, centre: np.ndarray, trees: int, bits: int) -> np.ndarray:
    """One integer per vector and tree, the first projection in its highest bit."""
    signs = ((vectors - centre) @ planes(vectors.shape[1], trees, bits) > 0).reshape(len(vectors), trees, bits)
    return signs @ (1 << np.arange(bits - 1, -1, -1, dtype=np.int64))


def distinct_vectors(vectors: DataFrame, keep: int) -> DataFrame:
    """(vector, members): each distinct vector with its ``keep`` smallest ids; a hot vector is salted first."""
    salts = parts(vectors.count(), 4096)
    best = lambda ids: F.slice(F.array_sort(F.array_distinct(ids)), 1, keep)
    return (
        vectors.groupBy("vector", bucket_of(salts, "id").alias("salt"))
        .agg(best(F.collect_set("id")).alias("ids"))
        .groupBy("vector")
        .agg(best(F.flatten(F.collect_list("ids"))).alias("members"))
    )


def nearest(
    vectors: DataFrame,
    is_query: F.Column,
    k: int = NEAREST,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    trees: int = TREES,
    bits: int = STRING_BITS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each row for which ``is_query`` holds."""
    spark = vectors.sparkSession
    small_batches(spark, 5000)
    own = vectors.filter(usable(F.col(vector_col)) & F.col(id_col).isNotNull())
    own = stable(own.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"), is_query.alias("asks")), "vectors")
    sample = own.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).select("vector").toPandas()["vector"]
    centres = {d: np.mean([v for v in sample if len(v) == d], axis=0) for d in {len(v) for v in sample}}

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = [None] * len(rows)
            sizes = rows["vector"].map(len).to_numpy()
            for d in np.unique(sizes):
                at = np.flatnonzero(sizes == d)
                x = np.stack(rows["vector"].to_numpy()[at]).astype(np.float64)
                for i, c in zip(at, codes(x, centres.get(d, np.zeros(d)), trees, bits), strict=True):
                    out[i] = c
            yield rows.assign(codes=out, dim=sizes.astype(np.int32))

    kind = own.schema["vector"].dataType.simpleString()
    id_kind = own.schema["id"].dataType.simpleString()
    index = stable(
        distinct_vectors(own, k + 1)
        .withColumn("node", F.xxhash64("vector"))
        .mapInPandas(coded, f"vector {kind}, members array<{id_kind}>, node long, codes array<long>, dim int"),
        "index",
    )
    n = index.count()
    depth = min(bits, max(0, int(np.ceil(np.log2(max(1, n / BLOCK_ROWS))))))
    # Besides the share, as many entries as the query's own vector and k near copies of it put into all runs.
    wanted = int(np.ceil(CANDIDATE_SHARE * n)) + trees * (k + 1)
    block = F.shiftright("code", bits - depth).alias("block") if depth else F.lit(0).cast("long").alias("block")

    # Runs of every prefix length: counts per block, rolled up.
    entries = index.select("node", "dim", F.posexplode("codes").alias("tree", "code")).select("node", "dim", "tree", block)
    blocks = stable(entries.groupBy("dim", "tree", "block").count(), "blocks")
    lengths = F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("length")
    prefix = F.expr(f"shiftright(block, {depth} - length)").alias("prefix")
    runs = (
        blocks.select("dim", "tree", "block", "count", lengths)
        .groupBy("dim", "tree", "length", prefix)
        .agg(F.sum("count").alias("held"))
    )
    asked = stable(
        own.filter("asks")
        .groupBy("id")
        .agg(F.min("vector").alias("vector"))
        .mapInPandas(coded, f"id {id_kind}, vector {kind}, codes array<long>, dim int"),
        "queries",
    )
    descents = asked.select("id", "dim", F.posexplode("codes").alias("tree", "code")).select("id", "dim", "tree", "code", block)
    levels = descents.select("id", "dim", "tree", "code", lengths, prefix)
    longest = F.coalesce(F.max(F.when(F.col("held") >= wanted, F.col("length"))), F.lit(0)).alias("length")
    ascent = stable(
        levels.join(runs, ["dim", "tree", "length", "prefix"])
        .groupBy("id", "length")
        .agg(F.sum("held").alias("held"))
        .groupBy("id")
        .agg(longest),
        "ascent",
    )
    salted = blocks.withColumn("salts", F.ceil(F.col("count") / (2 * BLOCK_ROWS)).cast("int"))
    salts = F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")
    stored = (
        index.select("node", "dim", "vector", "members", F.posexplode("codes").alias("tree", "code"))
        .select("node", "dim", "vector", "members", "tree", "code", block)
        .join(checked_broadcast(salted.select("dim", "tree", "block", "salts")), ["dim", "tree", "block"])
        .withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int"))
        .drop("salts")
    )
    keys = ["dim", "tree", "block", "salt"]

    # Where whole blocks are enough, the runs of longer prefixes inside them.
    def deeper(_, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        held_codes, asked_codes, found = np.sort(rows["code"].to_numpy()), queries["code"].to_numpy(), []
        for length in range(depth + 1, bits + 1) if len(rows) and len(queries) else ():
            low = asked_codes >> (bits - length) << (bits - length)
            held = np.searchsorted(held_codes, low + (1 << (bits - length))) - np.searchsorted(held_codes, low)
            some = held > 0
            if not some.any():
                break
            found.append(pd.DataFrame({"id": queries["id"].to_numpy()[some], "length": length, "held": held[some]}))
        return pd.concat(found) if found else pd.DataFrame({"id": [], "length": [], "held": []})

    inside = (
        descents.join(ascent.filter(F.col("length") == depth).select("id"), "id")
        .join(salted.select("dim", "tree", "block", "salts"), ["dim", "tree", "block"])
        .select("id", "dim", "tree", "block", "code", salts)
    )
    deep = (
        inside.groupBy(keys)
        .cogroup(stored.select(*keys, "code").groupBy(keys))
        .applyInPandas(deeper, f"id {id_kind}, length int, held long")
        .groupBy("id", "length")
        .agg(F.sum("held").alias("held"))
        .groupBy("id")
        .agg(longest)
    )
    ascent = stable(ascent.union(deep).groupBy("id").agg(F.max("length").alias("length")), "lengths")
    def search(_, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or rows.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        rows = rows.assign(first=rows["members"].map(lambda m: m[0])).sort_values("first", kind="stable")
        x = np.stack(rows["vector"].to_numpy()).astype(np.float64)
        members, held_codes = rows["members"].to_numpy(), rows["code"].to_numpy()
        squares = (x * x).sum(axis=1)
        found = []
        for q, v, code, length in zip(queries["id"], queries["vector"], queries["code"], queries["length"], strict=True):
            at = np.flatnonzero((held_codes ^ code) >> (bits - length) == 0) if length > depth else np.arange(len(x))
            v, most, ids = np.asarray(v, dtype=np.float64), k + 1, {}
            while len(ids) <= k:  # an id with several vectors takes several of the nearest
                near = at
                if len(at) > most:  # the products only leave out what is farther by more than their error
                    rough = (squares + v @ v - 2 * (x @ v))[at]
                    near = at[rough <= np.partition(rough, most - 1)[most - 1] + 1e-9 * (squares.max() + v @ v)]
                gap = x[near] - v
                d = np.sqrt((gap * gap).sum(axis=1))
                ids = {}
                for i in np.argsort(d, kind="stable"):
                    for m in members[near[i]]:
                        ids.setdefault(m, d[i])
                    if len(ids) > k and d[i] > max(ids.values()):
                        break
                if most >= len(at):
                    break
                most *= 2
            found.extend((q, m, score) for m, score in ids.items() if m != q)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    def found_at(lengths: DataFrame) -> DataFrame:
        """(query_id, vec_id, score) of all that the runs of these lengths hold, for the queries that they name."""
        chosen = levels.withColumnRenamed("length", "upto").join(lengths, "id").filter(F.col("upto") == F.least("length", F.lit(depth)))
        cut = salted.select("dim", "tree", "block", "salts", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("upto"))
        cut = cut.withColumn("prefix", F.expr(f"shiftright(block, {depth} - upto)"))
        visits = (
            chosen.join(cut, ["dim", "tree", "upto", "prefix"])
            .select("id", "dim", "tree", "block", "code", "length", salts)
            .join(asked.select("id", "vector"), "id")
        )
        pairs = visits.groupBy(keys).cogroup(stored.groupBy(keys)).applyInPandas(search, f"query_id {id_kind}, vec_id {id_kind}, score double")
        return stable(pairs.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")), "found")

    # Runs may hold the query's own vector and few others: such queries ascend again, at last to all vectors.
    candidates = own.groupBy(F.size("vector").alias("dim")).agg(F.count_distinct("id").alias("held"))
    due = asked.join(candidates, "dim").select("id", F.least(F.col("held") - 1, F.lit(k)).alias("due"))
    found, ask = found_at(ascent), ascent
    while True:
        have = found.groupBy(F.col("query_id").alias("id")).agg(F.count("*").alias("have"))
        short = ask.filter("length > 0").join(due, "id").join(have, "id", "left").filter("coalesce(have, 0) < due")
        short = stable(short.select("id", F.expr("length DIV 2").cast("int").alias("length")), "short_queries")
        if short.isEmpty():
            break
        again = checked_broadcast(short.select(F.col("id").alias("query_id")))
        found, ask = found.join(again, "query_id", "left_anti").unionByName(found_at(short)), short
    ranked = W.partitionBy("query_id").orderBy("score", "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(ranked))
        .filter(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int"), "vec_id", "score")
    )

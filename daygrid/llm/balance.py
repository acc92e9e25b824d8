"""Shards of nearly equal bytes by Karmarkar-Karp differencing.

Equal texts form an indivisible group. Groups are dealt by hash into buckets of
some thousand; each bucket is differenced on its own: the two partial partitions
with the largest spread are combined, the larger shares of one with the smaller
shares of the other, until one partial partition is left. The partitions of the
buckets are then combined the same way, level by level, until one is left, and
the places are handed back down. No task sees more than one bucket.

Defined results: a null text has no bytes and size 1, forms the group of null
texts (apart from empty texts) and has checksum 0. Repeated rows each take a
place. Further columns are ignored. An empty table gives an empty result. Ties
are broken by the group's key. A group of more bytes than an even share fills a
shard alone as far as the others allow it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from daygrid.llm.common import bucket_of, parts
from daygrid.session import checked_broadcast, stable

BUCKET_GROUPS = 4096
SLOT_CHUNK = 20_000


def difference(items: list[tuple[list[int]]], shards: int) -> tuple[list[list[int]], list[int]]:
    """Combine partial partitions, each a list of ``shards`` sums, into one.

    Returns for each item the final place of each of its sums, and the final sums
    in descending order. Items must come in a fixed order, which breaks ties.
    """
    heap = []
    for i, sums in enumerate(items):
        order = sorted(range(shards), key=lambda j: (-sums[j], j))
        heap.append((sums[order[-1]] - sums[order[0]], i, [sums[j] for j in order], [[(i, j)] for j in order]))
    heapq.heapify(heap)
    stamp = len(items)
    while len(heap) > 1:
        _, _, a, held = heapq.heappop(heap)
        _, _, b, other = heapq.heappop(heap)
        sums = [x + y for x, y in zip(a, reversed(b), strict=True)]
        for mine, theirs in zip(range(shards), range(shards - 1, -1, -1), strict=True):
            small, large = sorted((held[mine], other[theirs]), key=len)
            large.extend(small)
            held[mine] = large
        order = sorted(range(shards), key=lambda j: (-sums[j], j))
        heapq.heappush(heap, (sums[order[-1]] - sums[order[0]], stamp, [sums[j] for j in order], [held[j] for j in order]))
        stamp += 1
    _, _, sums, held = heap[0]
    places = [[0] * shards for _ in items]
    for place, members in enumerate(held):
        for i, j in members:
            places[i][j] = place
    return places, sums


def difference_buckets(items: DataFrame, shards: int, buckets: int) -> DataFrame:
    """(item, sums) to (bucket, item, places) plus one row per bucket with its sums and no item."""

    def one(key: tuple[int], rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("item", kind="stable")
        places, sums = difference([list(map(int, s)) for s in rows["sums"]], shards)
        bucket = str(key[0])
        return pd.DataFrame(
            {
                "bucket": [bucket] * (len(places) + 1),
                "item": [*rows["item"], None],
                "places": [*places, None],
                "sums": [None] * len(places) + [sums],
            }
        )

    dealt = items.withColumn("bucket", bucket_of(buckets, "item"))
    return dealt.groupBy("bucket").applyInPandas(one, "bucket string, item string, places array<int>, sums array<long>")


def shards_of_groups(groups: DataFrame, shards: int, bucket_groups: int = BUCKET_GROUPS) -> DataFrame:
    """(item string, bytes long), one row per group, to (item, shard)."""
    rest = ", ".join(["0L"] * (shards - 1))
    items = groups.select("item", F.expr(f"array(bytes{', ' + rest if rest else ''})").alias("sums"))
    left, levels = groups.count(), []
    while True:
        buckets = parts(left, bucket_groups)
        done = stable(difference_buckets(items, shards, buckets), "differenced")
        levels.append(done.filter("item IS NOT NULL").select("item", "bucket", "places"))
        if buckets == 1:
            break
        items, left = done.filter("item IS NULL").select(F.col("bucket").alias("item"), "sums"), buckets
    placed = levels.pop().select("item", "places")
    while levels:
        above = stable(placed, "places").select(F.col("item").alias("bucket"), F.col("places").alias("upper"))
        placed = (
            levels.pop()
            .join(checked_broadcast(above), "bucket")
            .select("item", F.transform("places", lambda p: F.get("upper", p)).alias("places"))
        )
    return placed.select("item", F.get("places", F.lit(0)).alias("shard"))


def shard_documents(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows with their shard and a gapless slot in it; law ``bytes``.

    Columns: the id, size, text_crc32, law, shard, slot, grown_shard (null).
    """
    text = F.col(text_col)
    facts = stable(
        docs.select(
            F.col(id_col).alias("row_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
            F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
            F.coalesce(F.md5(text.cast("binary")), F.lit("null")).alias("item"),
        ),
        "sizes",
    )
    groups = stable(facts.groupBy("item").agg(F.sum("size").alias("bytes")), "groups")
    shard_of = stable(shards_of_groups(groups, shards), "shards")
    chunks = parts(facts.count(), SLOT_CHUNK)
    placed = stable(
        facts.join(checked_broadcast(shard_of), "item").withColumn("chunk", bucket_of(chunks, "row_id", "item")).drop("item"),
        "placed",
    )
    so_far = W.partitionBy("shard").orderBy("chunk")
    before = (
        placed.groupBy("shard", "chunk")
        .count()
        .select("shard", "chunk", (F.sum("count").over(so_far) - F.col("count")).alias("before"))
    )
    within = W.partitionBy("shard", "chunk").orderBy("row_id", "text_crc32", "size")
    return (
        placed.withColumn("place", F.row_number().over(within))
        .join(before, ["shard", "chunk"])
        .select(
            F.col("row_id").alias(id_col),
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            F.col("shard").cast("int"),
            (F.col("before") + F.col("place") - 1).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )

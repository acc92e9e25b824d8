"""SimHash near-duplicates by a Gray-order hierarchical index.

A fingerprint has 64 bits: bit b is 1 if it is set in over half the hashes of the text's
shingles. Equal fingerprints are one class. All pairs of classes within ``radius``
differing bits are found through a tree whose upper nodes are shared masked bit patterns:

* The uppermost level is dealt over the cluster. The bits are cut into radius + 1
  fields; two linked fingerprints agree in at least one of them. A node is a field with
  its value, and holds the fingerprints that show it. A node that holds more than
  ``NODE_MOST`` is replaced by nodes that share one of radius + 1 fields of the bits
  still free, level by level, so that no task gets an unbounded node and no pair is lost.
* Inside a task the fingerprints of its nodes are sorted by Gray rank, in which
  neighbours differ in few bits. Runs of ``FAN`` neighbours become a node that keeps the
  bits in which all agree (mask and pattern), runs of such nodes their parents, up to the
  dealt node.
* The tree is joined with itself from the top. The differences in bits that both nodes
  share are a lower bound for all pairs below; each step down adds those of the bits
  that become shared, and the whole pair of groups is pruned once the bound passes the
  radius. Where even the bits not shared can not bring a difference over the radius, all
  pairs below link at once. Only a spanning forest of the links leaves a task, so a
  group of copies costs as many rows as it has fingerprints.

Components come from the links by alternating stars, then every row gets its class's.

Defined results: null, empty and blank texts have the fingerprint zero and link like any
other; fewer words than a shingle make one shingle of all words, and repeated shingles
count each. Repeated rows are kept. A row without id takes part, a component's id is its
smallest non-null id (null if it has none). An empty table gives an empty result. Long
texts are hashed in blocks of ``BLOCK`` shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daygrid.llm.common import bucket_of, parts, small_batches, texts_of
from daygrid.llm.graph import components
from daygrid.session import checked_broadcast, stable

SHINGLE = 3
SEED = 42
RADIUS = 2
BITS = 64
BLOCK = 1 << 15
FAN = 8
NODE_MOST = 20_000
TASK_ROWS = 200_000
PIECE = 1 << 14  # pairs of nodes that go down together
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, the lowest bit first."""
    return np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint of a text; zero without words."""
    words = text.encode("utf-8").translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    k = min(shingle, len(words))
    last = ends[k - 1 :].tolist()
    first = (ends - lengths)[: len(words) - k + 1].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for i in range(0, len(first), BLOCK):
        spans = zip(first[i : i + BLOCK], last[i : i + BLOCK], strict=True)
        ones += bit_counts(np.array([digest(joined[a:b], seed) for a, b in spans], np.uint64))
    return int(np.packbits(2 * ones > len(first), bitorder="little").view("<u8")[0])


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, print) of every row, the fingerprint as signed long."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in texts_of(batches, "hashed_text"):
            prints = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], names=["doc", "print"])

    return docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("hashed_text")).mapInArrow(run, f"doc {kind}, print long")


def fields(free: int, count: int) -> list[int]:
    """``count`` masks of neighbouring bits that share out the free bits, some empty if there are too few."""
    bits = [b for b in range(BITS) if free >> b & 1]
    cuts = [len(bits) * i // count for i in range(count + 1)]
    return [sum(1 << b for b in bits[i:j]) for i, j in zip(cuts, cuts[1:], strict=False)]


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in Gray order."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class Level:
    """Nodes of one height: the bits in which all below agree and their pattern, children, and fingerprints below, as ranges."""

    def __init__(self, mask, pattern, low, high, start, end, root):
        self.mask, self.pattern, self.low, self.high, self.start, self.end, self.root = mask, pattern, low, high, start, end, root

    def __len__(self) -> int:
        return len(self.mask)

    def above(self, fan: int = FAN) -> Level:
        """Runs of ``fan`` nodes under one root as nodes."""
        n = len(self)
        fresh = np.concatenate(([True], self.root[1:] != self.root[:-1]))
        place = np.arange(n) - np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
        low = np.flatnonzero(fresh | (place % fan == 0))
        high = np.append(low[1:], n)
        ones, zeros = np.bitwise_and.reduceat(self.mask & self.pattern, low), np.bitwise_and.reduceat(self.mask & ~self.pattern, low)
        return Level(ones | zeros, ones, low, high, self.start[low], self.end[high - 1], self.root[low])


def index_of(codes: np.ndarray, roots: np.ndarray) -> list[Level]:
    """Levels from the fingerprints, sorted by root and Gray rank, up to one node for each root."""
    at = np.arange(len(codes))
    levels = [Level(np.full(len(codes), ALL), codes, at, at, at, at + 1, roots)]
    tops = 1 + np.count_nonzero(roots[1:] != roots[:-1])
    while len(levels[-1]) > tops:
        levels.append(levels[-1].above())
    return levels


def children(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which parent, and the child, for each child of each range."""
    sizes = high - low
    parent = np.repeat(np.arange(len(low)), sizes)
    return parent, np.arange(len(parent)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(low, sizes)


class Forest:
    """Disjoint sets over places, linked in bulk."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, at: np.ndarray) -> np.ndarray:
        while True:
            up = self.parent[at]
            if (up == at).all():
                return at
            self.parent[at] = self.parent[up]
            at = up

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.roots(a), self.roots(b)
            apart = a != b
            a, b = np.maximum(a[apart], b[apart]), np.minimum(a[apart], b[apart])
            np.minimum.at(self.parent, a, b)


def linked(codes: np.ndarray, roots: np.ndarray, radius: int = RADIUS) -> tuple[Forest, int]:
    """Sets of the places of ``codes`` (sorted by root and Gray rank, distinct within one), and how many pairs of nodes were met.

    Two fingerprints under one root that differ in at most ``radius`` bits end in one
    set. The join goes down depth first in pieces of bounded size.
    """
    levels, forest, met = index_of(codes, roots), Forest(len(codes)), 0
    top = np.arange(len(levels[-1]))
    todo = [(len(levels) - 1, top, top, np.zeros(len(top), np.uint8), np.zeros(len(top), np.uint64))]
    while todo:
        height, *pairs = todo.pop()
        if len(pairs[0]) > PIECE:
            half = len(pairs[0]) // 2
            todo += [(height, *(p[:half] for p in pairs)), (height, *(p[half:] for p in pairs))]
            continue
        a, b, differing, shared = pairs
        level = levels[height]
        both = level.mask[a] & level.mask[b]
        # The bits that become shared at this height add to the differences found above.
        differing = differing + np.bitwise_count((level.pattern[a] ^ level.pattern[b]) & both & ~shared)
        met += len(a)
        # Even if all bits not shared differ, the pairs below these nodes link.
        surely = differing + np.bitwise_count(~both) <= radius
        forest.link(level.start[a[surely]], level.start[b[surely]])
        if height:
            nodes = np.unique(np.concatenate((a[surely], b[surely])))
            node, below = children(level.start[nodes], level.end[nodes])
            forest.link(level.start[nodes][node], below)
            go = (differing <= radius) & ~surely
            a, b, differing, shared = a[go], b[go], differing[go], both[go]
            pair, x = children(level.low[a], level.high[a])
            a, b, differing, shared = a[pair], b[pair], differing[pair], shared[pair]
            pair, y = children(level.low[b], level.high[b])
            x, a, b, differing, shared = x[pair], a[pair], b[pair], differing[pair], shared[pair]
            once = (a != b) | (x < y) | ((x == y) & (height > 1))
            if once.any():
                todo.append((height - 1, x[once], y[once], differing[once], shared[once]))
    return forest, met


def forest_of(rows: pd.DataFrame, radius: int = RADIUS) -> pd.DataFrame:
    """Spanning links (a, b) of the fingerprints under the nodes (mask, value) of a task."""
    rows = rows.drop_duplicates()
    rows = rows[rows.duplicated(["mask", "value"], keep=False)]
    codes = rows["print"].to_numpy().view(np.uint64)
    roots = rows.groupby(["mask", "value"], sort=False).ngroup().to_numpy()
    order = np.lexsort((gray_rank(codes), roots))
    codes, roots = codes[order], roots[order]
    if not len(codes):
        return pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)})
    forest, _ = linked(codes, roots, radius)
    top = forest.roots(np.arange(len(codes)))
    away = top != np.arange(len(codes))
    found = np.unique(np.stack((codes[away], codes[top[away]]), axis=1).view(np.int64), axis=0)
    return pd.DataFrame({"a": found[:, 0], "b": found[:, 1]})


def dealt_nodes(classes: DataFrame, radius: int, node_most: int) -> DataFrame:
    """(print, mask, value): the uppermost nodes with the fingerprints below, none of more than ``node_most``
    while bits are left to split it by."""
    def under(rows: DataFrame, masks: dict[int, list[int]]) -> DataFrame:
        # A mask has radius + 1 finer ones; there are a few hundred masks at most.
        choices = F.coalesce(*(F.when(F.col("above") == m, F.array(*map(F.lit, fs))) for m, fs in masks.items()))
        dealt = rows.select("print", F.explode(choices).alias("mask"))
        return stable(dealt.withColumn("value", F.col("print").bitwiseAND(F.col("mask"))), "nodes")

    def finer(mask: int) -> list[int]:
        own = mask & int(ALL)
        return [signed(own | f) for f in fields(~own & int(ALL), radius + 1)]

    nodes, settled = under(classes.select("print", F.lit(0).cast("long").alias("above")), {0: finer(0)}), None
    while True:
        crowded = nodes.groupBy("mask", "value").count().filter(F.col("count") > node_most).select("mask", "value")
        crowded = stable(crowded.filter(F.bit_count("mask") < BITS - int(np.log2(node_most))), "crowded_nodes")
        masks = [r["mask"] for r in crowded.select("mask").distinct().collect()]
        if not masks:
            return nodes if settled is None else settled.union(nodes)
        small = nodes.join(checked_broadcast(crowded), ["mask", "value"], "left_anti").select("print", "mask", "value")
        settled = small if settled is None else settled.union(small)
        again = nodes.join(checked_broadcast(crowded), ["mask", "value"], "left_semi").select("print", F.col("mask").alias("above"))
        nodes = under(again, {m: finer(m) for m in masks})


def simhash_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, node_most: int = NODE_MOST
) -> DataFrame:
    """(id, fingerprint, component_id) of every row."""
    small_batches(docs.sparkSession)
    rows = stable(fingerprints(docs, id_col, text_col), "fingerprints")
    classes = stable(rows.groupBy("print").agg(F.min("doc").alias("doc")), "print_classes")
    tasks = parts((radius + 1) * classes.count(), TASK_ROWS)
    nodes = dealt_nodes(classes, radius, node_most).withColumn("task", bucket_of(tasks, "mask", "value"))
    links = nodes.groupBy("task").applyInPandas(lambda _, r: forest_of(r[["print", "mask", "value"]], radius), "a long, b long")
    roots = components(links).withColumnRenamed("node", "print")
    grouped = stable(classes.join(roots, "print", "left").select("print", "doc", F.coalesce("root", "print").alias("root")), "print_roots")
    smallest = grouped.groupBy("root").agg(F.min("doc").alias("component_id"))
    named = stable(grouped.join(smallest, "root").select("print", "component_id"), "named_prints")
    return rows.join(checked_broadcast(named), "print").select(
        F.col("doc").alias(id_col), F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id"
    )

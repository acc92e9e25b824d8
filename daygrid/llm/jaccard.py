"""Exact n-gram Jaccard join with set relations, as components of linked documents.

A document is its set of distinct five-word shingles (64-bit hashes). Equal sets
are one class, joined once. Tokens are put in one global order, rare ones before
frequent ones and by hash within, so that two linked sets share a token among the
first n - ceil(0.75 n) + 1 of each. The inverted lists over these prefixes are dealt
by token.

* Index skipping: a list is ordered by set size; for a set only the block of sizes
  that can still reach the similarity is visited, and a pair is skipped when the
  positions of the shared token leave too few tokens for the needed overlap. Two
  sets that meet at a frequent token have all their rare tokens before it; unless
  they meet at a rare one too, they share at most their frequent tokens.
* Answer skipping: a long list, or one of a frequent token, is not paired out.
  All its sets are compared with one leader, the set that shares most lists. Sets
  that the leader links need no comparison with each other, for the result is
  components. What is left outside gets leaders of its own, round by round while a
  round still closes a tenth of the open lists. For the rest the first leader's answers bound theirs: Jaccard distance is a metric, so two
  sets whose distances to the leader differ by more than 0.25 cannot link; of the
  others only those are compared whose bitmaps (the hash ranges that hold a token) leave
  room for the needed overlap. No pair between different components is left out otherwise.

A class keeps its bitmap, made with its hash; its tokens are made anew from one
document where a pair that its bitmap leaves needs them, and travel for no other.

Frequent tokens are those whose share of the sets reaches ``HOT_SHARE`` in some
chunk; any token whose share is that large overall is frequent in one chunk. Being
in the list decides the order only, never the result.

Defined results: null, empty and blank texts have an empty set and link with
nothing; fewer than five words make one shingle; repeated rows are kept and share
their class; a row without id takes part, a component's id is its smallest
non-null id. Hashes of equal value count as equal shingles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daygrid.llm.common import GOLDEN, bucket_of, give_back, giving_back, giving_back_at_end, mix64, parts, small_batches, texts_of, with_row_key
from daygrid.llm.graph import components
from daygrid.session import checked_broadcast, stable

SHINGLE = 5
NUM, DEN = 75, 100
HOT_SHARE = 1 / 2000
HOT_LEAST, HOT_MOST = 16, 200_000
CHUNK_TOKENS = 2_000_000
SHORT_LIST = 4
ROUNDS = 4
ROUND_GAIN = 0.1
BUCKET_ENTRIES = 400_000
KNOWN_WORDS = 150_000
BITMAP_BITS, LEVEL_TOKENS = 11, 1024
CELL_SETS = 20_000
SMALL_CELL = 128
TASK_SETS = 30_000
WORDS_AT_ONCE = 1 << 18  # of bitmaps that are compared at once
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
ENTRY = np.dtype([("token", "<u8"), ("own", "<u2"), ("pos", "<u2")])
SET = np.dtype([("key", "<i8"), ("n", "<i4")])


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > KNOWN_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_HASHES = WordHashes()


def forget() -> None:
    """Empties the hashes of this worker; by name, as a task's own functions travel with copies of what they refer to."""
    _HASHES.clear()


def forgetting(run: Callable) -> Callable:
    """``run`` over the batches of a task; what it kept of words is given back at the end, for the worker lives on."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            forget()
            give_back()

    return wrapped


def shingles(text: str) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    k = min(SHINGLE, len(w))
    h = mix64(w[: len(w) - k + 1] + np.uint64(k))
    for j in range(1, k):
        h = mix64(h * GOLDEN + w[j : len(w) - k + 1 + j])
    return np.unique(h)


def key_of(tokens: np.ndarray) -> int:
    """Signed 64-bit hash of a set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes())).astype(np.int64))


def needed(n, m):
    """Least overlap of linked sets of sizes n and m."""
    return -((-NUM * (n + m)) // (NUM + DEN))


def prefix_length(n: int) -> int:
    return n + 1 + (-NUM * n) // DEN


def _sets_and_hot(batches: Iterator[pa.RecordBatch], with_bitmaps: bool = False) -> Iterator[pa.RecordBatch]:
    """A row per document, and per chunk a row with its frequent tokens and their counts.

    ``with_bitmaps`` adds the bitmap of each set that is new to the chunk.
    """
    seen, held = set(), bytearray()

    def rows(ids, n, keys, tokens, counts, bitmaps) -> pa.RecordBatch:
        columns = [ids, pa.array(n, pa.int64()), pa.array(keys, pa.int64()), pa.array(tokens, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int64()))]
        names = ["doc", "n", "key", "tokens", "counts"]
        if with_bitmaps:
            columns, names = [*columns, pa.array(bitmaps, pa.binary())], [*names, "bitmap"]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def hot(kind: pa.DataType) -> pa.RecordBatch:
        tokens, counts = often(np.frombuffer(held, np.uint64), max(3, HOT_SHARE * len(seen)))
        return rows(pa.nulls(1, kind), [None], [None], [tokens.view(np.int64)], [counts], [None])

    kind = pa.int64()
    for batch, texts in texts_of(batches, "shingled_text"):
        kind, ns, keys, bitmaps = batch.column(0).type, [], [], []
        for t in texts:
            s = shingles(t)
            key = key_of(s) if len(s) else None
            fresh = key is not None and key not in seen
            ns.append(len(s))
            keys.append(key)
            bitmaps.append(bitmap_of(s) if fresh and with_bitmaps else None)
            if fresh:
                seen.add(key)
                held += s.tobytes()
        yield rows(batch.column(0), ns, keys, [None] * len(ns), [None] * len(ns), bitmaps)
        if len(held) > 8 * CHUNK_TOKENS:
            yield hot(kind)
            seen, held = set(), bytearray()
    if held:
        yield hot(kind)


def often(tokens: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The tokens that stand at ``least`` places or more, with their counts; sorts ``tokens`` in place."""
    tokens.sort()
    more = int(np.ceil(least)) - 1
    found = np.unique(tokens[: len(tokens) - more][tokens[more:] == tokens[: len(tokens) - more]]) if len(tokens) > more else tokens[:0]
    return found, np.searchsorted(tokens, found, side="right") - np.searchsorted(tokens, found)


def pack(sets: np.ndarray, entries: np.ndarray) -> bytes:
    """Entries with the sets that they name, renumbered."""
    used, own = np.unique(entries["own"], return_inverse=True)
    entries = entries.copy()
    entries["own"] = own
    return len(used).to_bytes(4, "little") + sets[used].tobytes() + entries.tobytes()


def unpack(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Token, key, n and position of packed entries."""
    m = int.from_bytes(payload[:4], "little")
    sets = np.frombuffer(payload, SET, m, 4)
    e = np.frombuffer(payload, ENTRY, -1, 4 + m * SET.itemsize)
    return e["token"], sets["key"][e["own"]], sets["n"][e["own"]].astype(np.int64), e["pos"].astype(np.int64)


def prefix_lists(docs: DataFrame, hot: np.ndarray, buckets: int) -> DataFrame:
    """(bucket, payload) with packed prefix entries; those of frequent tokens go, by their set, to buckets below zero."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, seen = shared.value, set()
        for _, texts in texts_of(batches, "shingled_text"):
            sets, rows, where = [], [np.empty(0, ENTRY)], [np.empty(0, np.int64)]
            for t in texts:
                s = shingles(t)
                if not len(s):
                    continue
                key = key_of(s)
                if key in seen:
                    continue
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.add(key)
                p = prefix_length(len(s))
                at = np.minimum(np.searchsorted(frequent, s), max(0, len(frequent) - 1))
                is_hot = frequent[at] == s if len(frequent) else np.zeros(len(s), bool)
                first = s[~is_hot][:p]
                last = s[is_hot][: p - len(first)]
                e = np.empty(len(first) + len(last), ENTRY)
                e["token"], e["own"], e["pos"] = np.concatenate((first, last)), len(sets), np.minimum(np.arange(len(e)), min(len(first), 65535))
                sets.append((key, len(s)))
                rows.append(e)
                where.append(((first >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64))
                where.append(np.full(len(last), -1 - key % buckets, np.int64))
            e, b, sets = np.concatenate(rows), np.concatenate(where), np.array(sets, SET)
            order = np.argsort(b, kind="stable")
            e, b = e[order], b[order]
            cuts = [0, *(np.flatnonzero(np.diff(b)) + 1).tolist(), len(b)] if len(b) else [0]
            ids = [int(b[i]) for i in cuts[:-1]]
            packed = [pack(sets, e[i:j]) for i, j in zip(cuts, cuts[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(packed, pa.binary())], names=["bucket", "payload"])

    return docs.mapInArrow(forgetting(run), "bucket long, payload binary")


def pairs_of_bucket(bucket: tuple, rows: pa.Table) -> pa.Table:
    """Candidate pairs (a, b) of short lists; members (list, key, n, left) of long ones and of frequent tokens.

    ``left`` is the number of tokens from the shared one on, the most that can be shared.

    A long list is named by its members, so that tokens with the same list count once.
    """
    token, key, n, pos = (np.concatenate(x) for x in zip(*map(unpack, rows.column("payload").to_pylist()), strict=True))
    del rows
    order = np.lexsort((key, n, token))
    token, key, n, pos = token[order], key[order], n[order], pos[order]
    fresh = np.ones(len(token), bool)
    fresh[1:] = (token[1:] != token[:-1]) | (key[1:] != key[:-1])
    token, key, n, pos = token[fresh], key[fresh], n[fresh], pos[fresh]
    starts = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
    sizes = np.diff(np.concatenate((starts, [len(token)])))
    a, b, names, at = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    if bucket[0].as_py() < 0:
        names.append(token.view(np.int64))
        at.append(np.arange(len(token)))
    else:
        for start, size in zip(starts[sizes > SHORT_LIST], sizes[sizes > SHORT_LIST], strict=True):
            members = np.sort(key[start : start + size])
            names.append(np.full(size, key_of(members)))
            at.append(np.arange(start, start + size))
        for size in range(2, SHORT_LIST + 1):
            first = starts[sizes == size]
            for i in range(size):
                for j in range(i + 1, size):
                    x, y = first + i, first + j
                    ok = (DEN * n[x] >= NUM * n[y]) & (np.minimum(n[x] - pos[x], n[y] - pos[y]) >= needed(n[x], n[y]))
                    a.append(np.minimum(key[x], key[y])[ok])
                    b.append(np.maximum(key[x], key[y])[ok])
    pairs = np.unique(np.stack((np.concatenate(a), np.concatenate(b)), axis=1), axis=0)
    at = np.concatenate(at)
    members = np.unique(np.stack((np.concatenate(names), key[at], n[at], n[at] - pos[at]), axis=1), axis=0)
    m, k = len(pairs), len(members)

    def column(values: np.ndarray, above: int, below: int) -> pa.ChunkedArray:
        return pa.chunked_array([pa.nulls(above, pa.int64()), pa.array(np.ascontiguousarray(values)), pa.nulls(below, pa.int64())], pa.int64())

    columns = [column(pairs[:, c], 0, k) for c in range(2)] + [column(members[:, c], m, 0) for c in range(4)]
    return pa.table(columns, names=["a", "b", "list", "key", "n", "left"])


def level_of(n: np.ndarray) -> np.ndarray:
    """Levels of bitmaps: 0 up to ``LEVEL_TOKENS`` tokens, one more for each further factor of four."""
    return np.maximum(0, np.ceil(np.log2(np.maximum(n, 1) / LEVEL_TOKENS) / 2)).astype(np.int64)


def bitmap_of(tokens: np.ndarray) -> bytes:
    """Which hash ranges hold a token, two bits to a token at least.

    A range that holds one of a and none of b holds a token of a that b lacks.
    """
    bits = BITMAP_BITS + 2 * int(level_of(np.array(len(tokens))))
    out = np.zeros(1 << bits, bool)
    out[(tokens >> np.uint64(64 - bits)).astype(np.int64)] = True
    return np.packbits(out).tobytes()


def folded(maps: np.ndarray) -> np.ndarray:
    """Bitmaps (rows of words) one level down: four neighbouring ranges become one."""
    bits = np.unpackbits(maps.view(np.uint8), axis=1)
    return np.packbits(bits.reshape(len(maps), -1, 4).any(axis=2), axis=1).view(np.uint64)


class Bitmaps:
    """Bitmaps of some sets, to bound overlaps of pairs by place."""

    def __init__(self, raw: list[bytes], n: np.ndarray):
        self.n, self.level = n, level_of(n)
        self.words, self.slot = {}, {}
        for level in np.unique(self.level).tolist():
            own, above = np.flatnonzero(self.level == level), np.flatnonzero(self.level == level + 1)
            parts = [np.frombuffer(b"".join(raw[i] for i in own), np.uint64).reshape(len(own), -1)]
            if len(above):
                parts.append(folded(np.frombuffer(b"".join(raw[i] for i in above), np.uint64).reshape(len(above), -1)))
            self.words[level] = np.concatenate(parts)
            self.slot[level] = np.full(len(n), -1)
            self.slot[level][np.concatenate((own, above))] = np.arange(len(own) + len(above))

    def room(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether the pairs (i, j) can share as many tokens as they need; true where levels are too far apart to tell."""
        out = np.ones(len(i), bool)
        low = np.minimum(self.level[i], self.level[j])
        for level, words in self.words.items():
            slot, step = self.slot[level], max(1, WORDS_AT_ONCE // words.shape[1])
            found = np.flatnonzero((low == level) & (slot[i] >= 0) & (slot[j] >= 0))
            for start in range(0, len(found), step):
                at = found[start : start + step]
                p, q, n, m = words[slot[i[at]]], words[slot[j[at]]], self.n[i[at]], self.n[j[at]]
                most = np.minimum(n - np.bitwise_count(p & ~q).sum(axis=1, dtype=np.int64), m - np.bitwise_count(q & ~p).sum(axis=1, dtype=np.int64))
                out[at] = most >= needed(n, m)
        return out


def bitmaps_of(made: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, n, bitmap) of the classes in ``wanted`` (key), once each."""
    found = made.filter("bitmap IS NOT NULL").select("key", "n", "bitmap")
    return stable(found.join(checked_broadcast(stable(wanted.select("key"), "bitmap_keys")), "key", "left_semi").dropDuplicates(["key"]), "bitmaps")


def packed_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, n, prints) of the classes in ``wanted`` (key, doc), made anew from one document of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in texts_of(batches, "shingled_text"):
            sets = {key_of(s): s for s in map(shingles, texts) if len(s)}
            columns = [
                pa.array(list(sets), pa.int64()),
                pa.array([len(s) for s in sets.values()], pa.int64()),
                pa.array([s.tobytes() for s in sets.values()], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "n", "prints"])

    wanted = stable(wanted.select("key", F.col("doc").alias("rep")), "set_keys")
    ids = checked_broadcast(stable(wanted.select("rep").distinct(), "set_ids"))
    chosen = docs.join(ids, F.col("doc").eqNullSafe(F.col("rep")), "left_semi")
    made = chosen.mapInArrow(forgetting(run), "key long, n long, prints binary")
    return stable(made.join(checked_broadcast(wanted.select("key")), "key", "left_semi"), "sets")


def within_bound(pairs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """The pairs (a, b) whose bitmaps leave room for the needed overlap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.concatenate([batch.column(k).to_numpy() for k in (2, 3)])
            maps = Bitmaps([*batch.column(4).to_pylist(), *batch.column(5).to_pylist()], n)
            fits = maps.room(np.arange(batch.num_rows), np.arange(batch.num_rows) + batch.num_rows)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(fits)) for c in batch.columns[:2]], names=["a", "b"])

    first = bitmaps.select(F.col("key").alias("a"), F.col("n").alias("n_a"), F.col("bitmap").alias("x"))
    second = bitmaps.select(F.col("key").alias("b"), F.col("n").alias("n_b"), F.col("bitmap").alias("y"))
    rows = pairs.join(second, "b").join(first, "a").select("a", "b", "n_a", "n_b", "x", "y")
    return stable(rows.mapInArrow(giving_back_at_end(run), "a long, b long"), "bounded_pairs")


def verified(pairs: DataFrame, bitmaps: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b, shared, n_a, n_b): the exact overlap of each pair that the bitmaps leave; only the sets of those are made and travel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared, last, mine = [], None, None
            for x, y in zip(batch.column(4), batch.column(5), strict=True):
                raw = x.as_py()
                if raw != last:
                    last, mine = raw, np.frombuffer(raw, np.uint64)
                shared.append(len(np.intersect1d(mine, np.frombuffer(y.as_py(), np.uint64), assume_unique=True)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(shared, pa.int64())], names=["a", "b", "n_a", "n_b", "shared"])

    pairs = within_bound(pairs, bitmaps)
    used = checked_broadcast(stable(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "used_keys"))
    own = packed_sets(docs, classes.select("key", "doc").join(used, "key"))
    first = own.select(F.col("key").alias("a"), F.col("n").alias("n_a"), F.col("prints").alias("x"))
    second = own.select(F.col("key").alias("b"), F.col("n").alias("n_b"), F.col("prints").alias("y"))
    rows = pairs.join(second, "b").join(first, "a").select("a", "b", "n_a", "n_b", "x", "y")
    return stable(rows.mapInArrow(giving_back_at_end(run), "a long, b long, n_a long, n_b long, shared long").distinct(), "overlaps")


def linking(overlaps: DataFrame) -> DataFrame:
    return overlaps.filter(f"{DEN} * shared >= {NUM} * (n_a + n_b - shared)").select("a", "b")


def with_roots(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of the lists that still hold several components, with their root."""
    found = lists.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    found = stable(found, "members")
    several = found.groupBy("list").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("list")
    return found.join(several, "list")


def fitting() -> str:
    return f"{DEN} * least(n, leader_n) >= {NUM} * greatest(n, leader_n) AND {NUM + DEN} * least(left, leader_left) >= {NUM} * (n + leader_n)"


def star_pairs(members: DataFrame, candidates: DataFrame) -> DataFrame:
    """Pairs of each list's members with its leader, the candidate of the most weight."""
    best = F.max(F.struct("weight", F.col("key").alias("leader"), F.col("n").alias("leader_n"), F.col("left").alias("leader_left"), F.col("root").alias("leader_root"))).alias("best")
    leaders = candidates.groupBy("list").agg(best).select("list", "best.*").drop("weight")
    pairs = members.join(leaders, "list").filter(f"root <> leader_root AND {fitting()}")
    return pairs.select(F.least("leader", "key").alias("a"), F.greatest("leader", "key").alias("b")).distinct()


def residual_pairs(members: DataFrame, overlaps: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """Pairs of long lists that neither the leaders' answers nor the bitmaps linked or ruled out.

    A list of more than ``CELL_SETS`` sets is cut by the hash of the set; every two of
    its parts meet in a task of their own.
    """
    known = overlaps.select("a", "b", (1 - F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared"))).alias("gap"))
    known = known.union(known.select(F.col("b").alias("a"), F.col("a").alias("b"), "gap"))
    best = F.max(F.struct("weight", F.col("key").alias("leader"), F.col("root").alias("leader_root"))).alias("best")
    leaders = members.groupBy("list").agg(best).select("list", "best.leader", "best.leader_root")
    # Without a measured distance to the leader nothing is known of a set: null.
    gaps = members.join(leaders, "list").join(known.select(F.col("a").alias("key"), F.col("b").alias("leader"), "gap"), ["key", "leader"], "left")
    gaps = stable(gaps.withColumn("gap", F.when(F.col("key") == F.col("leader"), 0.0).otherwise(F.col("gap"))), "gaps")
    outside = F.col("root") != F.col("leader_root")
    room = 1 - NUM / DEN + 1e-9
    least = gaps.filter(outside).groupBy("list").agg(F.min(F.coalesce("gap", F.lit(0.0))).alias("nearest"))
    open_ = gaps.join(least, "list").filter(outside | F.col("gap").isNull() | (F.col("gap") >= F.col("nearest") - room))
    open_ = stable(open_.select("list", "key", "n", "left", "root", "gap"), "open_sets")
    cuts = open_.groupBy("list").agg(F.ceil(F.count("*") / CELL_SETS).cast("int").alias("cuts"))
    own = F.pmod(F.xxhash64("key"), F.col("cuts")).cast("int")
    dealt = open_.join(cuts, "list").withColumn("cut", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    dealt = dealt.withColumns({"low": F.least("cut", "other"), "high": F.greatest("cut", "other")})
    # Many cells meet in a task, each compared on its own; a set's bitmap comes to a task once, however many lists hold it.
    task = bucket_of(parts(open_.count(), TASK_SETS), "list", "low", "high").alias("task")
    dealt = stable(dealt.select(task, "list", "low", "high", "cut", "key", "n", "left", "root", "gap"), "cells")
    wanted = dealt.select(F.col("task").alias("to_task"), F.col("key").alias("of_set")).distinct()
    bitmaps = wanted.join(bitmaps.select(F.col("key").alias("of_set"), F.col("n").alias("size"), "bitmap"), "of_set")

    def pair(rows: pa.Table, held: pa.Table) -> pa.Table:
        cell = np.stack([rows.column(c).to_numpy().astype(np.int64) for c in ("list", "low", "high")], axis=1)
        keys, n, left, root, gap, cut = (rows.column(c).to_numpy() for c in ("key", "n", "left", "root", "gap", "cut"))
        order = np.lexsort((keys, n, cell[:, 2], cell[:, 1], cell[:, 0]))
        twice = np.concatenate(([False], (cell[order[1:]] == cell[order[:-1]]).all(axis=1) & (keys[order[1:]] == keys[order[:-1]])))[: len(order)]
        order = order[~twice]
        cell, keys, n, left, root, gap, cut = (x[order] for x in (cell, keys, n, left, root, gap, cut))
        held = held.sort_by("of_set")
        maps, spot = Bitmaps(held.column("bitmap").to_pylist(), held.column("size").to_numpy()), np.searchsorted(held.column("of_set").to_numpy(), keys)
        del rows, held
        starts = np.flatnonzero(np.concatenate(([True], (cell[1:] != cell[:-1]).any(axis=1))))
        stops, crossed = np.append(starts[1:], len(keys)), cell[:, 1] != cell[:, 2]
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]

        def compare(i: np.ndarray, j: np.ndarray) -> None:
            least_shared = needed(n[i], n[j])
            far = np.abs(gap[i] - gap[j]) > room  # false where a distance is not known
            meets = (root[i] != root[j]) & (DEN * n[i] >= NUM * n[j]) & (np.minimum(left[i], left[j]) >= least_shared) & ~far
            meets &= ~crossed[i] | (cut[i] != cut[j])
            i, j = i[meets], j[meets]
            fits = maps.room(spot[i], spot[j])
            x, y = keys[i[fits]], keys[j[fits]]
            a.append(np.minimum(x, y))
            b.append(np.maximum(x, y))

        for start, stop in zip(starts, stops, strict=True):
            if stop - start <= SMALL_CELL:
                i, j = np.triu_indices(stop - start, 1)
                compare(i + start, j + start)
                continue
            ends = start + np.searchsorted(n[start:stop], n[start:stop] * DEN // NUM, side="right")  # sizes that can still match
            for i in np.flatnonzero(left[start:stop] >= needed(n[start:stop], n[start:stop])) + start:  # partners need as much
                j = np.arange(i + 1, ends[i - start])
                compare(np.full(len(j), i), j)
        pairs = np.unique(np.stack((np.concatenate(a), np.concatenate(b)), axis=1), axis=0)
        return pa.table({"a": np.ascontiguousarray(pairs[:, 0]), "b": np.ascontiguousarray(pairs[:, 1])})

    found = dealt.groupBy("task").cogroup(bitmaps.groupBy("to_task")).applyInArrow(giving_back(pair), "a long, b long")
    return found.distinct().join(overlaps.select("a", "b"), ["a", "b"], "left_anti")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every row."""
    spark = docs.sparkSession
    small_batches(spark)
    own = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("shingled_text"))
    id_kind = docs.schema[id_col].dataType.simpleString()
    made = own.mapInArrow(forgetting(partial(_sets_and_hot, with_bitmaps=True)), f"doc {id_kind}, n long, key long, tokens array<long>, counts array<long>, bitmap binary")
    made = stable(made, "shingled")
    rows = made.filter("tokens IS NULL").select("doc", "n", "key")
    classes = stable(rows.filter("key IS NOT NULL").groupBy("key").agg(F.min("doc").alias("doc"), F.max("n").alias("n")), "classes")
    total = classes.agg(F.count("*").alias("sets"), F.sum(F.expr(f"n + 1 - ceil({NUM} * n / {DEN})")).alias("entries")).first()

    frequent = (
        made.filter("tokens IS NOT NULL")
        .select(F.explode(F.arrays_zip("tokens", "counts")).alias("t"))
        .groupBy(F.col("t.tokens").alias("token"))
        .agg(F.sum("t.counts").alias("n"))
        .filter(F.col("n") >= max(HOT_LEAST, HOT_SHARE * total["sets"]))
    )
    hot = [r["token"] for r in frequent.orderBy(F.desc("n"), "token").limit(HOT_MOST).collect()]
    hot = np.sort(np.array(hot, np.int64).view(np.uint64))

    packed = prefix_lists(own, hot, parts(total["entries"] or 0, BUCKET_ENTRIES))
    found = packed.groupBy("bucket").applyInArrow(giving_back(pairs_of_bucket), "a long, b long, list long, key long, n long, left long")
    found = stable(found, "candidates")
    lists = found.filter("list IS NOT NULL").groupBy("list", "key").agg(F.max("n").alias("n"), F.max("left").alias("left"))
    lists = stable(lists, "lists")
    held = lists.groupBy("list").agg(F.count("*").alias("held")).filter("held > 1")
    weights = lists.join(held, "list").groupBy("key").agg(F.sum("held").alias("weight"))
    lists = stable(lists.join(held.select("list"), "list").join(weights, "key"), "weighted_lists")

    in_pairs = found.filter("a IS NOT NULL").select(F.explode(F.array("a", "b")).alias("key")).union(lists.select("key")).distinct()
    bitmaps = bitmaps_of(made, in_pairs)
    members = lists.withColumn("root", F.col("key"))
    pairs = stable(found.filter("a IS NOT NULL").select("a", "b").union(star_pairs(members, members)).distinct(), "pairs")
    overlaps = verified(pairs, bitmaps, own, classes)
    members, still_open = stable(with_roots(lists, components(linking(overlaps))), "open_members"), None
    for _ in range(ROUNDS):
        before, still_open = still_open, members.count()
        if before is not None and still_open > (1 - ROUND_GAIN) * before:
            break
        main = members.groupBy("list").agg(F.max(F.struct("weight", "key", "root")).alias("m")).select("list", F.col("m.root").alias("main"))
        fresh = star_pairs(members, members.join(main, "list").filter("root <> main"))
        fresh = stable(fresh.join(overlaps.select("a", "b"), ["a", "b"], "left_anti"), "star_pairs")
        if fresh.isEmpty():
            break
        overlaps = overlaps.union(verified(fresh, bitmaps, own, classes))
        members = stable(with_roots(lists, components(linking(overlaps))), "open_members")
    rest = stable(residual_pairs(members, overlaps, bitmaps), "residual_pairs")
    roots = components(linking(overlaps.union(verified(rest, bitmaps, own, classes))))

    grouped = classes.join(roots.withColumnRenamed("node", "key"), "key", "left").select("key", "doc", F.coalesce("root", "key").alias("root"))
    grouped = stable(grouped, "grouped")
    smallest = grouped.groupBy("root").agg(F.min("doc").alias("component_id"))
    named = stable(grouped.join(smallest, "root").select("key", "component_id"), "named")
    return rows.join(checked_broadcast(named), "key", "left").select(
        F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce(F.when(F.col("key").isNotNull(), F.col("component_id")), F.col("doc")).alias("component_id")
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group, that with the smallest id; documents without words all stay.

    Decisions go by id and text together: of two texts under one id each keeps its own, a row
    without id is the last of its group, and of rows equal in both one stays.
    """
    keyed, key = with_row_key(docs)
    found = stable(jaccard_components(keyed, key), "row_components")
    losers = stable(found.filter(F.col(key) != F.col("component_id")).select(key).distinct(), "near_copies")
    left = keyed.join(checked_broadcast(losers), key, "left_anti")
    held = found.filter((F.col(key) == F.col("component_id")) & (F.col("n_shingles") > 0)).groupBy(key).count()
    repeated = stable(held.filter("count > 1").select(key), "repeated")
    if repeated.isEmpty():
        return left.select(docs.columns)
    again = checked_broadcast(repeated)
    single = left.join(again, key, "left_semi").dropDuplicates([key])
    return left.join(again, key, "left_anti").select(docs.columns).union(single.select(docs.columns))


def components_sql() -> str:
    """The same by brute force in DuckDB."""
    space = "[ \t-\r]+"
    return f"""
    WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id,
            list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{space}'), lambda x: x <> '') AS w
            FROM documents),
    s AS (SELECT r, doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) < {SHINGLE} THEN [array_to_string(w, ' ')]
            ELSE list_distinct(list_transform(range(1, len(w) - {SHINGLE} + 2), lambda p: array_to_string(w[p : p + {SHINGLE - 1}], ' '))) END AS s FROM d),
    t AS (SELECT r, len(s) AS n, unnest(s) AS g FROM s),
    p AS (SELECT x.r AS a, y.r AS b FROM t x JOIN t y ON x.g = y.g AND x.r < y.r GROUP BY x.r, y.r, x.n, y.n
          HAVING {DEN} * count(*) >= {NUM} * (x.n + y.n - count(*))),
    e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
    c AS (SELECT r, r AS o FROM s UNION SELECT c.r, e.b FROM c JOIN e ON c.o = e.a)
    SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m.component_id
    FROM s JOIN (SELECT c.r, min(x.doc_id) AS component_id FROM c JOIN s x ON x.r = c.o GROUP BY c.r) m USING (r)"""

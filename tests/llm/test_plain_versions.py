"""Plain versions beside the operators: sharding facts, follow-the-regularised-leader, batches by bytes, bounds of the join."""

import itertools
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from daygrid.llm import balance, jaccard, quality, tokens

WORDS = public_tokenizers.path("word_bpe_49k.json")


def test_shards_by_hand(spark):
    r = random.Random(2)
    texts = ["é" * r.randint(0, 40) + "x" * r.randint(0, 900) for _ in range(120)] + ["twin"] * 7 + [None, "", ""]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (3, texts[3]), (None, "no id")]
    got = balance.shard_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    facts = sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows), key=repr)
    assert sorted(((x.doc_id, x["size"], x.text_crc32) for x in got), key=repr) == facts
    assert {x.law for x in got} == {"bytes"} and {x.grown_shard for x in got} == {None}
    total = [sum(x["size"] for x in got if x.shard == s) for s in range(8)]
    assert all(sorted(x.slot for x in got if x.shard == s) == list(range(sum(x.shard == s for x in got))) for s in range(8))
    shard_of = {}
    for x in got:  # equal texts stay together; no text and an empty one are two groups
        assert x["size"] == 1 or shard_of.setdefault((x.text_crc32, x["size"]), x.shard) == x.shard
    assert max(total) - min(total) <= 0.05 * sum(total) / 8


@pytest.mark.parametrize("seed", range(6))
def test_differencing_is_near_the_best_of_all_partitions(seed):
    r = random.Random(seed)
    sizes = sorted((r.randint(1, 100) for _ in range(9)), reverse=True)
    places, _ = balance.difference([[s, 0, 0] for s in sizes], 3)
    spread = lambda t: max(t) - min(t)
    totals = lambda at: [sum(s for s, p in zip(sizes, at, strict=True) if p == k) for k in range(3)]
    best = min(spread(totals((0, *rest))) for rest in itertools.product(range(3), repeat=8))
    assert best <= spread(totals([p[0] for p in places])) <= best + max(sizes) / 2


def plain_ftrl(rows, bits, epochs):
    """One feature at a time, as the method is written down."""
    z, n = {}, {}
    good = sum(y for _, _, y in rows)
    cost = {0: math.sqrt(max(1, good) / max(1, len(rows) - good)), 1: 1.0}

    def weight(i):
        if abs(z.get(i, 0.0)) <= quality.L1:
            return 0.0
        return -(z[i] - math.copysign(quality.L1, z[i])) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)

    for _ in range(epochs):
        for ids, x, y in rows:
            w = [weight(i) for i in ids]
            p = 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, x, strict=True))))
            for i, a, old in zip(ids, x, w, strict=True):
                g = cost[y] * (p - y) * a
                step = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / quality.ALPHA
                z[i] = z.get(i, 0.0) + g - step * old
                n[i] = n.get(i, 0.0) + g * g
    return np.array([weight(i) for i in range(1 << bits)])


def test_ftrl_equals_the_plain_form():
    r = random.Random(4)
    texts = [" ".join(r.choices(["good", "Fine", "bad", "7", "xx-y"], k=r.randint(0, 12))) for _ in range(60)]
    rows = [(ids.tolist(), x.astype(float).tolist(), int("good" in t)) for t in texts for ids, x in [quality.features(t, 8)]]
    arrays = [(np.array(ids), np.array(x), y) for ids, x, y in rows]
    assert np.allclose(quality.fit_ftrl(arrays, 8, 3), plain_ftrl(rows, 8, 3), rtol=1e-6, atol=1e-7)


def test_calls_and_groups_are_bounded_by_bytes():
    r = random.Random(6)
    pieces = ["é" * r.randint(1, 60) for _ in range(3000)] + ["long" * 5000]
    for cut in (tokens.byte_groups(pieces, 1000), tokens.byte_balanced(pieces, 1000)):
        cut = list(cut)
        assert [p for c in cut for p in c] == pieces
        assert all(len("".join(c).encode()) <= 1000 or len(c) == 1 for c in cut)
    even = [len("".join(c).encode()) for c in tokens.byte_balanced(["abcd"] * 1000, 1500)]
    assert len(even) <= 4 and max(even[:3]) - min(even[:3]) <= 8  # what rounding leaves over is a small call
    assert list(tokens.byte_balanced([])) == []


def test_counts_do_not_depend_on_the_groups(monkeypatch):
    from tokenizers import Tokenizer

    r = random.Random(8)
    texts = [" ".join("".join(r.choices("abcdeé.,7", k=r.randint(1, 9))) for _ in range(r.randint(0, 50))) for _ in range(60)] + ["run" * 400]
    want = [len(e) for e in Tokenizer.from_file(WORDS).encode_batch(texts, add_special_tokens=False)]
    assert tokens.lengths(texts, WORDS) == want
    for name, value in (("GROUP_BYTES", 50), ("KNOWN_PIECES", 5), ("KNOWN_BYTES", 2), ("CALL_BYTES", 30)):
        monkeypatch.setattr(tokens, name, value)
    assert tokens.lengths(texts, WORDS) == want


@pytest.mark.parametrize("sizes", [(5, 40), (900, 1200), (3000, 5200), (1024, 4096)])
def test_bitmaps_bound_the_overlap(sizes):
    rng = np.random.default_rng(sizes[0])
    sets = []
    for _ in range(40):
        base = sets[rng.integers(len(sets))] if sets and rng.random() < 0.7 else np.empty(0, np.uint64)
        fresh = rng.integers(0, 2**63, int(rng.integers(*sizes)), dtype=np.int64).astype(np.uint64) * np.uint64(2)
        kept = base[rng.random(len(base)) < rng.choice([0.5, 0.9, 0.99])]
        sets.append(np.unique(np.concatenate((kept, fresh[: max(1, len(fresh) - len(kept))]))))
    sets.sort(key=len)
    n = np.array([len(s) for s in sets])
    maps = jaccard.Bitmaps([jaccard.bitmap_of(s) for s in sets], n)
    i, j = np.triu_indices(len(sets), 1)
    room, shared = maps.room(i, j), np.array([len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j, strict=True)])
    linked = 100 * shared >= 75 * (n[i] + n[j] - shared)
    assert not (linked & ~room).any()
    apart = (shared < 0.3 * n[i]) & (jaccard.level_of(n[i]) == jaccard.level_of(n[j]))
    assert not apart.any() or room[apart].mean() < 0.5

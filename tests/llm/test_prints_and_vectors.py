"""SimHash components, whitening and centroid clustering against brute force, and their edge rows."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from daygrid.llm import centroids, simhash, whitening
from daygrid.llm.exact import LONG_END

DOCS = "doc_id long, text string"
VECTORS = "vec_id long, embedding array<float>"


def groups_of(prints, radius=2):
    """Smallest place reachable from each place, every pair compared."""
    prints = np.asarray(prints, np.uint64)
    group = np.arange(len(prints))
    moved = True
    while moved:
        moved = False
        for i, p in enumerate(prints):
            least = group[np.bitwise_count(prints ^ p) <= radius].min()
            if least < group[i]:
                group[i], moved = least, True
    return group.tolist()


def plain_print(text):
    words = [w for w in (text or "").translate({**{i: i + 32 for i in range(65, 91)}, **{i: 32 for i in range(9, 14)}}).split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def crowd(seed, n, centres, flips):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        p = r.choice(centres)
        for b in r.sample(range(64), r.randint(0, flips)):
            p ^= 1 << b
        out.append(p)
    return out


@pytest.mark.parametrize("flips", [1, 3, 6, 64])
def test_index_join_equals_all_pairs(flips):
    r = random.Random(flips)
    codes = np.unique(np.array(crowd(flips, 900, [r.getrandbits(64) for _ in range(4)], flips), np.uint64))
    codes = codes[np.argsort(simhash.gray_rank(codes))]
    forest, met = simhash.linked(codes, np.zeros(len(codes), np.int64))
    assert forest.roots(np.arange(len(codes))).tolist() == groups_of(codes)
    if flips == 64:
        assert met < len(codes) ** 2 / 2  # groups were pruned


def test_gray_order():
    rank = simhash.gray_rank(np.arange(64, dtype=np.uint64))
    order = np.argsort(rank)
    assert (np.bitwise_count(np.diff(order.astype(np.int64)) ^ 0) >= 1).all()
    assert all((int(a) ^ int(b)).bit_count() == 1 for a, b in zip(order, order[1:], strict=False))


@pytest.mark.parametrize("most", [16, 60, 20_000])
def test_dealt_nodes_lose_no_link(spark, most):
    r = random.Random(5)
    centre = r.getrandbits(64)
    prints = sorted(set(crowd(1, 500, [centre], 4) + crowd(2, 200, [r.getrandbits(64) for _ in range(9)], 2)))
    classes = spark.createDataFrame([(simhash.signed(p),) for p in prints], "print long")
    nodes = simhash.dealt_nodes(classes, 2, most)
    links = simhash.forest_of(nodes.toPandas())
    place = {simhash.signed(p): i for i, p in enumerate(prints)}
    group = list(range(len(prints)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for a, b in links.itertuples(index=False):
        x, y = find(place[a]), find(place[b])
        group[max(x, y)] = min(x, y)
    assert [find(i) for i in range(len(prints))] == groups_of(prints)
    if most < 100:  # nodes are replaced while more bits are free than could crowd one
        sizes = nodes.groupBy("mask", "value").count().filter(F.bit_count("mask") < 64 - int(np.log2(most)))
        assert sizes.agg(F.max("count")).first()[0] <= most


def test_simhash_components(spark):
    r = random.Random(3)
    words = ["".join(r.choices("abcdefgh", k=4)) for _ in range(400)]
    base = " ".join(words)
    near = [" ".join(words[:i] + ["Other"] + words[i + 1 :]) for i in range(0, 300, 10)]
    texts = [None, "", " \t\x0b\n", "One", "one two", "ONE\ttwo", base, base.upper(), *near, base + " \x85 tail", "é ü " * 50, "w " * 70_000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(7, base), (None, near[3]), (None, "a lonely text of no id at all"), (None, "")]
    docs = spark.createDataFrame(rows, DOCS).withColumn("print", F.lit(1)).withColumn("component_id", F.lit("x")).repartition(5)
    got = simhash.simhash_components(docs).collect()
    prints = [plain_print(t) for _, t in rows]
    group = groups_of(prints)
    least = {g: min((rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None), default=None) for g in set(group)}
    want = sorted(((d, f"{p:016x}", least[g]) for (d, _), p, g in zip(rows, prints, group, strict=True)), key=repr)
    assert sorted(((x.doc_id, x.fingerprint, x.component_id) for x in got), key=repr) == want
    assert len({x.component_id for x in got}) < len(rows) - len(near) // 2
    assert simhash.simhash_components(spark.createDataFrame([], DOCS)).collect() == []


def test_long_text_in_blocks(monkeypatch):
    r = random.Random(9)
    text = " ".join(str(r.randint(0, 500)) for _ in range(3000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "BLOCK", 7)
    assert simhash.fingerprint(text) == whole == plain_print(text)


@pytest.mark.parametrize("rank", [3, 12])
def test_cholesky_and_jacobi(rank):
    rng = np.random.default_rng(rank)
    root = rng.standard_normal((12, rank)) * np.logspace(0, -5, rank)
    a = root @ root.T
    g = whitening.pivoted_cholesky(a)
    assert g.shape[1] <= rank and np.allclose(g @ g.T, a, rtol=0, atol=1e-13 * np.trace(a))
    values, vectors = whitening.eigen(a, 12)
    want = np.linalg.svd(root, compute_uv=False)[: len(values)] ** 2
    assert np.allclose(values[:3], want[:3], rtol=1e-10)
    assert np.allclose(vectors @ vectors.T, np.eye(len(values)), atol=1e-9)


def whitening_by_hand(rows, count=4):
    x = np.floor(256 * np.array(rows, np.float64)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:count], vectors[:, ::-1][:, :count]
    return n, ((n * x - sums) ** 2).sum(axis=1), (x - sums / n) @ vectors / np.sqrt(values), values / np.trace(centred.T @ centred / n)


def test_whitening_equals_eigh(spark):
    rng = np.random.default_rng(2)
    x = (rng.standard_normal((300, 9)) * np.linspace(3, 0.5, 9) + 100).astype(np.float32)
    x[100:200] = x[0]  # a hot vector weighs once
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(900, None), (901, [1.0, None, *[0.0] * 7]), (902, [float("nan")] * 9), (903, [float("inf")] * 9), (904, [])]
    extra = [(None, x[5].tolist()), (7, x[7].tolist())]
    df = spark.createDataFrame(rows + odd + extra, VECTORS).withColumn("dim", F.lit(3)).withColumn("x", F.lit(1)).repartition(6)
    n, deviation, whitened, explained = whitening_by_hand([*x, x[5], x[7]])
    got = whitening.whiten(df).collect()
    assert len(got) == 4 * (len(x) + 2)
    assert {r["n"] for r in got} == {n}
    assert {r["vec_id"] for r in got} == {*range(300), None}
    error = {r["identity_error"] for r in got}
    assert len(error) == 1 and error.pop() < 1e-9
    by_key = {(r["vec_id"], r["component"]): r for r in got}
    for c in range(1, 5):
        mine = np.array([by_key[i, c]["whitened"] for i in range(300)])
        assert min(np.abs(mine - whitened[:300, c - 1]).max(), np.abs(mine + whitened[:300, c - 1]).max()) < 1e-8
        assert abs(by_key[0, c]["explained"] - explained[c - 1]) < 1e-9
    assert all(by_key[i, 1]["deviation"] == deviation[i] for i in range(300))


def test_whitening_edge_tables(spark):
    assert whitening.whiten(spark.createDataFrame([], VECTORS)).collect() == []
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], VECTORS)
    assert whitening.whiten(same).collect() == []  # no variance, no component
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0]) for i in range(5)], VECTORS)
    rows = whitening.whiten(line).collect()
    assert {r["component"] for r in rows} == {1} and len(rows) == 5
    assert all(abs(r["explained"] - 1) < 1e-12 for r in rows)
    lengths = spark.createDataFrame([(i, [float(i)] * (1 + i % 2)) for i in range(8)], VECTORS)
    assert {r["n"] for r in whitening.whiten(lengths).collect()} == {4}
    large = spark.createDataFrame([(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [1e6, 5.0]), (4, [2e9, 3.0])], "vec_id long, embedding array<double>")
    rows = {r["vec_id"]: r for r in whitening.whiten(large).collect()}
    assert rows[1]["deviation"] is None and rows[3]["deviation"] is None
    wide = spark.createDataFrame([(1, [1e6, 0.0]), (2, [-3e6, 1.0])], "vec_id long, embedding array<double>")
    rows = whitening.whiten(wide).collect()
    x = [[256 * 10**6, 0], [-768 * 10**6, 256]]
    sums = [x[0][0] + x[1][0], 256]
    assert {r["deviation"] for r in rows} == {sum((2 * v - s) ** 2 for v, s in zip(x[0], sums, strict=True))} or {r["deviation"] for r in rows} == {
        d if (d := sum((2 * v - s) ** 2 for v, s in zip(p, sums, strict=True))) <= LONG_END else None for p in x
    }


def clusters_by_hand(rows, k=16, rounds=3, dim=64):
    kept = [(i, [int(np.floor(64 * float(c))) for c in v]) for i, v in rows]
    seeds = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), x) for i, x in kept if i is not None)[:k]
    centres = [x for _, x in seeds]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        own = [nearest(x)[1] for _, x in kept]
        for j in range(len(centres)):
            mine = [x for (_, x), o in zip(kept, own, strict=True) if o == j]
            if mine:
                centres[j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    ends = [nearest(x) for _, x in kept]
    total = sum(d for d, _ in ends)
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return [(i, j, d, sum(e for e, o in ends if o == j), total, names[j]) for (i, _), (d, j) in zip(kept, ends, strict=True)]


def test_clusters_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((220, 64)).astype(np.float32)
    x[50:120] = x[3]  # a hot vector
    x[120:150] = np.round(x[120:150])  # ties
    x[150:160] = 0
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(4, x[5].tolist()), (None, x[6].tolist()), (-9, x[7].tolist())]
    odd = [(900, None), (901, [None] * 64), (902, [float("nan")] * 64), (903, [1.0] * 63), (904, [])]
    df = spark.createDataFrame(rows + odd, VECTORS).withColumn("id", F.lit(1)).withColumn("cluster", F.lit(1)).withColumn("x", F.lit(0)).repartition(7)
    got = [tuple(r) for r in centroids.cluster(df).collect()]
    assert sorted(got, key=repr) == sorted(clusters_by_hand(rows), key=repr)


def test_cluster_edge_tables(spark):
    assert centroids.cluster(spark.createDataFrame([], VECTORS)).collect() == []
    few = [(i, [float(i)] * 64) for i in (3, 1)] + [(1, [9.0] * 64)]
    got = [tuple(r) for r in centroids.cluster(spark.createDataFrame(few, VECTORS)).collect()]
    assert sorted(got) == sorted(clusters_by_hand(few))
    huge = spark.createDataFrame([(i, [v] * 64) for i, v in enumerate((1e300, -1e300, 5.0, 1e12))], "vec_id long, embedding array<double>")
    rows = {r["vec_id"]: r for r in centroids.cluster(huge, k=2).collect()}
    assert len(rows) == 4 and any(r["distance"] is None for r in rows.values()) and {r["inertia"] for r in rows.values()} == {None}


def test_bounds_never_pass_a_distance():
    rng = np.random.default_rng(8)
    x = rng.integers(-300, 300, (400, 64))
    pivots, centres = x[:16], rng.integers(-300, 300, (16, 64))
    centres[:4] = x[20:24]
    pairs = centroids.pivot_pairs(pivots)
    gaps = np.stack([centroids.roots(centroids.squares(x, p)) for p in pivots], axis=1)
    to_pivots = np.stack([centroids.roots(centroids.squares(centres, p)) for p in pivots], axis=1)
    real = np.stack([centroids.squares(x, c) for c in centres], axis=1)
    assert (centroids.lower_bounds(gaps, to_pivots, pairs) ** 2 <= real).all()
    cluster, best, made = centroids.assign(x, gaps, centres, to_pivots, pairs)
    assert (best == real.min(axis=1)).all() and (cluster == real.argmin(axis=1)).all()
    near = np.repeat(pivots, 20, axis=0) + rng.integers(-2, 3, (320, 64))
    gaps = np.stack([centroids.roots(centroids.squares(near, p)) for p in pivots], axis=1)
    own = np.stack([centroids.roots(centroids.squares(pivots, p)) for p in pivots], axis=1)
    _, _, made = centroids.assign(near, gaps, pivots, own, pairs)
    assert made < near.shape[0] * 16 / 4  # most distances are left out where vectors lie near the centroids

"""Centroid clustering against a plain loop over Python integers, and the annulus search by itself."""

import hashlib
import math
import random

import numpy as np

from sitefold.llm import centroids

SCHEMA = "vec_id long, embedding array<double>, extra string"


def plain(data, k, rounds, dim, scale):
    """vec_id, number and distance of each usable vector, and the final centroids."""
    kept = [(i, [math.floor(min(max(x * scale, -centroids.BOUND), centroids.BOUND)) for x in e]) for i, e in data if e is not None and len(e) == dim and all(x is not None and math.isfinite(x) for x in e)]
    told = lambda i: (i is None, hashlib.sha256(f"3:{i}".encode()).hexdigest() if i is not None else "")
    c = [v for _, v in sorted(kept, key=lambda r: (told(r[0]), r[1]))[:k]]
    square = lambda v, m: sum((a - b) ** 2 for a, b in zip(v, m, strict=True))
    assign = lambda: [min(range(len(c)), key=lambda j: (square(v, c[j]), j)) for _, v in kept]
    for _ in range(rounds):
        own = assign()
        for j in range(len(c)):
            if mine := [v for (_, v), n in zip(kept, own, strict=True) if n == j]:
                c[j] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    return [(i, n, square(v, c[n])) for (i, v), n in zip(kept, assign(), strict=True)], c


def check(spark, data, k=5, rounds=6, dim=3, scale=64):
    got = centroids.cluster(spark.createDataFrame([(i, e, "x") for i, e in data], SCHEMA).repartition(3), k, rounds, dim, scale).collect()
    want, c = plain(data, k, rounds, dim, scale)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted([(r["vec_id"], r["cluster"], r["distance"]) for r in got], key=key) == sorted(want, key=key)
    for r in got:
        assert r["centroid"] == c[r["cluster"]]
        assert r["cluster_inertia"] == sum(d for _, n, d in want if n == r["cluster"]) and r["inertia"] == sum(d for *_, d in want)


def test_clusters_equal_a_plain_loop(spark):
    rng = random.Random(11)
    check(spark, [(i, [rng.gauss(i % 4, 0.4) for _ in range(3)]) for i in range(300)])


def test_ties_copies_odd_rows_and_negative_means(spark):
    data = [(i, [float(-(i % 3)), 0.0, -0.51]) for i in range(40)] + [(7, [1.0, 1.0, 1.0])] * 3 + [(None, [0.5, -0.5, 0.25])]
    data += [(100, None), (101, []), (102, [1.0, 2.0]), (103, [1.0, None, 2.0]), (104, [float("nan"), 0.0, 0.0]), (105, [float("inf"), 0.0, 0.0]), (106, [1.0] * 4)]
    check(spark, data, k=6)


def test_components_beyond_the_bound_and_few_or_no_vectors(spark):
    check(spark, [(1, [1e300, -1e300, 0.0]), (2, [1.0, 2.0, 3.0])], k=5)
    check(spark, [(1, None)])
    check(spark, [])


def test_the_annulus_holds_the_nearest_of_many_centroids_and_their_ties():
    rng = np.random.default_rng(5)
    for top, n, k in ((40, 3000, 200), (1 << 26, 500, 60)):
        x, c = rng.integers(-top, top, (n, 6)), rng.integers(-top, top, (k, 6))
        c[10:20] = c[:10]  # equal centroids: the smaller number wins
        x[:50] = c[rng.integers(0, k, 50)]
        number, distance = centroids.nearest(x, c)
        every = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
        assert np.array_equal(number, every.argmin(axis=1)) and np.array_equal(distance, every.min(axis=1))


def test_far_norms_are_not_compared(monkeypatch):
    rng = np.random.default_rng(6)
    ring = np.repeat(np.arange(1, 101), 8)
    angle = rng.random((800, 1)) * 2 * np.pi
    c = np.rint(1000 * ring[:, None] * np.hstack([np.cos(angle), np.sin(angle)])).astype(np.int64)
    x = c[rng.permutation(800)] + rng.integers(-3, 4, (800, 2))
    pairs, inner = [], centroids.squared_distances
    monkeypatch.setattr(centroids, "TOGETHER", 16)
    monkeypatch.setattr(centroids, "squared_distances", lambda a, b: pairs.append(len(a) * len(b)) or inner(a, b))
    number, _ = centroids.nearest(x, c)
    assert np.array_equal(number, inner(x, c).argmin(axis=1))
    assert sum(pairs[1:]) < 0.8 * len(x) * len(c)

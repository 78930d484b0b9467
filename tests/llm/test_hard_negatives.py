"""Hard negatives against all pairs of Python integers."""

import math
import random

import numpy as np

from sitefold.llm import hard_negatives as H
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<double>, label int, row long"


def plain(data, scale=256, n_pos=5, n_neg=5, low=80):
    rows = [(i, lab, [math.floor(min(max(x * scale, -H.BOUND), H.BOUND)) for x in e]) for i, e, lab in data if i is not None and lab is not None and e and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for k, (a, lab, v) in enumerate(rows):
        if a % 10:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w, strict=True)), b, m) for j, (b, m, w) in enumerate(rows) if j != k and len(w) == len(v)]
        for ps, p, _ in sorted(s for s in scored if s[2] == lab)[:n_pos]:
            fit = sorted(s for s in scored if s[2] != lab and low * -ps <= 100 * -s[0] <= 100 * -ps)
            out += [(a, p, r + 1, n, -ps, -ns) for r, (ns, n, _) in enumerate(fit[:n_neg])]
    return sorted(out)


def found(spark, data):
    rows = spark.createDataFrame([(*r, 1) for r in data], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in H.mine(rows, F.col("vec_id") % 10 == 0).collect())


def vectors(n, dim, seed, labels=3):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(6)]
    return [(i, [c + rng.gauss(0, 0.5) for c in centres[rng.randrange(6)]], rng.randrange(labels)) for i in range(n)]


def test_negatives_equal_all_pairs_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(H, "ROWS", 70)
    monkeypatch.setattr(H, "ANCHORS", 9)
    monkeypatch.setattr(H, "AT_ONCE", 4)
    data = vectors(400, 40, 1)
    want = plain(data)
    assert len(want) > 300 and found(spark, data) == want


def test_copies_ties_repeated_ids_and_rows_that_take_no_part(spark):
    data = vectors(60, 12, 2)
    data += [(200 + i, data[10][1], i % 3) for i in range(40)] + [data[20]] * 4 + [(30, data[31][1], 1)]
    data += [(None, data[0][1], 1), (300, None, 1), (310, [], 1), (320, [1.0] * 11 + [None], 1), (330, [float("nan")] * 12, 1), (340, data[0][1], None), (350, [0.0] * 12, 1), (-10, [-x for x in data[0][1]], 0)]
    data += [(400 + i, [1.0, float(i)], i % 2) for i in range(20)] + [(500, [1e200, 1.0], 0), (501, [1e200, 2.0], 0), (502, [1e200, 1.0], 1)]
    assert found(spark, data) == plain(data)


def test_no_rows_and_no_anchors(spark):
    assert found(spark, []) == [] == found(spark, [(1, [1.0], 0), (2, [1.0], 1)])


def test_most_pairs_go_before_all_components_are_added(monkeypatch):
    rng = np.random.default_rng(3)
    spread = np.r_[np.full(6, 60.0), np.full(58, 4.0)]
    turn = np.linalg.qr(rng.normal(size=(64, 64)))[0]
    v = np.rint(rng.normal(size=(1500, 64)) * spread @ turn).astype(np.int64)
    rotation = np.linalg.eigh((v.T @ v).astype(float))[1][:, ::-1]
    a, b, checked = H.Side(v[:32], rotation), H.Side(v, rotation), []
    inner = H.exact_products
    monkeypatch.setattr(H, "exact_products", lambda a, b, i, j: checked.append(len(i)) or inner(a, b, i, j))
    allowed = np.ones((32, len(v)), bool)
    i, j, score = H.left_over(a, b, slice(0, 32), allowed, None, None, 5)
    every = v[:32] @ v.T
    top = H.best_of(i, score, j, j, 5)
    assert sorted(zip(i[top].tolist(), score[top].tolist(), strict=True)) == sorted((r, s) for r in range(32) for s in np.sort(every[r])[-5:].tolist())
    assert sum(checked) < 0.05 * every.size

"""Classes of repeated ids, and cells that are parted again and again, against brute force."""

import math
import random
from collections import Counter

import numpy as np

from sitefold.llm import embedding_join

SCHEMA = "vec_id long, embedding array<double>, label int"


def test_a_repeated_id_with_unlike_vectors_is_two_classes(spark):
    data = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.001], 0), (0, [0.001, 1.0], 0), (0, [-1.0, 0.0], 0)]
    got = embedding_join.near_dedup(spark.createDataFrame(data, SCHEMA)).collect()
    assert Counter((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got) == Counter([(1, 1, 1, True), (1, 1, 0, False), (2, 1, 1, False), (0, 1, 0, True), (0, 0, 0, True)])


def test_cells_are_parted_until_they_are_small(spark, monkeypatch):
    rng = random.Random(4)
    data = []
    for i in range(900):
        centre = [math.sin(5 * (i % 60) + k) for k in range(6)]
        data.append((i, [c + rng.gauss(0, 0.03) for c in centre], 0 if i % 3 else 1))
    x = np.array([e for _, e, _ in data])
    x /= np.linalg.norm(x, axis=1)[:, None]
    label = np.array([lab for *_, lab in data])
    near = (x @ x.T >= 0.98) & (label[:, None] == label[None, :]) & ~np.eye(len(x), dtype=bool)
    least = np.arange(len(x))
    while True:
        new = np.minimum(least, np.where(near, least[None, :], len(x)).min(axis=1))
        if (new == least).all():
            break
        least = new
    levels = []
    parted = embedding_join.parted
    monkeypatch.setattr(embedding_join, "parted", lambda *a: levels.append(1) or parted(*a))
    got = {r["vec_id"]: r for r in embedding_join.near_dedup(spark.createDataFrame(data, SCHEMA), cell=8, fan=4, block=50).collect()}
    assert len(levels) >= 3
    assert [got[i]["n_links"] for i in range(len(x))] == near.sum(axis=1).tolist()
    assert [got[i]["component_id"] for i in range(len(x))] == least.tolist()

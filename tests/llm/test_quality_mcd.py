"""The minimum covariance determinant against all subsets of small groups; own estimates of groups of any size."""

import itertools
import math
import random

import numpy as np
from pyspark.sql import functions as F

from sitefold.llm import quality

STATS = "lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"


def vector(r):
    return [r[3] / r[2] / 0.3, math.log1p(100 * r[4] / r[2]) / 0.25, math.sqrt(r[6] / r[2]) / 0.15, math.log1p(100 * r[5] / r[2]) / 0.5]


def least_determinant(z):
    h = math.ceil(quality.SHARE * len(z))
    logdet = lambda x: np.linalg.slogdet(np.cov(x.T, bias=True) * quality.CONSISTENCY + np.eye(4))[1]
    return min(logdet(z[list(s)]) for s in itertools.combinations(range(len(z)), h))


def groups():
    rng, rows = random.Random(3), []
    for k in range(6):
        for i in range(12):
            n = rng.randint(80, 200)
            bad = i < 3
            rows.append((f"l{k % 2}", f"s{k}", n, int(n * rng.uniform(3.5, 5.5)) + (3 * n if bad and k % 2 else 0), rng.randint(0, 8) + 60 * bad, rng.randint(0, 3), rng.randint(0, n // 10) + (n // 3 if bad else 0), False))
    return rows


def test_determinant_is_the_least_of_all_subsets(spark):
    rows = groups()
    got = {r["key"]: r for r in quality.mcd_estimates(spark.createDataFrame(rows, STATS)).collect()}
    assert len(got) == 6 + 2 + 1 and got["0"]["n"] == 72
    for k in range(6):
        z = np.array([vector(r) for r in rows if r[1] == f"s{k}"])
        told = got[f"2=l{k % 2}\n=s{k}"]
        assert told["n"] == 12
        assert told["logdet"] <= least_determinant(z) + 0.02


def test_no_step_is_kept_that_raises_a_determinant_and_all_starts_settle(spark, monkeypatch):
    rng = random.Random(7)
    rows = [(f"l{i % 3}", f"s{i % 17}", n, int(n * rng.uniform(3, 9)), rng.choice([0, 0, 2, 30]), rng.choice([0, 0, 1, 9]), rng.randint(0, n // 3), False) for i in range(900) for n in [rng.randint(60, 400)]]
    seen, inner = [], quality.concentrated
    monkeypatch.setattr(quality, "concentrated", lambda *a: seen.append(inner(*a)) or seen[-1])
    monkeypatch.setattr(quality, "discard", lambda frame: None)  # steps are read again below
    got = {r["key"]: r for r in quality.mcd_estimates(spark.createDataFrame(rows, STATS)).collect()}
    assert len(seen) < quality.STEPS
    steps = [r for step in seen for r in step.select("key", "start", "was", "logdet").collect()]
    # within a bin points count alike, so a step can miss the fall by a little; such a step is the start's last
    assert max(r["logdet"] - r["was"] for r in steps) < 0.01
    for key, r in got.items():
        assert abs(r["logdet"] - min(x["logdet"] for x in steps if x["key"] == key)) < 1e-8


def test_verdicts_are_those_of_an_independent_estimate(spark):
    from .test_operators import reference_mcd

    rng = random.Random(8)
    rows = []
    for i in range(400):
        n = rng.randint(80, 300)
        odd = i % 20 == 0
        rows.append(("x", "s", n, int(n * rng.uniform(3.8, 5.2)) + 6 * n * odd, rng.randint(0, 6) + 400 * (i % 40 == 1), rng.randint(0, 3), rng.randint(0, n // 10), False))
    got = quality.group_estimates(spark.createDataFrame(rows, STATS)).first()
    z = np.array([vector(r) for r in rows])
    factor = np.array([[got[f"_l{i}_{j}"] if j <= i else 0.0 for j in range(4)] for i in range(4)])
    y = np.linalg.solve(factor, (z - np.array([got[f"_m{i}"] for i in range(4)])).T)
    mine, theirs = (y * y).sum(axis=0) <= quality.CUTOFF, reference_mcd(z) <= quality.CUTOFF
    assert np.array_equal(mine, theirs) and 0 < (~mine).sum() < 60


def test_small_groups_have_a_share_in_their_estimate(spark):
    rows = groups()
    told = {r["source"]: r for r in quality.group_estimates(spark.createDataFrame(rows, STATS)).collect()}
    assert len(told) == 6
    assert len({(round(r["_m1"], 9), round(r["_l0_0"], 9)) for r in told.values()}) == 6  # no two groups are judged alike
    more = [r for r in rows if r[1] == "s0"] * 10  # with 120 documents it stands alone
    alone = quality.group_estimates(spark.createDataFrame(more + rows, STATS)).where("source = 's0'").first()
    own = quality.mcd_estimates(spark.createDataFrame(more + rows, STATS)).where(F.col("key") == "2=l0\n=s0").first()
    assert alone["_m2"] == own["_m2"] and alone["_l3_0"] == own["_l3_0"]


def test_own_names_of_the_caller_pass_through(spark):
    names = ["_lang", "_source", "_w", "_z0", "_m0", "row", "key", "bin", "n", "distance2"]
    frame = spark.createDataFrame([(1, "a b", "en", "s"), (2, None, None, None), (3, "w " * 100, "en", "s"), (3, "w " * 100, "en", "s")], "doc_id long, text string, lang string, source string")
    got = quality.judge_quality(frame.select("*", *[F.lit(f"its {n}").alias(n) for n in names])).collect()
    assert len(got) == 4 and all(r[n] == f"its {n}" for r in got for n in names[:-1])
    assert {(r["doc_id"], r["n_words"], r["base_failed"]) for r in got} == {(1, 2, True), (2, 0, True), (3, 100, True)}

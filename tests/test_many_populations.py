"""Patterns, posteriors and frequencies of many populations against plain loops."""

import math
import random

import pytest

from sitefold.functions import patterns as P
from sitefold.operators import posterior


def frame(spark, rows):
    names = [f"p{j}" for j in range(len(rows[0]))]
    return spark.createDataFrame([("1", i, *map(float, r)) for i, r in enumerate(rows)], "chr string, pos long, " + ", ".join(f"{n} double" for n in names)), names


def shown(row):
    """Patterns of a site with their probabilities, population by population."""
    found = {0: 1.0}
    for j, p in enumerate(row):
        found = {m | (b << j): z * (p if b else 1 - p) for m, z in found.items() for b in (0, 1) if (p if b else 1 - p) != 0}
    return found


def wanted(rows, singletons):
    k, out = len(rows[0]), {}
    for row in rows:
        for m, z in shown(row).items():
            if 0 < m < (1 << k) - 1 and (singletons or m & (m - 1)):
                out[m] = out.get(m, 0) + z
    return out


def draw(n, k, undecided, seed):
    rng = random.Random(seed)
    rows = [[rng.choice([0.0, 1.0]) for _ in range(k)] for _ in range(n)]
    for row in rows:
        for j in rng.sample(range(k), undecided):
            row[j] = rng.choice([0.125, 0.5, 0.9])
    return rows


@pytest.mark.parametrize("k,undecided,singletons", [(20, 6, False), (32, 4, True), (56, 3, False), (12, 12, True)])
def test_sums_equal_a_plain_loop(spark, k, undecided, singletons):
    rows = draw(25 if undecided < 12 else 3, k, undecided, k) + [[0.0] * k, [1.0] * k, [1.0] * (k - 1) + [0.0]]
    sites, names = frame(spark, rows)
    got = {r["pat"]: r["value"] for r in P.pattern_sums(sites, names, singletons).collect()}
    assert got == pytest.approx(wanted(rows, singletons))


def test_no_array_holds_all_patterns(spark):
    rows = draw(2, 18, 18, 1)
    sites, names = frame(spark, rows)
    assert P.pattern_sums(sites, names, True).count() == (1 << 18) - 2
    plan = P.pattern_sums(sites, names, True)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate inline") == math.ceil(18 / P.CHUNK)


def test_groups_nulls_and_too_many_populations(spark):
    rows = draw(30, 10, 3, 2)
    sites, names = frame(spark, rows)
    by = {(r["pos"], r["pat"]): r["value"] for r in P.pattern_sums(sites, names, by=["pos"]).collect()}
    assert by == pytest.approx({(i, m): z for i, row in enumerate(rows) for m, z in wanted([row], False).items()})
    assert P.pattern_sums(sites.withColumn("p3", sites.p3.cast("string").try_cast("boolean").cast("double")), names).collect() == []
    with pytest.raises(ValueError):
        P.pattern_sums(sites, ["p0"] * 57)


def test_posteriors_and_frequencies_of_both_forms_agree(spark):
    rows = draw(40, 5, 3, 3) + [[0.0] * 5, [1.0] * 5]
    sites, names = frame(spark, rows)
    c = {m: 0.01 * m for m in P.masks(5, True) if m != 9}
    table = spark.createDataFrame([(m, x) for m, x in c.items()] + [(9, None)], "pat long, c double")
    want, share = {}, {}
    for i, row in enumerate(rows):
        found = wanted([row], True)
        total = sum(found.values())
        want[i] = sum(z * c.get(m, 0) for m, z in found.items()) / total if total else None
        for m, z in found.items():
            share[m] = share.get(m, 0) + z / total
    used = [x for x in want.values() if x is not None]
    for wide in (6, 2):
        got = {r["pos"]: r["posterior"] for r in posterior.site_posterior(sites, names, table, True, wide).collect()}
        assert {k: v for k, v in got.items() if v is not None} == pytest.approx({k: v for k, v in want.items() if v is not None})
        assert sorted(k for k, v in got.items() if v is None) == sorted(k for k, v in want.items() if v is None)
        told = posterior.pattern_frequencies(sites, names, table, True, wide).collect()
        assert {r["pat"]: r["frequency"] for r in told if r["frequency"]} == pytest.approx({m: w / len(used) for m, w in share.items()})
        assert {round(r["mean_posterior"], 12) for r in told} == {round(sum(used) / len(used), 12)} and {r["n_sites"] for r in told} == {len(used)}
        assert sum(r["frequency"] * c.get(r["pat"], 0) for r in told) == pytest.approx(sum(used) / len(used))

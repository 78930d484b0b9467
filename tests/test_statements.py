"""Statements over several lines, statements of components, state files of a model, and starts of very many blocks."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sitefold.operators import bootstrap, model_choice, rewriting
from sitefold.sources import text

LINES = "file string, line_no long, value string"


def rewritten(spark, lines, fits, width=1 << 14):
    frame = spark.createDataFrame(list(enumerate(lines)), "line_no long, value string").repartition(3)
    got = rewriting.with_fitted_values(frame, spark.createDataFrame(fits, "name string, fit double"), width)
    return [r["value"] for r in got.orderBy("line_no").collect()]


@pytest.mark.parametrize("width", [1, 2, 5, 1 << 14])
def test_formulas_over_three_lines_with_comments(spark, width):
    lines = [
        "# time free T = 9 +", "time constrained T = a +  # sum", "  # of two", "", "  b * # parts", "  c   # end", "twoN free N = 2",
        "param constrained x = T *", "  2 -", "  N", "mixFrac free m =  0.5   # share", "segment s t=T twoN=N", "param constrained y = x /", " 3",
    ]
    want = [
        "# time free T = 9 +", "time constrained T = 12  # sum", "  # of two", "", "# parts", "# end", "twoN free N = 2",
        "param constrained x = 0.25", "mixFrac free m =  0.123457   # share", "segment s t=T twoN=N", "param constrained y = x /", " 3",
    ]
    assert rewritten(spark, lines, [("T", 12.0), ("x", 0.25), ("m", 0.123456789), ("a", 1.0)], width) == want
    assert rewritten(spark, lines, [("none", 1.0)], width) == lines


def test_statements_of_two_files_keep_apart(spark):
    rows = [("a", 0, "param free x = 1 +"), ("a", 1, "2"), ("b", 0, "param free z = 3"), ("b", 1, "2")]
    got = rewriting.with_fitted_values(spark.createDataFrame(rows, LINES), spark.createDataFrame([("x", 7.0)], "name string, fit double"))
    assert sorted((r["file"], r["line_no"], r["value"]) for r in got.collect()) == [("a", 0, "param free x = 7"), ("b", 0, "param free z = 3"), ("b", 1, "2")]


def test_statements_of_components_make_the_estimates(spark):
    rng = random.Random(3)
    names = ["p", "q", "r"]
    base = [[rng.gauss(0, 1) for _ in range(3)] for _ in range(50)]
    data = [(b[0] + 0.2 * b[1] + 5, 3 * b[0] - b[2], 0.01 * b[2] + 0.02 * b[1]) for b in base]
    rows = spark.createDataFrame(data, "p double, q double, r double")
    means, coefficients, bounds = rewriting.component_coefficients(rewriting.component_lines(rows, names))
    n = len(data)
    mean = [sum(c) / n for c in zip(*data, strict=True)]
    assert [means[x] for x in names] == pytest.approx(mean)
    # the statements' coefficients times the components' variances are the covariances
    _, _, shares, _ = model_choice.principal_components(rows, names)
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            cov = sum((r[i] - mean[i]) * (r[j] - mean[j]) for r in data) / (n - 1)
            assert sum(coefficients[a][f"pc{k + 1}"] * coefficients[b][f"pc{k + 1}"] * shares[k] * 3 for k in range(3)) == pytest.approx(cov, rel=1e-9, abs=1e-12)
    sd = [math.sqrt(sum((r[i] - mean[i]) ** 2 for r in data) / (n - 1)) for i in range(3)]
    for pc, bound in bounds.items():
        top = max(abs(sum((r[i] - mean[i]) * coefficients[x][pc] / sd[i] ** 2 for i, x in enumerate(names))) for r in data)
        assert bound / 2 < top <= bound and math.log2(bound) == int(math.log2(bound))
    kept = rewriting.component_coefficients(rewriting.component_lines(rows, names, 0.3))[2]
    assert len(kept) == sum(s >= 0.3 for s in shares)


def test_state_files_are_held_against_a_model(spark):
    new = [("new", 0, "1 2 format-2"), ("new", 1, "cost T N"), ("new", 2, "0.5 1 2")]
    old = [("old", 0, "1 2"), ("old", 1, "7 8 9")]
    read = lambda lines, model: text.state_points(spark.createDataFrame(lines, LINES), model).collect()
    got = sorted((r["file"], r["name"], r["value"]) for r in read(new + old, ["T", "N"]))
    assert got == [("new", "N", 2.0), ("new", "T", 1.0), ("old", "N", 9.0), ("old", "T", 8.0)]
    for lines, model, match in (
        (new, ["N", "T"], "other parameters"), (new, ["T"], "other parameters"), (old, ["T"], "other parameters"), ([("new", 0, "1 2 fmt"), *new[1:]], ["T", "N"], "another format"),
        ([new[0], ("new", 1, "value T N"), new[2]], ["T", "N"], "another format"), ([("new", 0, "1 2 format-2 x"), *new[1:]], ["T", "N"], "another format"),
    ):
        with pytest.raises(Exception, match=match):
            read(lines, model)


def test_starts_of_very_many_blocks_do_not_overflow(spark):
    n, length = 3_000_000_000, 100
    starts = bootstrap.block_starts(spark, n, length, 2).where(F.col("block") % 7_500_001 == 7_500_000).collect()
    below = n - length + 1
    assert len(starts) == 2 * (bootstrap.n_blocks(n, length) // 7_500_001)
    for r in starts:
        rep, b = r["rep"], r["block"]
        assert r["start"] == ((rep + 1) * 7919 + (b + 1) ** 2 * 104729 + (rep + 1) * (b + 3) * 15485863) % below


def test_bad_genotypes_and_scores_are_told(spark):
    lines = spark.createDataFrame([("1\t1\ta\tc\ta\t0|1\t0|2",), ("1\t2\ta\tc\ta\t0|1\t01|",), ("1\t3\ta\tc\ta\t0|1\t1|1",)], "value string")
    assert {r["reason"]: r["n_rows"] for r in text.genotype_counters(lines).collect()} == {"badgtype": 2, "bad": 2, "good": 1}
    records = spark.createDataFrame([(0, "c", 1, 3, 5, "acg", "acg"), (1, "c", 1, 2, 50, "ac", "at"), (2, "c", 1, 3, 50, "acg", "aaa")], "rec long, chr string, start long, end long, score long, a string, b string")
    assert {r["rec"] for r in text.axt_bases(records, min_score=10).collect()} == {1, 2}
    assert {r["rec"] for r in text.axt_bases(records, min_length=3, min_score=10).collect()} == {2}


def test_genotypes_of_a_line_are_counted_together(spark):
    rng = random.Random(9)
    rows = []
    for i in range(300):
        gts = [rng.choice(".01") + rng.choice("|/x") + rng.choice(".01") for _ in range(rng.randrange(0, 6))]
        if rng.random() < 0.2 and gts:
            gts[rng.randrange(len(gts))] = rng.choice(["", "0", "0|", "0|12", "2|0", "0||1", "01"])
        rows.append((i, gts))
    lines = spark.createDataFrame([("\t".join(["1", str(i), "a", "c", "a", *g]),) for i, g in rows], "value string")
    got = {r["pos"]: r for r in text.genotype_daf(lines).collect()}
    for i, gts in rows:
        alleles = "".join(g[:1] + g[2:3] for g in gts)
        bad = any(len(g) != 3 or g[0] not in ".01" or g[2] not in ".01" for g in gts)
        called = len(alleles) - alleles.count(".")
        assert got[i]["reject"] == ("badgtype" if bad else "zerogtype" if not called else None)
        assert bad or got[i]["daf"] == (alleles.count("1") / called if called else None)

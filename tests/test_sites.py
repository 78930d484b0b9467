"""Golden values of alignment, polarisation, converters, pattern algebra and the bootstrap."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sitefold.functions import patterns as P
from sitefold.operators import bootstrap, model_choice, posterior, sites, tables
from sitefold.sources import sinks, text
from sitefold.streaming.tabulate import stream_patterns

RAF = "pop string, chr string, pos long, ref string, alt string, raf double"


def test_alignment_and_polarisation(spark):
    rows = [("0", *r) for r in (("1", 1, "a", "t", 0.0), ("10", 1, "a", "t", 0.5), ("10", 200, "g", "c", 1.0))]
    rows += [("1", *r) for r in (("1", 1, "a", "t", 0.5), ("1", 2, "a", ".", 0.5), ("10", 1, "a", "t", 0.1), ("10", 200, "g", "c", 1.0), ("10", 201, "g", "c", 1.0))]
    rows += [("2", *r) for r in (("1", 1, "a", ".", 1.0), ("10", 1, "a", "t", 0.0), ("10", 100, "a", "t", 0.0), ("10", 200, "g", "c", 0.0))]
    got = {(r["chr"], r["pos"]): r for r in sites.polarised(spark.createDataFrame(rows, RAF), ["0", "1"], "2").collect()}
    assert {k: r["status"] for k, r in got.items()} == {("1", 1): "OK", ("10", 1): "OK", ("10", 200): "MONOMORPHIC_SITE"}
    assert (got["1", 1]["daf0"], got["1", 1]["daf1"]) == (1.0, 0.5)
    assert (got["10", 1]["daf0"], got["10", 1]["daf1"]) == (0.5, 0.1)


@pytest.mark.parametrize("alleles,status", [
    ([("a", "t"), ("a", "."), ("a", "t")], "OK"), ([("a", "t"), ("c", "g"), ("a", "t")], "REF_MISMATCH"), ([("a", "t"), ("a", "g"), ("c", "t")], "MULTIPLE_ALT"),
    ([("a", "."), ("a", "g"), ("a", "t")], "MULTIPLE_ALT"), ([("a", "."), ("a", "."), ("a", "t")], "OK"),
])
def test_the_first_population_that_breaks_a_rule_tells_how(spark, alleles, status):
    rows = [(p, "1", 1, ref, alt, f) for (ref, alt), p, f in zip(alleles, "abo", (0.2, 0.5, 1.0))]
    assert sites.polarised(spark.createDataFrame(rows, RAF), ["a", "b"], "o").first()["status"] == status


def test_genotype_converters(spark):
    lines = ["# note", "1\t10001\ta\tt\ta\t1|1\t1|1", "1\t10002\tac\tt\ta\t0|1", "1\t10003\ta\tt\tt\t0|1\t1|0", "1\t10004\tC\t.\tc\t0|0\t.|.", "1\t10005\ta\tt,g\ta\t0|1", "1\t5\ta\t.\tt\t1|1", "1\t6\ta\tc\tg\t0|1", "1\t7\ta\tc\t-\t0|1", "1\t8\ta\tc\ta\t2|1", "1\t9\ta\tc\ta\t.|."]
    frame = spark.createDataFrame([(x,) for x in lines], "value string")
    got = {r["pos"]: r for r in text.genotype_daf(frame).collect()}
    good = {k: (r["aa"], r["da"], r["daf"]) for k, r in got.items() if r["reject"] is None}
    assert good == {10001: ("a", "t", 1.0), 10003: ("t", "a", 0.5), 10004: ("c", ".", 0.0), 5: ("t", "a", 0.0)}
    assert {k: r["reject"] for k, r in got.items() if r["reject"]} == {10002: "indelref", 10005: "multalt", 6: "threealleles", 7: "missaa", 8: "badgtype", 9: "zerogtype"}
    assert sum(r["n_rows"] for r in text.reject_counts(text.genotype_daf(frame)).collect()) == 10


def test_raf_statuses(spark):
    rows = ["1\t1\tA\tt\t.5", "1\t2\ta\tt\t1e99999", "1\t3\ta\tt\t1e-99999", "1\t4\ta\tt\tabc", "1\t5\ta\tt", "1\t6\tac\tt\t1", " # c"]
    got = [(r["pos"], r["status"]) for r in text.read_raf(spark.createDataFrame([(x,) for x in rows], "value string")).collect()]
    assert got == [(1, "OK"), (2, "ERANGE"), (3, "ERANGE"), (4, "EINVAL"), (5, "BAD_RAF_INPUT")]


def test_scrm_and_ms(spark):
    lines = ["scrm 4 2", "//", "position time 1 2 3", "0.1 2.0 0 1 1", "0.2 1e-3 1 1 0", "", "//", "position time 1 2 3", "0.3 1 0 0 1"]
    got = text.scrm_sites(spark.createDataFrame(list(enumerate(lines)), "line_no long, value string")).collect()
    assert sorted((r["rep"], r["idx"], r["g"]) for r in got) == [(0, 0, [0, 1, 1]), (0, 1, [1, 1, 0]), (1, 0, [0, 0, 1])]
    ms = spark.createDataFrame([(0, 0, "011"), (0, 1, "101")], "rep int, sample int, value string")
    assert sorted((r["site"], r["alleles"]) for r in text.ms_transposed(ms).collect()) == [(0, "01"), (1, "10"), (2, "11")]


def test_pattern_files_round_trip(spark, tmp_path):
    table = P.pattern_domain(spark, ["x", "y", "z"], singletons=True).withColumn("value", F.col("pat") * 1.5)
    sinks.write_patterns(table, f"{tmp_path}/opf")
    lines = text.read_lines(spark, f"{tmp_path}/opf", ordered=True)
    got = tables.by_mask(text.pattern_section(lines), ["x", "y", "z"]).collect()
    assert {r["pat"]: r["value"] for r in got} == {m: m * 1.5 for m in range(1, 7)}
    order = [r["label"] for r in text.pattern_rows(lines).orderBy("line_no").collect()]
    assert order == ["x", "y", "z", "x:y", "x:z", "y:z"]
    with pytest.raises(Exception, match="unknown label"):
        tables.by_mask(text.pattern_rows(lines), ["x", "y"]).collect()
    with pytest.raises(Exception):
        sinks.write_by_chromosome(table.withColumnRenamed("label", "chr"), f"{tmp_path}/opf")


def test_pattern_algebra(spark):
    labels, values = ["x", "y", "z"], {1: 1.0, 2: 2.0, 4: 3.0, 3: 4.0, 5: 5.0, 6: 6.0, 7: 7.0}
    table = spark.createDataFrame(list(values.items()), "pat long, value double")
    assert {r["pat"]: r["value"] for r in tables.without_populations(table, 3, {0}).collect()} == {1: 6.0, 2: 8.0, 3: 13.0}
    assert {r["pat"]: r["value"] for r in tables.with_collapsed(table, 3, {0, 1}).collect()} == {1: 7.0, 2: 3.0, 3: 18.0}
    one = spark.range(1)
    remap = lambda mask, to: one.select(P.remap(F.lit(mask).cast("long"), to)).first()[0]
    collapse = P.collapse_map(12, {j for j in range(12) if 0o4444 >> j & 1})
    assert remap(0o3333, collapse) == 0o773 and remap(0o4444, collapse) == 4  # both bits of each octal digit stay
    remove = P.removal_map(6, {2, 5})
    assert [remap(m, remove) for m in (0o77, 0o7, 0o10)] == [0o17, 0o3, 0o4]
    assert [r["label"] for r in P.pattern_domain(spark, labels).orderBy("rank").collect()] == ["x:y", "x:z", "y:z"]
    with pytest.raises(ValueError):
        P.check_labels(["1x"])


def test_all_patterns_sum_to_the_sites(spark):
    rng = random.Random(4)
    rows = [tuple(rng.choice([0.0, 0.25, 0.5, 1.0]) for _ in range(4)) for _ in range(50)]
    frame = spark.createDataFrame(rows, "a double, b double, c double, d double")
    wide = {r["pat"]: r["value"] for r in P.pattern_sums(frame, list("abcd"), True).collect()}
    long = {r["pat"]: r["value"] for r in P.pattern_sums(frame, list("abcd"), True, wide=2).collect()}
    assert wide == pytest.approx(long)
    fixed = sum(math.prod(r) + math.prod(1 - x for x in r) for r in rows)
    assert sum(wide.values()) + fixed == pytest.approx(50)
    assert {r["value"] for r in P.pattern_sums(frame.limit(0), list("abcd")).collect()} == {0.0}


def test_bootstrap_agrees_with_the_slow_way(spark):
    rng = random.Random(5)
    rows = [(str(rng.randint(1, 3)), i, rng.random(), rng.random()) for i in range(300)]
    rows = [(c, p, a, b) for c, p, a, b in rows]
    frame = spark.createDataFrame(rows, "chr string, pos long, a double, b double")
    placed = bootstrap.numbered(frame, width=17)
    order = [(r["chr"], r["pos"]) for r in placed.orderBy("idx").collect()]
    assert order == sorted((c, p) for c, p, _, _ in rows)
    starts = bootstrap.block_starts(spark, 300, 20, 3)
    table = {(r["chr"], r["pos"]): r for r in placed.collect()}
    by_rep = {}
    for r in starts.collect():
        for i in range(r["start"], r["start"] + 20):
            by_rep.setdefault(r["rep"], []).append(i)
    at = {r["idx"]: r for r in table.values()}
    want = {(rep, 1): sum(at[i]["a"] * (1 - at[i]["b"]) for i in ids) for rep, ids in by_rep.items()}
    got = {(r["rep"], r["pat"]): r["value"] for r in bootstrap.replicate_counts(placed, ["a", "b"], starts, 20, True).collect()}
    assert {k: got[k] for k in want} == pytest.approx(want)
    times = {(r["rep"], r["idx"]): r["w"] for r in bootstrap.multiplicity(starts, placed, 20).collect()}
    assert times == {(rep, i): ids.count(i) for rep, ids in by_rep.items() for i in set(ids)}
    assert [bootstrap.n_blocks(n, 6) for n in (11, 7, 6, 5, 3, 2, 0)] == [2, 1, 1, 1, 1, 0, 0]
    told = bootstrap.percentile_interval(spark.range(6).select(F.lit(1).alias("k"), F.col("id").cast("double").alias("value")), ["k"]).first()
    assert (told["low"], told["high"]) == pytest.approx((0.125, 4.875))


def test_posteriors(spark):
    zero = spark.createDataFrame([(3, 0.5), (5, 0.5), (6, 0.0)], "pat long, value double")
    one = spark.createDataFrame([(3, 0.25), (5, 0.75), (6, 0.0)], "pat long, value double")
    c = posterior.conditional(zero, one, 0.2)
    assert {r["pat"]: r["c"] for r in c.collect()} == {3: pytest.approx(0.05 / 0.45), 5: pytest.approx(0.15 / 0.55), 6: None}
    rows = spark.createDataFrame([("1", 1, 1.0, 1.0, 0.0), ("1", 2, 1.0, 0.0, 0.0)], "chr string, pos long, a double, b double, c double")
    got = {r["pos"]: r["posterior"] for r in posterior.site_posterior(rows, ["a", "b", "c"], c).collect()}
    assert got == {1: pytest.approx(0.05 / 0.45), 2: None}


def test_model_choice(spark):
    crit = spark.createDataFrame([(0, "a", 1.0), (0, "b", 1.0), (0, "c", 2.0), (1, "a", 3.0), (1, "b", 1.0), (1, "c", 2.0)], "row int, model string, crit double")
    weights = {r["model"]: r["weight"] for r in model_choice.model_weights(crit).collect()}
    assert weights == {"a": 0.25, "b": 0.75, "c": 0.0}
    est = spark.createDataFrame([(0, "a", "t", 4.0), (0, "b", "t", 8.0), (0, "c", "u", 1.0)], "row int, model string, name string, value double")
    got = {r["name"]: r["value"] for r in model_choice.model_average(est, model_choice.model_weights(crit)).collect()}
    assert got == {"t": 7.0, "u": None}
    rng = random.Random(6)
    points = [(i, *(p := (rng.random(), rng.random())), 3 - 2 * p[0] ** 2 + p[0] * p[1] - 5 * p[1] ** 2) for i in range(60)]
    h = model_choice.hessian(spark.createDataFrame(points, "ord int, a double, b double, lnL double"), ["a", "b"])
    assert h.ravel().tolist() == pytest.approx([-4, 1, 1, -10], rel=1e-6)


def test_label_index_in_order_of_appearance(spark):
    got = tables.label_index(spark.createDataFrame([(0, "x:y"), (1, "x:z"), (2, "y:z")], "ord long, label string")).collect()
    assert {r["name"]: r["bit"] for r in got} == {"x": 0, "y": 1, "z": 2}


def test_axt(spark):
    lines = ["# c", "0 chr1 1 5 chrB 1 5 + 10", "ac-gta", "acggt-", "", "1 chr1 4 6 chrB 1 3 + 10", "ggn", "tgn"]
    records = text.axt_records(spark.createDataFrame(list(enumerate(lines)), "line_no long, value string"))
    rows = text.axt_merged(text.axt_bases(records)).orderBy("pos").collect()
    assert [(r["pos"], r["ref"], r["alt"], r["raf"]) for r in rows] == [(1, "a", ".", 1.0), (2, "c", ".", 1.0), (3, "g", ".", 1.0), (4, "g", "t", 0.0), (5, "g", ".", 1.0)]


def test_streaming_tabulation(spark, tmp_path):
    rows = spark.range(40).select((F.col("id") % 5 / 5).alias("a"), (F.col("id") % 3 / 3).alias("b"))
    rows.repartition(4).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = stream_patterns(stream, ["a", "b"], "live_patterns", f"{tmp_path}/cp")
    q.awaitTermination(120)
    want = {r["pat"]: r["value"] for r in P.pattern_sums(rows, ["a", "b"], True).collect()}
    assert {r["pat"]: r["value"] for r in spark.table("live_patterns").collect()} == pytest.approx(want)


def test_fitted_values_replace_assignments(spark):
    from sitefold.operators import rewriting

    lines = ["# time free T = 1", "time free T=1  # split", "twoN fixed [1, 1e7] N = 2", "param constrained x = T + 1", "segment s t=T twoN=N", "mixFrac free m = 0.5"]
    frame = spark.createDataFrame(list(enumerate(lines)), "line_no int, value string")
    got = rewriting.with_fitted_values(frame, spark.createDataFrame([("T", 12.0), ("m", 0.123456789)], "name string, fit double"))
    want = ["# time free T = 1", "time free T=12  # split", *lines[2:5], "mixFrac free m = 0.123457"]
    assert [r["value"] for r in got.orderBy("line_no").collect()] == want


def test_numeric_functions(spark):
    from sitefold.functions import numeric

    told = spark.createDataFrame([(0.5,), (1.25,), (-3.5,), (5.0,)], "x double").select(numeric.reflect(F.col("x"), 0.0, 1.0).alias("y"))
    assert [r["y"] for r in told.collect()] == [0.5, 0.75, 0.5, 1.0]
    one = spark.range(1).select(numeric.binomial(F.lit(6), 2).alias("a"), numeric.binomial(F.lit(1), 2).alias("b"))
    assert tuple(one.first()) == (15.0, None)

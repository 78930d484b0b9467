"""Readers of several files at once, headers and command lines of simulation output, and what has to be an error."""

import pytest
from pyspark.sql import functions as F

from sitefold.operators import bootstrap, model_choice, tables
from sitefold.sources import samples, text

LINES = "file string, line_no long, value string"


def test_lines_of_files_are_numbered_in_order(spark, tmp_path):
    for name, n in (("a", 5), ("b", 3)):
        (tmp_path / f"{name}.txt").write_text("".join(f"{name}{k}\n" for k in range(n)))
    got = text.read_lines(spark, str(tmp_path), ordered=True).collect()
    assert sorted((r["file"].rpartition("/")[2], r["line_no"], r["value"]) for r in got) == [(f"{x}.txt", k, f"{x}{k}") for x, n in (("a", 5), ("b", 3)) for k in range(n)]


def test_large_files_are_numbered_across_splits(spark, tmp_path):
    (tmp_path / "long.txt").write_text("".join(f"line {k}\n" for k in range(20_000)))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        got = text.read_lines(spark, str(tmp_path / "long.txt"), ordered=True).where(F.concat(F.lit("line "), "line_no") == F.col("value"))
        assert got.count() == 20_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)


def test_axt_records_of_two_files_keep_apart(spark):
    lines = [(f, k, v) for f, at in (("x", 1), ("y", 101)) for k, v in enumerate((f"0 chr1 {at} {at + 2} c2 1 3 + 9", "acg", "acg", ""))]
    bases = text.axt_bases(text.axt_records(spark.createDataFrame(lines, LINES)))
    assert sorted((r["file"], r["pos"]) for r in bases.collect()) == [("x", 1), ("x", 2), ("x", 3), ("y", 101), ("y", 102), ("y", 103)]
    assert {(r["file"], r["pos"]) for r in text.axt_merged(bases).collect()} == {("x", 1), ("x", 2), ("x", 3), ("y", 101), ("y", 102), ("y", 103)}
    for head in ("0 chr1 1 4 c2 1 3 + 9", "0 chr1 1 3 c2 1 4 + 9"):
        with pytest.raises(Exception, match="other numbers of bases"):
            text.axt_records(spark.createDataFrame([("x", 0, head), ("x", 1, "acg"), ("x", 2, "acg")], LINES)).collect()


def test_scrm_blocks_of_two_files_keep_apart(spark):
    block = ["//", "position time 1 2", "0.1 1 0 1", "0.2 1 1 1", ""]
    lines = [(f, k, v) for f in "xy" for k, v in enumerate(["scrm", *block, *block])]
    got = text.scrm_sites(spark.createDataFrame(lines, LINES)).collect()
    assert sorted((r["file"], r["rep"], r["idx"]) for r in got) == [(f, rep, i) for f in "xy" for rep in (0, 1) for i in (0, 1)]


def test_sample_sizes_of_command_lines():
    command = "scrm 18 2 -transpose-segsites -I 5 6 6 0 0 0 -eI 0.01 0 0 2 0 0 -eI 0.02 0 0 2 0 0 -eI 0.03 0 0 0 2 0 -n 1 2.0"
    assert samples.scrm_samples(command) == [6, 6, 2, 2, 2]
    for bad in ("ms 3 1", "scrm 3 1 -I 1 3", "scrm 3 1 -transpose-segsites"):
        with pytest.raises(ValueError):
            samples.scrm_samples(bad)
    assert samples.ms_samples("ms 6 1 -I 3 2 0 1 -eA 0.5 2 1 -eA 0.2 1 1 -eA 0.5 2 1") == [(1, 0.0, 2), (3, 0.0, 1), (1, 0.2, 1), (2, 0.5, 2)]
    assert samples.label_order(["x:1", "y:0", "z:2"]) == ["y", "x", "z"]
    with pytest.raises(ValueError):
        samples.label_order(["x:1", "y:1"])


def test_simulation_headers(spark):
    first = ["npops = 2", "pop sampsize", "x 1", "y 2", "0 1 0 1", "1 0 1 1"]
    second = ["nchromosomes = 1", "chrlen = 9", "npops = 2", "pop sampsize", "x 1", "y 2", "0 4.5 1 0 0"]
    frame = spark.createDataFrame([("a", k, v) for k, v in enumerate(first)] + [("b", k, v) for k, v in enumerate(second)], LINES)
    sizes = samples.sim_samples(frame)
    assert sizes == {"x": 1, "y": 2}
    got = samples.frequency_columns(samples.sim_sites(frame, sizes), sizes).collect()
    assert sorted((r["file"], r["chr"], r["pos"], r["x"], r["y"]) for r in got) == [("a", 0, None, 1.0, 0.5), ("a", 1, None, 0.0, 1.0), ("b", 0, 4.5, 1.0, 0.0)]
    for bad in ("0 1 0", "0 1 0 2"):
        with pytest.raises(Exception, match="bad line"):
            samples.sim_sites(spark.createDataFrame([("a", 9, bad)], LINES), sizes).collect()
    with pytest.raises(ValueError):
        samples.sim_samples(spark.createDataFrame([("a", 0, "npops = 3"), ("a", 1, "pop sampsize"), ("a", 2, "x 1")], LINES))


def test_state_files(spark):
    lines = [("new", 0, "2 2 fmt"), ("new", 1, "cost T N"), ("new", 2, "0.5 1 2"), ("new", 3, "0.25 3 4"), ("old", 0, "1 1"), ("old", 1, "7 8")]
    got = text.state_points(spark.createDataFrame(lines, LINES)).collect()
    assert sorted((r["file"], r["pt"], r["cost"], r["name"], r["value"]) for r in got) == [("new", 0, 0.5, "N", 2.0), ("new", 0, 0.5, "T", 1.0), ("new", 1, 0.25, "N", 4.0), ("new", 1, 0.25, "T", 3.0), ("old", 0, 7.0, "p0", 8.0)]
    with pytest.raises(Exception, match="other numbers"):
        text.state_points(spark.createDataFrame([*lines, ("old", 2, "1 1")], LINES)).collect()


def test_unlike_tables_and_models_are_an_error(spark):
    table = spark.createDataFrame([(1, 2.0), (2, 3.0)], "pat long, value double")
    with pytest.raises(Exception, match="one table only"):
        tables.residuals(table, table.where("pat = 1")).collect()
    crit = spark.createDataFrame([("m", "a-x-1.pts", 1.0), ("n", "b-x-2.pts", 2.0)], "model string, name string, crit double")
    assert {(r["row"], r["model"]) for r in model_choice.aligned_criteria(crit, "clic").collect()} == {("x", "m"), ("x", "n")}
    with pytest.raises(Exception, match="no one row each"):
        model_choice.aligned_criteria(crit, "bepe").collect()
    with pytest.raises(Exception, match="illegal name"):
        model_choice.aligned_criteria(crit.withColumn("name", F.lit("a-b.pts")), "clic").collect()
    hess = spark.createDataFrame([("f", 1.0, "p", "p", -2.0)], "file string, lnL double, a string, b string, h double")
    cov = spark.createDataFrame([("p", "p", 0.5)], "a string, b string, cov double")
    assert model_choice.clic_by_file(hess, cov).first()["clic"] == 0.0
    with pytest.raises(Exception, match="other parameters"):
        model_choice.clic_by_file(hess, cov.replace("p", "q")).collect()


def test_seeded_starts(spark):
    one, two, again = ([r["start"] for r in bootstrap.block_starts(spark, 5000, 50, 40, s).orderBy("rep", "block").collect()] for s in (1, 2, 1))
    assert one == again != two and len(one) == 4000 and all(0 <= s <= 4950 for s in one)
    counts = [sum(lo <= s < lo + 495 for s in one) for lo in range(0, 4950, 495)]
    assert min(counts) > 320 and max(counts) < 480 and len({tuple(one[k * 100 : k * 100 + 100]) for k in range(40)}) == 40

"""Tabulation in one pass, tables in buckets by position, and the writers of side outputs."""

import os

import pytest
from pyspark.sql import functions as F

from sitefold.functions import patterns as P
from sitefold.operators import sites, tabulate
from sitefold.sources import sinks, stored, text


def example(spark):
    statuses = ["OK", "OK", "OK", "REF_MISMATCH", "MONOMORPHIC_SITE", "NO_ANCESTRAL_ALLELE", "MULTIPLE_ALT"]
    rows = [(str(i % 3), i, statuses[i % 7], i % 5 / 5, i % 3 / 3, i % 2 / 2) for i in range(200)]
    return spark.createDataFrame(rows, "chr string, pos long, status string, a double, b double, c double")


def test_sums_counters_and_the_log_come_from_one_scan(spark, tmp_path):
    rows = example(spark)
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    scanned = spark.sparkContext.accumulator(0)
    stored_rows = spark.read.parquet(f"{tmp_path}/in")

    def seen(batches):
        for batch in batches:
            scanned.add(batch.num_rows)
            yield batch

    once = stored_rows.mapInArrow(seen, stored_rows.schema)
    patterns, counters = tabulate.tabulated(once, ["a", "b", "c"], f"{tmp_path}/log", singletons=True)
    assert {r["pat"]: r["value"] for r in patterns.collect()} == pytest.approx({r["pat"]: r["value"] for r in P.pattern_sums(rows.where("status = 'OK'"), ["a", "b", "c"], True).collect()})
    assert {r["status"]: r["n_sites"] for r in counters.collect()} == {r["status"]: r["n_sites"] for r in sites.status_counts(rows).collect()}
    log = spark.read.schema("chr string, pos long, status string").option("sep", "\t").csv(f"{tmp_path}/log")
    key = lambda f: sorted((r["status"], r["chr"], r["pos"]) for r in f.collect())
    assert key(log) == key(rows.where("status <> 'OK'"))
    assert scanned.value == 200


def test_other_sites_can_be_logged(spark, tmp_path):
    tabulate.tabulated(example(spark), ["a", "b", "c"], f"{tmp_path}/all", logged=["OK", "REF_MISMATCH"])
    assert sorted(x for x in os.listdir(f"{tmp_path}/all") if "=" in x) == ["status=OK", "status=REF_MISMATCH"]
    patterns, counters = tabulate.tabulated(example(spark).limit(0), ["a", "b", "c"], f"{tmp_path}/none")
    assert {r["value"] for r in patterns.collect()} == {0.0} and counters.collect() == []
    with pytest.raises(ValueError):
        tabulate.tabulated(example(spark), list("abcabca"), f"{tmp_path}/many")


def test_tables_in_buckets_are_aligned_without_an_exchange(spark, tmp_path):
    rows = spark.createDataFrame([(p, str(i % 4), i, "a", "c" if p != "y" or i % 5 else "g", (i + k) % 4 / 4) for k, p in enumerate("xyz") for i in range(300) if (i + k) % 6], "pop string, chr string, pos long, aa string, da string, daf double")
    table = stored.write_by_position(rows, "frequencies_in_buckets", f"file://{tmp_path}/t", 4)
    aligned = sites.derived(table, ["x", "y", "z"])
    plan = aligned._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Bucketed: true" in plan
    key = lambda f: sorted(map(tuple, f.collect()))
    assert key(aligned) == key(sites.derived(rows, ["x", "y", "z"]))
    sums = P.pattern_sums(aligned.where("status = 'OK'"), ["daf0", "daf1", "daf2"])
    assert sums._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1  # the sums themselves
    spark.sql("drop table frequencies_in_buckets")


def test_writers_of_replicates_frequencies_and_rejected_sites(spark, tmp_path):
    counts = spark.createDataFrame([(rep, pat, rep + pat / 8) for rep in range(3) for pat in (3, 5)], "rep int, pat long, value double")
    sinks.write_replicates(counts, f"{tmp_path}/boot")
    back = spark.read.schema("pat long, value double, rep int").option("sep", "\t").csv(f"{tmp_path}/boot")
    assert sorted((r["rep"], r["pat"], r["value"]) for r in back.collect()) == sorted(map(tuple, counts.collect()))
    assert sorted(x for x in os.listdir(f"{tmp_path}/boot") if "=" in x) == ["rep=0", "rep=1", "rep=2"]
    daf = spark.createDataFrame([("1", 5, "a", "c", 0.25), ("2", 7, "g", ".", 0.0)], "chr string, pos long, aa string, da string, daf double")
    sinks.write_frequencies(daf, f"{tmp_path}/daf")
    lines = text.read_lines(spark, f"{tmp_path}/daf")
    assert sorted((r["chr"], r["pos"], r["aa"], r["da"], r["daf"]) for r in text.read_daf(lines).collect()) == sorted(map(tuple, daf.collect()))
    sinks.write_rejected(example(spark), f"{tmp_path}/rejected")
    assert sorted(x for x in os.listdir(f"{tmp_path}/rejected") if "=" in x) == ["status=MONOMORPHIC_SITE", "status=MULTIPLE_ALT", "status=NO_ANCESTRAL_ALLELE", "status=REF_MISMATCH"]
    told = spark.read.option("sep", "\t").csv(f"{tmp_path}/rejected").where(F.col("status") == "REF_MISMATCH")
    assert told.count() == example(spark).where("status = 'REF_MISMATCH'").count()


def test_gzipped_files_are_read_like_others(spark, tmp_path):
    import gzip

    (tmp_path / "a.raf.gz").write_bytes(gzip.compress(b"# chr pos ref alt raf\n1\t5\ta\tc\t0.5\n1\t6\tg\tt\t1\n"))
    got = text.read_raf(text.read_lines(spark, str(tmp_path / "a.raf.gz"), ordered=True)).orderBy("line_no").collect()
    assert [(r["line_no"], r["pos"], r["raf"], r["status"]) for r in got] == [(1, 5, 0.5, "OK"), (2, 6, 1.0, "OK")]

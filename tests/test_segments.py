"""Scans that look at a file or chromosome in segments, against plain loops over all rows."""

import random
import re

from sitefold.sources import text


def test_rows_out_of_order_across_segments(spark):
    rng = random.Random(1)
    rows, want = [], []
    for file in "ab":
        before = None
        for line_no in sorted(rng.sample(range(2000), 300)):
            chr_, pos = rng.choice(["1", "1", "1", "2"]), line_no + rng.choice([0, 0, 0, -40])
            if before and (chr_ < before[0] or (chr_ == before[0] and pos <= before[1])):
                want.append((file, line_no))
            before = chr_, pos
            rows.append((file, line_no, chr_, pos))
    frame = spark.createDataFrame(rows, "file string, line_no long, chr string, pos long")
    for width in (1, 7, 64, 1 << 14):
        got = text.out_of_order(frame, width)
        assert sorted((r["file"], r["line_no"]) for r in got.collect()) == sorted(want)
    # only last rows of segments are put in order of a whole file
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"windowspecdefinition\(file#\d+, line_no", plan)


def test_order_of_a_file_of_several_splits(spark, tmp_path):
    positions = list(range(1, 6001))
    positions[2500], positions[4001] = 5, positions[4000]
    (tmp_path / "a.raf").write_text("".join(f"1\t{p}\ta\tc\t0.5\n" for p in positions))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        lines = text.read_lines(spark, str(tmp_path / "a.raf"), ordered=True)
        assert spark.read.text(str(tmp_path / "a.raf")).rdd.getNumPartitions() > 1
        got = text.out_of_order(text.read_raf(lines), 512).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert sorted((r["line_no"], r["pos"]) for r in got) == [(2500, 5), (4001, positions[4001])]


def merged(spans):
    """(pos: record) of records (rec, start, end) in order: the last to start wins, unless it is nested in an earlier one."""
    reach, out = -1, {}
    for rec, start, end in sorted(spans, key=lambda s: (s[1], s[0])):
        if end > reach:
            out |= dict.fromkeys(range(start, end + 1), rec)
        reach = max(reach, end)
    return out


def test_chains_of_nested_records_over_many_ranges(spark):
    rng = random.Random(2)
    chains = [(0, 1, 400), (1, 20, 90), (2, 60, 80), (3, 85, 95), (4, 200, 399), (5, 390, 420), (6, 401, 420), (7, 430, 431), (8, 431, 500)]
    drawn = [(100 + i, a, a + rng.randrange(1, 120)) for i, a in enumerate(rng.randrange(1, 3000) for _ in range(80))]
    for spans in (chains, drawn):
        rows = [(chr_, rec, start, end, pos, chr(97 + rec % 26), ".", float(rec)) for chr_ in ("c1", "c2") for rec, start, end in spans for pos in range(start, end + 1)]
        bases = spark.createDataFrame(rows, "chr string, rec long, start long, end long, pos long, ref string, alt string, raf double")
        for width in (10, 64, 1 << 12):
            got = {(r["chr"], r["pos"]): int(r["raf"]) for r in text.axt_merged(bases, width).collect()}
            want = merged(spans)
            assert {k[1] for k in got} == set(want)
            # records that start alike are told by their number in the reach, but positions by their start alone
            starts = {rec: start for rec, start, _ in spans}
            assert all(starts[got[c, p]] == starts[want[p]] for c in ("c1", "c2") for p in want)

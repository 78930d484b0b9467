"""Conversion of ms output, and transposition in blocks, against plain loops."""

import random

import pytest

from sitefold.sources import ms, samples, text
from sitefold.sources.transpose import transposed

LINES = "file string, line_no long, value string"
COMMAND = "ms 4 3 -t 5 -I 2 2 1 0.5 -eA 0.5 1 1 -eA 0.25 2 2"


def output(seed, sites, command=COMMAND, n=6):
    """Lines of ms output and its replicates as lists of haplotypes."""
    rng = random.Random(seed)
    lines, reps = [command, "1 2 3", ""], []
    for s in sites:
        haps = ["".join(rng.choice("01") for _ in range(s)) for _ in range(n)]
        lines += ["//", f"segsites: {s}", "positions: " + " ".join(f"{k / 100:.4f}" for k in range(s)), *[h + " " * (k % 2) for k, h in enumerate(haps)], ""]
        reps.append(haps)
    return lines, reps


def lines_of(spark, **files):
    return spark.createDataFrame([(f, k, v) for f, lines in files.items() for k, v in enumerate(lines)], LINES).repartition(5)


def told(frame, file):
    return [r["value"] for r in frame.where(frame.file == file).orderBy("line_no").collect()]


def test_haplotypes_become_lines_of_sites(spark):
    (a, reps_a), (b, reps_b) = output(1, [3, 11, 1]), output(2, [7])
    lines = lines_of(spark, a=a, b=b)
    # samples by age: populations 1 and 2 now, 2 at 0.25, 1 at 0.5; printed in the order 2, 0, 3, 1
    spans = [(0, 2), (2, 3), (3, 5), (5, 6)]
    order = [2, 0, 3, 1]
    arguments = ["w:2", "x:0", "y:3", "z:1"]
    head = ["npops = 4", "pop sampsize", "y 2", "w 2", "z 1", "x 1"]
    for genotypes in (True, False):
        got = ms.sim_lines(lines, arguments, genotypes)
        for file, reps in (("a", reps_a), ("b", reps_b)):
            want = []
            for rep, haps in enumerate(reps):
                for s in range(len(haps[0])):
                    parts = [[haps[h][s] for h in range(*spans[k])] for k in order]
                    want.append(" ".join([str(rep), *(" ".join(p) if genotypes else f"{p.count('1') / len(p):f}" for p in parts)]))
            assert told(got, file) == head + want


def test_what_is_converted_is_read_as_simulation(spark):
    a, reps = output(3, [5, 8])
    lines = ms.sim_lines(lines_of(spark, a=a), ["w", "x", "y", "z"])
    sizes = samples.sim_samples(lines)
    assert sizes == {"w": 2, "x": 1, "y": 2, "z": 1}
    got = samples.frequency_columns(samples.sim_sites(lines, sizes), sizes).collect()
    want = sorted((rep, *(sum(int(haps[h][s]) for h in range(a, b)) / (b - a) for a, b in ((0, 2), (2, 3), (3, 5), (5, 6)))) for rep, haps in enumerate(reps) for s in range(len(haps[0])))
    assert sorted((r["chr"], r["w"], r["x"], r["y"], r["z"]) for r in got) == want


@pytest.mark.parametrize("change,match", [
    (lambda x: [v.replace("segsites: 4", "segsites: 5") for v in x], "another length"), (lambda x: [v for v in x if not v.startswith("positions")], "positions not found"),
    (lambda x: x[:-2], "another number of haplotypes"), (lambda x: [v.replace("segsites: 4", "segsites: 0") for v in x], "illegal number of sites"), (lambda x: x[:6], "another number of haplotypes"),
])
def test_faulty_output_is_an_error(spark, change, match):
    lines = lines_of(spark, a=change(output(4, [4])[0]))
    with pytest.raises(Exception, match=match):
        ms.sim_lines(lines, ["w", "x", "y", "z"]).collect()


def test_labels_and_commands_have_to_fit(spark):
    a, b = output(5, [2])[0], output(5, [2], "ms 4 3 -I 2 3 1 -eA 0.5 1 1 -eA 0.25 2 2", 7)[0]
    with pytest.raises(ValueError, match="labels"):
        ms.sim_lines(lines_of(spark, a=a), ["w", "x"])
    with pytest.raises(ValueError, match="differently"):
        ms.sim_lines(lines_of(spark, a=a, b=b), ["w", "x", "y", "z"])
    assert samples.label_order(["x:1", "y:2", "z:0"]) == ["y", "z", "x"] and samples.label_order(["x", "y"]) == ["x", "y"]


def test_matrices_are_turned_in_blocks(spark):
    rng = random.Random(6)
    data = {rep: ["".join(rng.choice("01") for _ in range(n)) for _ in range(k)] for rep, n, k in ((0, 37, 11), (1, 8, 3), (2, 1, 30), (3, 64, 5))}
    rows = spark.createDataFrame([(rep, 3 * i, v) for rep, values in data.items() for i, v in enumerate(values)], "rep int, sample long, value string").repartition(4)
    got = transposed(rows, ["rep"], samples=9, sites=16).collect()
    assert {(r["rep"], r["site"]): r["alleles"] for r in got} == {(rep, s): "".join(v[s] for v in values) for rep, values in data.items() for s in range(len(values[0]))}
    assert len(got) == 37 + 8 + 1 + 64
    for odd in ([(0, 0, "01"), (0, 1, "011")], [(0, 0, "02")]):
        with pytest.raises(Exception, match="unlike|other than"):
            text.ms_transposed(spark.createDataFrame(odd, "rep int, sample long, value string")).collect()


def test_blocks_are_whole_across_batches_and_runs(spark, monkeypatch):
    """Small blocks are turned round many at once, whether batches or runs end within them; null keys are keys."""
    rng = random.Random(8)
    data = [(k, h, "".join(rng.choice("01") for _ in range(w))) for k, w in [(None, 5), *((k, rng.randrange(1, 20)) for k in range(40))] for h in range(5)]
    rows = spark.createDataFrame(data, "rep int, sample long, value string")
    want = {(k, i): "".join(v[i] for r, _, v in data if r == k) for k, _, first in data for i in range(len(first))}
    monkeypatch.setattr("sitefold.sources.transpose.CELLS", 64)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for batch in ("3", before):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
            assert {(r["rep"], r["site"]): r["alleles"] for r in transposed(rows, ["rep"], one_block=True, sites=8).collect()} == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_frequencies_of_few_and_many_samples_and_short_rows(spark):
    sites = spark.createDataFrame([(1, [1, 0, 1] + [1] * 20), (2, [1, 0])], "chr int, g array<int>")
    got = samples.frequency_columns(sites, {"x": 1, "y": 2, "z": 20}).orderBy("chr").collect()
    assert [tuple(r) for r in got] == [(1, 1.0, 0.5, 1.0), (2, 1.0, 0.0, 0.0)]

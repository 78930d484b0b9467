"""The data source of site lines against the line readers."""

import gzip

import pytest

from sitefold.sources import site_lines, text


def written(tmp_path, n=900):
    rows = [(c, p) for c in ("1", "10", "2", "X") for p in range(1, n + 1)]
    body = "".join(["# chr pos\n", *[f"{c}\t{p}\ta\tc\t{p / 1000}\n" for c, p in rows], "\n"])
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.raf").write_text(body)
    (tmp_path / "in" / "b.raf.gz").write_bytes(gzip.compress(b"3\t5\ta\tc\t0.5\n3\t6\ta\tc\t0.5"))
    (tmp_path / "in" / "_SUCCESS").write_text("")
    return f"{tmp_path}/in", rows


@pytest.mark.parametrize("split", [100, 777, 1 << 20])
def test_rows_are_those_of_the_line_readers(spark, tmp_path, split):
    path, _ = written(tmp_path, 60)
    site_lines.register(spark)
    for where in (path, f"file://{path}"):
        lines = spark.read.format("site_lines").option("split", split).load(where)
        got = text.read_raf(lines.drop("chr")).drop("line_no", "file")
        want = text.read_raf(text.read_lines(spark, path)).drop("line_no", "file")
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 242
    assert lines.rdd.getNumPartitions() > (1 if split < 1000 else 0)
    first = [r["value"] for r in lines.where("file like '%a.raf'").orderBy("line_no").limit(3).collect()]
    assert first[0] == "# chr pos" and first[2].startswith("1\t2\t")


def test_filters_on_chromosomes_are_pushed_and_give_the_same_rows(spark, tmp_path):
    path, rows = written(tmp_path)
    site_lines.register(spark)
    lines = spark.read.format("site_lines").option("split", 2000).option("sorted", "true").load(path)
    for condition, wanted in (("chr = '10'", {"10"}), ("chr in ('2', 'X')", {"2", "X"}), ("chr = '9'", set()), ("chr = '2' and chr in ('1', '2')", {"2"})):
        got = text.read_raf(lines.where(condition).drop("chr"))
        assert sorted((r["chr"], r["pos"]) for r in got.collect()) == sorted(r for r in rows if r[0] in wanted)
    assert lines.where("chr > '2'").select("chr").distinct().count() == 2  # not pushed, but kept


def test_splits_without_a_wanted_chromosome_are_not_read(tmp_path, monkeypatch):
    path, rows = written(tmp_path, 40_000)
    parts = [p for p in site_lines.splits(path, 200_000) if not p.path.endswith(".gz")]
    monkeypatch.setattr(site_lines, "PEEK", 1000)
    read, inner = [], site_lines.lines_from
    monkeypatch.setattr(site_lines, "lines_from", lambda file, start, end, size: read.append(end - start) or inner(file, start, end, size))
    got = [r for p in parts for r in site_lines.read_split(p, {"2"}, True)]
    assert [r[3].split("\t")[1] for r in got] == [str(p) for c, p in rows if c == "2"]
    assert sum(read) < 0.45 * parts[0].size
    read.clear()
    assert len([r for p in parts for r in site_lines.read_split(p, {"2"}, False)]) == 40_000 and sum(read) == parts[0].size


def test_a_place_without_files_is_an_error(tmp_path):
    with pytest.raises(FileNotFoundError):
        site_lines.splits(f"{tmp_path}/none", 10)

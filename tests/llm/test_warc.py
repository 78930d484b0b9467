"""Archives read back by plain means, and the index against a plain sort."""

import base64
import gzip
import hashlib
import json
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sitefold.llm import warc

SCHEMA = "page_id long, url string, html string, second long, type string"


def pages(n=60, seed=1):
    rng = random.Random(seed)
    bodies = ["", "<p>é\r\n\r\nWARC/1.1</p>", "x" * 5000, *(f"<html>{i}</html>" for i in range(n // 2))]
    return [(i, f"http://{rng.choice('abc')}.Example.com/{rng.randrange(5)}?q={i % 4}", rng.choice(bodies), 1_700_000_000 + rng.randrange(50), "t") for i in range(n)]


def written(spark, tmp_path, data, **options):
    path = f"file://{tmp_path}/archives"
    warc.write_archives(spark.createDataFrame(data, SCHEMA).repartition(3), path, **options)
    return path


def wanted(data, least=0):
    out = []
    for i, url, html, second, _ in data:
        payload = (html or "").encode()
        ids = [r[0] for r in data if (r[2] or "").encode() == payload and r[0] is not None]
        first = min(ids, default=None) if len(payload) >= least else i
        out.append((i, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "response" if first is None or first == i else "revisit", None if first == i else first))
    return Counter(out)


def told(index):
    return Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in index.collect())


def test_what_is_read_back_is_what_was_written(spark, tmp_path):
    data = pages()
    assert told(warc.capture_index(spark, written(spark, tmp_path, data))) == wanted(data)


def test_short_payloads_are_always_responses(spark, tmp_path):
    data = pages() + [(900, "http://z.org", "", 5, "t"), (901, "http://z.org", "", 5, "t")]
    assert told(warc.capture_index(spark, written(spark, tmp_path, data, min_bytes=20))) == wanted(data, 20)


def test_nulls_repeated_rows_long_texts_and_odd_urls(spark, tmp_path):
    data = [(1, None, None, 0, "t"), (2, "no scheme", "", 0, "t"), (2, "no scheme", "", 0, "t"), (None, "http://a/\r\nWARC-Type: x", "only", 0, None), (None, "", "é" * 300_000, 1, None), (3, "http://A.b:80", "é" * 300_000, 1, None), (-4, "://", "\x00", 1, None)]
    got = warc.capture_index(spark, written(spark, tmp_path, data))
    assert told(got) == wanted(data)
    assert {r["url_key"] for r in got.collect()} == {"", "no%20scheme)/", "a)/%0D%0AWARC-Type:%20x", "b:80,a)/"}


def test_no_pages(spark, tmp_path):
    assert warc.capture_index(spark, written(spark, tmp_path, [])).collect() == []


def test_archives_are_gzip_files_of_one_member_a_record(spark, tmp_path):
    data = pages(20)
    path = written(spark, tmp_path, data)
    index = {(r["archive"], r["offset"]): r for r in warc.capture_index(spark, path).collect()}
    payloads = {i: (html or "").encode() for i, _, html, *_ in data}
    for name in os.listdir(path[7:]):
        if not name.startswith("part-"):
            continue
        raw = open(f"{path[7:]}/{name}", "rb").read()
        whole = gzip.decompress(raw)
        assert whole.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n") or not whole
        for (archive, offset), r in index.items():
            if archive == name:
                fields, http, payload = warc.parse_record(gzip.decompress(raw[offset : offset + r["length"]]))
                assert fields["warc-type"] == r["record_type"] and payload == (payloads[r["page_id"]] if r["record_type"] == "response" else b"")


def test_the_index_is_in_order_over_all_ranges(spark, tmp_path):
    data = pages(300, 2) + [(1000 + i, "http://hot.org/", f"{i}", 1_700_000_000 + i % 7, "t") for i in range(400)]
    path = written(spark, tmp_path, data)
    runs = warc.sorted_runs(spark, path).cache()
    assert runs.select("archive").distinct().count() > 2
    index = warc.merged_runs(runs, 6, fan=2)
    got = [tuple(r) for r in index.collect()]
    assert got == sorted((tuple(r) for r in runs.collect()), key=warc.order) and len(got) == len(data)
    assert index.select(F.spark_partition_id().alias("p")).groupBy("p").count().count() > 3  # the hot URL is cut too
    warc.write_index(index, f"{tmp_path}/index")
    lines = [line for name in sorted(os.listdir(f"{tmp_path}/index")) if name.startswith("part-") for line in open(f"{tmp_path}/index/{name}")]
    assert [line.split(" ", 2)[:2] for line in lines] == [[r[3], r[4]] for r in got]
    assert [json.loads(line.split(" ", 2)[2])["offset"] for line in lines] == [r[1] for r in got]


def test_the_tree_of_losers_merges_any_number_of_sources():
    rng = random.Random(4)
    for k in (0, 1, 2, 3, 7, 8, 33):
        sources = [sorted((rng.randrange(20), j, i) for i in range(rng.randrange(9))) for j in range(k)]
        assert list(warc.losers_merge([iter(s) for s in sources], lambda r: r[:1])) == sorted((r for s in sources for r in s), key=lambda r: (r[0], r[1], r[2]))


def test_damaged_archives_are_errors():
    record = warc.record(1, "http://a/", 0, b"abc", None)
    raw = gzip.compress(record)
    assert [r[5] for r in warc.captures("x", raw)] == [1]
    with pytest.raises(ValueError):
        list(warc.captures("x", raw[:-4]))
    with pytest.raises(ValueError):
        list(warc.captures("x", gzip.compress(record.replace(b"abc", b"abd"))))
    with pytest.raises(ValueError):
        list(warc.captures("x", gzip.compress(record + b"x")))

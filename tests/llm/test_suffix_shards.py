"""Shards larger than the memory they may take, hot k-grams, and every level of the recursion, against brute force."""

import random
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from sitefold.llm import _induced, suffix_dedup

from .test_operators import prose, repeated_bytes


def told(frame):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in frame.collect()}


def test_every_level_is_induced_whatever_the_number_of_names():
    rng = np.random.default_rng(5)
    text = rng.integers(97, 123, 60_000).astype(np.uint8)
    text[20_000:45_000] = text[:25_000]
    depths: list[int] = []
    got = list(_induced.suffixes_descending(text, 100, depths=depths))
    assert len(depths) >= 4 and depths[1] > 10_000  # names by the thousand, and still a recursion
    pos, lcp = (np.concatenate(x) for x in zip(*got))
    raw = text.tobytes() + b"\0" * 100
    keys = [raw[p : p + 100] for p in pos.tolist()]
    assert all(a >= b for a, b in zip(keys, keys[1:])) and np.array_equal(np.sort(pos), np.arange(len(text)))
    for k in range(1, len(keys), 97):
        same = next((i for i in range(100) if keys[k][i] != keys[k - 1][i]), 100)
        assert lcp[k] == min(same, len(text) - pos[k], len(text) - pos[k - 1])


def test_a_shard_ten_times_its_memory(monkeypatch):
    monkeypatch.setattr(_induced, "BLOCK", 1 << 11)
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    text = " ".join(rng.choice(words) for _ in range(60_000)).encode()
    text = np.frombuffer(text + text[:40_000], np.uint8)
    want = [np.concatenate(x) for x in zip(*_induced.suffixes_descending(text, 100, 1 << 30))]
    used = 40 * len(text)  # about what the arrays take in memory
    tracemalloc.start()
    got = [[], []]
    for pos, lcp in _induced.suffixes_descending(text, 100, used // 40):
        got[0].append(pos.astype(np.int32))
        got[1].append(lcp.copy())
    peak = tracemalloc.get_traced_memory()[1] - 5 * len(text)  # without what the test itself keeps
    tracemalloc.stop()
    assert np.array_equal(np.concatenate(got[0]), want[0]) and np.array_equal(np.concatenate(got[1]), want[1])
    assert peak < used // 10


def test_hot_grams_are_dealt_by_whole_strings(spark, monkeypatch):
    hot = prose(20)[:64]
    data = [(i, f"{prose(12)} {hot} {prose(12)}") for i in range(40)]
    data += [(100 + i, data[i][1][10:] + prose(3)) for i in range(0, 40, 3)]
    want = repeated_bytes(data)
    frame = spark.createDataFrame(data, "doc_id long, text string")
    assert told(suffix_dedup.suffix_dedup(frame)) == want
    compare = suffix_dedup.compared_anchors
    monkeypatch.setattr(suffix_dedup, "compared_anchors", lambda blocks, buckets, shards: compare(blocks, buckets, shards, 3))
    assert told(suffix_dedup.suffix_dedup(frame)) == want


def test_a_passage_in_all_documents_is_combined_before_it_is_sent(spark, monkeypatch):
    hot = prose(40)[:150]
    rng = random.Random(3)
    odd_text = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    data = [(i, f"{odd_text(300)} {hot} {odd_text(300)}") for i in range(900)]
    frame = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    compare, cut = suffix_dedup.compared_anchors, suffix_dedup.shard_rows
    seen = []
    monkeypatch.setattr(suffix_dedup, "COMBINE", 20_000)
    monkeypatch.setattr(suffix_dedup, "compared_anchors", lambda blocks, buckets, shards: compare(blocks, buckets, shards, 100))
    monkeypatch.setattr(suffix_dedup, "shard_rows", lambda *a: seen.append(cut(*a)) or seen[-1])
    got = told(suffix_dedup.suffix_dedup(frame))
    assert got == repeated_bytes(data)
    rows = seen[0].select("count", "bytes").collect()
    strings = np.concatenate([suffix_dedup.unpacked_strings(r["bytes"]) for r in rows if r["count"] == suffix_dedup.STRINGS])
    assert len(strings) > 900  # those that reach over an end of the passage
    assert sum(len(r["bytes"]) for r in rows) < 2 * sum(len(t) for _, t in data)
    times = np.unique(strings["hash"], return_counts=True)[1]
    assert 2 <= times.max() <= 10  # one for each time that a task combines


def test_marked_grams_are_hot_in_every_task(spark, monkeypatch):
    """A passage that is frequent in what one task combines and rare in what others do."""
    hot = prose(40)[:150]
    rng = random.Random(4)
    odd_text = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    data = [(i, odd_text(200) + (hot if i < 60 or i % 40 == 0 else "") + odd_text(200)) for i in range(240)]
    data += [(1000 + i, data[i][1][150:] + odd_text(20)) for i in (3, 70, 71)]
    monkeypatch.setattr(suffix_dedup, "OFTEN", 8)
    blocks, compare, seen = suffix_dedup.anchor_blocks, suffix_dedup.compared_anchors, []
    monkeypatch.setattr(suffix_dedup, "anchor_blocks", lambda *a: seen.append(blocks(*a)) or seen[-1])
    monkeypatch.setattr(suffix_dedup, "compared_anchors", lambda *a: seen.append(compare(*a)) or seen[-1])
    frame = spark.createDataFrame(data, "doc_id long, text string").repartitionByRange(2, "doc_id")
    assert told(suffix_dedup.suffix_dedup(frame)) == repeated_bytes(data)
    count = lambda f, kind: sum(len(r["docs"] or r["grams"]) // 8 for r in f.where(F.col("kind") == kind).collect())
    assert count(seen[0], suffix_dedup.MARK) > 0
    # tasks that saw it a few times sent anchors, which the mark made hot as well
    assert count(seen[1], suffix_dedup.LOOSE) > count(seen[0], suffix_dedup.LOOSE) > 0


def test_hashes_of_strings_are_those_of_their_bytes():
    rng = np.random.default_rng(1)
    raw = np.tile(rng.integers(97, 100, 400).astype(np.uint8), 3)
    begin, count = np.array([0, 400, 7, 1000]), np.array([69, 69, 3, 101])
    parts = list(suffix_dedup.string_hashes(raw, begin, count))
    hashes, more, of = (np.concatenate(x) for x in zip(*parts, strict=True))
    assert of.tolist() == np.repeat(np.arange(4), count).tolist()
    by_bytes = {}
    for h, m, b in zip(hashes.tolist(), more.tolist(), [begin[i] + k for i in range(4) for k in range(count[i])], strict=True):
        by_bytes.setdefault(raw[b : b + 100].tobytes(), set()).add((h, m))
    assert all(len(x) == 1 for x in by_bytes.values()) and len({next(iter(x)) for x in by_bytes.values()}) == len(by_bytes)


def test_own_names_of_the_caller_pass_through(spark):
    names = ["_spans", "_done", "_span_key", "key", "_key", "row", "done", "asked", "spans"]
    frame = spark.createDataFrame([(1, "a" * 150), (2, "a" * 150)], "doc_id long, text string").select("*", *[F.lit(f"its {n}").alias(n) for n in names])
    rows = suffix_dedup.suffix_dedup(frame).collect()
    assert len(rows) == 2 and all(r[n] == f"its {n}" for r in rows for n in names[:-1])
    assert {r["doc_id"]: r["n_removed"] for r in rows} == {1: 149, 2: 150}

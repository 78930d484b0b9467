"""Links of the n-gram join that depend on the order of shingles, of documents and of rows, against brute force."""

import random

import pyarrow as pa
import pytest

from sitefold.llm import ngram_join
from sitefold.llm._components import components

from .test_operators import groups_by_brute_force

DOCS = "doc_id long, text string"
rng = random.Random(29)


def classes(spark, data):
    frame = spark.createDataFrame(data, DOCS).coalesce(1)
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_jaccard_classes(frame).collect()}


def words_of(k, n=104):
    return [f"w{k}x{i}" for i in range(n)]


def changed(words, first, last, by):
    return [f"{by}{w}" if first <= i <= last else w for i, w in enumerate(words)]


def test_equal_sized_near_copies_in_any_order_of_shingles(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "SKETCH", 32)  # counters say nothing: the order of shingles is random
    data = []
    for k in range(100):
        at = rng.randrange(4, 100)
        data += [(2 * k, " ".join(words_of(k))), (2 * k + 1, " ".join(changed(words_of(k), at, at, "y")))]
    got = classes(spark, data)
    assert got == {d: (100, d // 2 * 2) for d, _ in data} == groups_by_brute_force(data)


def test_near_copies_of_exact_copies_in_falling_order(spark):
    base = words_of(0)
    data = [(20, " ".join(base)), (10, " ".join(base)), (15, " ".join(changed(base, 50, 50, "y"))), (30, " ".join(words_of(1)))]
    got = classes(spark, data)
    assert got == groups_by_brute_force(data) == {20: (100, 10), 10: (100, 10), 15: (100, 10), 30: (100, 30)}


def test_links_at_the_threshold_between_families(spark):
    """Two sets with 89 of 100 shingles in common and a nearer copy each: only their whole prefixes show that they link."""
    data = []
    for k in range(6):
        one = words_of(k)
        two = changed(one, 50, 56, "y")
        data += [(10 * k + i, " ".join(w)) for i, w in enumerate((changed(one, 103, 103, "a"), one, changed(two, 103, 103, "b"), two))]
    got = classes(spark, data)
    assert got == groups_by_brute_force(data) == {d: (100, d // 10 * 10) for d, _ in data}


def two_words(n, seed=5):
    draw = random.Random(seed)
    return [(d, " ".join(draw.choice(("on", "off")) for _ in range(draw.randrange(10, 40)))) for d in range(n)]


@pytest.mark.parametrize("family", [8, 768])
def test_families_of_loosely_alike_texts(spark, monkeypatch, family):
    monkeypatch.setattr(ngram_join, "FAMILY", family)
    data = two_words(300) + [(1000 + 2 * k + i, " ".join(w)) for k in range(20) for i, w in enumerate((words_of(k), changed(words_of(k), 50, 51, "y")))]
    assert classes(spark, data) == groups_by_brute_force(data)


def test_components_of_long_chains(spark):
    """The smallest node at one end of a chain and the next at the other: labels have to pass the whole chain."""
    path = [*range(1, 150), 0]
    got = components(spark.createDataFrame(list(zip(path[:-1], path[1:], strict=True)), "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in got} == dict.fromkeys(range(150), 0)


def test_components_of_links_that_differ_between_evaluations(spark):
    """A group's links are a star whose centre depends on the order in which rows arrive: both directions are of one evaluation."""

    def star(batches):
        for batch in batches:
            nodes = batch.column("id").to_pylist()
            centre = random.SystemRandom().choice(nodes)
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array([centre] * len(nodes))], ["a", "b"])

    links = spark.range(0, 400, 1, 4).mapInArrow(star, "a long, b long")
    got = components(links).collect()
    assert {r["node"]: r["component"] for r in got} == {k: k // 100 * 100 for k in range(400)}


def test_sets_meet_in_lists_of_shingles_early_in_both(spark, monkeypatch):
    """300 sets with one list late in each and one list early in two of them: those two meet, not all pairs."""
    schema = "token long, z long, size int, rest long, early boolean, family long, component long, members long"
    late = [(7, k, 100, 82, False, k, k, 1) for k in range(300)]
    early = [(t, k, 100, 100 - t, True, k, k, 1) for t in range(5) for k in (3, 5)]
    met = []
    frame = spark.createDataFrame(late + early, schema)
    join = type(frame).join
    monkeypatch.setattr(type(frame), "join", lambda *rows: met.append(join(*rows)) or met[-1])
    got = ngram_join.asks_of_lists(frame).collect()
    assert [tuple(r) for r in got] == [] and max(rows.count() for rows in met) <= 20
    more = [(t, k, 100, 100 - t, True, k, k, 1) for t in range(8, 20) for k in (3, 5)]
    got = ngram_join.asks_of_lists(spark.createDataFrame(late + early + more, schema)).collect()
    assert [tuple(r) for r in got] == [(5, 3, 3, 5)]

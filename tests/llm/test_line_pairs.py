"""Pairs of documents that the line dedup has to find."""

import random

from pyspark.sql import functions as F

from sitefold.llm import line_dedup

from .test_operators import prose


def kept(spark, data):
    frame = spark.createDataFrame(data, "doc_id long, text string")
    return {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(frame).collect()}


def test_a_line_goes_if_a_later_holder_than_the_first_has_it_alone(spark):
    a = prose(50)
    data = [(1, f"{a}\nfirst\n{a}"), (2, f"second\n{a}\nmore"), *[(k, f"top {k}\n{a}\nend {k}") for k in range(3, 6)]]
    assert kept(spark, data) == {1: data[0][1], 2: data[1][1], **{k: f"top {k}\nend {k}" for k in range(3, 6)}}


def test_runs_of_short_lines_found_pairs(spark):
    data = [(1, "x\none two\n\nthree four\nfive six\ny"), (2, "p\none two\n\nthree four\nfive six\nq"), (3, "r\none two\n\nthree four\nq")]
    assert kept(spark, data) == {1: data[0][1], 2: "p\nq", 3: data[2][1]}


def test_a_long_line_goes_though_the_alignment_prefers_short_ones(spark):
    line = prose(8)
    data = [(1, "\n".join([line, "w1", "s one", "w2", "s two", "w3", "s three"])), (2, "\n".join(["s one", "u1", "s two", "u2", "s three", "u3", line]))]
    assert kept(spark, data) == {1: data[0][1], 2: "s one\nu1\ns two\nu2\ns three\nu3"}


def test_reversed_documents_lose_every_line_in_few_rounds(monkeypatch):
    lines = [f"line {k} of a long reversed text" for k in range(4000)]
    rounds, inner = [], line_dedup.patience_matches
    monkeypatch.setattr(line_dedup, "patience_matches", lambda a, b: rounds.append(1) or inner(a, b))
    assert line_dedup.common_blocks(lines, [7] * 4000, lines[::-1]) == list(range(4000)) and len(rounds) <= 3


def test_random_documents_lose_what_an_independent_measure_asks_for(spark):
    """At production settings: every line of enough words that is alone in its document and in some earlier one goes; what has no
    equal line in an earlier document stays."""
    rng = random.Random(18)
    pool = [prose(rng.randint(5, 9)) for _ in range(40)] + ["", "short", "two words", "three more words"]
    data = random_documents(rng, 120, pool)
    got = kept(spark, data)
    lost = 0
    for k, (doc, text) in enumerate(data):
        lines, left = text.split("\n"), got[doc].split("\n")
        earlier = [t.split("\n") for _, t in data[:k] if t != text]
        for line in lines:
            if len(line.split()) >= 5 and lines.count(line) == 1 and any(e.count(line) == 1 for e in earlier):
                assert line not in left
                lost += 1
        unknown = [x for x in lines if not any(x in e for e in earlier) and all(t != text for _, t in data[:k])]
        assert all(left.count(x) == lines.count(x) for x in unknown)
    assert lost > 100


def gone_by_all_pairs(data):
    """Lines that some alignment with an earlier document deletes, over all pairs."""
    out = {}
    words = lambda x: len(x.split())
    for k, (doc, text) in enumerate(data):
        a = text.split("\n")
        gone = set()
        for _, other in data[:k]:
            gone |= set(line_dedup.common_blocks(a, [words(x) for x in a], other.split("\n")))
        out[doc] = "\n".join(x for i, x in enumerate(a) if i not in gone)
    return out


def random_documents(rng, n, pool):
    data = []
    for doc in range(n):
        lines = [rng.choice(pool) for _ in range(rng.randint(1, 7))]
        if data and rng.random() < 0.3:
            old = rng.choice(data)[1].split("\n")
            cut = rng.randrange(len(old))
            lines = old[cut:] + lines + old[:cut]
        data.append((doc, "\n".join(lines)))
    return data


def test_no_pair_is_lost_against_all_pairs(spark):
    rng = random.Random(8)
    pool = [prose(rng.randint(5, 9)) for _ in range(25)] + ["", "short", "two words", "three more words"]
    for _ in range(2):
        data = random_documents(rng, 30, pool)
        frame = spark.createDataFrame(data, "doc_id long, text string")
        got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(frame, rare=31).collect()}
        assert got == gone_by_all_pairs(data)


def test_lines_that_are_alone_in_both_go_however_frequent_they_are(spark):
    rng = random.Random(9)
    pool = [prose(rng.randint(5, 9)) for _ in range(12)]
    data = [(doc, "\n".join(rng.sample(pool, rng.randint(1, 6)) + [f"mine {doc}"])) for doc in range(40)]
    frame = spark.createDataFrame(data, "doc_id long, text string")
    for rare, hot in ((4, 1024), (2, 5)):
        got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(frame, rare=rare, hot=hot).collect()}
        assert got == gone_by_all_pairs(data)
        seen = set()
        for doc, text in data:
            assert not seen & set(got[doc].split("\n"))
            seen |= set(text.split("\n"))


def test_passages_in_another_order_and_exact_copies_with_repeated_lines(spark):
    a, b, c = prose(60), prose(60), prose(9)
    data = [(1, f"{a}\nx\n{b}"), (2, f"top\n{b}\ny\n{a}"), (3, f"{c}\n{c}\nz\n{c}"), (4, f"{c}\n{c}\nz\n{c}"), (5, "w " * 40_000 + "\n" + a)]
    got = kept(spark, data)
    assert got == {1: data[0][1], 2: "top\ny", 3: data[2][1], 4: "", 5: "w " * 40_000}


def test_callers_columns_pass_through(spark):
    names = ["_key", "_gone", "key", "gone", "tie", "row", "run", "n_lines"]
    frame = spark.createDataFrame([(1, "a b c d e"), (2, "a b c d e\nx")], "doc_id long, text string")
    frame = frame.select("*", *[F.lit(f"its {n}").alias(n) for n in names])
    got = line_dedup.dedup_lines(frame)
    assert got.columns == ["doc_id", "text", *names[:-1], "n_lines", "n_removed_lines"]
    rows = {r["doc_id"]: r for r in got.collect()}
    assert rows[2]["text"] == "x" and all(r[n] == f"its {n}" for r in rows.values() for n in names[:-1])

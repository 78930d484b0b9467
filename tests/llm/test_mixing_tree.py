"""The splitting tree decides which blocks the mix draws: quotas and disjointness against the definition."""

from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from sitefold.llm import mixing

CLASHING = ["_src", "_block", "_deal", "_tie", "_pos", "_rank", "row", "src", "block", "deal", "part", "draws", "id"]


def table(spark, n=3000):
    source = F.expr("case when id % 3 = 0 then 'hot' when id % 7 = 0 then null else concat('s', id % 5) end")
    return spark.range(n).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', cast(1 + id % 40 as int))").alias("text"), source.alias("source"))


def test_quotas_and_runs_of_the_plan(spark):
    sources = [("sa", 100, 2, 30), ("sb", 7, 0, 7), ("sc", 1, 3, 0), ("n", 50, 1, 0)]
    rows = mixing.draw_plan(spark, sources, 8, 3).collect()
    for src, n, passes, part in sources:
        mine = sorted((r for r in rows if r["src"] == src), key=lambda r: r["shard"])
        draws = [d for r in mine for d in range(r["first"], r["end"])]
        assert draws == list(range(n * passes))  # every draw of a whole pass once, in runs
        assert [b for r in mine for b in range(r["own"], r["own_end"])] == list(range(n))  # every block has one owner
        assert sum(r["drawn_end"] - r["own"] for r in mine) == part and all(r["own"] <= r["drawn_end"] <= r["own_end"] for r in mine)
    quotas = mixing.split_quotas(np.array([200, 0, 3, 50, 30, 7, 0, 0]), 8, 3)
    for r in rows:
        i = [s[0] for s in sources].index(r["src"])
        assert r["end"] - r["first"] == quotas[r["shard"], i] and r["drawn_end"] - r["own"] == quotas[r["shard"], 4 + i]


def test_rows_follow_the_tree(spark, monkeypatch):
    docs = table(spark)
    got = {r["doc_id"]: r for r in mixing.mix_sources(docs, shards=8).collect()}
    split = mixing.split_quotas
    monkeypatch.setattr(mixing, "split_quotas", lambda quotas, shards, seed: split(quotas, shards, seed + 1))
    other = {r["doc_id"]: r for r in mixing.mix_sources(docs, shards=8).collect()}
    assert sum(got[d]["taken"] != other[d]["taken"] for d in got) > 100
    monkeypatch.setattr(mixing, "split_quotas", lambda quotas, shards, seed: 0 * split(quotas, shards, seed))
    monkeypatch.setattr(mixing, "ROUNDS", ())
    assert all(r["taken"] == 0 for r in mixing.mix_sources(docs, shards=8).collect())


def test_without_filling_each_shard_holds_its_quota_of_whole_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ROUNDS", ())
    docs = table(spark)
    got = mixing.mix_sources(docs, shards=8, blocks=16).collect()
    blocks = {r["doc_id"]: r["b"] for r in docs.select("doc_id", F.pmod(F.xxhash64(F.lit(mixing.SEED), "doc_id", mixing.word_count(F.col("text"))), F.lit(16)).alias("b")).collect()}
    draws, members = defaultdict(set), Counter()
    for r in got:
        members[r["source"], blocks[r["doc_id"]]] += 1
        draws[r["source"], blocks[r["doc_id"]]].add(tuple((d["pass"], d["shard"]) for d in r["draws"]))
    assert all(len(d) == 1 for d in draws.values())  # a block is drawn whole, by the same shards
    per_shard = Counter(s for d in draws.values() for told in d for _, s in told)
    assert max(per_shard.values()) - min(per_shard.values()) <= 1  # shards get equal numbers of draws
    for told in draws.values():
        passes = [p for p, _ in next(iter(told))]
        assert passes == list(range(len(passes))) and len(passes) <= mixing.MAX_REPEATS


def test_own_names_of_the_caller_pass_through_and_shards_are_shuffled(spark, tmp_path):
    docs = table(spark, 300).select("*", *[F.concat(F.lit(f"{c}-"), "doc_id").alias(c) for c in CLASHING])
    mixed = mixing.mix_sources(docs)
    rows = mixed.collect()
    assert len(rows) == 300 and all(r[c] == f"{c}-{r['doc_id']}" for r in rows for c in CLASHING if c != "draws")
    mixing.write_mix(mixed.select("doc_id", "size", "draws"), str(tmp_path / "mix"))
    back = spark.read.parquet(str(tmp_path / "mix"))
    want = Counter((r["doc_id"], d["shard"]) for r in rows for d in r["draws"])
    assert Counter((r["doc_id"], r["shard"]) for r in back.collect()) == want
    order = [r["doc_id"] for r in mixing.shuffled_rows(mixed).where("shard = 0").collect()]
    assert order != sorted(order) or len(order) < 4

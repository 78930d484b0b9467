"""The pipeline stage by stage, each against brute force on its own input, and as a whole."""

from collections import Counter, defaultdict

import pytest

import corpus_pipeline as pipeline
from sitefold.llm import mixing
from sitefold.llm._tokens import tokenizer

from .test_line_pairs import gone_by_all_pairs
from .test_operators import DOCS, WORD, groups_by_brute_force, prose

STAGE = dict(pipeline.STAGES)


def corpus():
    rows, doc = [], 0

    def add(text, lang="en", source="s1"):
        nonlocal doc
        doc += 1
        rows.append((doc, text, lang, source, None if text is None else len(text)))

    for k in range(120):  # every third one is toxic
        add(prose(30) + ("\nvile scum filth\n" if k % 3 == 0 else "\n") + prose(30), source=f"s{k % 3}")
    base = [prose(80) for _ in range(6)]
    for text in base:
        add(text)
        add(text)
        words = text.split(" ")
        words[40] = "changed"
        add(" ".join(words), source=None)
    shared = prose(60)
    for _ in range(3):
        add(f"{prose(20)}\n{shared}\n{prose(20)}", lang=None)
    for text in (None, "", " \n ", shared):
        add(text)
    return rows


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    rows = corpus()
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(d, 1, int("vile" in (t or ""))) for d, t, *_ in rows if d <= 120], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """(input, output) of each stage, as rows."""
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    for name, stage in pipeline.STAGES:
        after = pipeline.materialize(stage(spark, docs, sf_dir), "test-stage")
        out[name] = ([tuple(r) for r in docs.collect()], [r.asDict() for r in after.collect()])
        docs = after
    return out


def test_stages_are_the_dealt_ones_in_order():
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "line dedup", "n-gram Jaccard join", "mixing sources to target weights", "best-fit packing"]


def test_toxic_documents_go_and_clean_ones_stay(stages):
    before, after = stages["toxicity"]
    assert sorted((tuple(r.values()) for r in after), key=str) == sorted((r for r in before if "vile" not in (r[1] or "")), key=str)


def test_repeated_lines_go_and_emptied_documents(stages):
    before, after = stages["line dedup"]
    want = gone_by_all_pairs([(r[0], r[1]) for r in sorted(before) if r[1] is not None])
    had = {r[0]: r for r in before}
    kept = {d: had[d][:1] + (t,) + had[d][2:4] + (len(t),) for d, t in want.items() if t == had[d][1] or WORD.search(t)}
    kept |= {r[0]: r for r in before if r[1] is None}
    assert {r["doc_id"]: tuple(r.values()) for r in after} == kept
    assert len(kept) < len(had)


def test_one_of_each_group_of_near_copies_stays(stages):
    before, after = stages["n-gram Jaccard join"]
    groups = groups_by_brute_force(before)
    assert sorted(r["doc_id"] for r in after) == sorted(d for d, (_, least) in groups.items() if least == d) and len(after) < len(before)
    assert {tuple(r.values()) for r in after} <= set(before)


def test_the_mix_takes_documents_whole_and_near_the_targets(stages):
    before, after = stages["mixing sources to target weights"]
    taken, size, total = Counter(r["doc_id"] for r in after), {r[0]: len(WORD.findall(r[1] or "")) for r in before}, Counter()
    for r in before:
        total[r[3]] += size[r[0]]
    order = sorted(s for s in total if s is not None) + [None] * (None in total)
    target = dict(zip(order, mixing.water_fill([total[s] for s in order], [(5.0, 2.0, 1.0)[k % 3] for k in range(len(order))])))
    assert max(taken.values()) <= 3 and {tuple(r.values()) for r in after} <= set(before)
    source = {r[0]: r[3] for r in before}
    for s in order:
        assert abs(sum(n * size[d] for d, n in taken.items() if source[d] == s) - target[s]) <= 60


def test_packing_holds_every_token_once(stages):
    before, after = stages["best-fit packing"]
    chunks = tokenizer("word_bpe_49k.json")
    want = Counter((r[0], len(chunks.whole(r[1] or "")) // 4 + 1) for r in before)
    assert Counter((r["doc_id"], r["length"]) for r in after) == want  # no text is longer than a sequence here
    inside = defaultdict(list)
    for r in after:
        inside[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in inside.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 4096


def test_run_applies_all_stages(spark, sf_dir, stages):
    got = Counter((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in pipeline.run(spark, sf_dir).collect())
    assert got == Counter((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in stages["best-fit packing"][1])

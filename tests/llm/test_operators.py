"""Operators on small tables with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sitefold.llm import chat, embedding_join, line_dedup, mixing, ngram_join, packing, quality, suffix_dedup, toxicity, url_filter
from sitefold.llm._components import components
from sitefold.llm._tokens import tokenizer

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
rng = random.Random(11)
WORDS = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]


def prose(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def corpus():
    base, passage = [prose(rng.randint(60, 120)) for _ in range(12)], prose(40)
    texts = [None, "", "  \n ", "a", "one two three", prose(3000), "x" * 400, "ab" * 300] + base
    texts += base[:3] * 2 + [base[0].upper(), base[4].replace(" ", "\n", 3), passage + " " + prose(70), prose(30) + "\n" + passage]
    for text in base[:6]:
        words = text.split(" ")
        words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    texts += ["\n".join([base[5][:80], prose(9), base[5][:80]]), "\n".join([prose(8), base[5][:80], prose(8)]), "é́ü😀 " * 60]
    return [(i, t, rng.choice(["en", None]), rng.choice(["s1", "s2", None]), None) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


def odd(docs, *names):
    """The documents with extra columns that clash with results and with names that operators use themselves."""
    return docs.select("*", *[F.lit("extra").alias(n) for n in names])


def empty(docs):
    return docs.limit(0)


def repeated_bytes(rows, length=100):
    seen, out = set(), {}
    for doc, text in sorted((r[0], r[1] or "") for r in rows):
        raw = text.encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - length + 1):
            if raw[s : s + length] in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(raw[s : s + length])
        spans = len(re.findall(b"\1+", bytes(gone)))
        out[doc] = (len(raw), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest())
    return out


def test_suffix_dedup(docs, rows, monkeypatch):
    want = repeated_bytes(rows)
    got = suffix_dedup.suffix_dedup(odd(docs, "key", "spans", "n_spans"), with_kept=True)
    told = {r["doc_id"]: r for r in got.collect()}
    assert {k: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for k, r in told.items()} == want
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] and r["key"] == "extra" for r in told.values())
    assert suffix_dedup.suffix_dedup(empty(docs)).count() == 0
    both = suffix_dedup.suffix_dedup(docs.union(docs.where("doc_id = 5")).union(docs.where("doc_id = 5").withColumn("doc_id", F.lit(None).cast("long"))))
    told = {(r["doc_id"], r["n_removed"]) for r in both.where("doc_id is null or doc_id = 5").collect()}
    assert (None, 0) in told and len(told) == 2  # the null doc_id is first; both rows of 5 are copies of it
    assert both.count() == len(rows) + 2


def test_long_texts_are_cut_into_overlapping_slices(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 256)
    data = [(0, prose(500)), (1, prose(30)), (2, "ab" * 700)]
    data.append((3, data[0][1][300:900] + prose(20)))
    want = repeated_bytes(data)
    import numpy as np
    import pyarrow as pa

    # the slices give the same strings whatever their size
    from sitefold.llm._words import text_bytes

    raw, at = text_bytes(pa.array([t for _, t in data]))
    starts = set()
    for row, offset, byte, inside in suffix_dedup._slices(at):
        first, count, *_ = suffix_dedup.anchors(raw[byte : byte + int(inside[-1])], inside)
        text = np.searchsorted(inside, first, side="right") - 1
        for r, f, c, t in zip(row + text, first, count, text):
            starts |= {(int(r), int(f - inside[t] + offset + k)) for k in range(int(c))}
    assert starts == {(i, s) for i, (_, t) in enumerate(data) for s in range(len(t.encode()) - 99)}
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.suffix_dedup(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == want


def test_line_dedup(spark, docs):
    a, b, c = prose(9), prose(9), prose(9)
    data = [(1, f"{a}\n{b}\nmine"), (2, f"x\n{a}\n{b}\ny"), (3, a), (4, None), (5, ""), (6, f"{c}\n{c}"), (7, f"of\n{c}\nx"), (7, f"of\n{c}\nx"), (None, f"{b} z\nq")]
    frame = spark.createDataFrame([(*r, "kept") for r in data], "doc_id long, text string, n_lines string")
    got = sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_removed_lines"]) for r in line_dedup.dedup_lines(frame).collect()), key=str)
    want = [(1, f"{a}\n{b}\nmine", 3, 0), (2, "x\ny", 4, 2), (3, "", 1, 1), (4, None, 0, 0), (5, "", 1, 0), (6, f"{c}\n{c}", 2, 0), (7, f"of\n{c}\nx", 3, 0), (7, f"of\n{c}\nx", 3, 0), (None, f"{b} z\nq", 2, 0)]
    # a line twice in the owner is no anchor; alone in both it would be
    assert got == sorted(want, key=str)
    assert line_dedup.dedup_lines(empty(docs)).count() == 0


def test_toxicity(spark, docs):
    bad = [(i, prose(40) + (" vile scum " if i % 3 == 0 else " ") + prose(40)) for i in range(400)]
    frame = spark.createDataFrame(bad + [(1000, None), (1001, ""), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0, int(i % 3 == 0)) for i in range(400)] + [(0, 1, None), (None, 0, 1), (3, 0, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity_scores(odd(frame, "score", "features"), labels).collect()}
    assert len(got) == 403
    held = [r for i, r in got.items() if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in got if i is not None and zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r["predicted"] == int(r["doc_id"] % 3 == 0) for r in held if r["doc_id"] < 400) >= 0.95 * len([r for r in held if r["doc_id"] < 400])
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())
    assert got[1000]["score"] == got[1001]["score"]
    none = toxicity.toxicity_scores(frame, labels.limit(0))
    assert {r["score"] for r in none.collect()} == {0.5}
    assert toxicity.toxicity_scores(empty(docs), labels).count() == 0


def test_labels_are_learned_from_training_folds_only(spark):
    frame = spark.createDataFrame([(i, "t") for i in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(50)], "doc_id long, toxic int")
    ids = {r["doc_id"] for r in toxicity.training_rows(frame, labels).collect()}
    assert ids == {i for i in range(50) if zlib.crc32(str(i).encode()) % 5}
    assert toxicity.training_rows(frame, labels, max_train=7).count() == 7


TREE = [
    (1, 1, None, "user", "hi <|im_start|>", 0.0), (1, 2, 1, "assistant", "a\n<\\|x|>", 1.0), (1, 3, 1, "assistant", "b", 2.0), (1, 4, 3, "us\ner", None, None), (1, 5, 2, "user", "c", 0.5),
    (2, 1, 2, "user", "loop", 0.0), (2, 2, 1, "user", "loop", 0.0), (3, 9, 77, None, "orphan", 1.0), (None, 1, None, "assistant", "x", None), (1, 4, 3, "zz", "repeated id", 9.0),
]


def test_chat_formatting(spark):
    frame = spark.createDataFrame([(*r, "extra") for r in TREE], "conv_id long, node long, parent long, role string, text string, score double, branch string")
    got = {(r["conv_id"], r["branch"]): r for r in chat.read_back(chat.format_reply_trees(frame, top_k=5)).collect()}
    assert set(got) == {(1, 1), (1, 2), (3, 1), (None, 1)}
    turns = {k: [(t["role"], t["text"]) for t in r["turns"]] for k, r in got.items()}
    assert turns[1, 1] == [("user", "hi <|im_start|>"), ("assistant", "b"), ("us\ner", "")]
    assert turns[1, 2] == [("user", "hi <|im_start|>"), ("assistant", "a\n<\\|x|>"), ("user", "c")]
    assert turns[3, 1] == [("", "orphan")] and turns[None, 1] == [("assistant", "x")]
    assert got[1, 2]["loss_text"] == "a\n<\\|x|>" and got[1, 1]["loss_text"] == "b" and got[3, 1]["loss_text"] == ""
    assert got[1, 1]["formatted"].count("<|") == 6
    assert chat.format_reply_trees(frame.limit(0)).count() == 0
    assert {(r["conv_id"], r["branch"]) for r in chat.format_reply_trees(frame).collect()} == {(1, 1), (3, 1), (None, 1)}


def test_deep_reply_trees_need_few_rounds(spark):
    frame = spark.range(1, 301).select(F.lit(1).alias("conv_id"), F.col("id").alias("node"), F.expr("nullif(id - 1, 0)").alias("parent"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"))
    row = chat.read_back(chat.format_reply_trees(frame)).first()
    assert [t["text"] for t in row["turns"]] == [str(i) for i in range(1, 301)]


def test_embedding_join(spark):
    data = []
    for i in range(240):
        centre = [math.sin(7 * (i % 9) + k) for k in range(8)]
        data.append((i, [c + rng.gauss(0, 0.05) for c in centre], i % 2))
    data += [(300, data[0][1], 0), (301, [2 * x for x in data[0][1]], 0), (302, None, 0), (303, [], 0), (304, [0.0] * 8, 0), (305, [float("nan")] * 8, 0), (306, data[0][1], None), (307, data[0][1][:4], 0), (308, [None] + data[0][1][1:], 0), (None, data[0][1], 0), (5, data[5][1], 1), (309, [float("inf")] * 8, 0)]
    frame = spark.createDataFrame([(*r, "extra") for r in data], "vec_id long, embedding array<float>, label int, component string")

    def cosine(a, b):
        f32 = lambda x: [struct_f(v) for v in x]
        a, b = f32(a), f32(b)
        return math.fsum(x * y for x, y in zip(a, b)) / math.sqrt(math.fsum(x * x for x in a) * math.fsum(y * y for y in b))

    import struct

    struct_f = lambda v: struct.unpack("f", struct.pack("f", v))[0]
    ok = [k for k, (i, e, lab) in enumerate(data) if i is not None and e and lab is not None and all(x is not None and math.isfinite(x) for x in e) and any(e)]
    near = defaultdict(set)
    for a in ok:
        for b in ok:
            if a != b and data[a][2] == data[b][2] and len(data[a][1]) == len(data[b][1]) and cosine(data[a][1], data[b][1]) >= 0.98:
                near[a].add(b)

    def least(k):
        seen, todo = {k}, [k]
        while todo:
            todo += [x for x in near[todo.pop()] if x not in seen and not seen.add(x)]
        return min(data[x][0] for x in seen) if data[k][0] is not None else None

    want = Counter((data[k][0], len(near[k]), least(k)) for k in range(len(data)))
    for cell, block in ((1024, 4096), (10, 7)):
        got = embedding_join.near_dedup(frame, cell=cell, block=block).collect()
        assert Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == want
        assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    assert embedding_join.near_dedup(frame.limit(0)).count() == 0


def test_mixing(spark, docs, rows):
    got = mixing.mix_sources(odd(docs, "taken", "draws", "rank")).collect()
    size = {i: len(WORD.findall(t or "")) for i, t, *_ in rows}
    total = Counter()
    for i, _, _, s, _ in rows:
        total[s] += size[i]
    order = sorted((s for s in total if s is not None)) + [None]
    want = dict(zip(order, mixing.water_fill([total[s] for s in order], [(5.0, 2.0, 1.0)[k % 3] for k in range(len(order))])))
    assert {r["doc_id"]: r["size"] for r in got} == size
    taken = Counter()
    for r in got:
        assert r["source_size"] == total[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert r["taken"] == r["size"] * len(r["draws"]) <= 3 * r["size"]
        assert all(0 <= d["shard"] < mixing.SHARDS for d in r["draws"])
        taken[r["source"]] += r["taken"]
    for s in order:
        # near, unless no document that is left would come nearer
        gap = want[s] - taken[s]
        assert abs(gap) <= 60 or all(abs(gap - r["size"]) >= abs(gap) for r in got if r["source"] == s and not r["draws"])
    again = mixing.mix_sources(docs.repartition(7)).collect()
    assert {(r["doc_id"], str(r["draws"])) for r in again} == {(r["doc_id"], str(r["draws"])) for r in got}
    copies = mixing.mixed_rows(mixing.mix_sources(docs))
    assert copies.agg(F.sum("size")).first()[0] == sum(taken.values())
    assert mixing.mix_sources(empty(docs)).count() == 0
    twice = mixing.mix_sources(docs.union(docs), columns=["doc_id"])
    assert twice.count() == 2 * len(rows)
    assert mixing.mix_sources(docs.where("text is null")).select("taken").first()[0] == 0


def base_statistics(text):
    words = WORD.findall(text or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
    seen, repeated = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            repeated += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), repeated, len(covered), failed


def reference_mcd(vectors):
    """Distances by the estimate of least determinant, with numpy: exact distances, no bins, many starts."""
    import numpy as np

    z, rng = np.array(vectors), np.random.default_rng(1)
    h, best = math.ceil(quality.SHARE * len(z)), None
    for _ in range(50):
        mean, cov = z[rng.choice(len(z), 5, replace=False)].mean(axis=0), np.eye(4)
        last = np.inf
        while True:
            d2 = np.einsum("ij,jk,ik->i", z - mean, np.linalg.inv(cov), z - mean)
            near = z[np.argsort(d2, kind="stable")[:h]]
            mean, cov = near.mean(axis=0), np.cov(near.T, bias=True) * quality.CONSISTENCY + np.eye(4)
            logdet = np.linalg.slogdet(cov)[1]
            if logdet > last - 1e-12:
                break
            last = logdet
        if best is None or logdet < best[0]:
            best = logdet, np.einsum("ij,jk,ik->i", z - mean, np.linalg.inv(cov), z - mean)
    return best[1]


def test_quality_rules(spark, docs, rows):
    texts = [prose(60 + i % 50) + (" ### $$ |" * 20 if i % 17 == 0 else "") for i in range(150)]
    data = rows + [(1000 + i, t, "xx", "big", None) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(data, DOCS)
    got = {r["doc_id"]: r for r in quality.judge_quality(odd(frame, "kept", "z0", "key")).collect()}
    for doc, text, *_ in data:
        r = got[doc]
        assert base_statistics(text) == (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"])
        assert not (r["base_failed"] and r["kept"])
    big = [got[1000 + i] for i in range(150)]
    vector = [[r["word_chars"] / r["n_words"] / 0.3, math.log1p(100 * r["n_symbols"] / r["n_words"]) / 0.25, math.sqrt(r["n_repeat_words"] / r["n_words"]) / 0.15, math.log1p(100 * r["n_dup_lines"] / r["n_words"]) / 0.5] for r in big if not r["base_failed"]]
    assert [r["distance2"] for r in big if not r["base_failed"]] == pytest.approx(reference_mcd(vector).tolist(), rel=0.05, abs=0.05)
    assert [r["kept"] for r in big] == [i % 17 != 0 for i in range(150)]
    assert quality.judge_quality(empty(docs)).count() == 0


def shingles(text):
    words = [w.translate({i: i + 32 for i in range(65, 91)}) for w in WORD.findall(text or "")]
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def groups_by_brute_force(rows):
    sets = {r[0]: shingles(r[1]) for r in rows}
    least = {d: d for d in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(least[a], least[b])
            changed |= least[a] != low or least[b] != low
            least[a] = least[b] = low
    return {d: (len(sets[d]), least[d]) for d in sets}


def test_ngram_jaccard_join(docs, rows):
    got = ngram_join.ngram_jaccard_classes(odd(docs, "n", "head", "component_id")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == groups_by_brute_force(rows)
    assert ngram_join.ngram_jaccard_classes(empty(docs)).count() == 0
    left = {r["doc_id"] for r in ngram_join.one_of_each_group(docs).collect()}
    assert left == {d for d, (_, c) in groups_by_brute_force(rows).items() if c == d}


def test_ngram_join_finds_links_between_large_groups(spark):
    """Families at all distances around the threshold, so that stars ask stars."""
    data, doc = [], 0
    for _ in range(4):
        base = prose(150).split(" ")
        for k in range(40):
            words = list(base)
            for _ in range(k % 8):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            data.append((doc := doc + 1, " ".join(words)))
    data += [(1000, data[3][1]), (1001, data[3][1].upper())]
    frame = spark.createDataFrame(data + [(None, "a b"), (None, None)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_jaccard_classes(frame).where("doc_id is not null").collect()}
    assert got == groups_by_brute_force(data)


def test_best_fit_packing(spark, docs, rows):
    frame = odd(docs.union(docs.where("doc_id in (3, 5)")), "piece", "length").union(odd(docs.where("doc_id = 1").withColumn("doc_id", F.lit(None).cast("long")), "piece", "length"))
    got = packing.pack_documents(frame, capacity=256, with_ids=True).collect()
    chunks = tokenizer(packing.TOKENIZER)
    want = Counter()
    for doc, text, *_ in [*rows, rows[3], rows[5], (None, "", None)]:
        ids = [int.from_bytes(raw, "little") for raw in re.findall(b"....", chunks.whole(text or ""), re.S)] + [1]
        for k, s in enumerate(range(0, len(ids), 256)):
            want[doc, k, s, tuple(ids[s : s + 256])] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], tuple(r["ids"])) for r in got) == want
    inside = defaultdict(list)
    for r in got:
        assert r["length"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in r["ids"]))
        inside[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in inside.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 256
    assert packing.pack_documents(empty(docs)).count() == 0


def test_url_filter(spark):
    urls = ["http://A.Example.org/es/x", "https://example.org/en/12?q", "https://example.org/en/2", "http://example.org", "http://badexample.org/es/", "x://m.foo.com/fr/", "x://foo.com/de/?a", "http://foo.net/de/", "no scheme", "", None, "://org/", "http://ORG/#a", "http://a.org?x://b.com/de/", "http://a.org/\nes", "http://İ.org/"]
    frame = spark.createDataFrame([(i, u, "extra", "extra") for i, u in enumerate(urls)] + [(0, urls[0], "e", "e")], "page_id long, url string, rule string, suffixes string")

    def judge(url):
        if url is None or "://" not in url:
            return "", "", None, "allow"
        host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
        host = host.translate({i: i + 32 for i in range(65, 91)})
        fits = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return host, path, *(max(fits)[1:] if fits else (None, "allow"))

    for blocks in (url_filter.BLOOM_BLOCKS, 1):
        got = url_filter.judge_urls(frame, url_filter.rules_frame(spark), blocks=blocks).collect()
        assert Counter((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got) == Counter((i, *judge(u)) for i, u in [*enumerate(urls), (0, urls[0])])
        assert all(r["suffixes"] in ("extra", "e") for r in got)
    none = url_filter.judge_urls(frame, url_filter.rules_frame(spark).limit(0)).collect()
    assert {(r["rule"], r["verdict"]) for r in none} == {(None, "allow")}
    assert url_filter.judge_urls(frame.limit(0), url_filter.rules_frame(spark)).count() == 0


def test_bloom_filter_has_no_false_negatives(spark):
    listed = spark.range(500).select(F.concat(F.lit("k"), "id").alias("key"))
    bloom = url_filter.bloom_words(listed, 64)
    told = spark.range(1000).select(F.concat(F.lit("k"), "id").alias("key"), "id").withColumn("bloom", bloom.scalar()).withColumn("hit", url_filter.might_contain(F.col("bloom"), F.col("key"), 64))
    assert told.where("id < 500 and not hit").count() == 0
    assert told.where("id >= 500 and hit").count() < 150


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (8, 9), (5, 5), (None, 4)] + [(i, i + 1) for i in range(100, 160)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 8, 8: 8} | {i: 100 for i in range(100, 161)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0

"""FTRL against a calculation by hand, unlike long words, and tokenizers that are not cut at white space."""

import json
import math
import re

import numpy as np
import pyarrow as pa

from sitefold.llm import ngram_join, toxicity
from sitefold.llm._tokens import tokenizer
from sitefold.llm._words import text_bytes, word_hashes, word_spans


def test_ftrl_by_hand():
    """Three examples over two features, each update written out in plain numbers."""
    alpha, beta, l1, l2 = 0.5, 1.0, 0.3, 0.1
    z, n = {0: 0.0, 1: 0.0, "bias": 0.0}, {0: 0.0, 1: 0.0, "bias": 0.0}

    def weight(i):
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    model = toxicity.Ftrl(2, alpha, beta, l1, l2)
    for features, label in (([0], 1), ([0, 1], 0), ([1], 1), ([0], 1)):
        model.learn(np.array(features), label)
        used = [*features, "bias"]
        w = {i: weight(i) for i in used}
        g = 1 / (1 + math.exp(-sum(w.values()))) - label
        for i in used:
            sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha
            z[i] += g - sigma * w[i]
            n[i] += g * g
        assert model.z.tolist() == [z[0], z[1], z["bias"]] and model.n.tolist() == [n[0], n[1], n["bias"]]
        assert model.weights().tolist() == [weight(0), weight(1), weight("bias")]
    assert model.n[2] > model.n[0] > 0 and np.count_nonzero(model.weights()) > 0


def test_l1_leaves_features_of_no_use_without_weight():
    model = toxicity.Ftrl(50, 0.5, 1.0, 1.0, 0.1)
    rng = np.random.default_rng(2)
    for _ in range(300):
        label = int(rng.random() < 0.5)
        model.learn(np.unique(np.r_[label, rng.integers(2, 50, 3)]), label)
    w = model.weights()
    assert w[1] > 0.5 > -0.5 > w[0] and np.count_nonzero(w[2:50]) < 10


def test_repeated_rows_are_learned_from_once(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (2, "c"), (3, "d")] * 3, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 1)], "doc_id long, toxic int")
    assert sorted(tuple(r) for r in toxicity.training_rows(docs, labels).collect()) == sorted({(1, "a", 1), (2, "c", 0), (3, "d", 1)} & {(i, t, x) for i, t, x in ((1, "a", 1), (2, "c", 0), (3, "d", 1)) if toxicity_fold(i)})


def toxicity_fold(i):
    import zlib

    return zlib.crc32(str(i).encode()) % 5 != 0


def alternating(n):
    word = "a"
    while len(word) < n:
        word += word.translate({97: 98, 98: 97})
    return word


def test_long_words_that_alternate_are_unlike(spark):
    one = alternating(1024)
    two = one.translate({97: 98, 98: 97})
    raw, at = text_bytes(pa.array([one, two, one.upper(), one[:-1], "x" * 100_000, "x" * 100_001]))
    starts, ends, _ = word_spans(raw, at)
    hashes = word_hashes(raw, starts, ends).tolist()
    assert hashes[0] == hashes[2] and len(set(hashes)) == 5
    got = ngram_join.ngram_jaccard_classes(spark.createDataFrame([(1, one), (2, two), (3, one.upper())], "doc_id long, text string"))
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == {1: 1, 2: 2, 3: 1}


def test_other_tokenizers_files_give_their_own_ids(tmp_path):
    import public_tokenizers

    texts = ["Don't STOP  now", " A b\tc", "x  y"]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        chunks = tokenizer(name)
        assert [chunks.ids(t) for t in texts] == [chunks.whole(t) for t in texts]
    told = json.load(open(public_tokenizers.path("word_bpe_49k.json")))
    told["normalizer"] = None  # the same vocabulary, without lower-casing
    (tmp_path / "cased.json").write_text(json.dumps(told))
    chunks = tokenizer(str(tmp_path / "cased.json"))
    assert [chunks.ids(t) for t in texts] == [chunks.whole(t) for t in texts]
    assert re.fullmatch(b"(?:....)*", chunks.ids("Abc"), re.S)


def test_caches_are_bound_by_bytes(monkeypatch):
    import random
    import sys

    from sitefold.llm import _tokens

    rng = random.Random(5)
    texts = [" ".join("".join(rng.choice("abcdeé,.1") for _ in range(rng.randint(1, 90))) for _ in range(200)) for _ in range(30)]
    free = _tokens.tokenizer("word_bpe_49k.json")
    want = [free.ids(t) for t in texts]
    monkeypatch.setattr(_tokens, "CACHE_BYTES", 50_000)
    monkeypatch.setattr(_tokens, "_loaded", {})
    small = _tokens.tokenizer("word_bpe_49k.json")
    assert [small.ids(t) for t in texts] == want
    held = [(k, v) for cache in (small, small.heads, small.pieces) for k, v in cache.items()]
    assert 0 <= small.room.left < 300 and 40_000 < sum(sys.getsizeof(k) + sys.getsizeof(v) + 100 for k, v in held) <= 50_000

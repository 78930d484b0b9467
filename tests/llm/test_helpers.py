"""Parts of the operators that need no Spark session, against brute force."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sitefold.llm import _induced
from sitefold.llm._tokens import tokenizer
from sitefold.llm._words import text_bytes, word_spans
from sitefold.llm._components import linked_groups
from sitefold.llm.line_dedup import common_blocks, patience_matches
from sitefold.llm.mixing import split_quotas, water_fill
from sitefold.llm.packing import packing_plan
from sitefold.llm.quality import chi_square_cdf, chi_square_quantile


@pytest.mark.parametrize("block,budget", [(1 << 18, 1 << 26), (3, 40)])
def test_induced_sorting_is_the_suffix_array(monkeypatch, block, budget):
    monkeypatch.setattr(_induced, "BLOCK", block)
    rng = random.Random(5)
    for _ in range(300):
        text = bytes(rng.randint(0, rng.choice([1, 2, 4])) for _ in range(rng.randint(1, 60)))
        text = text + text[: rng.randint(0, len(text))] + text if rng.random() < 0.4 else text
        order = sorted(range(len(text)), key=lambda i: text[i:])
        common = [next((k for k in range(200) if text[a + k : a + k + 1] != text[b + k : b + k + 1] or a + k >= len(text)), 200) for a, b in zip(order, order[1:])]
        blocks = list(_induced.suffixes_descending(np.frombuffer(text, np.uint8), 200, budget))
        assert np.concatenate([p for p, _ in blocks]).tolist() == order[::-1]
        assert np.concatenate([x for _, x in blocks])[1:].tolist() == common[::-1]


def test_recursion_induces_when_names_are_few():
    rng = np.random.default_rng(1)
    text = np.tile(rng.integers(0, 3, 40, dtype=np.uint8), 400)
    text[rng.integers(0, len(text), 20)] = 5
    raw = text.tobytes()
    pos = np.concatenate([p for p, _ in _induced.suffixes_descending(text, 100)])
    keys = [raw[p : p + 100] for p in pos[::-1]]
    assert keys == sorted(keys)
    assert sorted(pos.tolist()) == list(range(len(text)))


def test_words_break_at_ascii_white_space_and_rows_only():
    column = pa.array(["a b\x0bc", None, "", "d e", "x\x1cy", "é"])
    raw, at = text_bytes(column.slice(0))
    starts, ends, first = word_spans(raw, at)
    assert [bytes(raw[a:b]).decode() for a, b in zip(starts, ends)] == ["a", "b", "c", "d", "e", "x\x1cy", "é"]
    assert first.tolist() == [0, 3, 3, 3, 5, 6, 7]
    assert text_bytes(column.slice(3, 2))[1].tolist() == [0, 3, 6]


def test_cached_token_ids_equal_the_tokenizer():
    chunks, rng = tokenizer("word_bpe_49k.json"), random.Random(3)
    letters = list("aZé'.,$%&#*()[]!?:;<|> 1½ΣÉ́ß\n_-\x1c ")
    texts = ["", "don't we'll 12.", "a <|endoftext|>b <|startoftext|>", "İstanbul ΑΣ. ΑΣ Α"] + ["".join(rng.choice(letters) for _ in range(30)) for _ in range(1500)]
    for _ in range(2):
        assert [chunks.ids(t) for t in texts] == [chunks.whole(t) for t in texts]


def test_packing_plan_places_every_piece_and_is_never_worse_than_best_fit():
    rng = random.Random(1)
    for _ in range(200):
        cap = rng.choice([10, 20, 50])
        counts = {rng.randint(1, cap): rng.randint(1, 6) for _ in range(rng.randint(0, 12))}
        plan, n = packing_plan(counts, cap)
        ranks, inside = Counter(), {}
        for length, rank, times, sequence, offset in plan.tolist():
            assert rank == ranks[length]
            ranks[length] += times
            for k in range(times):
                inside.setdefault(sequence + k, []).append((offset, length))
        assert ranks == Counter(counts) and set(inside) == set(range(n))
        for parts in inside.values():
            end = 0
            for offset, length in sorted(parts):
                assert offset == end
                end += length
            assert end <= cap
        gaps = []
        for length in sorted(counts, reverse=True):
            for _ in range(counts[length]):
                fits = [g for g in gaps if g >= length]
                if fits:
                    gaps.remove(min(fits))
                gaps.append((min(fits) if fits else cap) - length)
        assert n <= len(gaps)


def test_water_fill_caps_and_shares_everything():
    sizes, weights = [100, 10, 500, 0, 7], [5.0, 2.0, 1.0, 5.0, 2.0]
    got = water_fill(sizes, weights)
    assert sum(got) == pytest.approx(sum(sizes))
    assert all(t <= 3 * s for t, s in zip(got, sizes))
    assert got[0] == 300 and got[1] == 30 and got[4] == 21
    assert water_fill([], []) == [] and water_fill([0], [1.0]) == [0.0]


def test_quotas_are_split_exactly_and_evenly():
    quotas = np.array([1000, 0, 37, 5])
    dealt = split_quotas(quotas, 7, 3)
    assert dealt.sum(axis=0).tolist() == quotas.tolist() and (dealt >= 0).all()
    assert np.ptp(dealt.sum(axis=1)) <= 1
    assert (split_quotas(quotas, 7, 3) == dealt).all()
    assert split_quotas(np.zeros(2, int), 3, 1).sum() == 0


def test_patience_matches_are_a_common_subsequence():
    rng = random.Random(2)
    for _ in range(300):
        a = [rng.randint(0, 8) for _ in range(rng.randint(0, 12))]
        b = [rng.randint(0, 8) for _ in range(rng.randint(0, 12))]
        got = patience_matches(a, b)
        assert all(a[i] == b[j] for i, j in got)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:]))
        assert patience_matches(a, a) == [(i, i) for i in range(len(a))]


def test_blocks_need_enough_words():
    assert common_blocks([1, 2, 3, 9], [2, 2, 2, 8], [7, 1, 2, 3]) == [0, 1, 2]
    assert common_blocks([1, 5, 3], [3, 9, 3], [1, 6, 3]) == []
    assert common_blocks([], [], [1]) == []


def test_linked_groups_take_the_smallest_row():
    pairs = [(np.array([5, 4]), np.array([3, 5])), (np.array([1]), np.array([2]))]
    assert linked_groups(iter(pairs), 7).tolist() == [0, 1, 1, 3, 3, 3, 6]


def test_chi_square_quantile():
    assert chi_square_quantile(0.95, 2) == pytest.approx(5.991, abs=1e-3)
    assert chi_square_cdf(chi_square_quantile(0.3, 6), 6) == pytest.approx(0.3)

"""Operator 8: ids against the tokenizer, and the packing against vector best-fit piece by piece."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pageloom.llm import packing

VOCABULARY = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()
TOKENIZER = Tokenizer.from_str(VOCABULARY)
ODD = ["don't", "<|endoftext|>x", "<|ENDOFTEXT|>x", "Ünïcödé", "ÀÉ×÷ß", "a1b22c", "--'s", "it's", "é", "ǅungla", "日本語123", "foo_bar", "\x1cab", "x y",
       "İstanbul", "ª²", "É'D", "&&a&&", "😀ok", "Straße", "<|a", "<", "a<|b", "Ã", "ÃÂ©", "éÉ", "\x7f", "\u0085x"]


def check_ids(texts, encoder):
    ids, ends = packing.ids_of(pa.array(texts, pa.string()), encoder, 0)
    got = [part.tolist() for part in np.split(ids, ends[:-1])] if texts else []
    assert got == [e.ids + [0] for e in TOKENIZER.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]


def test_ids_of_odd_words():
    encoder = packing.Encoder(VOCABULARY)
    check_ids([*ODD, " ".join(ODD), None, "", " \n "], encoder)
    check_ids([], encoder)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="aB1 \n.,'<|é×ÉÃ́日-_&\x1c", max_size=40), max_size=6))
def test_ids_against_the_tokenizer(texts):
    check_ids(texts, packing.Encoder(VOCABULARY))


def test_cache_generations(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 3)
    encoder = packing.Encoder(VOCABULARY)
    for _ in range(3):
        for text in ("one two three four five", "one six", "seven eight two", None):
            check_ids([text], encoder)
        assert len(encoder.young) <= 8


def best_fit(lengths, capacity, max_docs, max_cost, weights, rule):
    """One piece after the other, long ones first, each into the best bin there is."""
    scale, weight, bins = np.array([capacity, max_docs, max_cost], float), np.array(weights), []
    for length in sorted(lengths, reverse=True):
        need = np.array([length, 1, length * length], float)
        open_ = [b for b in bins if (b >= need).all()]
        if not open_:
            bins.append(scale - need)
        elif rule == "norm":
            min(open_, key=lambda b: (weight * ((b - need) / scale) ** 2).sum())[:] -= need
        else:
            max(open_, key=lambda b: (weight * (b / scale) * (need / scale)).sum())[:] -= need
    return sorted(tuple(b) for b in bins)


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("limits", [(64, 64, 4096), (64, 5, 4096), (64, 64, 900), (64, 6, 1300), (37, 3, 700)])
def test_bins_of_vector_best_fit(rule, limits):
    """Whichever capacity binds: the same contents as piece by piece, with every piece placed once and none overlapping."""
    capacity, max_docs, max_cost = limits
    for seed in range(12):
        rng = random.Random(seed)
        longest = min(capacity, int(max_cost ** 0.5))
        lengths = [rng.randint(1, longest) for _ in range(rng.randint(0, 120))]
        counted = {n: lengths.count(n) for n in set(lengths)}
        weights = (1.0, 0.013, 0.0107)
        segments, n_bins = packing.plan_bins(counted, capacity, max_docs, max_cost, weights, rule)
        content = [[] for _ in range(n_bins)]
        placed = dict.fromkeys(counted, 0)
        for s in sorted(segments, key=lambda s: (-s.length, s.rank)):
            assert s.rank == placed[s.length]
            following = [t.rank for t in segments if t.length == s.length and t.rank > s.rank]
            n = min(following, default=counted[s.length]) - s.rank
            placed[s.length] += n
            for i in range(n):
                content[s.bin + i // s.each].append((s.offset + i % s.each * s.length, s.length))
        assert placed == counted
        for c in content:
            at = 0
            for offset, length in sorted(c):
                assert offset == at
                at += length
            assert at <= capacity and len(c) <= max_docs and sum(n * n for _, n in c) <= max_cost
        left = sorted((capacity - sum(n for _, n in c), max_docs - len(c), max_cost - sum(n * n for _, n in c)) for c in content)
        assert left == best_fit(lengths, capacity, max_docs, max_cost, weights, rule)

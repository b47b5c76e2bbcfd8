"""Operator 11 against the definition of a run, word by word."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from llm_cases import ROWS, SF
from hypothesis import given, settings
from hypothesis import strategies as st

from pageloom.llm import periodic_runs as pr


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def runs_by_hand(w):
    """(start, length, period): for each period the maximal stretches, kept under their smallest period."""
    found = {}
    for p in range(1, len(w) // 4 + 1):
        i = 0
        while i + p < len(w):
            if w[i] != w[i + p]:
                i += 1
                continue
            start = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            length = i + p - start
            if length >= max(6, 4 * p):
                found.setdefault((start, length), p)
    return sorted((s, n, p) for (s, n), p in found.items())


def collapsed_by_hand(w, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def tail_by_hand(doc_id, w):
    if doc_id is None or not w:
        return w
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return w
    g = h // 10
    a = g % len(w)
    p = 1 + (len(w) - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]


def runs_of(lists):
    codes = np.array([x for w in lists for x in w], np.int64)
    out = [[] for _ in lists]
    for d, *run in zip(*pr.runs_of(codes, np.array([len(w) for w in lists], np.int64)), strict=True):
        out[d].append(tuple(int(v) for v in run))
    return out


def test_cover_holds_every_difference():
    starts, member = pr.cover_starts(), pr.in_cover()
    assert all(member[starts[d]] and member[(starts[d] + d) % pr.V] for d in range(pr.V))


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 4))
def test_extensions_against_plain_comparison(seed, letters):
    rng = np.random.default_rng(seed)
    w = rng.integers(0, letters, rng.integers(0, 300))
    if len(w) > 40:
        w[20:] = np.resize(w[:rng.integers(1, 19)], len(w) - 20)
    extend = pr.Extensions(w)
    if len(w) < 2:
        return
    i = rng.integers(0, len(w) - 1, 200)
    j = i + 1 + rng.integers(0, len(w), 200) % (len(w) - i)
    for a, b, got in zip(i, j, extend(i, j), strict=True):
        n = 0
        while b + n < len(w) and w[a + n] == w[b + n]:
            n += 1
        assert got == n


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 2**32))
def test_runs_against_the_definition(seed):
    rng = random.Random(seed)
    lists = []
    for _ in range(rng.randint(0, 8)):
        w = []
        for _ in range(rng.randint(0, 6)):
            unit = [rng.randint(0, rng.choice([1, 2, 30])) for _ in range(rng.randint(1, rng.choice([2, 9, 40])))]
            stretch = unit * rng.randint(1, 9)
            w += stretch[:len(stretch) - rng.randint(0, min(3, len(stretch)))]
        lists.append(w)
    assert runs_of(lists) == [runs_by_hand(w) for w in lists]


@pytest.mark.parametrize("w", [[0] * 5, [0] * 6, [0, 1] * 4, [0, 1] * 4 + [0], [0, 1, 0], [], [0] * 3000, [0, 1, 1] * 700 + [2] * 9])
def test_small_and_fully_periodic_texts(w):
    assert runs_of([w, [], w]) == [runs_by_hand(w), [], runs_by_hand(w)]


def test_awkward_rows(spark, edge, empty):
    assert pr.periodic_runs(empty).count() == 0
    got = sorted((repr(r.doc_id), r.n_words, [tuple(x) for x in r.runs], r.collapsed_text) for r in pr.periodic_runs(edge).collect())
    want = []
    for r in ROWS:
        w = words_of(r[1])
        # the long text repeats nothing before its 12961st word
        runs = runs_by_hand(w) if len(w) < 5000 else []
        want.append((repr(r[0]), len(w), runs, collapsed_by_hand(w, runs)))
    assert got == sorted(want)


def test_very_long_text(spark):
    text = "start " + "a b c " * 100_000 + "end " + "x " * 50
    row = pr.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [tuple(r) for r in row.runs] == [(1, 300_000, 3), (300_002, 50, 1)] and row.collapsed_text == "start a b c end x"


def test_query_on_the_given_table(spark):
    got = {r.doc_id: r for r in pr.op11_periodic_runs(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    damaged = 0
    for d in docs:
        w = tail_by_hand(d.doc_id, words_of(d.text))
        if len(w) > 3000:
            continue
        damaged += w != words_of(d.text)
        runs = runs_by_hand(w)
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None,) * 3)
        r = got[d.doc_id]
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == sha("".join(f"{s},{n},{p}\n" for s, n, p in runs))
        assert r.collapsed_sha256 == sha(collapsed_by_hand(w, runs))
    assert damaged >= 5

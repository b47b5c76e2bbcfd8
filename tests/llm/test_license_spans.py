"""Operator 9 on texts with very many notices."""

import random
import timeit

import pyarrow as pa
import pytest

from pageloom.llm import license_scan as ls

AUTOMATON, PATTERNS = ls.seeds_of(ls.NOTICES), ls.matchers(ls.NOTICES)


def spans(words):
    return ls.fuzzy_spans(words, ls.NOTICES, AUTOMATON, PATTERNS)


def scan(text):
    batch = pa.record_batch({"doc_id": pa.array([1]), "text": pa.array([text])})
    return next(iter(ls.scan_batches([batch], ls.NOTICES))).to_pylist()[0]


def edited(notice, rng, n):
    chars = list(notice)
    for _ in range(n):
        at = rng.randrange(1, len(chars) - 1)
        while chars[at] == " ":
            at = rng.randrange(1, len(chars) - 1)
        chars[at] = rng.choice("xyz")
    return "".join(chars)


@pytest.mark.parametrize("seed", range(6))
def test_every_notice_of_a_list_is_found(seed):
    """Edited notices one after the other, apart or side by side: a span for each, none over another of its kind."""
    rng = random.Random(seed)
    words, want = "", []
    for _ in range(60):
        i = rng.randrange(len(ls.NOTICES))
        notice, _, k = ls.NOTICES[i]
        words += " ".join(["filler"] * rng.randint(0, 3)) + " "
        words = words.lstrip().replace("  ", " ")
        n = rng.randint(0, k // 2)
        want.append((i, len(words), len(words) + len(notice)))
        words += edited(notice, rng, n) + " "
    found = spans(words.strip())
    for i, a, b in want:
        assert any(j == i and min(b, y) - max(a, x) > 0.7 * (b - a) for j, _, x, y in found), (i, words[a:b])
    for i in {f[0] for f in found}:
        own = sorted((x, y) for j, _, x, y in found if j == i)
        assert all(a[1] <= b[0] for a, b in zip(own, own[1:], strict=False))


def test_the_better_of_overlapping_matches_stays():
    words = "released under the mit licens x released under the mit license tail"
    assert [(e, words[a:b].strip()) for i, e, a, b in spans(words) if ls.NOTICES[i][1] == "mit"] == [
        (1, "released under the mit licens"), (0, "released under the mit license")]


def test_cost_grows_with_the_number_of_notices():
    best = lambda text: min(timeit.repeat(lambda: scan(text), number=1, repeat=3))
    line = "Released under the MIT licence, some words. "
    assert best(line * 1600) < 14 * best(line * 200) + 0.1
    assert best("mit license and " * 20_000) < 1.0
    row = scan("mit license and " * 20_000)
    assert (row["n_base"], row["first_word"], row["last_word"]) == (20_000, 0, 3 * 19_999)


def test_word_numbers():
    row = scan("one two Released under the MIT licence tail, apache license")
    assert [(s["first_word"], s["last_word"], s["matched"]) for s in row["spans"]] == [(2, 6, "released under the mit licence")]
    assert (row["n_base"], row["first_word"], row["last_word"]) == (1, 8, 8)

"""Operator 13 against all edit strings, a plain shortest path, and conversations cut into many partitions."""

import hashlib
import heapq
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import SF
from pyspark.sql import functions as F

from pageloom.llm import conversation_repair as cr

SCHEMA = "conv_id long, turn long, role string, text string, audit string, kind int, part string, pos long, cost string, extra int"
ROLES = ["system", "user", "assistant", "tool"]


def faults_of(rows):
    """rows: (turn, role, text) in order; the first fault of each."""
    seen, out = set(), []
    for _, role, text in rows:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        if not solid:
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        elif solid[-1] not in ".!?":
            out.append("truncated")
        else:
            out.append("")
        seen.add((role, text))
    return out


def simulate(edits, rows, faults):
    """Cost and lines of a string of edits, None where it breaks a rule."""
    cost, lines, at = 0, [], 0
    initials = ""
    for e in edits:
        want = "assistant" if initials.endswith("u") else "user"
        if e == "I":
            cost += 3
            lines.append(want + ":")
            initials += want[0]
            continue
        if at == len(rows):
            return None
        _, role, text = rows[at]
        fault = faults[at]
        at += 1
        if e == "D":
            cost += 4
            continue
        if fault in ("blank", "duplicate"):
            return None
        if e == "R":
            cost += 3
            role = want
        cost += 3 * (fault == "truncated")
        initials += role[:1] or " "
        lines.append(f"{role}:{text}")
    if at < len(rows) or not re.fullmatch(r"(s?(ua)+)?", initials):
        return None
    return cost, lines


def cheapest(rows, faults):
    """Uniform-cost search in the order of (cost, edits)."""
    step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, path, i, q = heapq.heappop(heap)
        if i == len(rows) and q in ("", "a"):
            return cost, path
        if (i, q) in done:
            continue
        done.add((i, q))
        want = "a" if q == "u" else "u"
        heapq.heappush(heap, (cost + 3, path + "I", i, want))
        if i < len(rows):
            heapq.heappush(heap, (cost + 4, path + "D", i + 1, q))
            if faults[i] not in ("blank", "duplicate"):
                more = 3 * (faults[i] == "truncated")
                initial = rows[i][1][:1]
                if initial in step[q]:
                    heapq.heappush(heap, (cost + more, path + "K", i + 1, step[q][initial]))
                heapq.heappush(heap, (cost + 3 + more, path + "R", i + 1, want))


def verdict(rows):
    """All columns but conv_id; rows: (turn, role, text)."""
    fill = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    digest = lambda r: hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()
    fill.sort(key=lambda r: (r[0] is not None, r[0] or 0, digest(r)))
    faults = faults_of(fill)
    cost, audit = cheapest(fill, faults)
    turns = [t for t, _, _ in fill if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(fill, fill[1:], strict=False))
    lines = simulate(audit, fill, faults)[1]
    return (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())


def verdicts(rows):
    groups = defaultdict(list)
    for conv_id, *rest in rows:
        groups[conv_id].append(tuple(rest))
    return {k: verdict(v) for k, v in groups.items()}


def got(df):
    rows = [tuple(r) for r in df.select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()]
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: r[1:] for r in rows}


def random_codes(rng, n):
    return bytes(4 * rng.choice([0, 1, 1, 1, 2, 2, 3]) + rng.choice([0, 0, 0, 0, 1, 2, 3]) for _ in range(n))


def as_rows(codes):
    names = ["", "blank", "duplicate", "truncated"]
    return [(i, "suax"[c // 4], f"t{i}") for i, c in enumerate(codes)], [names[c % 4] for c in codes]


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 2**32))
def test_search_against_all_edit_strings(seed):
    rng = random.Random(seed)
    codes = random_codes(rng, rng.randint(0, 3))
    rows, faults = as_rows(codes)
    best = min((s[0], e) for n in range(8) for e in map("".join, itertools.product("DIKR", repeat=n)) if (s := simulate(e, rows, faults)))
    assert cr.search(codes, cr.START, None) == best


@settings(max_examples=120, deadline=None)
@given(st.integers(0, 2**32))
def test_search_and_segments_against_a_plain_shortest_path(seed):
    rng = random.Random(seed)
    codes = random_codes(rng, rng.randint(0, 90))
    rows, faults = as_rows(codes)
    assert cr.repair(codes, cr.Paths()) == cheapest(rows, faults)
    if len(codes) <= 30:
        assert cr.search(codes, cr.START, None) == cheapest(rows, faults)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32))
def test_stretches_fold_to_the_whole(seed):
    """A conversation cut at arbitrary places costs and reads the same."""
    rng = random.Random(seed)
    codes = random_codes(rng, rng.randint(1, 80))
    cuts = sorted({0, len(codes), *(rng.randint(0, len(codes)) for _ in range(5))})
    paths = cr.Paths()
    pieces = [codes[a:b] for a, b in itertools.pairwise(cuts)]
    empty = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0) | {"low": None, "high": None, "first_initial": 1, "last_initial": 2}
    stretches = [empty | {"pos": k, "matrix": [v for r in cr.matrix_of(p, paths) for c in r for v in c]} for k, p in enumerate(pieces)]
    ways = list(cr.fold(stretches))
    audit = "".join(cr.trace(p, w["enter"], w["leave"], paths) + w["tail"] for p, w in zip(pieces, ways, strict=True))
    assert (sum(w["cost"] for w in ways), audit) == cr.repair(codes, paths) == cheapest(*as_rows(codes))


def conversation(rng, n):
    text = lambda: rng.choice(["Yes.", "No!", "Well?", "cut off", "", "  \n", "Same words.", None, f"Text {rng.randint(0, 50)}."])
    return [(rng.choice([None, rng.randint(-3, n + 5)]) if rng.random() < 0.2 else i, rng.choice([*ROLES, "user", "assistant", None, ""]), text())
            for i in range(n)]


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "a", 5, "p", 1, "c", 2) for r in rows], SCHEMA).repartition(parts)


def test_awkward_conversations(spark):
    rng = random.Random(3)
    rows = [(c, *r) for c in [None, *range(40)] for r in conversation(rng, rng.randint(1, 12))]
    rows += [(100, None, None, None)] * 3 + [(101, 2**63 - 1, "user", "a."), (101, -(2**63), "assistant", "b.")] + [(102, 0, "user", "Long. " * 200_000)]
    want = verdicts(rows)
    want[101] = (2**63 - 1, *want[101][1:])
    assert got(cr.repair_conversations(frame(spark, rows))) == want


def test_empty_tables_and_ids_without_rows(spark):
    none = frame(spark, [])
    assert cr.repair_conversations(none).count() == 0 and cr.repaired_rows(none).count() == 0
    every = spark.createDataFrame([(1,), (1,), (None,)], "conv_id long")
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got(cr.repair_conversations(none, every)) == {1: nothing, None: nothing}


@pytest.mark.parametrize("range_rows", [7, 40])
def test_a_conversation_over_many_partitions(spark, monkeypatch, range_rows):
    """A conversation with most of the rows and one of repeated rows only, cut by the ends of range partitions."""
    monkeypatch.setattr(cr, "RANGE_ROWS", range_rows)
    rng = random.Random(range_rows)
    rows = [(5, *r) for r in conversation(rng, 400)] + [(6, 1, "user", "Same.")] * 60
    rows += [(c, *r) for c in range(7, 40) for r in conversation(rng, rng.randint(1, 6))]
    assert got(cr.repair_conversations(frame(spark, rows))) == verdicts(rows)


def test_repaired_rows(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Hi."), (1, 2, "tool", "So."), (1, 3, "user", "Bye.")]
    out = [tuple(r) for r in cr.repaired_rows(frame(spark, rows)).orderBy("place").collect()]
    assert out == [(1, 0, 0, "K", "user", "Hi."), (1, 1, 2, "R", "assistant", "So."), (1, 2, 3, "K", "user", "Bye."), (1, 3, None, "I", "assistant", "")]


def damage_by_hand(rows):
    out = []
    for conv_id, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        kind = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv_id, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def test_query_on_the_given_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = verdicts(damage_by_hand(rows))
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got(cr.op13_conversation_repair(spark, SF)) == {c: want.get(c, nothing) for c, *_ in rows}


def test_damage_of_nulls(spark):
    rows = [(None, t, r, x) for t in [None, *range(25)] for r, x in [(None, "a. b!"), ("system", None)]]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sorted(map(repr, (tuple(r) for r in cr.damaged(df).collect()))) == sorted(map(repr, damage_by_hand(rows)))
    assert cr.damaged(df).filter(F.col("text").isNull()).count() == 0

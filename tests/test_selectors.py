"""The compiled matcher against a plain reading of each selector, and the nodes it names."""

import os
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark import cloudpickle
from pyspark.sql import functions as F

from pageloom.operators.marks import marks_of
from pageloom.operators.selectors import Matcher, Nodes, alternatives_of, hit_places, needs_scope
from pageloom.operators.tree import Tree, known_hits
from pageloom.operators.units import split_text
from pageloom.sources.html import ARROW_NODE, parse_nodes, parse_page
from pageloom.streaming.captures import TabCaptures

SELECTORS = [
    "p", "*", ".a", "#i", "div p", "div > p", "p + p", "div .a > b", ".a .b, p.b", "[href]", '[href="x"]', '[href*="x"]', '[href^="x"]', '[href$="y"]', '[href*=""]',
    "p:first-child", "p:last-child", "li:nth-child(2)", "ul > li + li b", "body div div", "p:unknown", "div > .a + .b p", 'b, i[class~="no"]',
]
PARTS = st.sampled_from([
    "<div>", "</div>", "<p>", "</p>", '<p class="a b">', '<b class="b">', "</b>", '<div class="a" id="i">', "<ul>", "<li>", "</ul>", '<a href="x">', '<a href="zxy">', "</a>",
    "t", "<i>", "</i>",
])


def holds(nodes, n, test):
    attrs, kind = dict(n["attrs"]), test[0]
    if kind == "tag":
        return test[1] in ("*", n["tag"])
    if kind == "class":
        return test[1] in n["classes"]
    if kind.endswith("child"):
        return {"first-child": n["sib_pos"] == 1, "last-child": n["sib_last"], "nth-child": n["sib_pos"] == int(test[1] or 0)}[kind]
    value = attrs.get(test[1])
    if value is None or kind == "has":
        return value is not None
    return {"=": value == test[2], "*=": test[2] in value, "^=": value.startswith(test[2]), "$=": value.endswith(test[2])}[kind] and (kind == "=" or test[2] != "")


def matches(nodes, n, chain):
    comb, tests = chain[-1]
    if not all(holds(nodes, n, t) for t in tests):
        return False
    if len(chain) == 1:
        return True
    if comb == " ":
        return any(matches(nodes, nodes[i], chain[:-1]) for i in n["path"])
    near = n["parent_id"] if comb == ">" else n["prev_id"]
    return near >= 0 and matches(nodes, nodes[near], chain[:-1])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(PARTS, max_size=40), min_size=1, max_size=4))
def test_matcher_against_a_plain_reading(pages):
    parsed = [parse_page("".join(p))[0] for p in pages]
    nodes = Nodes(pa.array(parsed, pa.list_(ARROW_NODE)))
    found = Matcher(SELECTORS)(nodes)
    flat = [(page, n) for page in parsed for n in page]
    for s in SELECTORS:
        assert found[s].tolist() == [any(matches(page, n, c) for c in alternatives_of(s)) for page, n in flat], s


@settings(max_examples=60, deadline=None)
@given(st.lists(PARTS, max_size=50), st.integers(0, 2**32))
def test_nearest_and_outermost(parts, seed):
    page = parse_page("".join(parts))[0]
    nodes = Nodes(pa.array([page, page], pa.list_(ARROW_NODE)))
    mask = np.random.default_rng(seed).random(nodes.n) < 0.3
    near, top, below = nodes.nearest(mask), nodes.outermost_above(mask), nodes.below(mask)
    for k in range(nodes.n):
        base = len(page) if k >= len(page) else 0
        line = [base + i for i in page[k - base]["path"]]
        marked = [i for i in line if mask[i]]
        assert below[k] == bool(marked) and top[k] == (marked[0] if marked else nodes.n)
        assert near[k] == (k if mask[k] else marked[-1] if marked else nodes.n)


@pytest.mark.parametrize("asked", [SELECTORS, [f"p.c{i}" for i in range(130)] + ["p"]])
def test_bits_on_nodes(spark, asked):
    """Bits from the parser and the column form agree; other lists of selectors are not known."""
    html = '<div class="a"><p class="a b">1<p class="b">2<ul><li>x<li><b>y</b></ul><a href="xy">z</a></div>'
    pages = spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")
    parsed = parse_nodes(pages, [*asked, ":scope > p"])
    places = known_hits(parsed, list(dict.fromkeys(asked)))
    assert set(places) == set(asked) and needs_scope(":scope > p") and not known_hits(parsed, ["p"])
    fast, slow = Tree(F.col("nodes"), F.col("texts"), hits=places), Tree(F.col("nodes"), F.col("texts"))
    some = asked if len(asked) < 40 else ["p", "p.c0", "p.c129"]
    counts = [F.size(F.filter("nodes", t.matching(s))) for s in some for t in (fast, slow)]
    for row in parsed.select(*counts).collect():
        assert list(row)[::2] == list(row)[1::2]
    assert len({f for f, _ in hit_places(asked).values()}) == -(-len(asked) // 62)


def test_kernels_load_where_the_package_is_missing(tmp_path):
    kernels = [Matcher(["ul > .a"]), marks_of, parse_page, split_text, TabCaptures(1)]
    (tmp_path / "kernels").write_bytes(cloudpickle.dumps(kernels))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", "import pickle; pickle.load(open('kernels', 'rb'))"], cwd=tmp_path, env=env, check=True)

"""The merge of two extractions against a plain loop, and its plan."""

import random

from pyspark.sql import functions as F

from pageloom.operators.blocks import make_block
from pageloom.operators.merge import HIGH_RISK, REPLACEABLE, merge_extractions

SCHEMA = "article_id string, block_pos int, block_id string, t string, s string, role string"


def frame(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    block = make_block("?", text=F.col("s"), role=F.col("role")).withField("type", F.col("t"))
    return df.select("article_id", "block_pos", "block_id", block.alias("block"))


def by_hand(left, right):
    """Blocks (id, type, text, role) and the four counts. Blocks: (id, type, text, role)."""
    if not left:
        return [(r[0], r[1], r[2], r[3]) for r in right], (0, 0, 0, 0)
    cursor, out, n = 0, [], [0, 0, 0, 0]
    for block_id, t, s, role in left:
        if t not in REPLACEABLE:
            n[2] += t in HIGH_RISK
            n[3] += t == "link"
            out.append((block_id, t, s, role))
            continue
        hit = next((i for i in range(cursor, len(right)) if right[i][1] == t and (t == "divider" or right[i][2] == s)), None)
        if hit is None:
            n[1] += 1
            out.append((block_id, t, s, role))
            continue
        out += [r for r in right[cursor:hit] if r[1] == "divider"]
        cursor = hit + 1
        n[0] += 1
        new = right[hit]
        caption = t == "paragraph" and "caption" in (role, new[3])
        out.append((block_id, t, new[2], "caption" if caption else new[3]))
    return out + [r for r in right[cursor:] if r[1] == "divider"], tuple(n)


def test_merge_against_a_plain_loop(spark):
    rng = random.Random(11)
    sides = {}
    for a in range(40):
        def some(name):
            kinds = [(t, rng.choice("xyz") if t != "divider" else None) for t in rng.choices(
                ["paragraph", "quote", "divider", "video", "gif", "link"], [5, 2, 3, 1, 1, 1], k=rng.randint(0, 14))]
            return [(f"{name}{i}", t, s, rng.choice([None, None, "caption"]) if t == "paragraph" else None) for i, (t, s) in enumerate(kinds)]

        sides[f"a{a:02}"] = some("p"), [b for b in some("c") if b[1] not in ("video", "gif", "link")]
    rows = lambda k: [(a, i, *b) for a, s in sides.items() for i, b in enumerate(s[k])]
    merged, stats = merge_extractions(frame(spark, rows(0)), frame(spark, rows(1)))
    got = {}
    for r in merged.orderBy("article_id", "order").collect():
        got.setdefault(r.article_id, []).append((r.block_id, r.block.type, r.block.text, r.block.role))
    counts = {r.article_id: (r.replaced, r.fallback, r.high_risk, r.primary_only) for r in stats.collect()}
    want = {a: by_hand(*s) for a, s in sides.items() if s[0] or s[1]}
    assert got == {a: w[0] for a, w in want.items()} and counts == {a: w[1] for a, w in want.items()}


def test_merge_plan(spark):
    """Columns only, and one exchange per side."""
    one = frame(spark, [("a", 0, "p0", "paragraph", "x", None)])
    merged, _ = merge_extractions(one, one)
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert plan.count("Exchange hashpartitioning(article_id") == 2

"""Splitter goldens and properties, runs, clipping, navigation."""

import random
import timeit

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pageloom.operators import units as un


def split(text, **kw):
    return [text[a:b] for a, b in un.split_text(text, **kw)]


def test_goldens():
    two = "一个下午。代码不到40行。"
    assert split(two) == [two]
    assert split(two, limit=10) == ["一个下午。", "代码不到40行。"]
    for whole in ("V3.2-Exp 达到 93.3%，快 5.76 倍", "192.168.1.1、10.0.0.1:8080 和 192.168.0.0/24",
                  "放在 ~/.claude/skills/ 里", "txt .pdf .docx .html .js"):
        assert all(part in whole for part in split(whole, limit=1))
    assert any("192.168.0.0/24" in u for u in split("见 192.168.1.1、10.0.0.1:8080 和 192.168.0.0/24 这些。", limit=1))
    assert any("~/.claude/skills/" in u for u in split("放在 ~/.claude/skills/ 里。好。", limit=1))
    tail = "再坚持一下。 。 😊 然后走。"
    assert split(tail, limit=1) == ["再坚持一下。 。 😊", "然后走。"]
    english = "The first sentence is long enough to fill a line of its own here. The second one follows it closely after."
    assert split(english) == [
        "The first sentence is long enough to fill a line of its own here.", "The second one follows it closely after."]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab1 .,;:!?。，；（）()[]'\"😀/~", max_size=200))
def test_units_are_ordered_slices(raw):
    text = un._SPACES.sub(" ", raw).strip(" ")
    spans = un.split_text(text) if text else []
    assert all(a < b for a, b in spans)
    assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
    assert "".join(text[a:b] for a, b in spans).replace(" ", "") == text.replace(" ", "")


def test_open_brackets_cost_their_length():
    def best(n):
        text = "(" * n + " [【" * n + "a. " * n
        return min(timeit.repeat(lambda: un.split_text(text), number=1, repeat=3))

    assert best(40_000) < 12 * best(5_000) + 0.2
    opened = "(" * 80_000
    assert un._protected(opened) == ([], []) and timeit.timeit(lambda: un._protected(opened), number=1) < 0.1
    assert list(un._bracketed("(a (b) c) d ( e", "()")) == [(0, 6)]


def test_width_matches_column(spark):
    from pageloom.functions.text import text_width
    samples = ["a b,c", "你好，世界 abc", "カタカナ。한국어!", "é😀 x"]
    rows = spark.createDataFrame([(s,) for s in samples], "t string").select("t", text_width(F.col("t")).alias("w")).collect()
    assert all(r.w == un.default_width(r.t) for r in rows)


def test_build_units(spark):
    blocks = spark.createDataFrame(
        [(1, 0, "b0", "heading", "H", None), (1, 1, "b1", "paragraph", "One. " * 30, None), (1, 2, "b2", "divider", None, None),
         (1, 3, "b3", "list", None, [("x",), ("y",)]), (1, 4, "b4", "paragraph", "a\nb", None), (1, 5, "b5", "image", None, None)],
        "page_id long, block_pos int, block_id string, type string, text string, items array<struct<text:string>>")
    units = un.index_units(un.build_units(blocks)).orderBy("unit_index").collect()
    ids = [u.unit_id for u in units]
    assert ids[0] == "b0-block" and ids[-1] == "b5-block" and "b4-u1" in ids and ids.count("b3-item-1") == 1
    assert "b1-u2" in ids and not any(i.startswith("b2") for i in ids)
    assert [u.unit_index for u in units] == list(range(len(units)))


def test_clip_matches_brute_force(spark):
    rnd = random.Random(7)
    units, ranges, cut = [], [], 0
    for k in range(60):
        end = cut + rnd.randint(1, 400)
        units.append((1, "b", f"u{k}", cut, end))
        cut = end + rnd.randint(0, 2)
    for k in range(80):
        a = rnd.randint(0, cut)
        ranges.append((1, "b", a, a + rnd.randint(0, 900), f"h{k}"))
    want = sorted((u[2], r[4], max(u[3], r[2]), min(u[4], r[3])) for u in units for r in ranges if r[3] > u[3] and r[2] < u[4] and min(u[4], r[3]) > max(u[3], r[2]))
    u = spark.createDataFrame(units, "page_id long, block_id string, unit_id string, start int, end int")
    r = spark.createDataFrame(ranges, "page_id long, block_id string, start int, end int, href string")
    got = sorted((x.unit_id, x.href, x.start, x.end) for x in un.clip_annotations(u, r).collect())
    assert got == want


def test_runs_join_to_text(spark):
    kind = "t string, r array<struct<start:int,end:int,href:string,bold:boolean>>"
    df = spark.createDataFrame([("hello world", [(6, 11, "/w", True), (0, 5, None, True), (3, 8, "/skip", False)]), ("plain", [])], kind)
    rows = df.select("t", un.text_runs(F.col("t"), F.col("r")).alias("runs")).collect()
    assert [[x.text for x in r.runs] for r in rows] == [["hello", " ", "world"], ["plain"]]
    assert all("".join(x.text for x in r.runs) == r.t for r in rows)


def test_navigation_matches_replay(spark):
    rnd = random.Random(3)
    kinds = ["next", "previous", "first", "last", "set"]
    log = [(rnd.randint(1, 3), 1, f"2024-01-0{rnd.randint(1, 5)} 0{rnd.randint(0, 9)}:00:00", i, rnd.choice(kinds), rnd.randint(-3, 12)) for i in range(300)]
    moves = spark.createDataFrame(log, "reader_id int, article_id int, ts string, seq int, move string, target int").withColumn("ts", F.col("ts").cast("timestamp"))
    units = spark.createDataFrame([(1, 7), (2, 0)], "article_id int, n_units int")
    want = {}
    for reader, _, _, _, move, target in sorted(log, key=lambda m: (m[2], m[3])):
        at = want.get(reader, 0)
        at = {"next": at + 1, "previous": at - 1, "first": 0, "last": 6, "set": target}[move]
        want[reader] = max(0, min(6, at))
    for width in (3600, 86_400, 10_000_000):
        got = {r.reader_id: r.position for r in un.replay_navigation(moves, units, width).collect()}
        assert got == want


def test_table_functions(spark):
    from pageloom.functions.udtf import register_table_functions
    register_table_functions(spark)
    assert [r.tag for r in spark.sql("select * from parse_nodes('<ul><li>a<li>b</ul>')").collect()] == ["html", "head", "body", "ul", "li", "li"]
    docs = spark.createDataFrame([(1, "One. Two.")], "id int, body string")
    docs.createOrReplaceTempView("docs_for_units")
    rows = spark.sql("select d.id, u.text from docs_for_units d, lateral split_units(d.body) u").collect()
    assert [(r.id, r.text) for r in rows] == [(1, "One. Two.")]


def test_text_without_ranges_is_one_plain_run(spark):
    df = spark.createDataFrame([("abc",), ("",)], "text string")
    none = F.lit(None).cast("array<struct<start:int,end:int,href:string,bold:boolean>>")
    assert [[(r.text, r.annotated) for r in row.runs] for row in df.select(un.text_runs(F.col("text"), none).alias("runs")).collect()] == [[("abc", False)], []]


def test_split_texts_is_called_per_group_of_documents(spark, tmp_path):
    from pageloom.plans.unit_queries import f4_split_texts

    spark.createDataFrame([(i, f"a b{i}" if i % 3 else None) for i in range(130)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = f4_split_texts(spark, str(tmp_path))
    assert "div 64" in found._jdf.queryExecution().executedPlan().toString()
    assert {(r.doc_id, r.n_solid) for r in found.collect()} == {(i, 2 + len(str(i))) for i in range(130) if i % 3}

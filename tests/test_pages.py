"""Parser, selectors, routing, blocks and articles on small pages."""

from dataclasses import replace

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pageloom.operators.blocks import make_block
from pageloom.operators.merge import merge_extractions
from pageloom.operators.routing import best_route, route, route_pages
from pageloom.operators.tree import parse_selector, select
from pageloom.plans.extract import blocks_of, extract, pages_of
from pageloom.sources.adapters import BUILT_IN, CORPUS, EXAMPLE_ARTICLE, SUBSTACK_ARTICLE, X_ARTICLE, adapters_df
from pageloom.sources.html import _parse_batches, parse_nodes, parse_page

TAGS = st.sampled_from(["<p>", "</p>", "<b>", "</b>", "<div>", "</div>", "<ul>", "<li>", "</ul>", "<br>", "text", "<table>", "<tr>", "<td>", "</table>", "<!-- c -->", "<img src=x>"])


@settings(max_examples=200, deadline=None)
@given(st.lists(TAGS, max_size=60))
def test_intervals_nest(parts):
    nodes, texts, owners = parse_page("".join(parts))
    for i, n in enumerate(nodes):
        assert n["node_id"] == i <= n["end_id"] < len(nodes)
        for a in n["path"]:
            assert a < i and nodes[a]["end_id"] >= n["end_id"]
        assert n["parent_id"] == (n["path"][-1] if n["path"] else -1)
    assert len(texts) == len(owners)


def test_parser_rules():
    tags = lambda h: [n["tag"] for n in parse_page(h)[0]]
    assert tags('<script>var t="</p>";</script><p>x') == ["html", "head", "script", "body", "p"]
    nodes, texts, _ = parse_page('<p>a<p>b &amp; c</p><a title="1>2" HREF=x>l</a>')
    assert [n["parent_id"] for n in nodes] == [-1, 0, 0, 2, 2, 2] and texts == ["a", "b & c", "l"]
    assert dict(nodes[5]["attrs"]) == {"title": "1>2", "href": "x"}
    deep, _, _ = parse_page("<div>" * 2000)
    assert max(n["depth"] for n in deep) == 511


def test_references_without_semicolon():
    _, texts, _ = parse_page("<title>a &amp;&amp</title><h1>b&amp</h1><p>c&am</p>")
    assert texts == ["a &&", "b&", "c&am"]


def test_few_pages_are_held_at_a_time():
    batch = pa.record_batch({"page_id": list(range(150)), "html": [f"<p>{i}" for i in range(150)]})
    parts = list(_parse_batches(iter([batch, batch.slice(0, 0)]), []))
    assert [p.num_rows for p in parts] == [64, 64, 22]
    assert [(r["page_id"], r["texts"]) for p in parts for r in p.to_pylist()] == [(i, [str(i)]) for i in range(150)]


def shape(source):
    """Elements with their own texts, nested as brackets."""
    nodes, texts, owners = parse_page(source)
    own = [[t for t, o in zip(texts, owners, strict=True) if o == n["node_id"]] for n in nodes]

    def draw(i):
        return nodes[i]["tag"] + "".join(own[i]) + "".join(f"[{draw(n['node_id'])}]" for n in nodes if n["parent_id"] == i)
    return draw(0).removeprefix("html[head][body").removesuffix("]") if nodes else ""


@pytest.mark.parametrize("source, want", [
    ("hello <p>x</p> tail", "hello  tail[p[x]".replace("[p[x]", "[px]")),
    ("<p><b>a<br><p>b", "[p[ba[br]]][p[bb]]"),
    ("<p><b>1<p><b>2<p><b>3<p><b>4<p>5", "[p[b1]][p[b[b2]]][p[b[b[b3]]]][p[b[b[b[b4]]]]][p[b[b[b5]]]]"),
    ("<b>x<i>y</b>z</i>w", "w[bx[iy]][iz]"),
    ("<table><tr><td><b>x<td>y</table>z", "z[table[tbody[tr[td[bx]][tdy]]]]"),
    ("<p>a</body> b</html>", "[pa b]"),
    ("<b><p>x</b>y</p>", "[b][p" + "y[bx]]"),
    ("<p>1<b>2<i>3</b>4</i>5</p>", "[p15[b2[i3]][i4]]"),
    ("<b>1<p>2</b>3</p>", "[b1][p3[b2]]"),
    ("<b><em><p>1</b>2</em>3", "3[b[em]][em][p[em2[b1]]]".replace("3[b", "[b").replace("[p[", "[p3[")),
    ("<font><p>hello<b>cruel</font>world", "[font][p[fonthello[bcruel]][bworld]]"),
    ("<div><a><b><u><i><code><div></a>", "[div[a[b[u[i[code]]]]][u[i[code[div[a]]]]]]"),
    ("<a>x<div>y<a>z", "[ax][div[ay][az]]"),
    ("<b><button>foo</b>bar</button>", "[b][buttonbar[bfoo]]"),
    ("<table>x<tr>", "x[table[tbody[tr]]]"),
    ("<table><b><tr><td>aaa</td></tr>bbb</table>ccc", "[b][bbbb][table[tbody[tr[tdaaa]]]][bccc]"),
    ("<table><a>1<p>2</a>3</p>", "[a1][p3[a2]][table]"),
    ("<table><td>1<td>2<tr><td>3</table>", "[table[tbody[tr[td1][td2]][tr[td3]]]]"),
    ("<table><caption>c<tr><td>x</table>", "[table[captionc][tbody[tr[tdx]]]]"),
    ("<table><col><col><tbody><tr><th>h</table>", "[table[colgroup[col][col]][tbody[tr[thh]]]]"),
    ("<table><tr><td><table><td>x</table>y</table>z", "z[table[tbody[tr[tdy[table[tbody[tr[tdx]]]]]]]]"),
    ("<p>a<table><td>x</table>b", "b[pa][table[tbody[tr[tdx]]]]"),
    ("<tr><td>x", "x"),
    ("<h1>a<h2>b</h1>c", "c[h1a][h2b]"),
    ("<dl><dt>a<dd>b<dt>c</dl>", "[dl[dta][ddb][dtc]]"),
    ("</p>x", "x[p]"),
    ("<pre>\n x</pre>", "[pre x]"),
    ("<a href=1>x<a href=2>y", "[ax][ay]"),
    ("<p>a<b>b</p>c</b>d", "d[pa[bb]][bc]"),
])
def test_formatting_goes_on_and_no_text_is_lost(source, want):
    assert shape(source) == want


PAGE = '<main id="m"><div class="a b"><p>1</p><p data-k="xyz">2</p></div><ul><li><a href="/p/1">x</a></li><li>y</li></ul></main>'


@pytest.mark.parametrize("selector, n", [
    ("p", 2), (".a > p", 2), ("#m p", 2), ("div + ul", 1), ('[data-k*="y"]', 1), ('[data-k^="y"]', 0), ("li:first-child a", 1),
    ("li:last-child", 1), ("li:nth-child(2)", 1), ('a[href*="/p/"], p', 3), (".a.b", 1), ("p:hover", 0), ("main > p", 0),
])
def test_selectors(spark, selector, n):
    df = parse_nodes(spark.createDataFrame([(1, PAGE)], "page_id long, html string"))
    assert select(df, selector).count() == n


def test_bad_selector_is_an_error_to_the_parser():
    with pytest.raises(ValueError):
        parse_selector("p:hover")


def test_routing(spark):
    cases = [
        ("https://substack.com/inbox/post/203490377", "substack.article"), ("https://substack.com/home/post/p-199574024", "substack.article"),
        ("https://substack.com/p/test", None), ("https://www.latent.space/p/test", None), ("https://latent.space/p/test", None),
        ("https://x.com/example/article/123456789", "x.article"), ("https://m.x.com/a/status/1", "x.article"),
        ("https://x.com.evil.io/a/status/1", None), ("https://fixture.local/article/1", "fixture.article"), ("not a url", None),
    ]
    df = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(cases)], "page_id long, url string")
    want = {i: a for i, (_, a) in enumerate(cases) if a}
    assert {r.page_id: r.adapter_id for r in best_route(route_pages(df, BUILT_IN)).collect()} == want
    assert {r.page_id: r.adapter_id for r in route(df, BUILT_IN).collect()} == want
    off = [replace(a, enabled=False) for a in BUILT_IN]
    assert route_pages(df, off).count() == 0 and route_pages(df, off, respect_enabled=False).count() == len(want)
    assert adapters_df(spark, CORPUS).count() == 4


GENERIC = replace(
    EXAMPLE_ARTICLE, id="generic.article", hosts=["generic.test"], url_patterns=[], root_selector="[data-article-root]",
    title_selector="[data-title]", content_selector="[data-content]", remove=["script", ".ad"], required=[], min_blocks=None, min_text=None,
    validation={"title": "required"}, semantic={}, preserve=["width", "height"],
)
STANDARD = """<html><head><title>Doc title</title></head><body><article data-article-root><h1 data-title>T</h1><section data-content>
<p>Alpha <a href="/l">link</a> and <strong>bold</strong>.</p><h3>Three</h3><hr><blockquote>Q</blockquote>
<ol><li>1. first</li><li>second</li></ol><ul><li>u</li></ul>
<p class="ad">noise</p><script>x</script>
<a href="/img"><picture><source srcset="s1.png 1x"><img data-src="lazy.png" width="1600" height="900" alt="A"></picture></a>
<pre><code class="language-js">const a = 1;
</code></pre>
<table><tr><th>h1</th><th>h2</th></tr><tr><td>1</td><td>2</td></tr></table>
<figure><img src="g1.png"><img src="g2.png"><img src="g1.png"><figcaption>Cap</figcaption></figure>
<iframe src="https://www.youtube.com/embed/1" data-poster="p.png"></iframe>
</section></article></body></html>"""


@pytest.fixture(scope="module")
def standard(spark):
    pages = spark.createDataFrame([
        (1, "https://generic.test/1", STANDARD), (2, "https://generic.test/2", "<p>nothing</p>"),
        (3, "https://generic.test/3", '<head><meta property="og:title" content="Og"></head><article data-article-root><section data-content><p>x</p></section></article>'),
    ], "page_id long, url string, html string")
    rows = extract(pages, [GENERIC])
    return blocks_of(rows).orderBy("page_id", "block_pos").collect(), {r.page_id: r for r in pages_of_with_id(rows)}


def pages_of_with_id(rows):
    return rows.filter("block_pos < 0").select("page_id", "page.*").collect()


def test_standard_blocks(standard):
    blocks = [b for b in standard[0] if b.page_id == 1]
    assert [b.type for b in blocks] == [
        "paragraph", "heading", "divider", "quote", "list", "list", "image", "code", "table", "image-gallery", "paragraph", "embed"]
    by = {b.type: b for b in blocks}
    p = blocks[0]
    assert p.text == "Alpha link and bold." and [(r.start, r.end, r.href, r.bold) for r in p.annotations] == [(6, 10, "/l", False), (15, 19, None, True)]
    assert by["heading"].level == 3 and by["quote"].text == "Q"
    ordered, unordered = [b for b in blocks if b.type == "list"]
    assert (ordered.kind, [i.text for i in ordered["items"]]) == ("ordered", ["first", "second"])
    assert (unordered.kind, [i.text for i in unordered["items"]]) == ("unordered", ["u"])
    image = by["image"].image
    assert (image.src, image.srcset, image.href, image.aspect_ratio, image.alt) == ("lazy.png", "s1.png 1x", "/img", 1.7778, "A")
    assert by["code"].text == "const a = 1;" and by["code"].code.language == "js"
    assert [[c.text for c in row] for row in by["table"].table.rows] == [["h1", "h2"], ["1", "2"]] and by["table"].table.rows[0][0].header
    assert [i.src for i in by["image-gallery"].gallery["items"]] == ["g1.png", "g2.png"]
    assert blocks[-2].text == "Cap" and blocks[-2].role == "caption"
    embed = by["embed"].embed
    assert (embed.provider, embed.label, embed.media[0].src) == ("youtube", "YouTube", "p.png")
    assert [b.block_id for b in blocks] == [f"generic.article:clean-block-{i}" for i in range(len(blocks))]


def test_page_states(standard):
    _, pages = standard
    assert pages[1].title == "T" and pages[1].not_ready is None
    assert pages[2].not_ready == "missing_article_root"
    assert pages[3].title == "Og"
    assert pages[1].clean_stats.removed_nodes == 2


def test_nested_option(spark):
    page = '<article data-article-root><h1 data-title>T</h1><section data-content><blockquote><p>in</p></blockquote><p>out</p></section></article>'
    df = spark.createDataFrame([(1, "https://generic.test/1", page)], "page_id long, url string, html string")
    kinds = lambda nested: [b.type for b in blocks_of(extract(df, [GENERIC], nested=nested)).orderBy("block_pos").collect()]
    assert kinds("keep") == ["quote", "paragraph", "paragraph"]
    assert kinds("outermost") == ["quote", "paragraph"]


def loose(a):
    return replace(a, min_blocks=None, min_text=None, required=[], validation=None)


POST = """<div data-testid="twitterArticleReadView"><div data-testid="twitter-article-title">X title</div>
<div data-testid="longformRichTextComponent"><div data-block="true" class="longform-header-one"><span data-text="true">Head</span></div>
<div data-block="true"><span data-text="true">1. typed</span></div>
<div data-block="true"><div data-testid="simpleTweet"><div data-testid="tweet"><div data-testid="User-Name"><span>Ann</span><span>@ann</span></div>
<time datetime="2024-01-05">Jan 5</time><a href="/ann/status/9">s</a><div data-testid="tweetText">Body</div>
<div data-testid="tweetPhoto"><img src="https://pbs.twimg.com/media/1"></div><div data-testid="tweetPhoto"><img src="https://pbs.twimg.com/media/2"></div>
<div role="link"><div data-testid="User-Name"><span>Bob</span></div><div data-testid="tweetText">Quoted</div></div></div></div></div>
</div></div>"""
NEWS = """<article class="newsletter-post post-viewer-post"><div><a href="/p/t">News title</a></div><div class="available-content"><div class="body markup">
<p>Text</p>
<a data-component-name="Twitter2ToDOM" data-attrs='{"full_text":"said","username":"@a","like_count":1,"date":"2024-01-05T16:05:00Z"}' href="https://x.com/a/status/1">t</a>
<div data-component-name="FootnoteToDOM"><a class="footnote-number">2</a><div class="footnote-content">see <em>this</em></div></div>
<div data-component-name="VideoEmbedPlayer"><video src="blob:x" poster="/p.png"></video></div>
<div data-component-name="SubscribeWidget"><button data-href="https://s.test/join">Join</button></div>
</div></div></article>"""


def test_site_components(spark):
    df = spark.createDataFrame([
        (1, "https://x.com/a/article/1", POST), (2, "https://substack.com/inbox/post/1", NEWS)], "page_id long, url string, html string")
    blocks = blocks_of(extract(df, [loose(X_ARTICLE), loose(SUBSTACK_ARTICLE)])).orderBy("page_id", "block_pos").collect()
    post, news = [b for b in blocks if b.page_id == 1], [b for b in blocks if b.page_id == 2]
    assert [b.type for b in post] == ["heading", "list", "simple-tweet"] and post[0].level == 1 and post[1]["items"][0].text == "typed"
    card = post[2].tweet
    assert (card.title, card.excerpt, card.href) == ("Ann · @ann · Jan 5", "Body", "https://x.com/ann/status/9")
    assert [i.type for i in card["items"]] == ["text", "photo-group", "quoted-tweet"]
    assert card["items"][2].quoted.excerpt == "Quoted" and len(card["items"][1].photos) == 2
    assert [b.type for b in news] == ["paragraph", "embed", "paragraph", "embed", "embed"]
    said = news[1].embed
    assert (said.text, said.author_handle, said.metrics.likes, said.published_at_text) == ("said", "@a", "1 Like", "12:05 AM · Jan 6, 2024")
    assert news[2].text == "Footnote 2: see this" and (news[2].annotations[0].start, news[2].annotations[0].end) == (16, 20)
    assert news[3].embed.media[0].src == "https://substack.com/p.png"
    assert (news[4].embed.presentation, news[4].embed.href, news[4].text) == ("cta", "https://s.test/join", "Join")


def test_merge(spark):
    def blocks(rows):
        df = spark.createDataFrame([("a", i, f"x{i}", t, s) for i, (t, s) in enumerate(rows)], "article_id string, block_pos int, block_id string, t string, s string")
        block = make_block("?", text=F.col("s")).withField("type", F.col("t"))
        return df.select("article_id", "block_pos", "block_id", block.alias("block"))

    merged, stats = merge_extractions(
        blocks([("paragraph", "one"), ("video", None), ("gif", None), ("link", "l"), ("quote", "lost"), ("paragraph", "three")]),
        blocks([("paragraph", "one"), ("divider", None), ("paragraph", "three"), ("divider", None)]))
    s = stats.first()
    assert (s.replaced, s.fallback, s.high_risk, s.primary_only) == (2, 1, 2, 1)
    alone, zeros = merge_extractions(blocks([("paragraph", "x")]).filter("false"), blocks([("paragraph", "one"), ("divider", None)]))
    assert [(r.block.type, r.block.text) for r in alone.orderBy("order").collect()] == [("paragraph", "one"), ("divider", None)]
    assert [tuple(r)[1:] for r in zeros.collect()] == [(0, 0, 0, 0)]
    order = [(r.block.type, r.block.text) for r in merged.orderBy("order").collect()]
    assert order == [("paragraph", "one"), ("video", None), ("gif", None), ("link", "l"), ("quote", "lost"), ("divider", None), ("paragraph", "three"), ("divider", None)]

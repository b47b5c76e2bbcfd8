"""The second extraction, captured videos, cover and marked-up header."""

from dataclasses import replace

from pyspark.sql import functions as F

from pageloom.operators.blocks import special_blocks
from pageloom.operators.handlers import HANDLERS
from pageloom.operators.locate import cover_image, locate_roots, post_metadata
from pageloom.operators.media_links import lookup_media, media_inventory, media_keys, media_list
from pageloom.operators.second import attach_captures
from pageloom.plans import extract
from pageloom.plans.extract import extract_merged, extract_twice, parsed_pages
from pageloom.schema import HLS, IMAGE
from pageloom.sources.adapters import X_ARTICLE

PAGE = """<div data-testid="twitterArticleReadView">
<a href="/a/photo/0"><div data-testid="tweetPhoto"><img src="https://pbs.twimg.com/media/cover" alt="C"></div></a>
<div data-testid="twitter-article-title">X title</div>
<div><div itemprop="author"><meta itemprop="name" content="Ann"><meta itemprop="additionalName" content="ann"></div><time datetime="2024-01-05">Jan 5</time></div>
<div role="group" aria-label="12 replies, 3.4K views"><div data-testid="reply"><span>12</span></div><div data-testid="like" aria-label="7 Likes"></div></div>
<div data-testid="longformRichTextComponent">
<div data-block="true" class="longform-header-two"><span data-text="true">Head</span></div>
<div data-block="true"><a href="https://l.test/x">https://l.test/x</a></div>
<ul><li data-block="true" class="public-DraftStyleDefault-unorderedListItem"><span data-text="true">a</span></li><li data-block="true" class="public-DraftStyleDefault-unorderedListItem"><span data-text="true">b</span></li></ul>
<div data-block="true"><span data-text="true">iv) typed</span></div>
<div data-block="true"><span data-text="true" style="font-weight: bold">Bold</span> text</div>
<div data-block="true"><div data-testid="tweetPhoto"><div data-testid="videoPlayer"><video poster="https://pbs.twimg.com/amplify_video_thumb/77/img/p.jpg"><source src="blob:https://x.com/1"></video></div></div></div>
<div data-block="true"><div data-testid="tweetPhoto"><div data-testid="videoPlayer"><video src="https://video.twimg.com/tweet_video/g.mp4"></video></div></div></div>
</div></div>"""
RULES = [replace(X_ARTICLE, min_blocks=None, min_text=None, required=[], validation=None)]


def pages(spark):
    return spark.createDataFrame([(1, "https://x.com/ann/article/1", PAGE)], "page_id long, url string, html string")


def test_second_extraction_and_captures(spark):
    blocks = extract_twice(pages(spark), RULES)
    got = blocks.orderBy("block_pos").collect()
    assert [b.block.type for b in got] == ["heading", "link", "list", "list", "paragraph", "video", "gif"]
    assert got[0].block.level == 2 and got[0].block_id == "1-b1"
    assert [i.text for i in got[2].block["items"]] == ["a", "b"] and got[2].block.kind == "unordered"
    # the second extraction keeps the typed marker
    assert got[3].block["items"][0].text == "iv) typed" and got[3].block.kind == "ordered"
    assert [(r.start, r.end, r.bold) for r in got[4].block.annotations] == [(0, 4, True)]
    sources = spark.createDataFrame([(1, "77", "p77", "https://v.test/playlist.m3u8")], "page_id long, video_id string, poster string, src string")
    sources = sources.withColumn("hls", F.lit(None).cast(HLS))
    video = [b.block.video for b in attach_captures(blocks, sources).collect() if b.block and b.block.type == "video"]
    assert [(v.src, v.poster, v.source_type) for v in video] == [("https://v.test/playlist.m3u8", "p77", "application/x-mpegURL")]
    missing = attach_captures(blocks, sources.filter("video_id = 'none'")).filter("block is not null").collect()
    assert "video" not in [b.block.type for b in missing]


def test_both_extractions_from_one_parse(spark):
    page = '<div data-testid="twitterArticleReadView"><div data-testid="twitter-article-title">T</div><div data-testid="longformRichTextComponent"><div data-block="true">iv) a</div><div data-block="true"><span data-text="true">b</span></div></div></div>'
    m = extract_merged(spark.createDataFrame([(1, "https://x.com/ann/article/1", page)], "page_id long, url string, html string"), RULES)
    assert [r.block.type for r in m.second.orderBy("block_pos").collect()] == ["list", "paragraph"]
    counts = m.stats.first()
    assert (counts.adapter_id, counts.replaced, counts.fallback, counts.high_risk, counts.primary_only) == ("x.article", 1, 1, 0, 0)


def test_a_candidate_is_converted_for_its_own_side(spark, monkeypatch):
    tables = []
    monkeypatch.setattr(extract, "written", lambda df, label: tables.append(df) or df)
    extract.extract_merged(pages(spark), RULES)
    rows = tables[0].select("adapter_id", "block.type", "second").collect()
    first, second = [[r for r in rows if r.adapter_id.endswith(extract.SECOND) == side] for side in (False, True)]
    assert all(r.second is None for r in first) and {"heading", "list", "paragraph"} <= {r.type for r in first}
    assert [r.second.block.type for r in second] == ["heading", "link", "list", "list", "list", "paragraph", "video", "gif"]
    assert all(r.second.marked for r in second) and not {"heading", "list", "paragraph"} & {r.type for r in second}


def test_cover_and_metadata(spark):
    located = locate_roots(parsed_pages(pages(spark), RULES), RULES)
    cover = cover_image(located).first()
    assert (cover.cover_src, cover.cover_alt, cover.cover_href) == ("https://pbs.twimg.com/media/cover", "C", "https://x.com/a/photo/0")
    meta = post_metadata(located).first()
    assert (meta.author_name, meta.author_handle, meta.published_at, meta.published_at_text) == ("Ann", "@ann", "2024-01-05", "Jan 5")
    assert (meta.metrics.replies, meta.metrics.likes) == ("12", "7")


def test_media_links(spark):
    kind = f"page_id long, block_pos int, type string, image {IMAGE}, gallery struct<items:array<{IMAGE}>>, tweet struct<items:array<struct<photos:array<struct<src:string,href:string,alt:string>>,quoted:struct<items:array<struct<photos:array<struct<src:string,href:string,alt:string>>>>>>>>"
    img = lambda src, href: (src, None, None, None, None, href) + (None,) * 6
    blocks = spark.createDataFrame([
        (1, 0, "image", img("https://pbs.twimg.com/media/a?name=small", "/p/1"), None, None),
        (1, 1, "image-gallery", None, ([img("g.png", "https://x.com/p/1"), img("h.png", None), img("i.png", "/p/2")],), None),
        (1, 2, "simple-tweet", None, None, ([([("t.png", "/p/3", None)], ([([("q.png", "/p/4", "Q")],)],))],)),
    ], kind)
    articles = spark.createDataFrame([(1, "https://x.com/a", None)], f"page_id long, base_url string, cover {IMAGE}")
    inventory = media_inventory(articles, blocks)
    got = inventory.orderBy("block_pos", "item_pos").collect()
    assert [r.src for r in got] == ["https://pbs.twimg.com/media/a?name=orig", "g.png", "i.png", "t.png", "q.png"] and got[0].alt == "图像"
    listed = media_list(inventory, articles).orderBy("block_pos", "item_pos").collect()
    assert [r.src for r in listed] == ["https://pbs.twimg.com/media/a?name=orig", "i.png", "t.png", "q.png"]
    links = spark.createDataFrame([
        (1, "l1", "https://x.com/p/1#z", "https://x.com/a", None, None), (1, "l2", "/nope", "https://x.com/a", "inline.png", "alt"), (1, "l3", "/nope", "https://x.com/a", None, None),
    ], "page_id long, link_id string, href string, base_url string, image_src string, image_alt string")
    found = {r.link_id: r.src for r in lookup_media(links, media_keys(inventory, articles)).collect()}
    assert found == {"l1": "g.png", "l2": "inline.png", "l3": None}


def test_a_handler_stands_in_the_plan_once(spark):
    """Both sides of a merge have the same component rules; the plan holds each handler's columns once."""
    calls = []

    def counted(name):
        return lambda *a: (calls.append(name), HANDLERS[name](*a))[1]

    rules = [RULES[0], replace(RULES[0], id="x.article#second")]
    special_blocks(F.col("n"), F.col("sub"), {name: counted(name) for name in HANDLERS}, rules)
    assert calls == ["x.simple-tweet"]

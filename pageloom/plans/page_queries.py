"""Registered queries over pages spelled from given rows, each with its SQL twin beside it: what a browser's tree, cleaning and
blocks make of markup that the given pages do not contain."""

from __future__ import annotations

from dataclasses import replace
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import articles as art
from ..operators import reports as rep
from ..operators.clean import platform_fixes, sanitize
from ..operators.locate import cover_image, locate_roots, post_metadata
from ..operators.routing import route
from ..session import written
from ..sources.adapters import CORPUS, EXAMPLE_ARTICLE, SUBSTACK_ARTICLE, X_ARTICLE, adapters_df
from ..sources.html import parse_nodes
from .extract import blocks_of, extract, extract_merged, parsed_pages
from .more_queries import query
from .queries import EXTRACTED_AT, table


def cases(of: str, *texts: str) -> str:
    """SQL text that picks one of several texts by a remainder."""
    return f"case {of} % {len(texts)} " + " ".join(f"when {i} then {t}" for i, t in enumerate(texts)) + " end"


def joined(template: str) -> str:
    """SQL text for a template whose $name parts are columns."""
    parts = [p for i, p in enumerate(template.replace("}", "{").split("{"))]
    return "concat(" + ", ".join(p if i % 2 else "'" + p.replace("'", "''") + "'" for i, p in enumerate(parts) if p) + ")"


def spelled(spark, d, html: str) -> DataFrame:
    """Documents as pages (page_id, url, html), with x, y and z as their words."""
    own = table(spark, d, "documents").select(F.col("doc_id").alias("page_id"), *[F.concat(F.lit(c), F.col("doc_id")).alias(c) for c in "xyz"])
    return own.select("page_id", F.concat(F.lit("https://example.com/en/"), "page_id").alias("url"), F.expr(html).alias("html"))


SPELLED = "p as (select doc_id as page_id, 'x' || doc_id as x, 'y' || doc_id as y, 'z' || doc_id as z from documents)"

#: Markup with x, y and z, and where a browser puts each: (place among the texts, path below body).
MISNESTED = [
    ("<b><p>{x}</b>{y}</p>{z}", [("x", "p/b"), ("y", "p"), ("z", "")]),
    ("<table>{x}<tr><td>{y}</table>{z}", [("x", ""), ("y", "table/tbody/tr/td"), ("z", "")]),
    ("<table><b><tr><td>{x}</td></tr>{y}</table>{z}", [("y", "b"), ("x", "table/tbody/tr/td"), ("z", "b")]),
    ("<a href=1>{x}<div>{y}<a href=2>{z}", [("x", "a"), ("y", "div/a"), ("z", "div/a")]),
    ("<p><i>{x}<b>{y}</i>{z}</b>", [("x", "p/i"), ("y", "p/i/b"), ("z", "p/b")]),
    ("<table><caption>{x}<tbody><tr><th>{y}<td>{z}", [("x", "table/caption"), ("y", "table/tbody/tr/th"), ("z", "table/tbody/tr/td")]),
    ("<p>{x}<table><td>{y}</table>{z}", [("x", "p"), ("y", "table/tbody/tr/td"), ("z", "")]),
    ("<font><p>{x}<b>{y}</font>{z}", [("x", "p/font"), ("y", "p/font/b"), ("z", "p/b")]),
    ("<h1>{x}<h2>{y}</h1>{z}", [("x", "h1"), ("y", "h2"), ("z", "")]),
    ("<ul><li>{x}<li><ol><li>{y}</ul>{z}", [("x", "ul/li"), ("y", "ul/li/ol/li"), ("z", "")]),
    ("<table><tr><td><table><td>{x}</table>{y}</table>{z}", [("x", "table/tbody/tr/td/table/tbody/tr/td"), ("y", "table/tbody/tr/td"), ("z", "")]),
]
MISNESTED_HTML = cases("page_id", *[joined(m) for m, _ in MISNESTED])


def _misnested_twin() -> str:
    rows = ", ".join(f"({k}, {n}, '{c}', '/{path}')" for k, (_, texts) in enumerate(MISNESTED) for n, (c, path) in enumerate(texts))
    return f"""
        with {SPELLED}, m(kind, text_seq, word, path) as (values {rows})
        select page_id, text_seq::bigint as text_seq, rtrim('html/body' || path, '/') as path, case word when 'x' then x when 'y' then y else z end as text
        from p join m on kind = page_id % {len(MISNESTED)}"""


@query(_misnested_twin())
def h1_misnested_markup(spark, d):
    """Every text of misnested pages with the tags above it."""
    parsed = parse_nodes(spelled(spark, d, MISNESTED_HTML))
    owner = lambda t: F.get("nodes", t["owners"])
    placed = F.transform(F.arrays_zip("texts", "owners"), lambda t: F.struct(
        F.array_join(F.concat(F.transform(owner(t)["path"], lambda i: F.get("nodes", i)["tag"]), F.array(owner(t)["tag"])), "/").alias("path"),
        t["texts"].alias("text")))
    rows = parsed.select("page_id", F.posexplode(placed).alias("text_seq", "t"))
    return rows.select("page_id", F.col("text_seq").cast("bigint").alias("text_seq"), "t.path", "t.text")


# ---- articles with marked blocks: both extractions, their merge and the reports on them ----------
POST_RULES = [replace(X_ARTICLE, min_blocks=None, min_text=None, required=[], validation=None)]


def _marked(inner: str, more: str = "") -> str:
    return f'<div data-block="true"{more}>{inner}</div>'


def _said(text: str) -> str:
    return f'<span data-text="true">{text}</span>'


def _post(body: str) -> str:
    return ('<div data-testid="twitterArticleReadView"><div data-testid="twitter-article-title">Title {x}</div>'
            f'<div data-testid="longformRichTextComponent">{body}</div></div>')


_LINK = '<a href="https://l.test/{x}">' + _said("link") + "</a>"
_ITEM = ' data-block="true" class="public-DraftStyleDefault-orderedListItem"'
#: Markup of a kind of page. Per kind: what the first and the second extraction make (type, text, link, target), the merge, and
#: the changes of the list fix, quotes of the clean tree, differing low-risk counts and issues.
ARTICLES = [
    dict(html="<div>{x}</div>", first=[], second=[], merge=[], issues="missing-readView,missing-longform,missing-title", whole=0),
    dict(html='<div data-testid="twitterArticleReadView"><div data-testid="twitter-article-title">Title {x}</div></div>',
         first=[], second=[], merge=[], issues="missing-longform", whole=0),
    dict(html=_post(_marked(_said("{x}") + _LINK) + _marked(_said("{y}"))), first=["paragraph:{x}link", "paragraph:{y}"],
         second=["paragraph:{x}link", "paragraph:{y}"], merge=["c0", "c1"], ranges=1),
    dict(html=_post(_marked(_said("{x}")) + _marked(_said("{y}"), ' class="longform-header-one"')), first=["paragraph:{x}", "heading:{y}"],
         second=["paragraph:{x}", "heading:{y}"], merge=["c0", "c1"], fix=1, issues="no-link-semantics"),
    dict(html=_post(f"<ol><li{_ITEM}>" + _said("{x}") + f"</li><li{_ITEM}>" + _said("{y}") + "</li></ol>" + _marked(_said("{z}") + _LINK)),
         first=["list:{x}/{y}", "paragraph:{z}link"], second=["list:{x}/{y}", "paragraph:{z}link"], merge=["c0", "c1"], fix=2, lists=1, ranges=1),
    dict(html=_post('<ol><li data-block="true">' + _said("{x}") + '</li><li data-block="true">' + _said("{y}") + "</li></ol>" + _marked(_said("{z}") + _LINK)),
         first=["paragraph:{x}", "paragraph:{y}", "paragraph:{z}link"], second=["list:{x}/{y}", "paragraph:{z}link"], merge=["p0", "c2"], lists=1, ranges=1,
         diffs=2, issues="fallback-blocks:1,low-risk-count-diff,list-fix-noop"),
    dict(html=_post(_marked("iv) {x}") + _marked(_said("{z}") + _LINK)), first=["paragraph:iv) {x}", "paragraph:{z}link"],
         second=["list:iv) {x}", "paragraph:{z}link"], merge=["p0", "c1"], lists=1, ranges=1, diffs=2,
         issues="fallback-blocks:1,low-risk-count-diff,list-fix-noop"),
    dict(html=_post(_marked('<a href="https://l.test/{y}" target="_blank">{x}</a>') + _marked(
        '<div data-testid="tweetPhoto"><div data-testid="videoPlayer"><video src="https://v.test/{x}.mp4"></video></div></div>') + _marked(_said("{y}"))),
         first=["paragraph:{x}", "paragraph:{y}"], second=["link:{x}", "gif:", "paragraph:{y}"], merge=["p0", "p1", "c1"], links=1, high=1, only=1, diffs=1),
    dict(html=_post(_marked('<div data-testid="simpleTweet"><div data-testid="tweet"><div data-testid="User-Name"><span>{x}</span><span>@{x}</span></div>'
                            '<a href="/{x}/status/9">s</a><div data-testid="tweetText">{y}</div></div></div>') + _marked(_said("{z}") + _LINK)),
         first=["simple-tweet:", "paragraph:{z}link"], second=["simple-tweet:", "paragraph:{z}link"], merge=["c0", "c1"], posts=1, quotes=2, ranges=1),
    dict(html=_post(_marked(_said("{x}") + _LINK) + _marked('<div role="separator"></div>') + _marked(_said("{y}"))),
         first=["paragraph:{x}link", "divider:", "paragraph:{y}"], second=["paragraph:{x}link", "paragraph:{y}"], merge=["c0", "c1", "c2"], ranges=1),
]
ARTICLE_HTML = cases("page_id", *[joined(a["html"]) for a in ARTICLES])


def _values(rows: list[tuple]) -> str:
    show = lambda v: "null" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(show, r)) + ")" for r in rows)


def _filled(text: str) -> str:
    return f"replace(replace(replace({text}, '{{x}}', x), '{{y}}', y), '{{z}}', z)"


def _blocks_twin(side: str) -> str:
    rows = [(k, n, *b.split(":", 1)) for k, a in enumerate(ARTICLES) for n, b in enumerate(a[side])]
    return f"""
        with {SPELLED}, b(kind, block_pos, type, t) as (values {_values(rows)})
        select page_id, block_pos::bigint as block_pos, type, {_filled('t')} as text from p join b on kind = page_id % {len(ARTICLES)}"""


@lru_cache(maxsize=4)
def merged_articles(spark, d):
    pages = spelled(spark, d, ARTICLE_HTML).withColumn("url", F.concat(F.lit("https://x.com/u/article/"), "page_id"))
    return extract_merged(pages, POST_RULES)


def shown() -> Column:
    return F.coalesce(F.array_join(F.transform("block.items", lambda i: i["text"]), "/"), "block.text", F.lit("")).alias("text")


@query(_blocks_twin("second"))
def b23_second_extraction(spark, d):
    blocks = merged_articles(spark, d).second
    return blocks.select("page_id", F.col("block_pos").cast("bigint").alias("block_pos"), F.col("block.type").alias("type"), shown())


@query(_blocks_twin("first"))
def b2_marked_blocks(spark, d):
    rows = merged_articles(spark, d).rows.filter("block_pos >= 0")
    return rows.select("page_id", F.col("block_pos").cast("bigint").alias("block_pos"), F.col("block.type").alias("type"), shown())


def _merge_twin() -> str:
    rows = []
    for k, a in enumerate(ARTICLES):
        for n, source in enumerate(a["merge"]):
            side, i = a["first" if source[0] == "c" else "second"], int(source[1:])
            rows.append((k, n, *side[i].split(":", 1)))
    return f"""
        with {SPELLED}, b(kind, place, type, t) as (values {_values(rows)})
        select page_id, place::bigint as place, type, {_filled('t')} as text from p join b on kind = page_id % {len(ARTICLES)}"""


@query(_merge_twin())
def a5_merge_of_both(spark, d):
    """What the merge of both extractions holds, in order."""
    place = F.row_number().over(Window.partitionBy("page_id").orderBy("order")) - 1
    return merged_articles(spark, d).blocks.select("page_id", place.cast("bigint").alias("place"), F.col("block.type").alias("type"), shown())


def _facts() -> str:
    """Per kind of page: counts that follow from the blocks above, and those that are stated."""
    rows = []
    for k, a in enumerate(ARTICLES):
        kept = a["merge"]
        replaced = sum(s[0] == "c" and not a["first"][int(s[1:])].startswith("divider") for s in kept)
        aside = a.get("high", 0) + a.get("only", 0)
        fallback = sum(s[0] == "p" for s in kept) - aside
        rows.append((k, len(a["second"]), len(a["first"]), a.get("lists", 0), a.get("posts", 0), a.get("links", 0), a.get("ranges", 0), a.get("diffs", 0),
                     replaced, fallback, a.get("high", 0), a.get("only", 0), a.get("fix", 0), a.get("quotes", 0), a.get("issues", "")))
    return ("f(kind, primary_blocks, clean_blocks, n_lists, n_posts, n_links, link_ranges, n_count_diffs, replaced, fallback, high_risk, primary_only, "
            f"list_fix_changed, snapshot_quotes, issues) as (values {_values(rows)})")


NUMBERS = ["primary_blocks", "clean_blocks", "n_lists", "n_posts", "n_links", "link_ranges", "n_count_diffs", "replaced", "fallback", "high_risk",
           "primary_only", "list_fix_changed", "snapshot_quotes"]
REPORT = f"with {SPELLED}, {_facts()}, r as (select * from p join f on kind = page_id % {len(ARTICLES)})"


def article_report(spark, d) -> DataFrame:
    m = merged_articles(spark, d)
    return rep.page_report(m.rows, m.second, m.stats.drop("adapter_id"))


@query(f"{REPORT} select page_id, case when kind > 0 then 'Title ' || x else '' end as title, {', '.join(f'{n}::bigint as {n}' for n in NUMBERS)} from r")
def g7_article_report(spark, d):
    return article_report(spark, d).select("page_id", "title", *NUMBERS)


@query(f"{REPORT} select page_id, issues from r")
def g4_article_issues(spark, d):
    return rep.flag_issues(article_report(spark, d)).select("page_id", F.array_join("issues", ",").alias("issues"))


@query(f"""{REPORT} select kind::bigint as kind, count(*) as samples, count(*) filter (issues <> '') as with_issues, count(*) filter (fallback > 0) as with_fallback,
    count(*) filter (issues like 'missing-%') as missing_selectors, sum(primary_blocks)::bigint as primary_blocks, sum(clean_blocks)::bigint as clean_blocks
    from r group by kind""")
def g5_article_rollup(spark, d):
    flagged = rep.flag_issues(article_report(spark, d)).withColumn("kind", F.col("page_id") % len(ARTICLES))
    return rep.corpus_rollup(flagged, "kind")


@query(f"{REPORT} select page_id, 'x.article' as adapter_id, 'x' as platform, replaced::bigint as replaced, fallback::bigint as fallback, high_risk::bigint as high_risk, primary_only::bigint as primary_only from r")
def a7_extraction_diagnostics(spark, d):
    return art.extraction_diagnostics(merged_articles(spark, d).stats, POST_RULES)


@query(f"""{REPORT}, fixes(id, own) as (values ('expand-folded-tweet-text', 0), ('normalize-handwritten-ordered-list', 1), ('preserve-svg-emoji', 0),
      ('capture-x-video-hls', 0), ('preserve-x-media-caption', 0), ('preserve-x-media-layout', 0))
    select page_id, id as fix, true as applied, case when own = 1 then list_fix_changed when id = 'capture-x-video-hls' and kind = 7 then 1
      when id = 'expand-folded-tweet-text' and kind = 8 then 1 else 0 end::bigint as changed from r, fixes""")
def h5_platform_fixes(spark, d):
    heads = merged_articles(spark, d).rows.filter("block_pos < 0")
    found = heads.select("page_id", F.explode("page.fixes").alias("f"))
    return found.select("page_id", F.col("f.id").alias("fix"), "f.applied", F.col("f.changed").cast("bigint").alias("changed"))


@query(f"""{REPORT} select page_id, 'link' as type, x as text, 'https://l.test/' || y as href, '_blank' as target, null as src from r where kind = 7
    union all select page_id, 'gif', null, null, null, 'https://v.test/' || x || '.mp4' from r where kind = 7""")
def b13_links_and_gifs(spark, d):
    """An element that is one link, and a player with a source of its own."""
    found = merged_articles(spark, d).second.filter("block.type in ('link', 'gif')")
    return found.select("page_id", "block.type", "block.text", "block.href", "block.target", F.col("block.video.src").alias("src"))


# ---- blocks of every family ----------------------------------------------------------------------
_FREE = dict(min_blocks=None, min_text=None, required=[], validation=None)
GENERIC = replace(
    EXAMPLE_ARTICLE, id="generic.article", platform="generic", hosts=["generic.test"], url_patterns=[], root_selector="[data-article-root]",
    title_selector="[data-title]", content_selector="[data-content]", remove=["script", ".ad"], semantic={}, preserve=["width", "height", "colspan"], **_FREE)
FAMILY_RULES = [GENERIC, replace(X_ARTICLE, **_FREE), replace(SUBSTACK_ARTICLE, **_FREE)]


def _plain(body: str) -> tuple[str, str]:
    return "https://generic.test/1", f"<article data-article-root><h1 data-title>T</h1><section data-content>{body}</section></article>"


def _letter(body: str) -> tuple[str, str]:
    return "https://substack.com/inbox/post/1", (
        '<article class="newsletter-post post-viewer-post"><div><a href="/p/t">News</a></div>'
        f'<div class="available-content"><div class="body markup">{body}</div></div></article>')


def _thread(body: str) -> tuple[str, str]:
    return "https://x.com/u/article/1", _post(body).replace("Title {x}", "T")


_EMOJI = '<img alt="{0}" src="https://abs.twimg.com/emoji/v2/svg/{1}.svg">'
_CARD = (
    '<div data-block="true"><div data-testid="simpleTweet"><div data-testid="tweet"><div data-testid="User-Name"><span>{x}</span><span>@{x}</span></div>'
    '<time datetime="2024-01-05">Jan 5</time><a href="/{x}/status/9">s</a><div data-testid="tweetText">%s</div>%s</div></div></div>')
#: Queries, and for each its kinds of pages: markup and the lines of its blocks.
FAMILIES: dict[str, list[tuple[tuple[str, str], list[str]]]] = {
    "b7_code_and_tables": [
        (_plain('<pre><code class="language-js">let {x} = 1;\n</code></pre><pre>{y}</pre><code>{z}</code>'),
         ["code|let {x} = 1;|js", "code|{y}|", "code|{z}|"]),
        (_plain('<table><tr><th>{x}</th><th colspan=2>{y}</th></tr><tr><td>1</td><td style="text-align: right">{z}</td><td></td></tr></table>'),
         ["table|{x},th/{y},th,2//1/{z},right/"]),
    ],
    "b9_images_and_galleries": [
        (_plain('<a href="/i/{x}"><picture><source srcset="{y}.png 1x"><img data-src="{x}.png" width="1600" height="900" alt="{z}"></picture></a><img src="{y}.jpg">'),
         ["image|{x}.png,{y}.png 1x,{z},/i/{x},1.7778", "image|{y}.jpg"]),
        (_plain('<figure><img src="{x}.png"><img src="{y}.png"><img src="{x}.png"><figcaption>{z}</figcaption></figure>'),
         ["image-gallery|{x}.png/{y}.png", "paragraph|caption|{z}"]),
        (_thread('<div data-block="true"><div data-testid="tweetPhoto"><img src="https://pbs.twimg.com/media/{x}?name=small" alt="{y}"></div></div>'
                 '<div data-block="true"><span data-text="true" style="font-weight: bold">{x}</span> <span data-text="true">{z}</span></div>'),
         ["image|https://pbs.twimg.com/media/{x}?name=small,{y}"] * 2 + ["paragraph|{x} {z}|bold"]),
    ],
    "b11_embeds_and_dividers": [
        (_plain('<iframe src="https://www.youtube.com/embed/{x}" data-poster="{y}.png" title="{z}"></iframe><iframe data-src="https://vimeo.com/{y}"></iframe>'),
         ["embed|youtube,YouTube,https://www.youtube.com/embed/{x},{z},{z},{y}.png", "embed|generic,Embed,https://vimeo.com/{y},Embed,Embed,"]),
        (_plain('<p>{x}</p><hr><div role="separator"></div><p>{y}</p>'), ["paragraph|{x}", "divider|", "divider|", "paragraph|{y}"]),
    ],
    "b6_headings_quotes_and_lists": [
        (_plain('<h3>{x}</h3><blockquote>{y}</blockquote><ol><li>1. {x}</li><li>{y}</li></ol><ul><li>{z}</li></ul>'),
         ["heading|3|{x}", "quote|{y}", "list|ordered|{x}/{y}", "list|unordered|{z}"]),
        (_plain('<p>{x} <a href="/l/{y}">{y}</a> <strong>{z}</strong></p>'), ["paragraph|{x} {y} {z}|/l/{y}/bold"]),
    ],
    "b14_site_components": [
        (_letter("<p>{x}</p><a data-component-name=\"Twitter2ToDOM\" data-attrs='[\"full_text\":\"{y}\",\"username\":\"@{z}\",\"like_count\":1,"
                 "\"date\":\"2024-01-05T16:05:00Z\"]' href=\"https://x.com/a/status/1\">t</a>"),
         ["paragraph|{x}", "embed|x,X,https://x.com/a/status/1,{y},@{z},12:05 AM · Jan 6, 2024,1 Like,"]),
        (_letter('<div data-component-name="Youtube2ToDOM"><iframe src="https://www.youtube-nocookie.com/embed/{x}"></iframe></div>'
                 '<div data-component-name="VideoEmbedPlayer"><video src="blob:{x}" poster="/{y}.png"></video></div>'),
         ["embed|youtube,YouTube,https://www.youtube-nocookie.com/embed/{x},YouTube video,YouTube video,",
          "embed|substack,Substack,Substack video,Substack video,https://substack.com/{y}.png"]),
        (_letter('<div data-component-name="FootnoteToDOM"><a class="footnote-number">2</a><div class="footnote-content">{x} <em>{y}</em></div></div>'
                 '<div data-component-name="SubscribeWidget"><button data-href="https://s.test/{x}">{z}</button></div>'),
         ["paragraph|Footnote 2: {x} {y}", "embed|substack,Substack,cta,https://s.test/{x},{z},{z},"]),
        (_letter('<audio src="https://a.test/{x}.mp3"></audio><div data-component-name="Paywall"><h2>{y}</h2><a href="https://s.test/{z}">Upgrade</a></div><p>{z}</p>'),
         ["embed|substack,Substack,https://a.test/{x}.mp3,Substack audio,Substack audio,", "embed|substack,Substack,https://s.test/{z},{y},{y}Upgrade,",
          "paragraph|{z}"]),
    ],
    "b18_post_cards": [
        (_thread(_CARD % ("{y}", '<div data-testid="tweetPhoto"><img src="https://pbs.twimg.com/media/{x}"></div>'
                          '<div data-testid="tweetPhoto"><img src="https://pbs.twimg.com/media/{y}"></div>'
                          '<div role="link"><div data-testid="User-Name"><span>{z}</span></div><div data-testid="tweetText">{z}q</div></div>')),
         ["simple-tweet|{x} · @{x} · Jan 5,{y},https://x.com/{x}/status/9,text:{y}/photo-group:https://pbs.twimg.com/media/{x}+https://pbs.twimg.com/media/{y}/"
          "quoted-tweet:{z}:{z}q"]),
        (_thread(_CARD % ("  {y} " + _EMOJI.format("😀", "1f600") + "  and   " + _EMOJI.format("🎉", "1f389") + "{z} ", "")),
         ["simple-tweet|{x} · @{x} · Jan 5,{y} 😀  and   🎉{z},https://x.com/{x}/status/9,text:{y} 😀  and   🎉{z}:1f600=😀+1f389=🎉"]),
    ],
}
FAMILY_CASES = [case for kinds in FAMILIES.values() for case in kinds]


def _line() -> Column:
    """A block as one line: its type and what its family holds."""
    img = lambda i: F.concat_ws(",", i["src"], i["srcset"], i["alt"], i["href"], i["aspect_ratio"].cast("string"))
    each = lambda c, f, sep="/": F.array_join(F.transform(c, f), sep)
    ranges = F.filter("annotations", lambda a: a["bold"] | a["href"].isNotNull())
    cell = lambda c: F.concat_ws(",", c["text"], F.when(c["header"], "th"), c["col_span"].cast("string"), c["style"]["text-align"])
    emoji = lambda i: F.array_join(F.transform(F.filter(i["annotations"], lambda a: a["emoji"].isNotNull()), lambda a: F.concat(
        F.regexp_extract(a["emoji"], "([0-9a-f]+)\\.svg$", 1), F.lit("="), F.substring(i["text"], a["start"] + 1, a["end"] - a["start"]))), "+")
    item = lambda i: F.concat_ws(":", i["type"], i["text"], F.nullif(emoji(i), F.lit("")), F.nullif(each(i["photos"], lambda p: p["src"], "+"), F.lit("")),
                                 i["quoted"]["title"], i["quoted"]["excerpt"])
    parts = {
        "code": F.concat_ws("|", "text", F.coalesce("code.language", F.lit(""))), "image": img(F.col("image")), "image-gallery": each("gallery.items", img),
        "table": each("table.rows", lambda r: each(r, cell), "//"), "list": F.concat_ws("|", "kind", each("items", lambda i: i["text"])),
        "heading": F.concat_ws("|", F.col("level").cast("string"), "text"),
        "embed": F.concat_ws(",", "embed.provider", "embed.label", "embed.presentation", "embed.href", "embed.title", "embed.text", "embed.author_handle", "embed.published_at_text", "embed.metrics.likes",
            F.coalesce(each("embed.media", lambda m: m["src"]), F.lit(""))),
        "simple-tweet": F.concat_ws(",", "tweet.title", "tweet.excerpt", "tweet.href", each("tweet.items", item)),
    }
    spoken = F.concat_ws("|", "role", "text", F.nullif(each(ranges, lambda a: F.coalesce(a["href"], F.lit("bold"))), F.lit("")))
    shown_as = F.coalesce(*[F.when(F.col("type") == t, c) for t, c in parts.items()], F.when(F.col("type") == "divider", ""), spoken)
    return F.concat(F.col("type"), F.lit("|"), shown_as)


@lru_cache(maxsize=4)
def family_blocks(spark, d) -> DataFrame:
    """Blocks of all kinds of pages, extracted in one run."""
    html = cases("page_id", *[joined(markup) for (_, markup), _ in FAMILY_CASES])
    url = cases("page_id", *[f"'{u}'" for (u, _), _ in FAMILY_CASES])
    pages = spelled(spark, d, html).withColumn("url", F.expr(url))
    # braces of JSON, which the templates cannot hold
    pages = pages.withColumn("html", F.regexp_replace(F.regexp_replace("html", "data-attrs='\\[", "data-attrs='{"), "\\]' href", "}' href"))
    return written(blocks_of(extract(pages, FAMILY_RULES)).select("page_id", "block_pos", _line().alias("line")), "family-blocks")


def _family(name: str, first: int, kinds: list) -> None:
    rows = [(first + k, n, line) for k, (_, lines) in enumerate(kinds) for n, line in enumerate(lines)]
    sql = f"""
        with {SPELLED}, b(kind, block_pos, t) as (values {_values(rows)})
        select page_id, block_pos::bigint as block_pos, {_filled('t')} as line from p join b on kind = page_id % {len(FAMILY_CASES)}"""

    def run(spark, d):
        own = F.col("page_id") % len(FAMILY_CASES)
        found = family_blocks(spark, d).filter((own >= first) & (own < first + len(kinds)))
        return found.select("page_id", F.col("block_pos").cast("bigint").alias("block_pos"), "line")

    run.__name__ = name
    query(sql)(run)


for _name, _kinds in FAMILIES.items():
    _family(_name, FAMILY_CASES.index(_kinds[0]), _kinds)


# ---- cleaning and heads ----------------------------------------------------------------------------
_HEAD = (
    '<div data-testid="twitterArticleReadView"><a href="/a/photo/{y}"><div data-testid="tweetPhoto"><img src="https://pbs.twimg.com/media/{x}" alt="{z}"></div></a>'
    '<div data-testid="twitter-article-title">T</div><div><div itemprop="author"><meta itemprop="name" content="{x}"><meta itemprop="additionalName" content="{y}">'
    '</div><time datetime="2024-01-05">{z}</time></div><div role="group" aria-label="12 replies, 3.4K views"><div data-testid="reply"><span>12</span></div>'
    '<div data-testid="like" aria-label="7 Likes"></div></div><div data-testid="longformRichTextComponent">%s</div></div>')
#: Pages of articles and letters, and what is left of the attributes of their elements.
CLEANED: list[tuple[tuple[str, str], list[tuple[str, str, str]]]] = [
    (("https://x.com/u/article/1", _HEAD % (
        '<p style="color: red; font-weight: 700; position: absolute">{x}</p><a href="/{x}" style="color: blue; margin: 0" onclick="f()">{y}</a>'
        '<pre style="white-space: pre; color: red">{z}</pre><span data-text="true" style="font-size: 12px; text-align: center; float: left">q</span>'
        '<script>x</script><button class="b">{z}</button>')),
     [("div", "data-testid", "longformRichTextComponent"), ("p", "style", "color: red; font-weight: 700"), ("a", "href", "/{x}"), ("a", "style", "color: blue"),
      ("pre", "style", "white-space: pre; color: red"), ("span", "data-text", "true"), ("span", "style", "font-size: 12px; text-align: center")]),
    (("https://x.com/u/article/1", _HEAD % (
        '<ul><li class="public-DraftStyleDefault-unorderedListItem {x}">{x}</li></ul><div class="public-DraftStyleDefault-orderedListItem" id="{y}">{y}</div>')),
     [("div", "data-testid", "longformRichTextComponent"), ("li", "data-pl-list-kind", "unordered"), ("div", "data-pl-list-kind", "ordered")]),
    (_letter('<div data-component-name="VideoEmbedPlayer"><div style="padding-bottom: 56.25%"></div></div><div><div style="background-image: url(https://i.test/{x})"></div>'
             '<audio src="https://a.test/{y}.mp3"></audio></div><p style="font-style: italic; float:left">{z}</p>'),
     [("article", "class", "newsletter-post post-viewer-post"), ("a", "href", "/p/t"), ("div", "class", "available-content"), ("div", "class", "body markup"),
      ("div", "data-component-name", "VideoEmbedPlayer"), ("div", "data-pl-media-ratio", "1.7778"), ("audio", "src", "https://a.test/{y}.mp3"),
      ("audio", "data-pl-media-cover", "https://i.test/{x}"), ("p", "style", "font-style: italic")]),
]


def cleaned_pages(spark, d) -> DataFrame:
    pages = spelled(spark, d, cases("page_id", *[joined(h) for (_, h), _ in CLEANED]))
    return locate_roots(parsed_pages(pages.withColumn("url", F.expr(cases("page_id", *[f"'{u}'" for (u, _), _ in CLEANED]))), FAMILY_RULES), FAMILY_RULES)


@query(f"""
    with {SPELLED}, b(kind, tag, name, t) as (values {_values([(k, *a) for k, (_, kept) in enumerate(CLEANED) for a in kept])})
    select page_id, tag, name, {_filled('t')} as value from p join b on kind = page_id % {len(CLEANED)}""")
def h7_kept_attributes(spark, d):
    """H6-H8: attributes that cleaning leaves or adds, styles by their context."""
    clean = sanitize(platform_fixes(cleaned_pages(spark, d), FAMILY_RULES), FAMILY_RULES)
    live = F.filter("nodes", lambda n: n["live"])
    kept = F.flatten(F.transform(live, lambda n: F.transform(F.map_entries(n["attrs"]), lambda e: F.struct(
        n["tag"].alias("tag"), e["key"].alias("name"), e["value"].alias("value")))))
    return clean.select("page_id", F.explode(kept).alias("k")).select("page_id", "k.*")


@query(f"""with {SPELLED} select page_id, 'https://pbs.twimg.com/media/' || x as cover_src, z as cover_alt, 'https://x.com/a/photo/' || y as cover_href
    from p where page_id % {len(CLEANED)} < 2""")
def b20_cover_image(spark, d):
    return cover_image(cleaned_pages(spark, d)).filter("cover_src is not null")


@query(f"""with {SPELLED} select page_id, x as author_name, '@' || y as author_handle, '2024-01-05' as published_at, z as published_at_text, '12' as replies, '7' as likes
    from p where page_id % {len(CLEANED)} < 2""")
def b22_post_metadata(spark, d):
    meta = post_metadata(cleaned_pages(spark, d)).filter("author_name is not null")
    return meta.select("page_id", "author_name", "author_handle", "published_at", "published_at_text", "metrics.replies", "metrics.likes")


@query("""with p as (select page_id, url from pages) select regexp_extract(url, '^https?://[^/?#]*?([a-z]+)(?:[:/?#]|$)', 1) as tld, 'example' as platform, 'article' as content_type,
    3::bigint as min_blocks, count(*) as n from p where regexp_matches(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '(^|\\.)example\\.(com|net|org)$')
      and regexp_matches(regexp_extract(url, '^https?://[^/?#]+([^#]*)', 1), '^/[a-z]{2}/[0-9]+') group by all""")
def s6_rules_of_pages(spark, d):
    """Routed pages beside the rule that took them, from the rule table."""
    routed = route(table(spark, d, "pages").select("page_id", "url"), CORPUS)
    rules = adapters_df(spark, CORPUS).select("adapter_id", "platform", "content_type", F.col("readiness.min_blocks").cast("bigint").alias("min_blocks"))
    tld = F.regexp_extract("url", "^https?://[^/?#]*?([a-z]+)(?:[:/?#]|$)", 1)
    own = routed.select("adapter_id", tld.alias("tld")).join(F.broadcast(rules), "adapter_id")
    return own.groupBy("tld", "platform", "content_type", "min_blocks").agg(F.count(F.lit(1)).alias("n"))


_RANGED = _plain('<p>{x} <a href="/l/{y}" target="_blank" style="color: red">{y}</a> <strong>{z}</strong> <em>q</em> <u>u</u> '
                 '<span style="font-size: 12px; float: left">w</span> <a href="#{z}"><b>v</b></a></p>')


@query(f"""
    with {SPELLED}, s as (select page_id, x, y, z, length(x) + 1 as a, length(x) + length(y) + 2 as b, length(x) + length(y) + length(z) + 3 as c from p)
    select page_id, a::bigint as "start", (a + length(y))::bigint as "end", false as bold, '/l/' || y as href, '_blank' as target, 'color=red' as style from s
    union all select page_id, b, b + length(z), true, null, null, '' from s union all select page_id, c, c + 1, false, null, null, 'font-style=italic' from s
    union all select page_id, c + 6, c + 7, false, '#' || z, null, '' from s""")
def b5_ranges_of_every_kind(spark, d):
    """Links with target and style, bold, italic, and a link around bold text."""
    pages = spelled(spark, d, joined(_RANGED[1])).withColumn("url", F.lit(_RANGED[0]))
    ranges = blocks_of(extract(pages, [GENERIC])).select("page_id", F.explode("annotations").alias("r"))
    style = F.array_join(F.transform(F.map_entries("r.style"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return ranges.select("page_id", F.col("r.start").cast("bigint").alias("start"), F.col("r.end").cast("bigint").alias("end"), "r.bold", "r.href", "r.target",
                         style.alias("style"))


@query(f"""with {SPELLED} select page_id, 'T' as title, x as author_name, '@' || y as author_handle, z as published_at_text, '12' as replies, '7' as likes,
    'https://pbs.twimg.com/media/' || x as cover_src, 'https://x.com/a/photo/' || y as cover_href, 2::bigint as n_blocks from p""")
def a1_articles_with_heads(spark, d):
    """Article rows of posts with author, date, counts and cover, from the same parse as their blocks."""
    pages = spelled(spark, d, joined(_HEAD % '<p data-block="true">{x} words</p><p data-block="true">{y}</p>')).withColumn("url", F.concat(F.lit("https://x.com/u/article/"), "page_id"))
    articles = art.assemble_articles(extract(pages, POST_RULES), POST_RULES, EXTRACTED_AT)
    return articles.select("page_id", "title", "author_name", "author_handle", "published_at_text", "metrics.replies", "metrics.likes", "cover_src", "cover_href",
                           F.col("n_blocks").cast("bigint").alias("n_blocks"))

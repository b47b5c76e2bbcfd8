"""Blocks of embedded components.

A handler gets columns, not elements: the component root, the marked elements
below it and the page URL. It returns a block struct,
null when the component says nothing. `HANDLERS` is the registry; a later
registration under the same id replaces the earlier one, blank ids are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.css import background_url, padding_ratio, text_style
from ..functions.media import first_nonempty
from ..functions.numbers import (
    aspect_ratio,
    format_compact_metric,
    format_metric,
    format_published,
    is_date_text,
    is_duration_text,
    parse_timestamp,
    positive_number,
    round_half_up,
)
from ..functions.text import normalize_text
from ..functions.urls import absolute_post_url, safe_url
from ..schema import COVER, EMBED, ITEM, MEDIA, METRICS, PHOTO, PREVIEW, QUOTED, QUOTED_ITEM, TWEET, VIDEO
from .blocks import first_tag, make_block, under
from .marks import is_
from .richtext import component_annotations, emoji_text, shift_ranges
from .tree import attr, first_of, let, make_struct

HANDLERS: dict = {}

# Fixed values.
POST_ATTRS = (
    "struct<url:string,full_text:string,username:string,name:string,profile_image_url:string,date:string,"
    "photos:array<struct<img_url:string,link_url:string>>,reply_count:double,retweet_count:double,like_count:double,"
    "impression_count:double>"
)
SUBSTACK = "Substack"
PAYWALL_TITLE = "This post is for paid subscribers"
CARD_IDS = ["simpleTweet", "tweet"]
VERIFIED_LABELS = ["认证账号", "Verified account"]
EMBEDDED_VIDEO_LABELS = ["嵌入式视频", "Embedded video"]
SHOW_ORIGINAL_LABELS = ["显示原文", "Show original"]
AI_LABELS = ["由 AI 生成", "Made by AI", "Generated by AI"]
REPLY_PREFIXES = ["回复 @", "Replying to @"]


def register(handler_id: str, handler) -> None:
    if handler_id and handler_id.strip():
        HANDLERS[handler_id.strip()] = handler


def handler(handler_id: str):
    def keep(fn):
        register(handler_id, fn)
        return fn

    return keep


def _pick(sub: Column, test) -> Column:
    return first_of(F.filter(sub, test))


def _named(n: Column, *names: str) -> Column:
    return F.coalesce(attr(n, "data-testid").isin(*names), F.lit(False))


def _clean(c: Column) -> Column:
    return F.nullif(normalize_text(c), F.lit(""))


def _embed(**fields: Column) -> Column:
    block = {k: fields[k] for k in ("text", "href") if k in fields}
    return make_block("embed", embed=make_struct(EMBED, **fields), **block)


def _picture(src: Column, **fields: Column) -> Column:
    return F.when(src.isNotNull(), F.array(make_struct(MEDIA, src=src, object_fit=F.lit("cover"), **fields)))


# ---- newsletter components ----------------------------------------------
@handler("substack.twitter-embed")
def post_embed(root: Column, sub: Column, url: Column) -> Column:
    """The post is spelled in a JSON attribute."""
    raw = F.coalesce(attr(root, "data-attrs"), attr(_pick(sub, lambda m: attr(m, "data-attrs").isNotNull()), "data-attrs"))

    def build(p: Column) -> Column:
        photos = F.filter(
            F.transform(p["photos"], lambda x: make_struct(
                MEDIA, src=_clean(x["img_url"]), href=F.nullif(x["link_url"], F.lit("")), aspect_ratio=F.lit(1.0),
                object_fit=F.lit("cover"), object_position=F.lit("center center"),
            )),
            lambda m: m["src"].isNotNull(),
        )
        metrics = make_struct(
            METRICS, replies=format_metric(p["reply_count"], "Reply", "Replies"),
            reposts=format_metric(p["retweet_count"], "Repost", "Reposts"), likes=format_metric(p["like_count"], "Like", "Likes"),
            views=format_compact_metric(p["impression_count"], "View", "Views"),
        )
        user = _clean(p["username"])
        text = F.nullif(p["full_text"], F.lit(""))
        date = F.nullif(p["date"], F.lit(""))
        return F.when(p.isNotNull(), _embed(
            label=F.lit("X"), provider=F.lit("x"), href=F.coalesce(F.nullif(p["url"], F.lit("")), F.nullif(attr(root, "href"), F.lit(""))),
            text=text, author_name=F.nullif(p["name"], F.lit("")),
            author_handle=F.when(user.isNotNull(), F.concat(F.lit("@"), F.regexp_replace(user, "^@", ""))),
            author_avatar_url=F.nullif(p["profile_image_url"], F.lit("")), published_at=date,
            published_at_text=F.when(date.isNotNull(), format_published(parse_timestamp(date))), metrics=metrics,
            media=F.when(F.size(photos) > 0, photos),
        ))

    parsed = F.from_json(raw, POST_ATTRS)
    return F.when(F.regexp_like(raw, F.lit("^\\s*\\{")), let(parsed, build))


@handler("substack.youtube-embed")
def youtube(root: Column, sub: Column, url: Column) -> Column:
    """B16."""
    video_id = _clean(F.get_json_object(attr(root, "data-attrs"), "$.videoId"))
    frame = F.when(is_(root, "frame"), root).otherwise(_pick(sub, lambda m: is_(m, "frame")))

    def build(f: Column) -> Column:
        title = F.coalesce(
            _clean(attr(f, "title")), _clean(attr(f, "aria-label")), F.concat(F.lit("YouTube video "), video_id), F.lit("YouTube video")
        )
        href = safe_url(first_nonempty(attr(f, "src"), attr(f, "data-src")), url)
        return let(href, lambda h: F.when(h.isNotNull(), _embed(
            label=F.lit("YouTube"), provider=F.lit("youtube"), href=h, title=title, text=title
        )))

    return let(frame, build)


@handler("substack.video-embed")
def video_embed(root: Column, sub: Column, url: Column) -> Column:
    """A direct video; without a usable source only its poster is kept."""
    def facts(v: Column) -> Column:
        inner = under(sub, v)
        source = _pick(inner, lambda m: (m["tag"] == "source") & attr(m, "src").isNotNull())
        padded = _pick(sub, lambda m: padding_ratio(attr(m, "style")).isNotNull())
        return F.struct(
            v.isNotNull().alias("found"),
            safe_url(first_nonempty(attr(v, "src"), attr(source, "src")), url).alias("src"),
            safe_url(attr(v, "poster"), url).alias("poster"),
            F.coalesce(
                _clean(attr(v, "title")), _clean(attr(v, "aria-label")),
                _clean(attr(_pick(sub, lambda m: attr(m, "aria-label").isNotNull()), "aria-label")), F.lit("Substack video"),
            ).alias("title"),
            F.coalesce(
                round_half_up(positive_number(attr(root, "data-pl-media-ratio")), 4), aspect_ratio(attr(v, "width"), attr(v, "height")),
                padding_ratio(attr(padded, "style")),
            ).alias("ratio"),
            attr(v, "preload").alias("preload"),
        )

    def build(p: Column) -> Column:
        preload = F.when(p["preload"].isin("auto", "metadata", "none", ""), p["preload"]).when(p["preload"].isNotNull(), "metadata")
        video = make_block("video", video=make_struct(
            VIDEO, src=p["src"], transport=F.lit("direct"), poster=p["poster"], aspect_ratio=p["ratio"],
            preload=F.nullif(preload, F.lit("")), aria_label=p["title"],
        ))
        still = _embed(
            label=F.lit(SUBSTACK), provider=F.lit("substack"), title=p["title"], text=p["title"],
            media=_picture(p["poster"], alt=p["title"], aspect_ratio=p["ratio"]),
        )
        return F.when(p["src"].isNotNull(), video).when(p["found"], still)

    player = F.when(root["tag"] == "video", root).otherwise(first_tag(sub, "video"))
    return let(let(player, facts), build)


@handler("substack.audio-embed")
def audio(root: Column, sub: Column, url: Column) -> Column:
    """B16."""
    title = F.coalesce(_clean(attr(root, "title")), _clean(attr(root, "aria-label")), F.lit("Substack audio"))
    backdrop = background_url(attr(_pick(sub, lambda m: background_url(attr(m, "style")).isNotNull()), "style"))
    cover = safe_url(F.coalesce(attr(root, "data-pl-media-cover"), backdrop), url)
    return let(F.struct(safe_url(attr(root, "src"), url).alias("href"), cover.alias("cover"), title.alias("title")), lambda p: F.when(
        p["href"].isNotNull(), _embed(
            label=F.lit(SUBSTACK), provider=F.lit("substack"), href=p["href"], title=p["title"], text=p["title"],
            media=_picture(p["cover"], href=p["href"], alt=p["title"]),
        )))


def _rich(n: Column, sub: Column, url: Column) -> Column:
    """Text, ranges and style of an element inside a component."""
    return let(normalize_text(n["text"]), lambda t: F.struct(
        t.alias("text"), component_annotations(under(sub, n), t, lambda h: safe_url(h, url)).alias("ranges"),
        text_style(attr(n, "style")).alias("style"),
    ))


def _first_link(sub: Column, url: Column) -> Column:
    links = F.transform(sub, lambda m: safe_url(F.coalesce(attr(m, "href"), attr(m, "data-href")), url))
    return first_of(F.filter(links, lambda h: h.isNotNull()))


@handler("substack.footnote")
def footnote(root: Column, sub: Column, url: Column) -> Column:
    """`Footnote n: text`."""
    number = _pick(sub, lambda m: F.array_contains(m["classes"], "footnote-number") | F.coalesce(
        (m["tag"] == "a") & attr(m, "href").startswith("#footnote-anchor"), F.lit(False)))
    body = F.coalesce(_pick(sub, lambda m: F.array_contains(m["classes"], "footnote-content")), root)
    prefix = F.coalesce(F.concat(F.lit("Footnote "), _clean(number["text"]), F.lit(": ")), F.lit(""))
    return let(F.struct(_rich(body, sub, url).alias("r"), prefix.alias("p")), lambda x: F.when(x["r"]["text"] != "", make_block(
        "paragraph", text=F.concat(x["p"], x["r"]["text"]), annotations=shift_ranges(x["r"]["ranges"], F.length(x["p"])),
        text_style=x["r"]["style"],
    )))


@handler("substack.paywall")
def paywall(root: Column, sub: Column, url: Column) -> Column:
    """B17."""
    head = _pick(sub, lambda m: F.array_contains(m["classes"], "paywall-title") | m["tag"].isin("h1", "h2", "h3"))
    title = F.coalesce(_clean(F.coalesce(head["text"], root["text"])), _clean(attr(root, "aria-label")), F.lit(PAYWALL_TITLE))
    return let(_rich(root, sub, url), lambda r: _embed(
        label=F.lit(SUBSTACK), provider=F.lit("substack"), title=title, text=F.coalesce(F.nullif(r["text"], F.lit("")), title),
        text_annotations=r["ranges"], text_style=r["style"], href=_first_link(sub, url),
    ))


@handler("substack.subscribe-widget")
def subscribe(root: Column, sub: Column, url: Column) -> Column:
    """B17."""
    state = F.when(F.array_contains(root["classes"], "is-fully-subscribed"), F.lit("Subscribed")).otherwise(F.lit("Subscribe"))
    return let(_rich(root, sub, url), lambda r: let(F.coalesce(F.nullif(r["text"], F.lit("")), state), lambda t: _embed(
        label=F.lit(SUBSTACK), provider=F.lit("substack"), presentation=F.lit("cta"), title=t, text=t,
        text_annotations=r["ranges"], text_style=r["style"], href=_first_link(sub, url),
    )))


# ---- post cards ----------------------------------------------------------
def _inside(m: Column, outer: Column) -> Column:
    return F.coalesce((m["node_id"] > outer["node_id"]) & (m["node_id"] <= outer["end_id"]), F.lit(False))


def _href(sub: Column) -> Column:
    """Link of a card: its status page, else its first link."""
    anchors = F.transform(F.filter(sub, lambda m: is_(m, "anchor")), lambda m: attr(m, "href"))
    status = F.filter(anchors, lambda h: F.regexp_like(h, F.lit("/status/(?!.*analytics)")))
    return absolute_post_url(F.coalesce(first_of(status), first_of(anchors)))


def _card_facts(sub: Column) -> Column:
    """Who wrote a card and when; notes around it."""
    author = _pick(sub, lambda m: _named(m, "User-Name"))

    def build(a: Column) -> Column:
        names = F.filter(
            F.transform(F.filter(sub, lambda m: (m["tag"] == "span") & _inside(m, a)), lambda m: normalize_text(m["text"])), lambda t: t != ""
        )
        spans = F.transform(F.filter(sub, lambda m: m["tag"] == "span"), lambda m: normalize_text(m["text"]))
        moment = first_tag(sub, "time")
        avatar = _pick(sub, lambda m: _named(m, "Tweet-User-Avatar"))
        reply = _pick(sub, lambda m: (m["tag"] == "div") & F.coalesce(attr(m, "dir") == "ltr", F.lit(False)) & (
            normalize_text(m["text"]).startswith(REPLY_PREFIXES[0]) | normalize_text(m["text"]).startswith(REPLY_PREFIXES[1])))
        shown = _pick(sub, lambda m: F.coalesce(attr(m, "aria-label").isin(*SHOW_ORIGINAL_LABELS), F.lit(False)))
        source = F.try_element_at(F.filter(sub, lambda m: F.coalesce(attr(m, "dir") == "ltr", F.lit(False)) & (
            (m["node_id"] <= shown["node_id"]) & (m["end_id"] >= shown["node_id"]))), F.lit(-1))
        return F.struct(
            first_of(F.filter(names, lambda t: (t != "·") & ~t.startswith("@") & ~is_date_text(t))).alias("name"),
            F.coalesce(
                first_of(F.filter(names, lambda t: t.startswith("@"))),
                first_of(F.filter(spans, lambda t: F.regexp_like(t, F.lit("^@[A-Za-z0-9_]+$")))),
            ).alias("handle"),
            F.nullif(attr(_pick(sub, lambda m: (m["tag"] == "img") & _inside(m, avatar)), "src"), F.lit("")).alias("avatar"),
            F.exists(sub, lambda m: _named(m, "icon-verified") | F.coalesce(attr(m, "aria-label").isin(*VERIFIED_LABELS), F.lit(False))).alias("verified"),
            F.nullif(attr(moment, "datetime"), F.lit("")).alias("at"), _clean(moment["text"]).alias("at_text"),
            attr(_pick(sub, lambda m: (m["tag"] == "img") & _inside(m, a) & ~_inside(m, avatar)), "src").alias("badge"),
            _clean(reply["text"]).alias("reply"),
            _clean(_pick(sub, lambda m: is_(m, "anchor") & _inside(m, reply) & attr(m, "href").startswith("/"))["text"]).alias("reply_to"),
            F.nullif(F.trim(F.regexp_replace(normalize_text(source["text"]), "(?i)\\s*(?:显示原文|Show original)\\s*$", "")), F.lit("")).alias("translated"),
            F.coalesce(_clean(shown["text"]), _clean(attr(shown, "aria-label"))).alias("action"),
            first_of(F.filter(F.transform(F.filter(sub, lambda m: m["tag"] == "div"), lambda m: normalize_text(m["text"])), lambda t: t.isin(*AI_LABELS))).alias("ai"),
        )

    return let(author, build)


def _photo_of(m: Column) -> Column:
    p = m["photo"]
    return F.struct(p["src"].alias("src"), p["display_src"].alias("display_src"), p["alt"].alias("alt"), p["href"].alias("href")).cast(PHOTO)


def _items(sub: Column, quotes: Column, ddl: str) -> Column:
    """Text, cover, previews and photos of one card in document order; what a quoted card holds is its own."""
    free = F.filter(sub, lambda m: ~F.exists(quotes, lambda q: _inside(m, q)))

    def build(own: Column) -> Column:
        text = _pick(own, lambda m: _named(m, "tweetText"))
        # emoji drawn as images read as their alt texts, and stay marked
        written = let(text, lambda n: emoji_text(n, F.filter(own, lambda m: _inside(m, n)), F.col("own_texts")))
        text_item = let(written, lambda t: F.when(t["text"] != "", make_struct(
            ddl, node_id=text["node_id"], type=F.lit("text"), text=t["text"], annotations=t["annotations"])))
        cover = _pick(own, lambda m: _named(m, "article-cover-image"))
        picture = _pick(own, lambda m: (m["tag"] == "img") & _inside(m, cover))
        after = F.transform(F.filter(own, lambda m: (m["tag"] == "div") & F.coalesce(attr(m, "dir") == "auto", F.lit(False)) & (
            m["node_id"] > cover["end_id"])), lambda m: normalize_text(m["text"]))
        cover_item = F.when(F.nullif(attr(picture, "src"), F.lit("")).isNotNull(), make_struct(
            ddl, node_id=cover["node_id"], type=F.lit("article-cover"), cover=make_struct(
                COVER, cover_url=attr(picture, "src"), cover_alt=F.nullif(attr(picture, "alt"), F.lit("")),
                title=F.get(after, F.lit(0)), excerpt=F.get(after, F.lit(1)), href=_href(own),
            )))
        marks = F.filter(own, lambda m: _named(m, "previewInterstitial", "videoPlayer") | F.coalesce(
            attr(m, "aria-label").isin(*EMBEDDED_VIDEO_LABELS), F.lit(False)))
        is_preview = lambda m: F.exists(marks, lambda v: (v["node_id"] == m["node_id"]) | _inside(v, m))
        roots = F.filter(own, lambda m: is_(m, "photo") & is_preview(m))
        bare = F.filter(marks, lambda v: ~F.exists(roots, lambda r: _inside(v, r)) & ~_named(v, "videoPlayer"))

        def preview(m: Column) -> Column:
            inner = F.filter(own, lambda x: _inside(x, m))
            img = first_tag(inner, "img")
            src = first_nonempty(attr(img, "src"), m["photo"]["display_src"])
            spans = F.transform(F.filter(inner, lambda x: x["tag"] == "span"), lambda x: normalize_text(x["text"]))
            return F.when(src.isNotNull(), make_struct(ddl, node_id=m["node_id"], type=F.lit("video-preview"), preview=make_struct(
                PREVIEW, src=src, alt=F.nullif(attr(img, "alt"), F.lit("")), href=absolute_post_url(m["link"]["href"]),
                duration_text=first_of(F.filter(spans, is_duration_text)), aspect_ratio=m["photo"]["aspect_ratio"],
            )))

        previews = F.transform(F.concat(roots, bare), preview)
        loose = F.filter(own, lambda m: is_(m, "photo") & m["photo"]["src"].isNotNull() & ~is_preview(m) & ~_inside(m, cover))
        photo_item = F.when(F.size(loose) > 0, make_struct(
            ddl, node_id=first_of(loose)["node_id"],
            type=F.when(F.size(loose) == 1, F.lit("photo")).otherwise(F.lit("photo-group")), photos=F.transform(loose, _photo_of),
        ))
        return F.array_compact(F.concat(F.array(text_item, cover_item, photo_item), previews))

    return let(free, build)


def _ordered(items: Column) -> Column:
    return F.array_sort(items, lambda a, b: a["node_id"] - b["node_id"])


def _card(ddl: str, facts: Column, items: Column, href: Column, **extra: Column) -> Column:
    line = F.concat_ws(" · ", facts["name"], facts["handle"], facts["at_text"])
    excerpt = F.coalesce(first_of(F.filter(items, lambda i: i["type"] == "text"))["text"], F.lit(""))
    return F.when(F.size(items) > 0, make_struct(
        ddl, title=F.when(line == "", F.lit("X Tweet")).otherwise(line), excerpt=excerpt, href=href, author_name=facts["name"],
        author_handle=facts["handle"], author_avatar_url=facts["avatar"], author_verified=facts["verified"], published_at=facts["at"],
        published_at_text=facts["at_text"], author_badge_avatar_url=facts["badge"], reply_context_text=facts["reply"],
        reply_to_handle=facts["reply_to"], translation_source_text=facts["translated"], translation_action_text=facts["action"],
        ai_generated_text=facts["ai"], items=items, **extra,
    ))


@handler("x.simple-tweet")
def post_card(root: Column, sub: Column, url: Column) -> Column:
    """A post with its media and at most one level of quoted posts."""
    inner_tweet = _pick(sub, lambda m: _named(m, "tweet"))
    named = lambda m, *ids: F.exists(sub, lambda x: _named(x, *ids) & _inside(x, m))
    content = ["tweetText", "tweetPhoto", "previewInterstitial", "videoPlayer", "article-cover-image"]
    cards = F.filter(sub, lambda m: (_named(m, *CARD_IDS) | F.coalesce(attr(m, "role") == "link", F.lit(False)))
                     & ~F.coalesce(m["node_id"] == inner_tweet["node_id"], F.lit(False)) & named(m, "User-Name") & named(m, *content))
    quotes = let(cards, lambda c: F.filter(c, lambda m: ~F.exists(c, lambda o: _inside(m, o))))

    def quoted(q: Column) -> Column:
        inner = under(sub, q)
        none = F.filter(inner, lambda _: F.lit(False))
        parts = F.struct(_card_facts(inner).alias("facts"), _ordered(_items(inner, none, QUOTED_ITEM)).alias("items"))
        return let(parts, lambda p: let(_card(QUOTED, p["facts"], p["items"], _href(inner)), lambda c: F.when(
            c.isNotNull(), make_struct(ITEM, node_id=q["node_id"], type=F.lit("quoted-tweet"), quoted=c))))

    def build(q: Column) -> Column:
        items = F.concat(_items(sub, q, ITEM), F.filter(F.transform(q, quoted), lambda i: i.isNotNull()))
        free = F.filter(sub, lambda m: ~F.exists(q, lambda x: _inside(m, x)))
        parts = F.struct(_card_facts(free).alias("facts"), _ordered(items).alias("items"))
        return let(parts, lambda p: let(_card(TWEET, p["facts"], p["items"], _href(sub)), lambda c: F.when(
            c.isNotNull(), make_block("simple-tweet", tweet=c))))

    return let(quotes, build)


"""The second, block-marked extraction that a merge takes as its primary side.

It looks only at elements marked `data-block`, in page order, and asks in another
order: list, typed list item, quote, post, video, gif, gallery, image, link,
table, code, then heading or paragraph. Items of one kind without anything else
between them form a list. It shares the marked candidate rows of the first
extraction, so both sides come from one parse.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.css import text_style
from ..functions.text import handwritten_marker, normalize_text
from ..schema import BLOCK_FIELDS, VIDEO
from .blocks import _code, _gallery, _image, _table, by_node, make_block, under
from .marks import is_, within
from .richtext import annotations
from .tree import attr, first_of, let, make_struct

# Fixed values.
NON_TEXT_TAGS = ["img", "video", "iframe"]
POST_VIDEO_ID = "amplify_video(?:_thumb)?/([0-9]+)"


def link_block(n: Column, sub: Column) -> Column:
    """An element whose whole text is its first link."""
    def build(a: Column) -> Column:
        text = normalize_text(a["text"])
        whole = (F.coalesce(attr(a, "href"), F.lit("")) != "") & (text != "") & (text == normalize_text(n["text"]))
        return F.when(whole, make_block("link", text=text, href=attr(a, "href"), target=attr(a, "target")))

    return let(first_of(F.filter(sub, lambda m: is_(m, "anchor"))), build)


def player_of(sub: Column) -> Column:
    """What a player inside a photo shows: its poster, direct source, and whether it is a blob."""
    photo = first_of(F.filter(sub, lambda m: is_(m, "photo")))

    def build(p: Column) -> Column:
        inner = under(sub, p)
        has_player = F.exists(inner, lambda m: attr(m, "data-testid") == "videoPlayer")
        video = first_of(F.filter(inner, lambda m: m["tag"] == "video"))
        source = first_of(F.filter(inner, lambda m: (m["tag"] == "source") & attr(m, "src").startswith("blob:")))
        return F.when(F.coalesce(has_player, F.lit(False)) & video.isNotNull(), F.struct(
            source.isNotNull().alias("blob"), F.nullif(attr(video, "src"), F.lit("")).alias("src"),
            F.nullif(attr(video, "poster"), F.lit("")).alias("poster"),
            F.nullif(F.regexp_extract(F.concat_ws(" ", attr(video, "poster"), attr(video, "src")), POST_VIDEO_ID, 1), F.lit("")).alias("video_id"),
            attr(video, "aria-label").alias("aria_label"),
        ))

    return let(photo, build)


def with_second(parts: DataFrame, wanted: Column | None = None) -> DataFrame:
    """Adds `second`: a candidate's marked, is_item and block as the second extraction sees it; null where it is not `wanted`.

    `block` is null where nothing is made. A blob player needs a capture:
    `attach_captures` fills or drops its video block.
    """
    asked = F.lit(True) if wanted is None else wanted
    n, sub, text = F.col("n"), F.col("sub"), F.col("wrap")
    is_quote = n["tag"] == "blockquote"
    heading = F.coalesce(F.regexp_extract(n["tag"], "^h([1-6])$", 1).try_cast("int"), attr(n, "data-pl-heading-level").try_cast("int"))
    rich = F.col("code_root").isNotNull() | F.col("special_root").isNotNull() | F.exists(
        sub, lambda m: is_(m, "photo") | m["tag"].isin(*NON_TEXT_TAGS))
    typed = ~is_quote & heading.isNull() & ~rich & (handwritten_marker(text) != "")
    listed = attr(n, "data-pl-list-kind")
    kind = (
        F.when(within(n, "ol") | F.coalesce(listed == "ordered", F.lit(False)), "ordered")
        .when(within(n, "ul") | F.coalesce(listed == "unordered", F.lit(False)), "unordered").when(typed, "ordered")
    )
    spans = F.filter(sub, lambda m: is_(m, "text_span"))
    staged = parts.withColumns({name: F.when(asked, c) for name, c in {
        "second_kind": kind, "player": player_of(sub), "span_ranges": annotations(spans, text), "second_level": heading,
    }.items()})
    style = text_style(attr(n, "style"))
    caption = within(n, "caption") | (n["tag"] == "figcaption")
    player = F.col("player")
    gif = F.when(player.isNotNull() & ~player["blob"] & player["src"].isNotNull(), make_block(
        "gif", video=make_struct(VIDEO, src=player["src"], poster=player["poster"], transport=F.lit("direct"))))
    video = F.when(player["blob"], make_block("video", video=make_struct(
        VIDEO, video_id=player["video_id"], poster=player["poster"], transport=F.lit("hls"), aria_label=player["aria_label"])))
    ranges, text = F.col("span_ranges"), F.col("wrap")
    spoken = lambda t, **kw: make_block(t, text=text, annotations=ranges, text_style=style, **kw)
    item = F.struct(text.alias("text"), ranges.alias("annotations"), style.alias("style"))
    photo = first_of(F.filter(sub, lambda m: is_(m, "photo")))
    with_text = text != ""
    block = F.coalesce(
        F.when(F.col("second_kind").isNotNull() & with_text, make_block("list", kind=F.col("second_kind"), items=F.array(item))),
        F.when(is_quote & with_text, spoken("quote")),
        F.when(~is_quote, F.col("special_block")),
        video, gif,
        let(_gallery(n, sub), lambda g: F.when(g.isNotNull(), make_block("image-gallery", gallery=g))),
        F.when(photo.isNotNull(), let(photo["photo"], lambda i: F.when(i.isNotNull(), make_block("image", image=i)))),
        link_block(n, sub),
        F.when(F.col("table_root").isNotNull(), let(_table(F.col("table_root"), sub), lambda t: F.when(t.isNotNull(), make_block("table", table=t)))),
        F.when(F.col("code_root").isNotNull(), let(_code(F.col("code_root"), sub), lambda c: F.when(
            c["text"] != "", make_block("code", text=c["text"], code=c["code"])))),
        F.when(with_text & F.col("second_level").isNotNull(), spoken("heading", level=F.col("second_level"))),
        F.when(with_text, spoken("paragraph", role=F.when(caption, "caption"))),
    )
    return staged.withColumn("second", F.when(asked, F.struct(
        F.coalesce(is_(n, "data_block"), F.lit(False)).alias("marked"), F.col("second_kind").isNotNull().alias("is_item"), block.alias("block"),
    )))


def second_blocks(parts: DataFrame) -> DataFrame:
    """Candidate rows after `with_parts` to (page_id, node_id, marked, is_item, block)."""
    return with_second(parts).select("page_id", F.col("n.node_id").alias("node_id"), "second.*")


def second_extraction(blocks: DataFrame) -> DataFrame:
    """Numbered blocks `{page}-b{n}`; list items of one kind in a row become one list.

    Any other marked element ends a list, also one that makes no block; an empty
    item does not.
    """
    w = Window.partitionBy("page_id").orderBy("node_id")
    seen = blocks.filter("marked and not (is_item and block is null)")
    prev = F.lag(F.struct("is_item", F.col("block.kind").alias("kind"))).over(w)
    same = F.col("is_item") & F.coalesce(prev["is_item"] & (prev["kind"] == F.col("block.kind")), F.lit(False))
    grouped = seen.withColumn("starts", ~same).withColumn("group", F.sum(F.col("starts").cast("int")).over(w))
    merged = grouped.groupBy("page_id", "group").agg(
        F.min("node_id").alias("node_id"), F.min_by(F.struct("block"), "node_id").alias("first"),
        F.array_sort(F.collect_list(F.when(F.col("block.items").isNotNull(), F.struct("node_id", F.col("block.items").alias("items")))), by_node).alias("found"),
    ).filter("first.block is not null")
    block = F.col("first.block")
    items = F.flatten(F.transform("found", lambda x: x["items"]))
    whole = F.when(block["type"] == "list", block.withField("items", items)).otherwise(block)
    numbered = merged.withColumn("block", whole).withColumn("block_pos", F.row_number().over(w) - 1)
    return numbered.select(
        "page_id", "block_pos", F.concat(F.col("page_id").cast("string"), F.lit("-b"), F.col("block_pos") + 1).alias("block_id"), "block"
    )


def attach_captures(blocks: DataFrame, sources: DataFrame) -> DataFrame:
    """Blob players get the captured playlists of their video; without a capture there is no block.

    sources: page_id, video_id, poster, hls, src (ST4, keyed by the page shown in the tab).
    """
    found = sources.select("page_id", F.col("video_id").alias("captured_id"), "hls", F.col("src").alias("captured_src"), F.col("poster").alias("captured_poster"))
    wanted = F.col("block.video.video_id")
    joined = blocks.join(found, (blocks["page_id"] == found["page_id"]) & (wanted == F.col("captured_id")), "left").drop(found["page_id"])
    is_video = (F.col("block.type") == "video") & (F.col("block.video.transport") == "hls")
    filled = F.col("block").withField("video", make_struct(
        VIDEO, video_id=wanted, src=F.nullif(F.col("captured_src"), F.lit("")),
        source_type=F.when(F.regexp_like(F.col("captured_src"), F.lit("(?i)\\.m3u8(?:$|\\?)")), "application/x-mpegURL"),
        transport=F.lit("hls"), hls=F.col("hls"), poster=F.coalesce("captured_poster", "block.video.poster"),
        aria_label=F.col("block.video.aria_label"),
    ))
    kept = joined.withColumn("block", F.when(is_video, F.when(F.coalesce("captured_src", F.lit("")) != "", filled)).otherwise(F.col("block")))
    return kept.select(*blocks.columns)

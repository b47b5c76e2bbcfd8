"""Candidates to typed blocks.

Everything up to the finished block is column work on the candidate's own row
(`n`, `sub`, `page`), without a join or a shuffle. Pages were hashed by page_id
before; consuming, list grouping and numbering are windows over that.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.css import style_value, text_style
from ..functions.media import clean_language, first_nonempty, trimmed
from ..functions.numbers import is_duration_text, positive_number
from ..functions.text import list_marker, normalize_code, normalize_prewrap, normalize_text
from ..functions.urls import embed_provider, provider_name
from ..schema import BLOCK_FIELDS, CODE, EMBED, GALLERY, IMAGE, TABLE
from ..sources.adapters import Adapter
from .marks import is_, within
from .richtext import annotations, cut_front
from .tree import any_of, attr, first_of, let, make_struct

Handler = Callable[[Column, Column, Column], Column]


def make_block(type_: str, **fields: Column) -> Column:
    """A block struct with every family present; absent ones null."""
    values = {"type": F.lit(type_), **fields}
    return F.struct(*[
        (values[k] if k in values else F.lit(None)).cast(ddl).alias(k) for k, ddl in BLOCK_FIELDS.items()
    ])


def below(sub: Column, *names: str) -> Column:
    return F.filter(sub, lambda m: is_(m, *names))


def any_below(sub: Column, *names: str) -> Column:
    return F.exists(sub, lambda m: is_(m, *names))


def under(sub: Column, root: Column) -> Column:
    """Part of `sub` inside `root`."""
    return F.filter(sub, lambda m: (m["node_id"] > root["node_id"]) & (m["node_id"] <= root["end_id"]))


def first_tag(sub: Column, tag: str) -> Column:
    return first_of(F.filter(sub, lambda m: m["tag"] == tag))


# ---- facts a classification needs ---------------------------------------
def with_facts(cands: DataFrame) -> DataFrame:
    """Normalized texts, list kind, component root: read by several steps, so computed once."""
    n, sub = F.col("n"), F.col("sub")
    spans = F.transform(below(sub, "text_span"), lambda s: normalize_text(s["text"]))
    staged = cands.withColumns({
        "flat": normalize_text(n["text"]),
        "wrap": normalize_prewrap(n["text"]),
        "in_player": is_(n, "data_block") & any_below(sub, "media_mark"),
        "special_root": F.when(n["special"] >= 0, n).otherwise(_first_special(sub)),
        "frame": F.when(is_(n, "frame"), n).otherwise(first_of(below(sub, "frame"))),
        "code_root": F.when(is_(n, "code"), n).otherwise(first_of(below(sub, "code"))),
        "table_root": F.when(is_(n, "table"), n).otherwise(first_of(below(sub, "table"))),
    })
    span_text = F.when(F.size(spans) > 0, F.array_join(F.filter(spans, lambda s: s != ""), " "))
    typed = is_(n, "data_block") & (list_marker(F.col("wrap")) != "")
    return staged.withColumns({
        "span_text": F.when(F.col("in_player"), span_text),
        "list_kind": F.when(is_(n, "ordered") | typed, "ordered").when(is_(n, "unordered"), "unordered"),
    })


def _first_special(sub: Column) -> Column:
    """First match of the component listed first in the site rules."""
    hits = F.filter(sub, lambda m: m["special"] >= 0)
    lowest = F.array_min(F.transform(hits, lambda m: m["special"]))
    return let(lowest, lambda k: first_of(F.filter(hits, lambda m: m["special"] == k)))


def with_family(facts: DataFrame) -> DataFrame:
    """B2: first matching family, in this order; null for wrappers that stay silent."""
    n, sub = F.col("n"), F.col("sub")
    galleries = F.size(below(sub, "gallery"))
    is_gallery = (galleries > 1) | (is_(n, "gallery") & (F.size(below(sub, "image")) > 1))
    # A rule, or a wrapper whose only content is one
    divider = is_(n, "divider") | (F.col("lone_divider") & (F.col("flat") == ""))
    label = F.col("in_player") & F.col("span_text").isNull() & ((F.col("flat") == "GIF") | is_duration_text(F.col("flat")))
    silent = any_below(sub, "ordered", "unordered", "code") | within(n, "code") | label
    family = (
        F.when(n.isNull(), None)
        .when(divider, "divider")
        .when(is_gallery, "image-gallery")
        .when(is_(n, "image"), "image")
        .when(F.col("frame").isNotNull(), "embed")
        .when(is_(n, "heading"), "heading")
        .when(F.col("code_root").isNotNull(), "code")
        .when(F.col("table_root").isNotNull(), "table")
        .when(F.col("list_kind").isNotNull(), "list")
        .when(is_(n, "quote"), "quote")
        .when(~silent, "paragraph")
    )
    return facts.withColumn("family", family)


# ---- conversion ----------------------------------------------------------
def _image(n: Column, sub: Column) -> Column:
    """Photos of posts first, then the element's own or first inner image."""
    own = F.when(n["tag"] == "img", n["image"]).otherwise(first_tag(sub, "img")["image"])
    at = lambda k: trimmed(attr(n, k))
    bare = first_nonempty(at("src"), at("data-src"), at("data-original"))
    fallback = F.when(bare.isNotNull(), make_struct(IMAGE, src=bare, alt=at("alt"), href=n["link"]["href"]))
    alt = lambda i: i.withField("alt", F.coalesce(i["alt"], at("alt")))
    return F.coalesce(n["photo"], F.col("outer_photo"), let(own, lambda i: F.when(i.isNotNull(), alt(i))), fallback)


def _gallery(n: Column, sub: Column) -> Column:
    """Two or more images with different sources, in order; posts keep every photo."""
    def distinct(items: Column) -> Column:
        sources = F.transform(items, lambda i: i["src"])
        return F.filter(items, lambda i, k: F.array_position(sources, i["src"]) == k + 1)

    present = lambda items: F.filter(items, lambda i: i.isNotNull())
    photos = present(F.transform(below(sub, "photo"), lambda m: m["photo"]))
    photos = F.transform(photos, lambda p: p.withField("aspect_ratio", F.lit(None).cast("double")).withField(
        "object_fit", F.lit(None).cast("string")).withField("object_position", F.lit(None).cast("string")))
    images = F.transform(F.filter(sub, lambda m: m["tag"] == "img"), lambda m: m["image"])
    of_post = F.struct(photos.alias("items"), first_of(F.transform(below(sub, "photo"), lambda m: m["photo"]["aspect_ratio"])).alias("aspect_ratio"))
    ratio = positive_number(attr(n, "data-pl-media-ratio"))
    plain = let(distinct(present(images)), lambda items: F.struct(
        items.alias("items"), F.coalesce(ratio, first_of(items)["aspect_ratio"]).alias("aspect_ratio")
    ))
    enough = lambda g: F.when(F.size(g["items"]) >= 2, g.cast(GALLERY))
    return F.coalesce(F.when(F.col("platform") == "x", let(of_post, enough)), let(plain, enough))


def _embed(n: Column, e: Column) -> Column:
    """A link to what the frame shows; the frame itself is not kept."""
    at = lambda m, k: trimmed(attr(m, k))
    source = F.struct(
        first_nonempty(at(e, "src"), at(e, "data-src")).alias("href"),
        first_nonempty(at(e, "title"), at(e, "aria-label"), at(n, "title")).alias("title"),
        first_nonempty(
            at(e, "poster"), at(e, "data-poster"), at(n, "data-poster"), at(e, "data-thumbnail"), at(n, "data-thumbnail")
        ).alias("poster"),
    )

    def build(p: Column) -> Column:
        title = F.coalesce(p["title"], provider_name(p["provider"]))
        picture = F.array(F.struct(
            p["poster"].alias("src"), p["href"].alias("href"), title.alias("alt"), F.lit(None).cast("double").alias("aspect_ratio"),
            F.lit("cover").alias("object_fit"), F.lit(None).cast("string").alias("object_position"),
        ))
        return F.when(p["href"].isNotNull(), make_struct(
            EMBED, label=provider_name(p["provider"]), provider=p["provider"], href=p["href"], title=title, text=title,
            media=F.when(p["poster"].isNotNull(), picture),
        ))

    return let(let(source, lambda p: p.withField("provider", embed_provider(p["href"]))), build)


def _code(root: Column, sub: Column) -> Column:
    """(text, code struct)."""
    inner = under(sub, root)
    code = F.when(root["tag"] == "code", root).otherwise(first_tag(inner, "code"))
    pre = F.when(root["tag"] == "pre", root).otherwise(first_tag(inner, "pre"))
    first_div = first_of(F.filter(inner, lambda m: (m["parent_id"] == root["node_id"]) & (m["tag"] == "div") & (m["sib_pos"] == 1)))
    header = let(first_div, lambda d: first_tag(under(inner, d), "span")["text"])
    text = normalize_code(F.coalesce(code["text"], pre["text"], root["text"]))
    language = clean_language(code["lang"], header)
    tokens = F.when(F.size(code["pieces"]) > 0, code["pieces"])
    return F.struct(text.alias("text"), F.struct(language.alias("language"), tokens.alias("tokens")).cast(CODE).alias("code"))


def _table(root: Column, sub: Column) -> Column:
    """B8."""
    inner = under(sub, root)
    kids_of = lambda row: F.filter(inner, lambda m: m["parent_id"] == row["node_id"])

    def cells_of(row: Column) -> Column:
        return let(kids_of(row), lambda kids: let(
            F.filter(kids, lambda k: is_(k, "cell")),
            lambda hit: F.when(F.size(hit) > 0, hit).otherwise(F.filter(kids, lambda k: normalize_text(k["text"]) != "")),
        ))

    def cell(m: Column) -> Column:
        span = lambda *names: F.coalesce(*[attr(m, x) for x in names]).try_cast("int")
        cols, rows = span("colspan", "aria-colspan"), span("rowspan", "aria-rowspan")
        styled = first_of(F.filter(under(inner, m), lambda t: (
            is_(t, "text_span") | t["tag"].isin("span", "div") | attr(t, "dir").isin("ltr", "auto")
        ) & (normalize_text(t["text"]) != "")))
        size = F.coalesce(style_value(attr(styled, "style"), "font-size"), style_value(attr(m, "style"), "font-size"))
        align = F.coalesce(style_value(attr(m, "style"), "text-align"), style_value(attr(styled, "style"), "text-align"))
        pair = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
        pairs = F.filter(F.array(pair("font-size", size), pair("text-align", align)), lambda e: e["value"].isNotNull())
        return F.struct(
            normalize_prewrap(m["text"]).alias("text"),
            ((m["tag"] == "th") | F.coalesce(attr(m, "role").isin("columnheader", "rowheader"), F.lit(False))).alias("header"),
            F.when(cols > 1, cols).alias("col_span"), F.when(rows > 1, rows).alias("row_span"),
            F.map_from_entries(pairs).alias("style"),
        )

    marked = below(inner, "row")
    direct = F.filter(kids_of(root), lambda k: F.size(cells_of(k)) > 0)
    rows = F.when(F.size(marked) > 0, marked).otherwise(let(direct, lambda d: F.when(F.size(d) > 0, d).otherwise(F.array(root))))
    grid = F.filter(F.transform(rows, lambda r: F.transform(cells_of(r), cell)), lambda r: F.exists(r, lambda x: x["text"] != ""))
    width = lambda r: F.aggregate(r, F.lit(0), lambda acc, x: acc + F.coalesce(x["col_span"], F.lit(1)))
    return let(grid, lambda g: F.when(F.size(g) > 0, F.struct(
        g.alias("rows"), F.array_max(F.transform(g, width)).alias("column_count")
    ).cast(TABLE)))


def heading_level(n: Column) -> Column:
    by_tag = F.regexp_extract(n["tag"], "^h([1-6])$", 1).try_cast("int")
    marked = attr(n, "data-pl-heading-level").try_cast("int")
    return F.coalesce(by_tag, F.when(marked.between(1, 6), marked), F.lit(2))


def with_parts(typed: DataFrame, handlers: dict[str, Handler], adapters: list[Adapter]) -> DataFrame:
    """The pieces of each family, one column per family, null for the others."""
    n, sub, fam = F.col("n"), F.col("sub"), F.col("family")
    only = lambda f, c: F.when(fam == f, c)
    text = (
        F.when(fam == "heading", F.col("flat"))
        .when(fam == "quote", F.col("wrap"))
        .when(fam == "paragraph", F.coalesce("span_text", "wrap"))
    )
    marker = F.when((fam == "list") & (F.col("list_kind") == "ordered"), F.length(list_marker(F.col("wrap")))).otherwise(0)
    staged = typed.withColumns({
        "body": F.when(fam == "list", F.col("wrap")).otherwise(text),
        "marker": marker,
        "code_part": only("code", _code(F.col("code_root"), sub)),
        "table_part": only("table", _table(F.col("table_root"), sub)),
        "gallery_part": only("image-gallery", _gallery(n, sub)),
        "image_part": only("image", _image(n, sub)),
        "embed_part": only("embed", _embed(n, F.col("frame"))),
        "special_block": special_blocks(n, sub, handlers, adapters),
    })
    return staged.withColumn("ranges", F.when(F.col("body").isNotNull(), annotations(sub, F.col("body"))))


def special_blocks(n: Column, sub: Column, handlers: dict[str, Handler], adapters: list[Adapter]) -> Column:
    """The block a component handler makes, null when there is none.

    A handler's columns are large and know no adapter, so each handler stands in the plan once, whatever number of rules name it.
    """
    root = F.col("special_root")
    block = F.when(F.lit(False), make_block("none"))
    inner = under(sub, root)
    hits: dict[str, list[Column]] = {}
    for a in adapters:
        for k, comp in enumerate(a.special):
            name = (comp.get("handler") or "").strip()
            if handlers.get(name) is not None:
                hits.setdefault(name, []).append((F.col("adapter_id") == a.id) & (root["special"] == k))
    for name, places in hits.items():
        block = F.when(any_of(places), handlers[name](root, inner, F.col("url"))).otherwise(block)
    return block


def finish_blocks(parts: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Adds `block` (null when the candidate makes none) and what it uses up; keeps the columns named in `carry`.

    Rows without a block are dropped after the first window: a filter here would
    be pushed through every projection above and copy their expressions.
    """
    n, fam, sub = F.col("n"), F.col("family"), F.col("sub")
    style = text_style(attr(n, "style"))
    caption = (n["tag"] == "figcaption") | within(n, "caption") | any_below(sub, "caption")
    body, marker, ranges = F.col("body"), F.col("marker"), F.col("ranges")
    item_text = F.when(marker > 0, F.ltrim(F.substring(body, marker + 1, F.length(body)))).otherwise(body)
    item = F.struct(item_text.alias("text"), cut_front(ranges, marker).alias("annotations"), style.alias("style"))
    spoken = (body != "") & fam.isin("heading", "quote", "paragraph")
    made = (
        (fam == "divider") | (fam == "list") | F.coalesce(spoken, F.lit(False))
        | F.coalesce(F.col("code_part.text") != "", F.lit(False)) | F.col("table_part").isNotNull()
        | F.col("gallery_part").isNotNull() | F.col("image_part").isNotNull() | F.col("embed_part").isNotNull()
    )
    fields = {
        "type": fam,
        "role": F.when((fam == "paragraph") & caption, "caption"),
        "level": F.when(fam == "heading", heading_level(n)),
        "kind": F.when(fam == "list", F.col("list_kind")),
        "text": F.coalesce(F.when(fam.isin("heading", "quote", "paragraph"), body), F.col("code_part.text"), F.col("embed_part.text")),
        "annotations": F.when(fam.isin("heading", "quote", "paragraph"), ranges),
        "text_style": F.when(fam.isin("heading", "quote", "paragraph"), style),
        "href": F.col("embed_part.href"),
        "items": F.when(fam == "list", F.array(item)),
        "code": F.col("code_part.code"), "table": F.col("table_part"), "image": F.col("image_part"),
        "gallery": F.col("gallery_part"), "embed": F.col("embed_part"),
    }
    plain = F.struct(*[(fields.get(k, F.lit(None))).cast(ddl).alias(k) for k, ddl in BLOCK_FIELDS.items()])
    special = F.col("special_block")
    is_special = special.isNotNull()
    inner_root = (
        F.when(is_special, F.col("special_root.block_end")).when(fam == "code", F.col("code_root.block_end"))
        .when(fam == "table", F.col("table_root.block_end"))
    )
    end = n["end_id"]
    return parts.select(
        "page_id", "adapter_id", "page",
        F.coalesce(n["node_id"], F.lit(-1)).alias("node_id"), F.coalesce(end, F.lit(-1)).alias("end_id"), "rank",
        F.when(fam == "list", F.col("rank") + F.coalesce(F.col("live_below"), F.lit(0))).alias("end_rank"),
        F.when(is_special | (made & fam.isin("code", "table")), F.greatest(end, inner_root)).when(fam == "divider", end).alias("consume_end"),
        F.when(~is_special & made & (fam == "image-gallery"), end).alias("gallery_end"),
        F.when(~is_special & made & (fam == "embed"), end).alias("embed_end"),
        F.when(F.col("platform") == "x", within(n, "photo")).otherwise(n["tag"] == "img").alias("in_media"),
        n["tag"].isin("iframe", "embed").alias("is_frame"),
        F.coalesce(special, F.when(made, plain)).alias("block"), *carry,
    )


def by_node(a: Column, b: Column) -> Column:
    """Document order; items hold maps, which have no order of their own."""
    return (a["node_id"] - b["node_id"]).cast("int")


# ---- page-wide steps -----------------------------------------------------
def suppress_consumed(rows: DataFrame) -> DataFrame:
    """Drop candidates inside what an earlier candidate used up.

    A running maximum of the consumed ends is enough: intervals nest, so a later
    candidate that starts before that end lies inside.
    """
    w = Window.partitionBy("page_id").orderBy("node_id").rowsBetween(Window.unboundedPreceding, -1)
    covered = lambda end: F.coalesce(F.max(end).over(w) >= F.col("node_id"), F.lit(False))
    kept = rows.withColumn(
        "used",
        covered("consume_end") | (F.col("in_media") & covered("gallery_end")) | (F.col("is_frame") & covered("embed_end")),
    )
    kept = kept.filter(~F.coalesce(F.col("used"), F.lit(False)) & (F.col("block").isNotNull() | (F.col("node_id") < 0)))
    return kept.drop("used", "consume_end", "gallery_end", "embed_end", "in_media", "is_frame")


def group_lists(rows: DataFrame) -> DataFrame:
    """Items of one kind that directly follow each other become one list (gaps and islands)."""
    w = Window.partitionBy("page_id").orderBy("node_id")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    is_list = F.coalesce(F.col("block.type") == "list", F.lit(False))
    inside = F.coalesce(F.max(F.when(is_list, F.col("end_id"))).over(before) >= F.col("node_id"), F.lit(False))
    marked = rows.withColumn("top", is_list & ~inside)
    last = F.max(F.when(F.col("top"), F.struct("end_rank", F.col("block.kind").alias("kind")))).over(before)
    marked = marked.withColumn("last", last)
    follows = F.coalesce(
        (F.col("last.end_rank") + 1 == F.col("rank")) & (F.col("last.kind") == F.col("block.kind")), F.lit(False)
    )
    marked = marked.withColumn("opens", F.col("top") & ~follows)
    number = F.sum(F.col("opens").cast("int")).over(w)
    marked = marked.withColumn("island", F.when(F.col("top"), number).otherwise(-2 - F.col("node_id")))
    group = Window.partitionBy("page_id", "island")
    item = F.get("block.items", F.lit(0))
    filled = F.col("top") & (item["text"] != "")
    # counted over the window, gathered only once per list: copies of a list on each of its rows would be its square
    marked = marked.withColumn("n_items", F.sum(F.when(filled, 1).otherwise(0)).over(group))
    alive = F.col("top") & (F.col("n_items") > 0)
    covered = F.coalesce(F.max(F.when(alive, F.col("end_id"))).over(before) >= F.col("node_id"), F.lit(False))
    marked = marked.withColumn("covered", covered)
    kept = marked.filter(F.when(F.col("top"), F.col("n_items") > 0).otherwise(~F.col("covered")))
    rest = [c for c in rows.columns if c not in ("page_id", "rank", "end_rank")]
    lists = kept.groupBy("page_id", "island").agg(
        F.min_by(F.struct("top", *rest), "node_id").alias("row"),
        F.array_sort(F.collect_list(F.when(filled, F.struct("node_id", item.alias("item")))), by_node).alias("found"),
    )
    block = F.col("row.block")
    merged = F.when(F.col("row.top"), block.withField("items", F.transform("found", lambda x: x["item"]))).otherwise(block)
    return lists.select("page_id", *[merged.alias(c) if c == "block" else F.col(f"row.{c}").alias(c) for c in rest])


def outermost(rows: DataFrame) -> DataFrame:
    """Corpus option: keep only blocks that stand in no other block."""
    w = Window.partitionBy("page_id").orderBy("node_id").rowsBetween(Window.unboundedPreceding, -1)
    inner = F.coalesce(F.max("end_id").over(w) >= F.col("node_id"), F.lit(False))
    return rows.withColumn("inner", inner & (F.col("node_id") >= 0)).filter(~F.col("inner")).drop("inner")


def number_blocks(rows: DataFrame) -> DataFrame:
    """A1: position and id of every block; head rows keep position -1."""
    w = Window.partitionBy("page_id").orderBy("node_id")
    pos = F.row_number().over(w) - 2
    block_id = F.when(pos >= 0, F.concat(F.col("adapter_id"), F.lit(":clean-block-"), pos.cast("string")))
    return rows.withColumns({"block_pos": pos, "block_id": block_id})

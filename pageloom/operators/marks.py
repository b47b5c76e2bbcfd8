"""B1: every selector of every site evaluated once per node, kept as bits.

`f` holds what an element is, `up` what it or an ancestor is. Later steps test
bits instead of selectors. `sub` of an exploded candidate holds the descendants
that matter to it, so a page costs its node count times its depth.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.css import background_url, padding_ratio
from ..functions.media import cdn_image_meta, first_nonempty, first_srcset, trimmed
from ..functions.numbers import aspect_ratio, positive_number
from ..functions.urls import absolute_post_url
from ..kernels import ship_by_value
from ..schema import IMAGE
from ..sources.adapters import Adapter
from .selectors import Matcher, Nodes
from .tree import Tree, attr, first_of, let, make_struct

ship_by_value(__name__)

# Fixed values.
EMBED_SOURCE = "iframe[src], iframe[data-src], embed[src], embed[data-src]"
EXTRA_CANDIDATES = EMBED_SOURCE + ', [data-kind="embed"], figcaption'
PHOTO_SELECTOR = '[data-testid="tweetPhoto"]'
PLAIN_FIGURE = '[data-component-name="Image2ToDOM"]'
COMMON = {
    "frame": EMBED_SOURCE,
    "text_span": '[data-text="true"]',
    "link": 'a[href], [role="link"]',
    "anchor": "a[href]",
    "bold": 'strong, b, [style*="font-weight: bold"], [style*="font-weight: 700"]',
    "italic": 'em, i, [style*="font-style: italic"]',
    "underline": "u",
    "styled": '[style*="font-weight"], [style*="font-style"], [style*="text-decoration"]',
    "emoji": "[data-pl-emoji-url]",
    "media_mark": "[data-pl-media-ratio], [data-pl-media-direction], [data-pl-hls-candidate]",
    "caption": '[data-pl-block-role="caption"]',
    "data_block": "[data-block]",
    "row": 'tr, [role="row"]',
    "cell": 'th, td, [role="columnheader"], [role="rowheader"], [role="cell"], [role="gridcell"]',
    "photo": PHOTO_SELECTOR,
    "ol": "ol",
    "ul": "ul",
}
FAMILIES = ["divider", "heading", "quote", "ordered", "unordered", "image", "gallery", "code", "table"]
BITS = {name: 1 << i for i, name in enumerate(["candidate", "special", *FAMILIES, *COMMON])}
INLINE = ("text_span", "link", "bold", "italic", "underline", "styled", "emoji")


def bits(*names: str) -> int:
    return sum(BITS[n] for n in names)


def is_(n: Column, *names: str) -> Column:
    return n["f"].bitwiseAND(F.lit(bits(*names))) != 0


def within(n: Column, *names: str) -> Column:
    """The element or one of its ancestors is one of these."""
    return n["up"].bitwiseAND(F.lit(bits(*names))) != 0


def candidate_selector(a: Adapter) -> str:
    """B1: everything that may become a block of this site."""
    families = ["block", "paragraph", "divider", "heading", "quote", "ordered", "unordered", "gallery", "image"]
    parts = [a.selector(f) for f in families] + [EXTRA_CANDIDATES, a.selector("code"), a.selector("table")]
    parts += [s["root"] for s in a.special]
    return ", ".join(dict.fromkeys(p.strip() for p in parts if p.strip()))


def _page_image(tree: Tree, m: Column, platform: Column) -> Column:
    """B9 for one img element: source fallback chain, link, ratio."""
    at = lambda n, k: trimmed(attr(n, k))

    def build(p: Column) -> Column:
        source = first_of(F.filter(
            F.slice(tree.nodes, p["node_id"] + 2, p["end_id"] - p["node_id"]),
            lambda s: (s["tag"] == "source") & trimmed(attr(s, "srcset")).isNotNull(),
        ))
        src = first_nonempty(
            at(m, "src"), at(m, "data-src"), at(m, "data-original"), first_srcset(at(m, "srcset")), first_srcset(at(source, "srcset"))
        )
        own = first_nonempty(at(m, "src"), at(m, "data-src"), at(m, "data-original"), first_srcset(at(m, "srcset")), first_srcset(at(m, "data-srcset")))
        plain = F.exists(m["path"], lambda i: F.coalesce(attr(tree.at(i), "data-component-name") == "Image2ToDOM", F.lit(False)))
        meta = F.when(platform == "substack", let(own, lambda o: cdn_image_meta(o, plain)))
        link = F.filter(m["path"], lambda i: is_(tree.at(i), "anchor"))
        return let(F.struct(src.alias("src"), meta.alias("meta"), source.alias("source")), lambda x: F.when(
            x["src"].isNotNull(), make_struct(
                IMAGE, src=x["src"], srcset=first_nonempty(at(m, "srcset"), at(x["source"], "srcset")),
                sizes=first_nonempty(at(m, "sizes"), at(x["source"], "sizes")), alt=at(m, "alt"),
                href=attr(tree.at(F.try_element_at(link, F.lit(-1))), "href"),
                aspect_ratio=F.coalesce(aspect_ratio(attr(m, "width"), attr(m, "height")), x["meta"]["aspect_ratio"]),
                background_color=x["meta"]["background_color"], object_fit=x["meta"]["object_fit"],
                object_position=x["meta"]["object_position"], visual_bleed_scale=x["meta"]["visual_bleed_scale"],
                visual_bleed_mode=x["meta"]["visual_bleed_mode"],
            )
        ))

    picture = F.filter(m["path"], lambda i: (i >= tree.root_id) & (tree.at(i)["tag"] == "picture"))
    return let(tree.at(F.try_element_at(picture, F.lit(-1))), build)


def _media_ratio(tree: Tree, n: Column, line: Column) -> Column:
    """Ratio kept open around an element: a mark or padding below it, else the nearest mark above."""
    inner = F.slice(tree.nodes, n["node_id"] + 2, n["end_id"] - n["node_id"])
    mark = lambda m: positive_number(attr(m, "data-pl-media-ratio"))
    some = lambda r: r.isNotNull()
    below = first_of(F.filter(F.transform(inner, mark), some))
    padded = first_of(F.filter(F.transform(inner, lambda m: padding_ratio(attr(m, "style"))), some))
    above = F.try_element_at(F.filter(F.transform(line, lambda i: mark(tree.at(i))), some), F.lit(-1))
    return F.coalesce(below, padded, above)


def _photo(tree: Tree, n: Column) -> Column:
    """B9/B10 on a post photo: its image, else its background layer."""
    line = F.filter(F.concat(n["path"], F.array(n["node_id"])), lambda i: i >= tree.root_id)
    inner = F.filter(F.slice(tree.nodes, n["node_id"] + 2, n["end_id"] - n["node_id"]), lambda m: m["live"])
    parts = F.struct(
        first_of(F.filter(inner, lambda m: m["tag"] == "img")).alias("img"),
        background_url(attr(first_of(F.filter(inner, lambda m: attr(m, "style").contains("background-image"))), "style")).alias("shown"),
        F.try_element_at(F.filter(line, lambda i: is_(tree.at(i), "anchor")), F.lit(-1)).alias("link"),
        F.coalesce(
            F.try_element_at(F.filter(line, lambda i: attr(tree.at(i), "data-block") == "true"), F.lit(-1)),
            F.try_element_at(F.filter(line, lambda i: tree.at(i)["tag"] == "a"), F.lit(-1)), n["node_id"],
        ).alias("box"),
    )

    def build(p: Column) -> Column:
        src = first_nonempty(attr(p["img"], "src"), p["shown"])
        return F.when(src.isNotNull(), make_struct(
            IMAGE, src=src, display_src=p["shown"], alt=F.nullif(attr(p["img"], "alt"), F.lit("")),
            href=absolute_post_url(attr(tree.at(p["link"]), "href")),
            aspect_ratio=let(tree.at(p["box"]), lambda b: _media_ratio(tree, b, line)),
            object_fit=F.lit("cover"), object_position=F.lit("center center"),
        ))

    return let(parts, build)


MARKS = pa.list_(pa.struct([
    ("f", pa.int32()), ("up", pa.int32()), ("special", pa.int32()), ("in_special", pa.bool_()), ("link_id", pa.int32()),
    ("emoji_id", pa.int32()), ("block_id", pa.int32()), ("photo_id", pa.int32()),
]))
MARKS_DDL = "array<struct<f:int,up:int,special:int,in_special:boolean,link_id:int,emoji_id:int,block_id:int,photo_id:int>>"


def marks_of(pages: pa.ListArray, adapter_ids: pa.Array, root_ids: pa.Array, rules: dict, matcher: Matcher) -> pa.Array:
    """Bits of every node and of its line (the node and its ancestors up to the content root), and the nodes of that line
    that links, emoji, blocks and photos are read from. `rules`: per adapter its selectors by bit and its component roots."""
    nodes = Nodes(pages)
    live = nodes.flag("live")
    found = matcher(nodes, ~nodes.flag("unwrap"))
    f, special = np.zeros(nodes.n, np.int32), np.full(nodes.n, -1, np.int32)
    of_page = np.array(adapter_ids.to_pylist(), object)
    for adapter_id, (tests, components) in rules.items():
        own = live & (of_page[nodes.page] == adapter_id) if nodes.n else live
        for bit, selector in tests.items():
            f |= np.where(own & found[selector], np.int32(bit), np.int32(0))
        for k, selector in reversed(list(enumerate(components))):
            special[own & found[selector]] = k
    at = np.arange(nodes.n)
    roots = np.array([1 << 40 if r is None else r for r in root_ids.to_pylist()], np.int64)
    in_root = at - nodes.base >= roots[nodes.page] if nodes.n else live
    up = f * in_root
    for bit in BITS.values():
        up |= np.where(nodes.below((f & bit != 0) & in_root), np.int32(bit), np.int32(0))
    in_line = (special >= 0) & in_root
    has = lambda name: (f & BITS[name] != 0) & in_root
    ids = lambda pos: pa.array(pos - nodes.base, pa.int32(), mask=pos >= nodes.n)
    flat = pa.StructArray.from_arrays([
        pa.array(f), pa.array(up), pa.array(special), pa.array(in_line | nodes.below(in_line)), ids(nodes.nearest(has("link"))),
        ids(nodes.nearest(has("emoji"))), ids(nodes.outermost_above(has("data_block"))), ids(nodes.nearest(has("gallery"))),
    ], [x.name for x in MARKS.value_type])
    return pa.ListArray.from_arrays(pa.array(nodes.offsets.astype(np.int32)), flat, mask=pages.is_null())


def mark_nodes(clean: DataFrame, adapters: list[Adapter]) -> DataFrame:
    """Adds `f`, `up`, `text`, closest link and images to every node."""
    root_id = F.col("content_root.node_id")
    rules = {a.id: (
        {BITS[name]: s for name, s in {"candidate": candidate_selector(a), **{f: a.selector(f) for f in FAMILIES}, **COMMON}.items()},
        [c["root"] for c in a.special],
    ) for a in adapters}
    matcher = Matcher(list(dict.fromkeys(s for tests, roots in rules.values() for s in [*tests.values(), *roots])))

    @F.arrow_udf(MARKS_DDL)
    def marks(nodes: pa.Array, ids: pa.Array, roots: pa.Array) -> pa.Array:
        return marks_of(nodes, ids, roots, rules, matcher)

    narrow = F.transform("nodes", lambda n: F.struct(*[
        n[c].alias(c) for c in ("end_id", "parent_id", "prev_id", "sib_pos", "sib_last", "tag", "attrs", "classes", "live", "unwrap")]))
    platform = F.create_map(*[F.lit(v) for a in adapters for v in (a.id, a.platform)])[F.col("adapter_id")]
    flagged = clean.withColumns({"marks": marks(narrow, F.col("adapter_id"), root_id), "platform": platform})
    tree = Tree(F.col("nodes"), F.col("texts"), root_id, cleaned=True)

    def settle(n: Column, m: Column) -> Column:
        inline = is_(m, *INLINE)
        link = tree.at(m["link_id"])
        return F.struct(
            n["node_id"].alias("node_id"), n["end_id"].alias("end_id"), n["parent_id"].alias("parent_id"),
            n["sib_pos"].alias("sib_pos"), n["tag"].alias("tag"), n["attrs"].alias("attrs"), n["classes"].alias("classes"), n["path"].alias("path"),
            n["text_from"].alias("text_from"), n["text_to"].alias("text_to"), n["live"].alias("live"),
            n["lang"].alias("lang"), m["special"].alias("special"), m["f"].alias("f"), m["up"].alias("up"),
            m["in_special"].alias("in_special"),
            F.when(inline | m["in_special"], F.struct(
                attr(link, "href").alias("href"), attr(link, "target").alias("target"), attr(link, "style").alias("style"),
            )).alias("link"),
            F.when(inline, attr(tree.at(m["emoji_id"]), "data-pl-emoji-url")).alias("emoji"),
            tree.at(m["block_id"])["end_id"].alias("block_end"), m["photo_id"].alias("photo_id"),
        )

    def with_text(n: Column) -> Column:
        matters = (n["f"] != 0) | n["in_special"] | within(n, "table", "code", "photo")
        pieces = F.filter(F.slice(tree.texts, n["text_from"] + 1, n["text_to"] - n["text_from"]), lambda t: t != "")
        return (
            n.withField("matters", n["live"] & matters)
            .withField("text", F.when(n["live"] & matters, tree.text(n)))
            .withField("pieces", F.when(n["live"] & (n["tag"] == "code"), pieces))
        )

    def with_images(n: Column) -> Column:
        is_img, is_photo = n["live"] & (n["tag"] == "img"), (F.col("platform") == "x") & is_(n, "photo")
        return n.withField("image", F.when(is_img, _page_image(tree, n, F.col("platform")))).withField(
            "photo", F.when(is_photo, _photo(tree, n))
        )

    settled = flagged.withColumn("nodes", F.zip_with("nodes", "marks", settle)).drop("marks")
    texted = settled.withColumn("nodes", F.transform("nodes", with_text))
    return texted.withColumn("nodes", F.transform("nodes", with_images))


PAGE_FIELDS = [
    "url", "title", "header", "post", "not_ready", "root_found", "body_found", "block_count", "text_length", "fixes", "clean_stats", "snapshot",
]


def explode_candidates(marked: DataFrame) -> DataFrame:
    """One row per candidate of a ready page, plus a head row (`n` null) per page with its facts.

    The outer form of inline keeps the planner from inferring a size filter and
    pushing it, with everything it depends on, down to the scan.
    """
    root_id = F.col("content_root.node_id")
    nodes = F.col("nodes")
    ranked = F.transform(F.filter("nodes", lambda n: n["live"]), lambda n, i: F.struct(n.alias("n"), i.alias("rank")))
    found = F.filter(ranked, lambda r: (r["n"]["node_id"] > root_id) & is_(r["n"], "candidate"))

    def row(r: Column) -> Column:
        n = r["n"]
        inner = F.slice(nodes, n["node_id"] + 2, n["end_id"] - n["node_id"])
        kids = F.filter(inner, lambda m: m["live"] & (m["parent_id"] == n["node_id"]))
        return F.struct(
            n.alias("n"), r["rank"].alias("rank"),
            F.filter(inner, lambda m: m["matters"]).alias("sub"),
            F.get(nodes, n["photo_id"])["photo"].alias("outer_photo"),
            let(kids, lambda k: (F.size(k) == 1) & is_(F.get(k, F.lit(0)), "divider")).alias("lone_divider"),
            F.when(is_(n, "ordered", "unordered", "data_block"), F.size(F.filter(inner, lambda m: m["live"]))).alias("live_below"),
            F.when((n["special"] >= 0) | F.exists(inner, lambda m: m["special"] >= 0), F.transform(
                F.slice("texts", n["text_from"] + 1, n["text_to"] - n["text_from"]),
                lambda t, k: F.struct((k + n["text_from"]).alias("k"), t.alias("text")))).alias("own_texts"),
        )

    staged = marked.withColumn("rows", F.when(F.col("not_ready").isNull(), F.transform(found, row)))
    head = F.array(F.when(F.lit(False), F.get("rows", F.lit(0))))
    facts = [f for f in PAGE_FIELDS if f in marked.columns]
    out = staged.withColumn("rows", F.when(F.col("rows").isNull(), head).otherwise(F.concat(head, F.col("rows"))))
    exploded = out.select("page_id", "adapter_id", "platform", "url", F.struct(*facts).alias("page"), F.inline_outer("rows"))
    return exploded.withColumn("page", F.when(F.col("rank").isNull(), F.col("page")))

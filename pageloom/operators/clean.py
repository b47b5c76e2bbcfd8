"""Site fixes, noise removal, attribute and style whitelists, counts.

Removal only flags nodes (`live`), because positions in the array are the
addresses every walk uses. `gone` marks removed subtrees, `live` is false for
those and for unwrapped elements, whose children move up to the next ancestor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.css import background_url, filter_style, padding_ratio
from ..functions.numbers import plain_number
from ..functions.text import normalize_text
from ..sources.adapters import FIX_ORDER, Adapter
from .locate import (
    CAPTION_ROOT,
    CARD,
    CODE_AROUND,
    DATA_BLOCK,
    FOLDED_TEXT,
    HEADER_ONE,
    HEADER_TWO,
    LAID_OUT,
    LAYOUT_PARTS,
    MEDIA_INSIDE,
    ORDERED_ITEM,
    PLAYER,
    RETAINING_COMPONENTS,
    TABLE_AROUND,
    UNORDERED_ITEM,
    page_selectors,
)
from .tree import Tree, any_of, attr, first_of, known_hits, let, per_adapter

# What never belongs to an article, and what always may stay.
REMOVED_TAGS = ["script", "style", "noscript", "button", "input", "textarea", "select", "option", "svg"]
INTERACTIVE_TEST_IDS = ["bookmark", "like", "reply", "retweet", "unlike"]
KEPT_ATTRS = [
    "alt", "aria-label", "contenteditable", "datetime", "dir", "href", "lang", "rel", "role", "src", "srcset", "sizes",
    "style", "target", "title",
]
KEPT_DATA_ATTRS = [
    "data-block", "data-editor", "data-pl-block-role", "data-pl-emoji-url", "data-pl-folded-text",
    "data-pl-heading-level", "data-pl-list-kind", "data-pl-media-ratio", "data-pl-media-cover",
    "data-pl-media-height", "data-pl-media-direction", "data-pl-media-width", "data-pl-hls-candidate",
    "data-original", "data-poster", "data-src", "data-srcset", "data-thumbnail", "data-offset-key", "data-testid",
    "data-text",
]
TABLE_ROLES = ["table", "grid", "row", "columnheader", "rowheader", "cell", "gridcell"]
TABLE_TAGS = ["table", "thead", "tbody", "tr", "th", "td"]
READABLE_TAGS = ["p", "span", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote"]
EMPHASIS_TAGS = ["strong", "b", "em", "i"]
COVER_SEARCH_DEPTH = 6

_NO_ENTRIES = "cast(array() as array<struct<key:string,value:string>>)"


def _entry(key: str, value: Column) -> Column:
    return F.struct(F.lit(key).alias("key"), value.cast("string").alias("value"))


def _with_attrs(n: Column, entries: Column) -> Column:
    """Set attributes; a name set twice keeps its last value."""
    keys = F.transform(entries, lambda e: e["key"])
    last = F.filter(
        entries,
        lambda e, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries), F.lit(1))), lambda x: x["key"] == e["key"]),
    )
    kept = F.map_filter(n["attrs"], lambda k, v: ~F.array_contains(keys, k))
    return F.when(F.size(entries) > 0, n.withField("attrs", F.map_concat(kept, F.map_from_entries(last)))).otherwise(n)


def _with_layout(tree: Tree, n: Column) -> Column:
    """First pass of the layout fix: which elements hold media, and in which direction they lay them out."""
    by_class = F.when(F.array_contains(n["classes"], "r-18u37iz"), "row").when(F.array_contains(n["classes"], "r-eqz5dr"), "column")
    in_card = F.exists(n["path"], lambda i: (i > tree.root_id) & tree.matches(tree.at(i), CARD))
    scope = tree.matches(n, LAID_OUT) | (
        tree.matches(n, LAYOUT_PARTS) & in_card
    )
    return let(tree.has(n, MEDIA_INSIDE), lambda media: n.withField("media", media).withField(
        "direction", F.when(media & scope, by_class)
    ))


def _fix_entries(a: Adapter, tree: Tree, n: Column) -> dict[str, tuple[Column, Column]]:
    """Per fix: attributes it puts on `n` and how many changes that counts as."""
    none = F.expr(_NO_ENTRIES)

    def when(cond: Column, *entries: Column) -> Column:
        return F.when(F.coalesce(cond, F.lit(False)), F.array(*entries)).otherwise(none)

    def one(cond: Column) -> Column:
        return F.when(F.coalesce(cond, F.lit(False)), 1).otherwise(0)

    folded = tree.matches(n, FOLDED_TEXT)
    h1, h2 = tree.matches(n, HEADER_ONE), tree.matches(n, HEADER_TWO)
    ordered = tree.matches(n, ORDERED_ITEM)
    unordered = tree.matches(n, UNORDERED_ITEM)
    emoji = F.when(attr(n, "style").contains("abs.twimg.com/emoji/v2/svg/"), background_url(attr(n, "style")))
    player = tree.matches(n, PLAYER)
    caption_roots = F.size(F.filter(
        tree.line(n), lambda i: (i > tree.root_id) & tree.matches(tree.at(i), CAPTION_ROOT)
    ))
    captions = F.when(tree.matches(n, DATA_BLOCK), caption_roots).otherwise(0)

    own, parent = n["direction"], tree.at(n["parent_id"])
    # a media branch of a laid-out parent takes an equal share of it
    outer = F.when((n["parent_id"] > tree.root_id) & n["media"], parent["direction"])
    branches = F.size(F.filter(tree.children(parent), lambda m: m["media"]))
    part = F.when(outer.isNotNull() & (branches > 1), F.floor(F.lit(10000.0) / branches + 0.5) / 10000.0)
    padded = F.filter(tree.children(n), lambda m: padding_ratio(attr(m, "style")).isNotNull())
    facts = F.struct(
        outer.alias("outer"),
        plain_number(part).alias("share"),
        F.when(n["media"], F.size(padded)).otherwise(0).alias("ratios"),
        plain_number(padding_ratio(attr(F.try_element_at(padded, F.lit(-1)), "style"))).alias("ratio"),
    )

    def layout(x: Column) -> Column:
        row = x["outer"] == "row"
        return F.struct(
            F.concat(
                when(own.isNotNull(), _entry("data-pl-media-direction", own)),
                when(
                    x["share"].isNotNull(),
                    _entry("data-pl-media-width", F.when(row, x["share"]).otherwise(F.lit("1"))),
                    _entry("data-pl-media-height", F.when(row, F.lit("1")).otherwise(x["share"])),
                ),
                when(x["ratios"] > 0, _entry("data-pl-media-ratio", x["ratio"])),
            ).alias("entries"),
            (one(own.isNotNull()) + one(x["share"].isNotNull()) + x["ratios"]).alias("n"),
        )

    # an element without media has no direction, no share and no ratios
    laid_out = F.when(n["media"], let(facts, layout))
    return {
        "expand-folded-tweet-text": (when(folded, _entry("data-pl-folded-text", F.lit("candidate"))), one(folded)),
        "normalize-handwritten-ordered-list": (
            F.concat(
                when(h1 | h2, _entry("data-pl-block-role", F.lit("heading")), _entry("data-pl-heading-level", F.when(h1, "1").otherwise("2"))),
                when(ordered, _entry("data-pl-list-kind", F.lit("ordered"))),
                when(unordered, _entry("data-pl-list-kind", F.lit("unordered"))),
            ),
            one(h1 | h2) + one(ordered) + one(unordered),
        ),
        "preserve-svg-emoji": (when(emoji.isNotNull(), _entry("data-pl-emoji-url", emoji)), one(emoji.isNotNull())),
        "capture-x-video-hls": (when(player, _entry("data-pl-hls-candidate", F.lit(a.id))), one(player)),
        "preserve-x-media-caption": (when(captions > 0, _entry("data-pl-block-role", F.lit("caption"))), captions),
        "preserve-x-media-layout": (F.coalesce(laid_out["entries"], none), F.coalesce(laid_out["n"], F.lit(0))),
    }


def platform_fixes(located: DataFrame, adapters: list[Adapter]) -> DataFrame:
    """H5: tag what the later class removal would lose; adds `fixes` with changed-node counts."""
    tree = Tree(F.col("nodes"), F.col("texts"), F.col("content_root.node_id"), hits=known_hits(located, page_selectors(adapters)))
    inside = lambda n: (n["node_id"] > F.col("content_root.node_id")) & (n["node_id"] <= F.col("content_root.end_id"))

    def fixed(a: Adapter) -> Column:
        enabled = [f for f in FIX_ORDER if f in a.fixes and f in a.enabled_fixes]

        def one(n: Column) -> Column:
            pairs = _fix_entries(a, tree, n)
            entries = F.concat(*[pairs[f][0] for f in enabled])
            counts = F.array(*[pairs[f][1].cast("int") for f in enabled])
            zero = F.array(*[F.lit(0) for _ in enabled])
            changed = let(F.when(inside(n), F.struct(entries.alias("e"), counts.alias("c"))).otherwise(
                F.struct(F.expr(_NO_ENTRIES).alias("e"), zero.alias("c"))
            ), lambda x: F.struct(_with_attrs(n, x["e"]).alias("node"), x["c"].alias("counts")))
            return changed

        if not enabled:
            return F.transform(F.col("nodes"), lambda n: F.struct(n.alias("node"), F.expr("cast(array() as array<int>)").alias("counts")))
        return F.transform(F.col("nodes"), one)

    def summary(a: Adapter) -> Column:
        ordered = [f for f in FIX_ORDER if f in a.fixes]
        enabled = [f for f in ordered if f in a.enabled_fixes]
        rows = []

        def changed(k: int) -> Column:
            return F.aggregate(F.col("tagged"), F.lit(0), lambda acc, t: acc + F.get(t["counts"], F.lit(k)))

        for f in ordered:
            total = changed(enabled.index(f)) if f in enabled else F.lit(0)
            rows.append(F.struct(F.lit(f).alias("id"), F.lit(f in enabled).alias("applied"), total.alias("changed")))
        if not rows:
            return F.expr("cast(array() as array<struct<id:string,applied:boolean,changed:int>>)")
        return F.array(*rows)

    if not any(a.fixes for a in adapters):
        empty = F.expr("cast(array() as array<struct<id:string,applied:boolean,changed:int>>)")
        return located.withColumn("fixes", empty)
    def prepared(a: Adapter) -> Column:
        def one(n: Column) -> Column:
            idle = n.withField("media", F.lit(False)).withField("direction", F.lit(None).cast("string"))
            if "preserve-x-media-layout" not in a.enabled_fixes:
                return idle
            return F.when(inside(n), _with_layout(tree, n)).otherwise(idle)

        return F.transform(F.col("nodes"), one)

    staged = located.withColumn("nodes", per_adapter(adapters, prepared))
    tagged = staged.withColumn("tagged", per_adapter(adapters, fixed))
    tagged = tagged.withColumn("fixes", per_adapter(adapters, summary))
    return tagged.withColumn("nodes", F.transform("tagged", lambda t: t["node"].dropFields("media", "direction"))).drop("tagged")


def _style_context(tree: Tree, n: Column, a: Adapter) -> dict[str, Column]:
    """H7: what an element is, as far as style rules care."""
    role = F.coalesce(attr(n, "role"), F.lit(""))
    link = (n["tag"] == "a") | (role == "link")
    custom = any_of([tree.matches(n, s) for s in a.style.get("custom_color_selectors", [])])
    return {
        "link": link,
        "emphasis": n["tag"].isin(*EMPHASIS_TAGS) | attr(n, "data-text").isNotNull(),
        "preformatted": n["tag"].isin("pre", "code"),
        "code": tree.has_closest(n, CODE_AROUND),
        "table": n["tag"].isin(*TABLE_TAGS) | role.isin(*TABLE_ROLES)
        | tree.has_closest(n, TABLE_AROUND),
        "readable": attr(n, "data-text").isNotNull() | attr(n, "data-block").isNotNull() | link | n["tag"].isin(*READABLE_TAGS),
        "custom": custom,
    }


def sanitize(located: DataFrame, adapters: list[Adapter]) -> DataFrame:
    """H6-H8: nodes with `live`/`gone`, whitelisted attributes and styles; `clean_stats` counts."""
    return strip_attrs(remove_noise(located, adapters), adapters)


def remove_noise(located: DataFrame, adapters: list[Adapter]) -> DataFrame:
    """H6: nodes with `live`/`gone`; asks nothing of an adapter's `preserve`.

    The content root itself is never removed; nodes outside it are not live.
    Pages without one keep their row and have no live nodes: a filter here would
    be pushed below the root lookup and evaluate it twice.
    """
    root = F.col("content_root")
    raw = Tree(F.col("nodes"), F.col("texts"), root["node_id"], hits=known_hits(located, page_selectors(adapters)))

    def removal(a: Adapter) -> Column:
        def one(n: Column) -> Column:
            below_root = F.coalesce((n["node_id"] > root["node_id"]) & (n["node_id"] <= root["end_id"]), F.lit(False))
            retained = (n["tag"] == "button") & raw.has_closest(n, RETAINING_COMPONENTS) & (
                (F.coalesce(attr(n, "data-href"), F.lit("")) != "") | (normalize_text(raw.text(n)) != "")
            )
            noise = (
                any_of([raw.matches(n, s) for s in a.remove])
                | n["tag"].isin(*REMOVED_TAGS)
                | (F.coalesce(attr(n, "role"), F.lit("")) == "button")
                | F.coalesce(attr(n, "data-testid").isin(*INTERACTIVE_TEST_IDS), F.lit(False))
            )
            unwrap = any_of([raw.matches(n, s) for s in a.unwrap])
            lang = F.regexp_extract(F.coalesce(attr(n, "class"), F.lit("")), "(?:^|\\s)language-(\\S+)", 1)
            return (
                n.withField("remove", below_root & noise & ~retained)
                .withField("unwrap", below_root & unwrap)
                .withField("lang", lang)
            )

        return F.transform(F.col("nodes"), one)

    flagged = located.withColumn("nodes", per_adapter(adapters, removal))
    nodes = F.col("nodes")

    def in_root(n: Column) -> Column:
        return F.coalesce((n["node_id"] >= root["node_id"]) & (n["node_id"] <= root["end_id"]), F.lit(False))

    def settle(n: Column) -> Column:
        gone = ~in_root(n) | n["remove"] | F.exists(n["path"], lambda i: F.get(nodes, i)["remove"])
        path = F.filter(n["path"], lambda i: ~F.get(nodes, i)["unwrap"])
        return (
            n.withField("gone", gone)
            .withField("live", ~gone & ~n["unwrap"])
            .withField("path", path)
            .withField("parent_id", F.coalesce(F.try_element_at(path, F.lit(-1)), F.lit(-1)))
        )

    settled = flagged.withColumn("nodes", F.transform("nodes", settle))
    owners = F.col("owners")
    return settled.withColumn(
        "texts",
        F.transform("texts", lambda t, i: F.when(F.get(nodes, F.get(owners, i))["gone"], F.lit("")).otherwise(t)),
    )


def strip_attrs(settled: DataFrame, adapters: list[Adapter]) -> DataFrame:
    """H7, H8: whitelisted attributes and styles of the live nodes, and `clean_stats`."""
    root = F.col("content_root")
    hits = known_hits(settled, page_selectors(adapters))
    # roles and test ids outlast the stripping of attributes, so what is asked of them below was known before
    tree = Tree(F.col("nodes"), F.col("texts"), root["node_id"], cleaned=True, hits={s: hits[s] for s in (CODE_AROUND, TABLE_AROUND) if s in hits})

    def keep(a: Adapter) -> Column:
        allowed = sorted({k.lower() for k in [*KEPT_ATTRS, *KEPT_DATA_ATTRS, *a.preserve]})
        keeps_class = "class" in allowed

        def semantics(n: Column) -> Column:
            """H8: facts that live in classes and backgrounds, copied to attributes."""
            none = F.expr(_NO_ENTRIES)
            kind = (
                F.when(F.array_contains(n["classes"], "public-DraftStyleDefault-orderedListItem"), "ordered")
                .when(F.array_contains(n["classes"], "public-DraftStyleDefault-unorderedListItem"), "unordered")
            )
            player = F.coalesce(attr(n, "data-component-name") == "VideoEmbedPlayer", F.lit(False))
            ratio = F.when(player, padding_ratio(attr(tree.first(n, '[style*="padding-bottom"]'), "style")))
            audio = (n["tag"] == "audio") & (F.coalesce(attr(n, "src"), F.lit("")) != "")
            near = F.slice(F.reverse(F.filter(n["path"], lambda i: i >= root["node_id"])), 1, COVER_SEARCH_DEPTH)

            def cover_at(i: Column) -> Column:
                return let(tree.at(i), lambda p: background_url(attr(
                    F.coalesce(
                        tree.first(p, '[style*="background-image"]'),
                        F.when(tree.matches(p, '[style*="background-image"]'), p),
                    ), "style")))

            cover = F.when(audio, first_of(F.filter(F.transform(near, cover_at), lambda c: c.isNotNull())))
            return F.concat(
                F.when(kind.isNotNull(), F.array(_entry("data-pl-list-kind", kind))).otherwise(none),
                F.when(ratio.isNotNull(), F.array(_entry("data-pl-media-ratio", plain_number(ratio)))).otherwise(none),
                F.when(cover.isNotNull(), F.array(_entry("data-pl-media-cover", cover))).otherwise(none),
            )

        def strip(n: Column) -> Column:
            marked = let(semantics(n), lambda e: _with_attrs(n, e))

            def kept(m: Column) -> Column:
                attrs = F.map_filter(m["attrs"], lambda k, v: F.lower(k).isin(*allowed))
                out = m.withField("stripped", F.size(m["attrs"]) - F.size(attrs)).withField("attrs", attrs)
                return out if keeps_class else out.withField("classes", F.expr("cast(array() as array<string>)"))

            done = let(marked, kept)
            idle = n.withField("stripped", F.lit(0))
            return F.when(n["live"], done).otherwise(idle)

        return F.transform(F.col("nodes"), strip)

    def styled(a: Adapter) -> Column:
        def one(n: Column) -> Column:
            context = _style_context(tree, n, a)
            kept = let(
                F.struct(*[c.alias(k) for k, c in context.items()]),
                lambda x: filter_style(attr(n, "style"), {k: x[k] for k in context}, a.style),
            )
            rest = F.map_filter(n["attrs"], lambda k, v: k != "style")
            new = let(kept, lambda s: F.when(s == "", rest).otherwise(F.map_concat(rest, F.create_map(F.lit("style"), s))))
            return F.when(n["live"] & attr(n, "style").isNotNull(), n.withField("attrs", new)).otherwise(n)

        return F.transform(F.col("nodes"), one)

    def total(value) -> Column:
        return F.aggregate(F.col("nodes"), F.lit(0), lambda acc, n: acc + F.when(n["live"], value(n)).otherwise(0))

    stripped = settled.withColumn("nodes", per_adapter(adapters, keep))
    counted = stripped.withColumn("clean_stats", F.struct(
        F.aggregate(F.col("nodes"), F.lit(0), lambda acc, n: acc + F.when(n["remove"], 1).otherwise(0)).alias("removed_nodes"),
        total(lambda n: n["stripped"]).alias("stripped_attrs"),
        total(lambda n: F.size(n["attrs"])).alias("preserved_attrs"),
    ))
    return counted.withColumn("nodes", per_adapter(adapters, styled))


# Counted shapes of a clean page.
SNAPSHOT = {
    "paragraphs": '[data-block="true"]',
    "quotes": '[data-testid="tweet"], [data-testid="simpleTweet"], blockquote',
    "list_items": "li, [data-pl-list-kind]",
    "images": 'img, [data-testid="tweetPhoto"]',
    "links": 'a[href], [role="link"]',
    "scripts": "script, style, noscript",
    "interactive": 'button, input, textarea, select, [role="button"]',
}


def with_snapshot(clean: DataFrame, adapters: list[Adapter]) -> DataFrame:
    """H9: adds `snapshot`, how many titles, paragraphs, quotes, ... the clean tree has."""
    root = F.col("content_root")
    tree = Tree(F.col("nodes"), F.col("texts"), root["node_id"], cleaned=True)
    count = lambda s: F.size(tree.all(root, s)).cast("bigint")
    titles = per_adapter(adapters, lambda a: count(a.title_selector) if a.title_selector else F.lit(0).cast("bigint"))
    own_class = F.when(attr(tree.at(root["node_id"]), "class").isNotNull(), 1).otherwise(0)
    return clean.withColumn("snapshot", F.struct(
        titles.alias("titles"), *[count(s).alias(name) for name, s in SNAPSHOT.items()], (count("[class]") + own_class).alias("class_attrs")))


def clean_snapshot(clean: DataFrame, adapters: list[Adapter]) -> DataFrame:
    """H9: the counts of the clean tree, one row per page."""
    return with_snapshot(clean, adapters).select("page_id", "snapshot.*", "clean_stats.*")


def selector_inventory(parsed: DataFrame, selectors: dict[str, str]) -> DataFrame:
    """Matches per named selector and page."""
    tree = Tree(F.col("nodes"), F.col("texts"))
    return parsed.select("page_id", *[
        F.size(F.filter("nodes", tree.matching(s))).cast("bigint").alias(name)
        for name, s in selectors.items()
    ])

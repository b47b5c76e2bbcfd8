"""Ranges of the inline markup inside a block's text.

Offsets count code points of the block text, start included, end excluded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.css import background_url, parse_style, style_map
from ..functions.text import normalize_prewrap, normalize_text
from ..schema import ANNOTATION, ANNOTATIONS
from .marks import INLINE, is_, within
from .tree import attr, let

# Fixed values.
RANGE_STYLE = ["color", "font-size", "line-height", "text-align", "font-style", "text-decoration"]
SILENT = ["normal", "auto", "none", "rgba(0, 0, 0, 0)"]
EMOJI_PATH = "(?:^|/)emoji/v2/svg/"

NO_RANGES = f"cast(array() as {ANNOTATIONS})"
NO_STYLE = "cast(map() as map<string,string>)"


def _range_styles(*styles: Column) -> Column:
    declared = F.concat(*[parse_style(s) for s in styles])
    return F.filter(declared, lambda d: d["property"].isin(*RANGE_STYLE) & ~d["value"].isin(*SILENT))


def _declare(prop: str, value: str, when: Column) -> Column:
    one = F.struct(F.lit(prop).alias("property"), F.lit(value).alias("value"))
    return F.when(when, F.array(one)).otherwise(F.expr("cast(array() as array<struct<property:string,value:string>>)"))


def make_range(start, end, bold, href, target, emoji, style) -> Column:
    return F.struct(
        start.alias("start"), end.alias("end"), bold.alias("bold"), href.alias("href"), target.alias("target"),
        emoji.alias("emoji"), style.alias("style"),
    ).cast(ANNOTATION)


def has_signal(r: Column) -> Column:
    """A range that changes nothing is not worth keeping."""
    return F.coalesce(r["bold"], F.lit(False)) | r["href"].isNotNull() | r["emoji"].isNotNull() | (F.size(r["style"]) > 0)


def fold_ranges(found: Column, full: Column, retry: bool = False) -> Column:
    """Place each (text, range) at or after the end of the one before it.

    `retry` looks from the start again when nothing follows the cursor.
    """
    zero = F.struct(F.lit(0).alias("cursor"), F.expr(NO_RANGES).alias("ranges"))

    def step(acc: Column, item: Column) -> Column:
        ahead = F.position(item["text"], full, acc["cursor"] + 1)
        pos = F.when(ahead == 0, F.position(item["text"], full)).otherwise(ahead) if retry else ahead

        def placed(p: Column) -> Column:
            end = p - 1 + F.length(item["text"])
            here = item["range"].withField("start", p - 1).withField("end", end).cast(ANNOTATION)
            kept = F.when(has_signal(here), F.concat(acc["ranges"], F.array(here))).otherwise(acc["ranges"])
            return F.when(p > 0, F.struct(end.alias("cursor"), kept.alias("ranges"))).otherwise(acc)

        return let(pos, placed)

    items = F.filter(found, lambda i: i["text"] != "")
    return F.aggregate(items, zero, step, lambda acc: acc["ranges"])


def annotations(sub: Column, full: Column) -> Column:
    """Ranges of links, emphasis, styled spans and emoji."""
    lines = F.contains(full, F.lit("\n"))

    def item(m: Column) -> Column:
        text = F.when(lines, normalize_prewrap(m["text"])).otherwise(normalize_text(m["text"]))
        style = style_map(F.concat(
            _range_styles(attr(m, "style")), _declare("font-style", "italic", within(m, "italic")), _range_styles(m["link"]["style"])
        ))
        ranged = make_range(
            F.lit(0), F.lit(0), within(m, "bold"), F.nullif(m["link"]["href"], F.lit("")), m["link"]["target"],
            F.nullif(m["emoji"], F.lit("")), style,
        )
        return F.struct(text.alias("text"), ranged.alias("range"))

    found = F.transform(F.filter(sub, lambda m: is_(m, *INLINE)), item)
    return F.when(F.coalesce(full, F.lit("")) == "", F.expr(NO_RANGES)).otherwise(fold_ranges(found, full))


def component_annotations(sub: Column, full: Column, safe: Callable[[Column], Column]) -> Column:
    """B5, variant of embedded components: retries from the start, links are underlined."""
    def styled(m: Column) -> Column:
        declared = F.filter(parse_style(attr(m, "style")), lambda d: d["property"].isin(*RANGE_STYLE, "font-weight"))
        return (F.size(declared) > 0) | is_(m, "anchor", "bold", "italic", "underline") | attr(m, "data-href").isNotNull()

    def item(m: Column) -> Column:
        declared = parse_style(attr(m, "style"))
        weight = F.get(F.filter(declared, lambda d: d["property"] == "font-weight"), F.lit(0))["value"]
        bold = within(m, "bold") | F.coalesce((weight == "bold") | (weight.try_cast("int") >= 600), F.lit(False))
        href = safe(F.coalesce(attr(m, "href"), attr(m, "data-href")))

        def ranged(h: Column) -> Column:
            own = F.filter(declared, lambda d: d["property"].isin(*RANGE_STYLE))
            lined = F.exists(own, lambda d: d["property"] == "text-decoration")
            style = style_map(F.concat(
                own, _declare("font-style", "italic", within(m, "italic")),
                _declare("text-decoration", "underline", within(m, "underline") | (h.isNotNull() & ~lined)),
            ))
            return make_range(
                F.lit(0), F.lit(0), bold, h, F.when(h.isNotNull(), attr(m, "target")), F.lit(None).cast("string"), style
            )

        return F.struct(normalize_text(m["text"]).alias("text"), let(href, ranged).alias("range"))

    found = F.transform(F.filter(sub, styled), item)
    return F.when(F.coalesce(full, F.lit("")) == "", F.expr(NO_RANGES)).otherwise(fold_ranges(found, full, retry=True))


def shift_ranges(ranges: Column, by: Column) -> Column:
    return F.transform(ranges, lambda r: r.withField("start", r["start"] + by).withField("end", r["end"] + by))


def cut_front(ranges: Column, by: Column) -> Column:
    """Ranges after the first `by` characters are gone; emptied ranges drop."""
    zero = F.lit(0)
    moved = F.transform(
        ranges,
        lambda r: r.withField("start", F.greatest(zero, r["start"] - by)).withField("end", F.greatest(zero, r["end"] - by)),
    )
    return F.when(by == 0, ranges).otherwise(F.filter(moved, lambda r: r["end"] > r["start"]))


def emoji_url(n: Column) -> Column:
    """Image an emoji is drawn with, null for anything else."""
    url = F.coalesce(
        F.when((n["tag"] == "img") & F.regexp_like(attr(n, "src"), F.lit(EMOJI_PATH)), attr(n, "src")),
        F.when(F.regexp_like(attr(n, "data-pl-emoji-url"), F.lit(EMOJI_PATH)), attr(n, "data-pl-emoji-url")),
        background_url(attr(n, "style")),
    )
    return F.when(F.regexp_like(url, F.lit(EMOJI_PATH)), url)


def emoji_text(n: Column, sub: Column, texts: Column) -> Column:
    """(text, annotations) where emoji images read as their alt text.

    `texts` are the page's text nodes with their numbers. Text nodes and emoji
    are put in document order, joined, and the emoji are found again in the
    normalized text.
    """
    def drawn(m: Column) -> Column:
        written = F.when(m["tag"] == "img", attr(m, "alt")).otherwise(normalize_text(m["text"]))
        return F.struct(
            m["text_from"].alias("at"), F.lit(0).alias("rank"), m["text_to"].alias("until"),
            F.coalesce(written, F.lit("")).alias("text"), emoji_url(m).alias("emoji"),
        )

    marks = F.transform(F.filter(sub, lambda m: emoji_url(m).isNotNull()), drawn)

    def joined(emoji: Column) -> Column:
        plain = F.transform(
            F.filter(texts, lambda t: (t["k"] >= n["text_from"]) & (t["k"] < n["text_to"])
                     & ~F.exists(emoji, lambda e: (t["k"] >= e["at"]) & (t["k"] < e["until"]))),
            lambda t: F.struct(
                t["k"].alias("at"), F.lit(1).alias("rank"), (t["k"] + 1).alias("until"), t["text"].alias("text"),
                F.lit(None).cast("string").alias("emoji"),
            ),
        )
        parts = F.array_sort(F.concat(emoji, plain))
        raw = F.array_join(F.transform(parts, lambda p: p["text"]), "")

        def placed(text: Column) -> Column:
            items = F.transform(emoji, lambda e: F.struct(normalize_prewrap(e["text"]).alias("text"), make_range(
                F.lit(0), F.lit(0), F.lit(False), F.lit(None), F.lit(None), e["emoji"], F.expr(NO_STYLE)
            ).alias("range")))
            return F.struct(text.alias("text"), fold_ranges(items, text).alias("annotations"))

        return let(normalize_prewrap(raw), placed)

    return let(marks, joined)

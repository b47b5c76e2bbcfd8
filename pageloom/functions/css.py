"""Inline CSS."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import round_half_up

# Which properties survive in which context.
EMPHASIS_PROPS = ["font-weight", "font-style", "text-decoration"]
READABLE_PROPS = ["color", "font-size", "line-height", "text-align", "font-style", "font-weight"]
CODE_PROPS = [
    "background", "background-color", "color", "font-family", "font-size", "font-style", "font-weight",
    "line-height", "tab-size", "white-space",
]
TABLE_PROPS = [
    "background", "background-color", "border", "border-color", "border-style", "border-width", "color",
    "font-size", "font-style", "font-weight", "line-height", "text-align",
]
TEXT_STYLE_PROPS = ["color", "font-size", "line-height", "text-align", "font-style", "font-weight"]
SILENT_VALUES = ["", "normal", "auto", "none", "rgba(0, 0, 0, 0)"]

DECLARATIONS = "array<struct<property:string,value:string>>"


def parse_style(style: Column) -> Column:
    """Ordered (property, value) pairs; malformed declarations vanish."""
    def declaration(part: Column) -> Column:
        return F.struct(
            F.lower(F.trim(F.regexp_extract(part, "^([^:]*):", 1))).alias("property"),
            F.trim(F.regexp_extract(part, "^[^:]*:(.*)$", 1)).alias("value"),
        )

    parts = F.transform(F.split(F.coalesce(style, F.lit("")), ";"), lambda p: F.regexp_replace(p, "\\s+", " "))
    return F.filter(F.transform(parts, declaration), lambda d: (d["property"] != "") & (d["value"] != ""))


def style_map(declarations: Column) -> Column:
    """Property map; a repeated property keeps its last value."""
    last = F.filter(
        declarations,
        lambda d, i: ~F.exists(
            F.slice(declarations, i + 2, F.greatest(F.size(declarations), F.lit(1))),
            lambda later: later["property"] == d["property"],
        ),
    )
    return F.map_from_entries(last)


def style_value(style: Column, prop: str) -> Column:
    """Last value of one property, null when it says nothing."""
    hits = F.filter(parse_style(style), lambda d: d["property"] == prop)
    value = F.try_element_at(hits, F.lit(-1))["value"]
    return F.when(~value.isin(*SILENT_VALUES), value)


def text_style(style: Column) -> Column:
    """Readable text style of an element as a map."""
    wanted = F.filter(
        parse_style(style),
        lambda d: d["property"].isin(*TEXT_STYLE_PROPS) & ~d["value"].isin(*SILENT_VALUES),
    )
    return style_map(wanted)


def filter_style(style: Column, context: dict[str, Column], config: dict) -> Column:
    """Declarations that survive in `context`, joined again; '' when none do."""
    keep = [p.strip().lower() for p in config.get("preserve_props", [])]
    colour_for = config.get("preserve_color_for", [])
    spaces = [v.strip().lower() for v in config.get("preserve_white_space", [])]
    no = F.lit(False)
    colour = (
        (context["link"] if "link" in colour_for else no)
        | (context["emphasis"] if "inline-emphasis" in colour_for else no)
        | (context.get("custom", no) if "custom-selector" in colour_for else no)
        | context["readable"]
        | context["code"]
        | context["table"]
    )

    def survives(d: Column) -> Column:
        p = d["property"]
        return (
            F.when(p == "color", colour)
            .when(context["code"] & p.isin(*CODE_PROPS), True)
            .when(context["table"] & p.isin(*TABLE_PROPS), True)
            .when(context["readable"] & p.isin(*READABLE_PROPS), True)
            .when(p == "white-space", context["preformatted"] & F.lower(d["value"]).isin(*(spaces or ["\x00"])))
            .otherwise(p.isin(*(keep or ["\x00"])))
        )

    kept = F.filter(parse_style(style), survives)
    return F.array_join(F.transform(kept, lambda d: F.concat_ws(": ", d["property"], d["value"])), "; ")


def padding_ratio(style: Column) -> Column:
    """Width / height held open by a percentage padding."""
    pct = F.regexp_extract(style, "(?i)padding-bottom\\s*:\\s*([0-9.]+)%", 1).try_cast("double")
    return F.when(pct > 0, round_half_up(F.lit(100.0) / pct, 4))


def background_url(style: Column) -> Column:
    """T19."""
    url = F.regexp_extract(style, "url\\((?:\"|'|&quot;)?([^\"')]+?)(?:\"|'|&quot;)?\\)", 1)
    return F.nullif(F.replace(url, F.lit("&amp;"), F.lit("&")), F.lit(""))

"""Media and code helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import let
from .numbers import aspect_ratio
from .text import WS, normalize_text

# Fixed values.
TRANSPARENT_BLEED = 1.08
MARKUP_LANGUAGES = ["xml", "html", "jsx", "tsx"]
MARKUP_TOKENS = (
    "</?[A-Za-z][\\w:-]*|>|/>|\"[^\"]*\"|'[^']*'|//[^\\n]*|"
    "\\b(?:class|function|const|let|var|return|type|interface|export|import|from|extends|pub|struct|impl|fn|let|mut)\\b"
)
CODE_TOKENS = (
    "//[^\\n]*|\"[^\"]*\"|'[^']*'|"
    "\\b(?:class|function|const|let|var|return|type|interface|export|import|from|extends|pub|struct|impl|fn|mut|async|await)\\b|"
    "\\b\\d+(?:\\.\\d+)?\\b"
)
MARKDOWN_LINE = "^(\\s*)(#{1,6}(?=\\s)|[0-9]+\\.(?=\\s)|[-*+](?=\\s))"


def first_nonempty(*cols: Column) -> Column:
    """First value with more than white space in it, as it stands."""
    return F.get(F.filter(F.array(*cols), lambda c: F.length(F.btrim(c, F.lit(WS))) > 0), F.lit(0))


def trimmed(c: Column) -> Column:
    return F.nullif(F.btrim(c, F.lit(WS)), F.lit(""))


def first_srcset(srcset: Column) -> Column:
    """URL of the first candidate."""
    parts = F.filter(F.transform(F.split(srcset, ","), lambda p: F.btrim(p, F.lit(WS))), lambda p: p != "")
    return F.regexp_extract(F.try_element_at(parts, F.lit(1)), f"^([^{WS}]+)", 1)


def provider_label(label: Column, provider: Column, source: Column) -> Column:
    """An explicit label, else the provider, else a title-cased source name."""
    words = F.filter(F.split(source, "[-_.\\s]+"), lambda w: w != "")
    titled = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, 2, 1 << 30))), " ")
    made = F.when(F.lower(source) == "x", F.lit("X")).when(source != "", titled)
    return F.coalesce(label, provider, made)


def detect_language(text: Column) -> Column:
    return (
        F.when(F.regexp_like(text, F.lit("^\\s*<")), F.lit("xml"))
        .when(F.regexp_like(text, F.lit("\\bpub\\s+struct\\b|\\bfn\\s+\\w+")), F.lit("rust"))
        .when(F.regexp_like(text, F.lit("\\bnpm\\s+install\\b|\\bcd\\s+")), F.lit("shell"))
        .otherwise(F.lit(""))
    )


def clean_language(lang_class: Column, header: Column) -> Column:
    """Language named by the page: class first, header label second."""
    raw = F.coalesce(F.nullif(lang_class, F.lit("")), F.nullif(normalize_text(header), F.lit("")))
    return F.nullif(F.lower(F.regexp_replace(normalize_text(raw), "^language-", "")), F.lit(""))


def code_language(lang_class: Column, header: Column, text: Column) -> Column:
    """Named language, else a guess from the text, else `text`."""
    return F.coalesce(
        clean_language(lang_class, header), F.nullif(detect_language(text), F.lit("")), F.lit("text")
    )


def code_tokens(text: Column, language: Column) -> Column:
    """Array of (token, kind)."""
    def kind(token: Column) -> Column:
        return (
            F.when(F.startswith(token, F.lit("//")), "comment")
            .when(F.regexp_like(token, F.lit("^[\"']")), "string")
            .when(F.regexp_like(token, F.lit("^</?[A-Za-z]")), "tag")
            .when(F.regexp_like(token, F.lit("^\\d")), "number")
            .when(token.isin(">", "/>"), "punctuation")
            .otherwise("keyword")
        )

    def lexed(pattern: str) -> Column:
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        return F.transform(found, lambda t: F.struct(t.alias("token"), kind(t).alias("kind")))

    def line_tokens(line: Column) -> Column:
        mark = F.regexp_extract(line, MARKDOWN_LINE, 2)
        rest = F.regexp_extract(line, "^\\s*#{1,6}(\\s+.*)$", 1)
        first = F.struct(mark.alias("token"), F.lit("punctuation").alias("kind"))
        second = F.struct(rest.alias("token"), F.lit("heading").alias("kind"))
        return (
            F.when(mark == "", F.expr("cast(array() as array<struct<token:string,kind:string>>)"))
            .when(F.startswith(mark, F.lit("#")), F.array(first, second))
            .otherwise(F.array(first))
        )

    markdown = F.flatten(F.transform(F.split(text, "\n"), line_tokens))
    return (
        F.when(language.isin("markdown", "md"), markdown)
        .when(language.isin(*MARKUP_LANGUAGES), lexed(MARKUP_TOKENS))
        .otherwise(lexed(CODE_TOKENS))
    )


def cdn_image_meta(src: Column, in_plain_figure: Column) -> Column:
    """Size, fit and position spelled in an image CDN path."""
    def tokens(decoded: Column) -> Column:
        number = lambda key: F.regexp_extract(decoded, f"(?:^|[,/]){key}_(\\d+)", 1)
        token = lambda key: F.lower(F.regexp_extract(decoded, f"(?i)(?:^|[,/]){key}_([a-z]+)", 1))
        return F.struct(
            aspect_ratio(number("w"), number("h")).alias("ratio"), token("c").alias("crop"), token("g").alias("gravity")
        )

    def meta(t: Column) -> Column:
        crop = t["crop"]
        bleed = (crop == "limit") & in_plain_figure
        return F.struct(
            t["ratio"].alias("aspect_ratio"),
            F.when(crop == "limit", F.lit("transparent")).alias("background_color"),
            F.when(crop == "fill", F.lit("cover")).when(crop == "limit", F.lit("contain")).alias("object_fit"),
            F.when(t["gravity"] == "auto", F.lit("center center")).alias("object_position"),
            F.when(bleed, F.lit(TRANSPARENT_BLEED)).alias("visual_bleed_scale"),
            F.when(bleed, F.lit("alpha-transparent")).alias("visual_bleed_mode"),
        )

    return let(let(F.coalesce(F.try_url_decode(src), src), tokens), meta)

"""Text columns (T1-T6, T10): whitespace, comparison form, width, list markers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters a browser treats as white space, spelled out so
# that Java and RE2 regexes agree on them.
WS = (
    "\t\n\x0b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
# The same characters as a class for Java, whose classes test their members one after the other, for every character of a
# text: ranges keep ordinary characters from most of the tests, and a single member beside them (U+FEFF) would cost one more.
SPACE = "[\t-\r \u00a0[\u1680-\ufeff&&[\u1680-\u3000\ufeff]&&[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]]]"
PUNCTUATION_AFTER_SPACE = ",.;:!?，。！？；："
CJK_MARKS = "，。；：！？、"
ASCII_MARKS = ",.;:!?"


def normalize_text(c: Column) -> Column:
    """Runs of white space become one space, ends trimmed."""
    return F.trim(F.regexp_replace(c, f"{SPACE}+", " "))


def trim_ws(c: Column) -> Column:
    return F.btrim(c, F.lit(WS))


def normalize_prewrap(c: Column) -> Column:
    """Keeps line breaks, at most one blank line, NBSP as space."""
    unix = F.regexp_replace(c, "\r\n?", "\n")
    spaced = F.replace(unix, F.lit("\u00a0"), F.lit(" "))
    return trim_ws(F.regexp_replace(spaced, "\n{3,}", "\n\n"))


def normalize_code(c: Column) -> Column:
    """Unix line ends, outer line feeds dropped, everything else kept."""
    return F.btrim(F.regexp_replace(c, "\r\n?", "\n"), F.lit("\n"))


def has_text(c: Column) -> Column:
    """T4."""
    return F.length(F.coalesce(normalize_text(c), F.lit(""))) > 0


def normalize_for_compare(c: Column) -> Column:
    """T5: T1 without the space before punctuation."""
    joined = F.regexp_replace(c, f"{SPACE}+", " ")
    return F.trim(F.regexp_replace(joined, f" +([{PUNCTUATION_AFTER_SPACE}])", "$1"))


def comparable_code_language(c: Column) -> Column:
    """T5 for languages: `text` and `plain` say nothing."""
    lang = F.lower(normalize_for_compare(F.coalesce(c, F.lit(""))))
    return F.when(lang.isin("text", "plain"), F.lit("")).otherwise(lang)


def text_width(c: Column) -> Column:
    """Estimated line width; every code point has one weight."""
    def hits(pattern: str) -> Column:
        return F.regexp_count(c, F.lit(pattern))

    space = hits(SPACE)
    word = hits("[A-Za-z0-9_]")
    mark = hits(f"[{ASCII_MARKS}]")
    cjk_mark = hits(f"[{CJK_MARKS}]")
    wide = hits("[\\p{IsHan}\\p{IsHiragana}\\p{IsKatakana}\\p{IsHangul}]")
    other = F.length(c) - space - word - mark - cjk_mark - wide
    return (space * 0.5 + word + mark * 0.5 + cjk_mark + wide * 2 + other * 1.5).cast("double")


def list_marker(c: Column) -> Column:
    """`12. ` style marker including the white space after it, else ''."""
    return F.regexp_extract(c, f"^([0-9]+\\.){SPACE}+", 0)


def handwritten_marker(c: Column) -> Column:
    """T10, wider set used by the second extraction: roman and CJK numerals too."""
    pattern = (
        f"(?i)^[{WS}]*(?:(?:[0-9]+|[ivxlcdm]+)[{WS}]*[.)、:：]|[一二三四五六七八九十百千]+[{WS}]*[、.．:：])[{WS}]*"
    )
    return F.regexp_extract(c, pattern, 0)


def list_bullet(c: Column, kind: Column, index: Column) -> Column:
    """What a list shows in front of an item: nothing when the text brings its own number."""
    typed = F.regexp_like(c, F.lit(f"^[{WS}]*[0-9]+\\.[{WS}]+"))
    return (
        F.when(kind != "ordered", F.lit("•"))
        .when(typed, F.lit(""))
        .otherwise(F.concat((index + 1).cast("string"), F.lit(".")))
    )

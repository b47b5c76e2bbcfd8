"""Column functions against values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from pageloom.functions import css, media, numbers, text, urls


def value(spark, column, **cols):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()]).select(column.alias("v")).first()
    return row.v.asDict(True) if hasattr(row.v, "asDict") else row.v


@pytest.mark.parametrize("raw, flat, wrapped, code", [
    ("  a \t b c　", "a b c", "a \t b c", "  a \t b c　"),
    ("\n\na\r\n\r\n\r\n\r\nb\n", "a b", "a\n\nb", "a\n\n\n\nb"),
    ("a\u0085b", "a\u0085b", "a\u0085b", "a\u0085b"),
])
def test_white_space(spark, raw, flat, wrapped, code):
    got = value(spark, F.struct(
        text.normalize_text(F.col("t")).alias("flat"), text.normalize_prewrap(F.col("t")).alias("wrapped"),
        text.normalize_code(F.col("t")).alias("code")), t=raw)
    assert got == {"flat": flat, "wrapped": wrapped, "code": code}


def test_compare_and_width(spark):
    assert value(spark, text.normalize_for_compare(F.col("t")), t="a  , b 。") == "a, b。"
    assert value(spark, text.comparable_code_language(F.col("t")), t="Plain") == ""
    assert value(spark, text.text_width(F.col("t")), t="ab, 你好。é") == 2 + 0.5 + 0.5 + 4 + 1 + 1.5


def test_markers(spark):
    assert value(spark, text.list_marker(F.col("t")), t="12. x") == "12. "
    assert value(spark, text.list_marker(F.col("t")), t="12.x") == ""
    assert value(spark, text.handwritten_marker(F.col("t")), t="iv) x") == "iv) "
    assert value(spark, text.handwritten_marker(F.col("t")), t="二、x") == "二、"


@pytest.mark.parametrize("href, base, want", [
    ("/p?q=1#f", "https://a.b/c", "https://a.b/p?q=1#f"),
    ("x/../y", "https://a.b/c/d", "https://a.b/c/y"),
    ("//h.com/z", "http://a.b/", "http://h.com/z"),
    ("?z", "http://a.b/c?d#e", "http://a.b/c?z"),
    ("#e", "http://a.b/c?d", "http://a.b/c?d#e"),
    ("HTTP://A.B:80", "http://x/", "http://a.b/"),
    ("mailto:a@b", "http://x/", "mailto:a@b"),
    ("  ", "http://x/", None),
])
def test_resolve_url(spark, href, base, want):
    assert value(spark, urls.resolve_url(F.col("h"), F.col("b")), h=href, b=base) == want


def test_url_rules(spark):
    assert value(spark, urls.safe_url(F.col("h"), F.lit("http://x/")), h="javascript:1") is None
    assert value(spark, urls.safe_url(F.col("h"), F.lit("http://x/")), h="blob:http://x/1") is None
    assert value(spark, urls.post_id(F.col("h")), h="https://x.com/a/status/12/") == "12"
    assert value(spark, urls.post_id(F.col("h")), h="https://m.x.com/a/status/12") is None
    assert value(spark, urls.post_canonical(F.col("h")), h="https://twitter.com/a/article/7") == "https://x.com/a/article/7"
    assert value(spark, urls.embed_provider(F.col("h")), h="https://youtu.be/1") == "youtube"
    assert value(spark, urls.embed_provider(F.col("h")), h="https://y.com") == "generic"
    assert value(spark, urls.embed_provider(F.col("h")), h="https://m.x.com/1") == "x"
    assert value(spark, urls.upgrade_image_url(F.col("h")), h="https://pbs.twimg.com/media/a?format=jpg&name=small") == (
        "https://pbs.twimg.com/media/a?format=jpg&name=orig")
    assert value(spark, urls.upgrade_image_url(F.col("h")), h="https://pbs.twimg.com/media/a") == "https://pbs.twimg.com/media/a?name=orig"
    assert value(spark, urls.href_keys(F.col("h"), F.lit("https://a.b/")), h="/x#y") == ["/x#y", "https://a.b/x#y", "https://a.b/x"]


def test_numbers(spark):
    assert value(spark, numbers.metric_value(F.col("v")), v="1.2K") == 1200.0
    assert value(spark, numbers.metric_value(F.col("v")), v="3万") == 30000.0
    assert value(spark, numbers.metric_label(F.col("v")), v="12.5K views") == "12.5K"
    assert value(spark, numbers.article_metric_label(F.col("v")), v="1,234 likes") == "1,234"
    assert value(spark, numbers.format_metric(F.col("v"), "Like", "Likes"), v=1) == "1 Like"
    assert value(spark, numbers.format_compact_metric(F.col("v"), "View", "Views"), v=12345) == "12.35K Views"
    assert value(spark, numbers.format_metric(F.col("v"), "a", "b"), v=float("inf")) is None
    assert value(spark, numbers.format_published(F.col("v").cast("timestamp")), v="2024-01-05 16:05:00") == "12:05 AM · Jan 6, 2024"
    assert value(spark, numbers.is_date_text(F.col("v")), v="1月5日") and not value(spark, numbers.is_date_text(F.col("v")), v="5 Jan")
    assert value(spark, numbers.is_duration_text(F.col("v")), v="0:12")
    assert value(spark, numbers.aspect_ratio(F.col("w"), F.col("h")), w="1600", h="900") == 1.7778
    assert value(spark, numbers.aspect_ratio(F.col("w"), F.col("h")), w="x", h="900") is None


def test_css(spark):
    style = "COLOR: red; broken; font-weight : 700;; color: blue"
    got = value(spark, css.style_map(css.parse_style(F.col("s"))), s=style)
    assert got == {"color": "blue", "font-weight": "700"}
    assert value(spark, css.padding_ratio(F.col("s")), s="padding-bottom: 56.25%") == 1.7778
    assert value(spark, css.background_url(F.col("s")), s='background-image: url("https://a/b?x=1&amp;y=2")') == "https://a/b?x=1&y=2"
    no = F.lit(False)
    context = {k: no for k in ("link", "emphasis", "preformatted", "code", "table", "readable", "custom")}
    rules = {"preserve_props": ["font-weight"], "preserve_color_for": ["link"], "preserve_white_space": ["pre"]}
    keep = lambda **on: value(spark, css.filter_style(
        F.col("s"), {**context, **{k: F.lit(True) for k in on}}, rules), s="color: red; font-weight: 700; white-space: pre; margin: 0")
    assert keep() == "font-weight: 700"
    assert keep(link=1) == "color: red; font-weight: 700"
    assert keep(preformatted=1) == "font-weight: 700; white-space: pre"
    assert keep(code=1) == "color: red; font-weight: 700; white-space: pre"


def test_media(spark):
    assert value(spark, media.first_srcset(F.col("s")), s=" , a.png 1x, b.png 2x") == "a.png"
    assert value(spark, media.provider_label(F.lit(None), F.lit(None), F.col("s")), s="my-site_x") == "My Site X"
    assert value(spark, media.provider_label(F.lit(None), F.lit(None), F.col("s")), s="x") == "X"
    meta = value(spark, media.cdn_image_meta(F.col("s"), F.lit(True)), s="https://cdn/w_1200,h_800%2Cc_limit,g_auto/a")
    assert meta["aspect_ratio"] == 1.5 and meta["object_fit"] == "contain" and meta["visual_bleed_scale"] == 1.08
    assert value(spark, media.code_language(F.lit(""), F.lit(""), F.col("s")), s="pub struct A") == "rust"
    assert value(spark, media.code_language(F.col("s"), F.lit(""), F.lit("x")), s="TS") == "ts"
    tokens = value(spark, media.code_tokens(F.col("s"), F.lit("js")), s='const a = "x"; // hi 1')
    assert [(t["token"], t["kind"]) for t in tokens] == [("const", "keyword"), ('"x"', "string"), ("// hi 1", "comment")]
    marks = value(spark, media.code_tokens(F.col("s"), F.lit("md")), s="# Head\n- item\ntext")
    assert [(t["token"], t["kind"]) for t in marks] == [("#", "punctuation"), (" Head", "heading"), ("-", "punctuation")]

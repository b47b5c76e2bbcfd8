"""Registered queries: every operator over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numbers as num
from ..functions import text as txt
from ..functions.media import provider_label
from ..functions.urls import href_keys, resolve_url, upgrade_image_url, url_host
from ..operators import articles as art
from ..operators import reports as rep
from ..operators import units as un
from ..operators.blocks import make_block
from ..operators.clean import clean_snapshot, platform_fixes, sanitize, selector_inventory
from ..operators.locate import locate_roots, resolve_title
from ..operators.merge import merge_extractions
from ..operators.routing import (
    adapter_coverage,
    article_identity,
    audit_hosts,
    best_route,
    route,
    route_pages,
)
from ..operators.tree import Tree, attr, select
from ..sources import articles as store
from ..sources.adapters import CORPUS, EXAMPLE_ARTICLE
from ..sources.html import node_rows, parse_nodes, raw_tokens, text_rows
from ..sources.pages import read_pages
from ..session import dealt
from ..streaming import progress as prog
from ..streaming import stability as stab
from .extract import Merged, blocks_of, extract, extract_merged, pages_of, parsed_pages, ready_pages

SITES = [EXAMPLE_ARTICLE]
# The navigation of the same pages, read as an article of its own.
NAVIGATION = [replace(
    EXAMPLE_ARTICLE, root_selector="nav", title_selector=None, remove=["script", "style"], required=["nav"],
    min_blocks=None, min_text=None, validation={"title": "optional"},
)]
EXTRACTED_AT = 1_767_225_600_000

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_pages(spark, f"{sf_dir}/pages.parquet")


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_nodes(dealt(pages(spark, sf_dir), "page_id"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(table(spark, sf_dir, "documents"), "doc_id")


@lru_cache(maxsize=8)
def rows_of(spark: SparkSession, sf_dir: str, nested: str = "keep") -> DataFrame:
    return extract(pages(spark, sf_dir), SITES, nested=nested)


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return art.assemble_articles(rows_of(spark, sf_dir), SITES, EXTRACTED_AT)


def k_of(events: DataFrame) -> Column:
    return F.get_json_object("props", "$.k").cast("bigint")


def big(c: Column) -> Column:
    return c.cast("bigint")


# ---- flagship ------------------------------------------------------------
@query
def corpus_quality(spark, d):
    """Pages to validated articles, then quality per path language."""
    a = articles(spark, d).withColumn("lang", F.regexp_extract("url", "^https?://[^/]+/([a-z]{2})/", 1))
    return a.groupBy("lang", F.coalesce("rejected", F.lit("accepted")).alias("outcome")).agg(
        F.count("*").alias("n_pages"), F.sum("n_blocks").alias("n_blocks"),
        F.sum("article_text_length").alias("text_length"),
    )


# ---- sources -------------------------------------------------------------
@query
def s1_read_pages(spark, d):
    p = read_pages(spark, f"{d}/pages.parquet")
    return p.select("page_id", "url", big(F.length("html")).alias("html_length"))


def _versions(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("article_id"), "ts", "event_id", "event_type", "value")


@query
def s3_upsert_articles(spark, d):
    v = _versions(spark, d)
    old, new = v.filter("event_type <> 'view'"), v.filter("event_type = 'view'")
    return store.upsert_articles(old, new, order=("ts", "event_id")).select("article_id", "event_id", "event_type", "value")


@query
def s4_get_articles(spark, d):
    v = _versions(spark, d)
    latest = store.upsert_articles(None, v.filter("value > 250"), order=("ts", "event_id"))
    ids = v.select("article_id").distinct()
    return store.get_articles(latest, ids).select("article_id", "event_id", "value")


@query
def s5_delete_articles(spark, d):
    v = _versions(spark, d)
    latest = store.upsert_articles(None, v, order=("ts", "event_id"))
    return store.delete_articles(latest, v.filter("value > 250")).select("article_id", "event_id")


# ---- routing and URLs ----------------------------------------------------
@query
def u1_route_pages(spark, d):
    p = table(spark, d, "pages").select("page_id", "url")
    return route_pages(p, CORPUS).select("page_id", "adapter_id", "confidence", "reason")


@query
def u2_best_route(spark, d):
    # a second, more general rule for one of the hosts loses on confidence
    general = replace(EXAMPLE_ARTICLE, id="general.page", hosts=["example.com"], url_patterns=[], confidence=0.5)
    early = replace(EXAMPLE_ARTICLE, id="early.page", hosts=["example.org"], url_patterns=["^/en/"])
    p = table(spark, d, "pages").select("page_id", "url")
    return best_route(route_pages(p, [general, early, EXAMPLE_ARTICLE]))


def _links(spark, d) -> DataFrame:
    """Every link of the pages: page_id, url, href, text."""
    p = parsed(spark, d)
    tree = Tree(F.col("nodes"), F.col("texts"))
    found = F.transform(
        F.filter("nodes", lambda n: tree.matches(n, "a[href]")),
        lambda n: F.struct(attr(n, "href").alias("href"), tree.text(n).alias("link_text")),
    )
    return p.select("page_id", "url", F.posexplode(found).alias("link_pos", "l")).select("page_id", "url", "link_pos", "l.*")


@query
def u4_resolve_url(spark, d):
    return _links(spark, d).select("page_id", "link_pos", "href", resolve_url(F.col("href"), F.col("url")).alias("absolute"))


@query
def u7_href_keys(spark, d):
    # the page's own address carries fragments, so it has up to three keys
    p = table(spark, d, "pages").select("page_id", "url")
    keys = href_keys(F.col("url"), F.lit("https://example.com/"))
    return p.select("page_id", F.posexplode(keys).alias("key_pos", "key"))


@query
def u9_article_identity(spark, d):
    p = table(spark, d, "pages").select("page_id", "url")
    return article_identity(route(p, CORPUS), CORPUS).select(
        "page_id", "article_id", "source", "source_kind", "platform", "content_type"
    )


@query
def u10_audit_hosts(spark, d):
    media = _links(spark, d).select(resolve_url(F.col("href"), F.col("url")).alias("src"))
    allowed = table(spark, d, "pages").select(url_host(F.col("url")).alias("host")).filter("host like 'www.%'").distinct()
    return audit_hosts(media, allowed)


# ---- scalars -------------------------------------------------------------
@query
def t1_normalize_text(spark, d):
    t = documents(spark, d)
    return t.select("doc_id", txt.normalize_text(F.col("text")).alias("normalized"))


@query
def t2_normalize_prewrap(spark, d):
    return documents(spark, d).select("doc_id", txt.normalize_prewrap(F.col("text")).alias("normalized"))


@query
def t4_has_text(spark, d):
    lines = documents(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.groupBy("doc_id").agg(
        F.count("*").alias("n_lines"), big(F.sum(txt.has_text(F.col("line")).cast("int"))).alias("n_with_text")
    )


@query
def t5_normalize_for_compare(spark, d):
    spaced = F.regexp_replace("text", "([.,])", " $1")
    return documents(spark, d).select("doc_id", txt.normalize_for_compare(spaced).alias("normalized"))


@query
def t6_text_width(spark, d):
    return documents(spark, d).select("doc_id", txt.text_width(F.col("text")).alias("width"))


@query
def t7_provider_label(spark, d):
    p = documents(spark, d)
    none = F.lit(None).cast("string")
    return p.select("doc_id", provider_label(none, none, F.concat_ws("-", "lang", "source")).alias("label"))


@query
def t10_list_marker(spark, d):
    lines = documents(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    numbered = F.concat((F.col("pos") + 1).cast("string"), F.lit(". "), F.col("line"))
    return lines.select("doc_id", "pos", txt.list_marker(numbered).alias("marker"))


@query
def t11_metric_value(spark, d):
    e = table(spark, d, "events")
    label = F.concat(F.col("value").cast("decimal(12,2)").cast("string"), F.element_at(
        F.array(F.lit("K"), F.lit("M"), F.lit("")), (F.col("event_id") % 3 + 1).cast("int")
    ), F.lit(" views"))
    found = num.metric_label(label)
    return e.select("event_id", found.alias("label"), F.round(num.metric_value(found), 2).alias("value"))


@query
def t12_format_metric(spark, d):
    e = table(spark, d, "events")
    whole, scaled = F.floor("value"), F.floor(F.col("value") * 100)
    return e.select(
        "event_id", num.format_metric(whole, "Like", "Likes").alias("likes"),
        num.format_compact_metric(scaled, "View", "Views").alias("views"),
    )


@query
def t13_format_published(spark, d):
    return table(spark, d, "events").select("event_id", num.format_published(F.col("ts")).alias("published"))


@query
def t17_aspect_ratio(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", num.aspect_ratio(F.col("value"), k_of(e)).alias("ratio"))


# ---- nodes ---------------------------------------------------------------
@query
def h1_parse_nodes(spark, d):
    n = node_rows(parsed(spark, d))
    return n.groupBy("page_id", "tag").agg(F.count("*").alias("n"))


@query
def h1_text_nodes(spark, d):
    t = text_rows(parsed(spark, d))
    return t.groupBy("page_id").agg(F.count("*").alias("n_texts"), big(F.sum(F.length("text"))).alias("n_chars"))


@query
def h1_raw_tokens(spark, d):
    t = raw_tokens(table(spark, d, "pages"))
    is_tag = F.startswith("token", F.lit("<"))
    return t.groupBy("page_id").agg(big(F.sum(is_tag.cast("int"))).alias("n_tags"), F.count("*").alias("n_tokens"))


@query
def h2_select(spark, d):
    return select(parsed(spark, d), "nav > ul > li a[href]").groupBy("page_id").agg(
        F.count("*").alias("n"), F.min(F.element_at("attrs", F.lit("href"))).alias("first_href")
    )


@query
def h3_locate_roots(spark, d):
    r = locate_roots(parsed_pages(pages(spark, d), SITES), SITES)
    tree = Tree(F.col("nodes"), F.col("texts"))
    return r.select(
        "page_id", F.col("article_root.tag").alias("root_tag"), F.col("title_node.tag").alias("title_tag"),
        big(F.length(txt.normalize_text(tree.text(F.col("content_root"))))).alias("content_length"),
    )


@query
def h4_readiness(spark, d):
    r = ready_pages(parsed_pages(pages(spark, d), SITES), SITES)
    return r.select("page_id", big(F.col("block_count")).alias("block_count"), big(F.col("text_length")).alias("text_length"), "not_ready")


# the whole document as content root, so that there is something to remove
WHOLE = [replace(EXAMPLE_ARTICLE, root_selector="html")]


@query
def h6_sanitize(spark, d):
    r = locate_roots(parsed_pages(pages(spark, d), WHOLE), WHOLE)
    clean = sanitize(platform_fixes(r, WHOLE), WHOLE)
    tree = Tree(F.col("nodes"), F.col("texts"), F.col("content_root.node_id"), cleaned=True)
    return clean.select(
        "page_id", big(F.col("clean_stats.removed_nodes")).alias("removed"),
        big(F.size(F.filter("nodes", lambda n: n["live"]))).alias("kept"),
        big(F.length(txt.normalize_text(tree.text(F.col("content_root"))))).alias("text_length"),
    )


@query
def h9_clean_snapshot(spark, d):
    keep_nav = [replace(a, remove=["script", "style"]) for a in WHOLE]
    r = locate_roots(parsed_pages(pages(spark, d), keep_nav), keep_nav)
    s = clean_snapshot(sanitize(platform_fixes(r, keep_nav), keep_nav), keep_nav)
    return s.select("page_id", "titles", "paragraphs", "quotes", "list_items", "images", "links", "scripts", "class_attrs")


@query
def h10_selector_inventory(spark, d):
    return selector_inventory(parsed(spark, d), {
        "root": "article", "title": "article > h1", "paragraph": "article p", "bold": "p > b", "ad": "div.ad",
        "nav_link": "nav li > a[href]",
    })


# ---- blocks --------------------------------------------------------------
@query
def b4_text_blocks(spark, d):
    b = blocks_of(rows_of(spark, d))
    return b.select("page_id", big(F.col("block_pos")).alias("block_pos"), "block_id", "type", big(F.col("level")).alias("level"), "text")


@query
def b5_annotations(spark, d):
    b = blocks_of(rows_of(spark, d))
    return b.select("page_id", big(F.col("block_pos")).alias("block_pos"), F.inline("annotations")).filter("bold").select(
        "page_id", "block_pos", big(F.col("start")).alias("start"), big(F.col("end")).alias("end")
    )


@query
def b6_group_lists(spark, d):
    b = blocks_of(extract(pages(spark, d), NAVIGATION)).filter("type = 'list'")
    return b.select("page_id", "kind", big(F.size("items")).alias("n_items"), F.array_join(F.transform("items", lambda i: i["text"]), "|").alias("items"))


@query
def b13_link_blocks(spark, d):
    """Elements whose whole text is their single link."""
    p = parsed(spark, d)
    tree = Tree(F.col("nodes"), F.col("texts"))

    def link_of(n: Column) -> Column:
        a = tree.first(n, "a[href]")
        return F.struct(
            n["node_id"].alias("node_id"), attr(a, "href").alias("href"),
            txt.normalize_text(tree.text(a)).alias("text"), txt.normalize_text(tree.text(n)).alias("whole"),
        )

    found = F.transform(F.filter("nodes", lambda n: n["tag"].isin("li", "p")), link_of)
    return p.select("page_id", F.inline(found)).filter("href <> '' and text <> '' and text = whole").select("page_id", "href", "text")


@query
def b21_resolve_title(spark, d):
    untitled = [replace(EXAMPLE_ARTICLE, title_selector=None)]
    r = parsed_pages(pages(spark, d), SITES)
    by_rule = resolve_title(locate_roots(r, SITES), SITES).select("page_id", "title")
    by_head = resolve_title(locate_roots(r, untitled), untitled).select("page_id", F.col("title").alias("document_title"))
    return by_rule.join(by_head, "page_id")


# ---- articles ------------------------------------------------------------
@query
def a1_assemble_articles(spark, d):
    return articles(spark, d).select("page_id", "article_id", "source", "title", "n_blocks", "extracted_at")


@query
def a3_validate_default(spark, d):
    a = art.validate_default(articles(spark, d))
    return a.select("page_id", "n_blocks", "strict_text_length", "invalid")


@query
def a4_validate_adapter(spark, d):
    loose = [replace(EXAMPLE_ARTICLE, min_blocks=None, min_text=None, required=[])]
    rows = extract(pages(spark, d), loose)
    return art.assemble_articles(rows, loose, EXTRACTED_AT).select("page_id", "n_blocks", "article_text_length", "rejected")


@query
def a5_merge_extractions(spark, d):
    lines = un.paragraphs_of(documents(spark, d)).withColumnRenamed("page_id", "article_id")
    as_block = lines.select("article_id", "block_pos", "block_id", make_block("paragraph", text=F.col("text")).alias("block"))
    long = as_block.filter(F.length(txt.normalize_for_compare(F.col("block.text"))) >= 40)
    w = Window.partitionBy("article_id").orderBy("block_pos")
    clean = long.withColumn("block_pos", F.row_number().over(w) - 1)
    _, stats = merge_extractions(as_block, clean)
    return stats


# ---- reading units -------------------------------------------------------
@query
def r1_split_units(spark, d):
    u = un.split_units(documents(spark, d).select("doc_id", "text"), "text")
    return u.select("doc_id", "unit_pos", "start", "end", "text")


@query
def r1_unit_cover(spark, d):
    """Units hold every character of a document that is no space."""
    u = un.split_units(documents(spark, d).select("doc_id", "text"), "text")
    solid = F.length(F.regexp_replace("text", f"{txt.SPACE}+", ""))
    return u.groupBy("doc_id").agg(big(F.sum(solid)).alias("n_solid"), big(F.max("end")).alias("last_end"))


@query
def r2_protected_spans(spark, d):
    spans = un.protected_spans(documents(spark, d).select("doc_id", "text"), "text")
    return spans.groupBy("doc_id", "kind", "value").agg(F.count("*").alias("n"))


@query
def r3_sentence_candidates(spark, d):
    s = un.sentence_candidates(documents(spark, d).select("doc_id", "text"), "text")
    return s.select("doc_id", big(F.col("sentence_pos")).alias("sentence_pos"), "sentence")


@query
def r4_build_units(spark, d):
    """Units per block type of the pages' articles; every heading is one unit."""
    b = blocks_of(rows_of(spark, d))
    u = un.build_units(b)
    solid = F.length(F.regexp_replace("text", f"{txt.SPACE}+", ""))
    return u.groupBy("page_id", "unit_type").agg(
        F.countDistinct("block_id").alias("n_blocks"), big(F.sum(solid)).alias("n_solid")
    )


@query
def r7_replay_navigation(spark, d):
    e = table(spark, d, "events")
    k = k_of(e)
    move = (
        F.when(F.col("event_type") == "view", "next").when(F.col("event_type") == "click", "previous")
        .when(F.col("event_type") == "signup", "first").when(F.col("event_type") == "purchase", "last").otherwise("set")
    )
    moves = e.select(F.col("user_id").alias("reader_id"), (k % 20).alias("article_id"), "ts", F.col("event_id").alias("seq"), move.alias("move"), k.alias("target"))
    units = un_counts(spark, d)
    return un.replay_navigation(moves, units)


def un_counts(spark, d) -> DataFrame:
    """Lines per document stand for the units of an article."""
    return documents(spark, d).select(
        F.col("doc_id").alias("article_id"), big(F.size(F.split("text", "\n"))).alias("n_units")
    )


@query
def r8_unit_context(spark, d):
    lines = un.paragraphs_of(documents(spark, d))
    indexed = lines.select("page_id", F.col("block_pos").alias("unit_index"), "text")
    c = un.unit_context(indexed)
    return c.select("page_id", big(F.col("unit_index")).alias("unit_index"), F.length("previous").alias("previous_length"), F.length("next").alias("next_length"))


# ---- reports -------------------------------------------------------------
@query
def g1_block_type_counts(spark, d):
    return rep.block_type_counts(blocks_of(rows_of(spark, d)))


@query
def g2_block_summary(spark, d):
    s = rep.block_summary(blocks_of(rows_of(spark, d)))
    return s.select("page_id", "total_blocks", "low_risk_blocks", "text_length", "bold_ranges", "link_ranges", "ordered_items")


@query
def g3_diff_counts(spark, d):
    """Node counts per tag against the counts of opening tags in the raw text."""
    nodes = node_rows(parsed(spark, d)).groupBy("page_id", F.col("tag").alias("type")).agg(F.count("*").alias("n"))
    raw = raw_tokens(table(spark, d, "pages"))
    name = F.regexp_extract("token", "^</?([a-z0-9]+)", 1)
    tokens = raw.select("page_id", name.alias("type")).filter("type <> ''").groupBy("page_id", "type").agg(F.count("*").alias("n"))
    return rep.diff_counts(nodes, tokens)


@lru_cache(maxsize=4)
def merged_of(spark: SparkSession, sf_dir: str) -> Merged:
    return extract_merged(pages(spark, sf_dir), SITES)


def _report(spark, d) -> DataFrame:
    m = merged_of(spark, d)
    return rep.page_report(m.rows, m.second, m.stats.drop("adapter_id"))


@query
def g4_flag_issues(spark, d):
    f = rep.flag_issues(_report(spark, d))
    return f.select("page_id", F.array_join("issues", ",").alias("issues"))


@query
def g5_corpus_rollup(spark, d):
    f = rep.flag_issues(_report(spark, d)).withColumn("host", url_host(F.col("url")))
    return rep.corpus_rollup(f, "host")


@query
def g7_extraction_report(spark, d):
    return _report(spark, d).select("page_id", "title", "clean_blocks", "primary_blocks", "fallback", "n_lists", "link_ranges", "snapshot_quotes")


@query
def g8_adapter_coverage(spark, d):
    only_en = [replace(EXAMPLE_ARTICLE, url_patterns=["^/en/"])]
    return adapter_coverage(table(spark, d, "pages"), only_en)


# ---- streams -------------------------------------------------------------
def _progress(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    k = k_of(e)
    return e.select(
        F.col("user_id").alias("reader_id"), (k % 20).alias("article_id"), k.alias("focus_index"), "ts", F.col("event_id").alias("seq"),
        F.concat(F.lit("b"), k.cast("string")).alias("unit_id"),
    )


@query
def st5_latest_progress(spark, d):
    return prog.latest_progress(_progress(spark, d), order=("ts", "seq")).select("reader_id", "article_id", "focus_index", "seq")


@query
def st6_resume_index(spark, d):
    latest = prog.latest_progress(_progress(spark, d), order=("ts", "seq"))
    units = un.paragraphs_of(documents(spark, d)).select(
        F.col("page_id").alias("article_id"), F.col("block_id").alias("unit_id"), big(F.col("block_pos")).alias("unit_index")
    )
    return prog.resume_index(latest, units).select("reader_id", "article_id", "unit_id", "resume_index")


@query
def st7_progress_percent(spark, d):
    latest = prog.latest_progress(_progress(spark, d), order=("ts", "seq"))
    sized = latest.join(un_counts(spark, d), "article_id")
    capped = sized.withColumn("at", F.least(F.col("focus_index"), F.col("n_units") - 1))
    return prog.with_percent(capped, "at", "n_units").select("reader_id", "article_id", big(F.col("percent")).alias("percent"))


@query
def st8_page_state(spark, d):
    e = table(spark, d, "events")
    ready = F.col("event_type").isin("view", "click", "purchase")
    states = e.select(
        F.col("user_id").alias("tab_id"), "ts", F.col("event_id").alias("seq"), F.when(ready, "READY").otherwise("NOT_READY").alias("state"),
        F.when(~ready, F.col("event_type")).alias("reason"),
    )
    return prog.page_state(states).select("tab_id", "state", "reason", "seq")


@query
def st9_stable_window(spark, d):
    e = table(spark, d, "events")
    snaps = e.select(F.col("user_id").alias("page_id"), "ts", F.col("event_id").alias("seq"), F.col("event_type").alias("content_hash"))
    return stab.stable_window(snaps, quiet_ms=6 * 3_600_000)


@query
def st10_media_clicks(spark, d):
    e = table(spark, d, "events")
    clicks = stab.media_click_log(e.select(
        "event_type", "ts", (k_of(e) % 20).alias("article_id"), F.lit("b0").alias("block_id"), F.lit("/p").alias("href"),
        upgrade_image_url(F.lit("https://pbs.twimg.com/media/a?name=small")).alias("src"),
    ))
    return stab.click_counts(clicks, "1 day")

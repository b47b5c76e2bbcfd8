"""Corpus reports over block rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
LOW_RISK = ["paragraph", "heading", "quote", "list", "image", "code", "simple-tweet", "image-gallery"]


def block_type_counts(blocks: DataFrame) -> DataFrame:
    """G1."""
    return blocks.groupBy("page_id", "type").agg(F.count("*").alias("n"))


def _ranges(b: DataFrame) -> Column:
    own = F.coalesce("annotations", F.slice("annotations", 1, 0))
    of_items = F.flatten(F.transform("items", lambda i: i["annotations"]))
    return F.when(F.col("type") == "list", of_items).otherwise(own)


def block_summary(blocks: DataFrame, key: str = "page_id") -> DataFrame:
    """Totals, range counts, media counts and text length per article, one aggregation."""
    text = F.col("text")
    size = (
        F.when(F.col("type").isin("paragraph", "heading", "quote", "link", "code"), F.length(text))
        .when(F.col("type") == "list", F.length(F.array_join(F.transform("items", lambda i: i["text"]), "\n")))
        .when(F.col("type") == "simple-tweet", F.length(F.trim(F.concat_ws(" ", "tweet.title", "tweet.excerpt"))))
        .otherwise(0)
    )
    def ranged(test) -> Column:
        return F.size(F.filter("ranges", test))

    rows = blocks.withColumn("ranges", _ranges(blocks))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    count = lambda cond: total(F.when(cond, 1).otherwise(0))
    n = lambda c: F.greatest(F.coalesce(c, F.lit(0)), F.lit(0))
    hls = F.col("video.hls")
    return rows.groupBy(key).agg(
        F.count("*").alias("total_blocks"),
        count(F.col("type").isin(*LOW_RISK)).alias("low_risk_blocks"),
        total(size).alias("text_length"),
        total(n(ranged(lambda r: F.coalesce(r["bold"], F.lit(False))))).alias("bold_ranges"),
        (total(n(ranged(lambda r: r["href"].isNotNull()))) + count(F.col("type") == "link")).alias("link_ranges"),
        total(n(ranged(lambda r: r["emoji"].isNotNull()))).alias("emoji_ranges"),
        count(F.col("image.href").isNotNull()).alias("linked_images"),
        count(hls["master"].isNotNull() | (F.size(hls["video_playlists"]) > 0)).alias("videos_with_playlists"),
        total(n(F.when(F.col("kind") == "ordered", F.size("items")))).alias("ordered_items"),
        total(n(F.when(F.col("kind") == "unordered", F.size("items")))).alias("unordered_items"),
    )


def diff_counts(left: DataFrame, right: DataFrame, keys: tuple[str, ...] = ("page_id", "type")) -> DataFrame:
    """Counts that differ; a missing one is 0."""
    joined = left.withColumnRenamed("n", "n_left").join(right.withColumnRenamed("n", "n_right"), list(keys), "full_outer")
    filled = joined.na.fill(0, ["n_left", "n_right"])
    return filled.filter("n_left <> n_right")


LIST_FIX = "normalize-handwritten-ordered-list"


def side_counts(blocks: DataFrame) -> DataFrame:
    """Counts of one extraction's blocks (page_id, block) that a report names, one row per page."""
    count = lambda cond: F.sum(F.when(cond, 1).otherwise(0)).cast("bigint")
    kind = F.col("block.type")
    own = F.coalesce(F.size(F.filter("block.annotations", lambda r: r["href"].isNotNull())), F.lit(0))
    items = F.flatten(F.transform("block.items", lambda i: F.coalesce(i["annotations"], F.slice("block.annotations", 1, 0))))
    of_items = F.coalesce(F.size(F.filter(items, lambda r: r["href"].isNotNull())), F.lit(0))
    return blocks.groupBy("page_id").agg(
        F.count(F.lit(1)).alias("blocks"), count(kind == "list").alias("n_lists"), count(kind == "simple-tweet").alias("n_posts"),
        count(kind == "link").alias("n_links"), F.sum(F.greatest(own, F.lit(0)) + F.greatest(of_items, F.lit(0))).cast("bigint").alias("link_ranges"),
    )


def page_report(rows: DataFrame, second: DataFrame, stats: DataFrame) -> DataFrame:
    """One row per page from both extractions (`extract_merged`): page facts, counts of either side, differing counts of
    low-risk types, counts of the merge, what the list fix changed and how many quotes the clean tree holds."""
    of_types = lambda blocks: blocks.groupBy("page_id", F.col("block.type").alias("type")).agg(F.count(F.lit(1)).alias("n")).filter(
        F.col("type").isin(*LOW_RISK))
    clean = rows.filter("block_pos >= 0").select("page_id", "block")
    diffs = diff_counts(of_types(second), of_types(clean)).groupBy("page_id").agg(F.count(F.lit(1)).alias("n_count_diffs"))
    primary = side_counts(second).withColumnRenamed("blocks", "primary_blocks")
    cleaned = clean.groupBy("page_id").agg(F.count(F.lit(1)).alias("clean_blocks"))
    fix = F.get(F.filter("page.fixes", lambda f: f["id"] == LIST_FIX), F.lit(0))["changed"]
    facts = rows.filter("block_pos < 0").select(
        "page_id", "page.url", "page.title", "page.root_found", "page.body_found", F.coalesce(fix, F.lit(0)).cast("bigint").alias("list_fix_changed"),
        F.coalesce("page.snapshot.quotes", F.lit(0)).alias("snapshot_quotes"))
    counted = extraction_report(facts, primary, cleaned, diffs, stats)
    # a page without a part of the article has no extraction to report
    numbers = [c for c, kind in counted.dtypes if kind == "bigint" and c != "page_id"]
    whole = F.col("root_found") & F.col("body_found") & (F.coalesce("title", F.lit("")) != "")
    return counted.select("page_id", *[
        F.when(whole, F.coalesce(c, F.lit(0))).otherwise(0).cast("bigint").alias(c) if c in numbers else F.col(c)
        for c in counted.columns if c != "page_id"])


def flag_issues(report: DataFrame) -> DataFrame:
    """Adds `issues`. Needs the columns it names; a missing page part ends the check there."""
    missing = F.array_compact(F.array(
        F.when(~F.col("root_found"), "missing-readView"), F.when(~F.col("body_found"), "missing-longform"),
        F.when(F.coalesce("title", F.lit("")) == "", "missing-title"),
    ))
    fallback = F.coalesce("fallback", F.lit(0))
    found = F.array_compact(F.array(
        F.when(fallback > 0, F.concat(F.lit("fallback-blocks:"), fallback.cast("string"))),
        F.when((fallback > 0) & (F.col("n_count_diffs") > 0), "low-risk-count-diff"),
        F.when((F.col("n_lists") > 0) & (F.col("list_fix_changed") == 0), "list-fix-noop"),
        F.when((F.col("n_posts") > 0) & (F.col("snapshot_quotes") == 0), "quote-snapshot-mismatch"),
        F.when((F.col("link_ranges") == 0) & (F.col("n_links") == 0), "no-link-semantics"),
    ))
    return report.withColumn("issues", F.when(F.size(missing) > 0, missing).otherwise(found))


def corpus_rollup(flagged: DataFrame, *by: str) -> DataFrame:
    """Samples, samples with issues, fallbacks, missing parts, blocks per side."""
    count = lambda cond: F.sum(F.when(cond, 1).otherwise(0)).cast("bigint")
    lost = F.exists("issues", lambda i: i.startswith("missing-"))
    return flagged.groupBy(*by).agg(
        F.count("*").alias("samples"), count(F.size("issues") > 0).alias("with_issues"),
        count(F.coalesce("fallback", F.lit(0)) > 0).alias("with_fallback"), count(lost).alias("missing_selectors"),
        F.sum("primary_blocks").alias("primary_blocks"), F.sum("clean_blocks").alias("clean_blocks"),
    )


def component_coverage(seen: DataFrame, registry: DataFrame) -> DataFrame:
    """Components seen on pages that no handler knows. seen: component; registry: component."""
    counted = seen.groupBy("component").agg(F.count("*").alias("n_seen"))
    return counted.join(registry.select("component"), "component", "left_anti")


def extraction_report(pages: DataFrame, summary: DataFrame, *others: DataFrame) -> DataFrame:
    """One row per page from tables keyed by page_id."""
    report = pages.join(summary, "page_id", "left")
    for table in others:
        report = report.join(table, "page_id", "left")
    return report

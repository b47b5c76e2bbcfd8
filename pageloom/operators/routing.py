"""Which site rules a URL belongs to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.urls import dot_suffixes, url_file, url_host
from ..sources.adapters import MATCH_REASON, Adapter, adapters_df

# Rule tables up to this many (host, pattern) rows travel to every executor;
# larger ones are joined like any other table.
BROADCAST_RULES = 20_000


def rules_df(spark: SparkSession, adapters: list[Adapter], respect_enabled: bool = True) -> DataFrame:
    """One row per (host, pattern); a site without patterns keeps a null pattern."""
    table = adapters_df(spark, adapters)
    if respect_enabled:
        table = table.filter("enabled")
    hosts = table.select("adapter_pos", "adapter_id", "confidence", F.explode("hosts").alias("rule_host"), "url_patterns")
    return hosts.select(
        "adapter_pos", "adapter_id", "confidence", "rule_host", F.explode_outer("url_patterns").alias("pattern")
    )


def route_pages(pages: DataFrame, adapters: list[Adapter], respect_enabled: bool = True) -> DataFrame:
    """Every (page, site) match. The url is all that is needed, so drop html first."""
    rules = rules_df(pages.sparkSession, adapters, respect_enabled)
    size = sum(len(a.hosts) * max(1, len(a.url_patterns)) for a in adapters)
    if size <= BROADCAST_RULES:
        rules = F.broadcast(rules)
    keyed = pages.withColumn("rule_host", F.explode(dot_suffixes(url_host(F.col("url"))))).withColumn(
        "file", url_file(F.col("url"))
    )
    hit = F.col("pattern").isNull() | F.expr("file rlike pattern")
    matched = keyed.join(rules, "rule_host").filter(hit).drop("rule_host", "file", "pattern")
    keys = [c for c in pages.columns]
    # several hosts or patterns of one site may match: still one match
    return matched.dropDuplicates([*keys, "adapter_id"]).withColumn("reason", F.lit(MATCH_REASON))


def best_route(matches: DataFrame, key: str = "page_id") -> DataFrame:
    """Highest confidence; ties go to the earlier rule."""
    best = F.min_by(
        F.struct("adapter_id", "confidence", "reason"), F.struct((-F.col("confidence")).alias("c"), "adapter_pos")
    )
    return matches.groupBy(key).agg(best.alias("m")).select(key, "m.*")


def route_column(url: Column, adapters: list[Adapter]) -> Column:
    """U1+U2 as one column, for pipelines that carry the html along: no join, no shuffle."""
    host, file = url_host(url), url_file(url)
    chosen = None
    for a in sorted((a for a in adapters if a.enabled), key=lambda a: -a.confidence):
        on_host = F.lit(False)
        for h in a.hosts:
            on_host = on_host | (host == h) | host.endswith("." + h)
        on_path = F.lit(not a.url_patterns)
        for p in a.url_patterns:
            on_path = on_path | F.regexp_like(file, F.lit(p))
        hit = on_host & on_path
        chosen = F.when(hit, F.lit(a.id)) if chosen is None else chosen.when(hit, F.lit(a.id))
    return chosen if chosen is not None else F.lit(None).cast("string")


def route(pages: DataFrame, adapters: list[Adapter]) -> DataFrame:
    """Pages some site rule claims, with `adapter_id`."""
    return pages.withColumn("adapter_id", route_column(F.col("url"), adapters)).filter("adapter_id is not null")


def article_identity(routed: DataFrame, adapters: list[Adapter]) -> DataFrame:
    """Id, source and source kind of a routed page."""
    facts = F.create_map(*[F.lit(v) for a in adapters for v in (a.id, a.source)]) if adapters else None
    platforms = F.create_map(*[F.lit(v) for a in adapters for v in (a.id, a.platform)])
    types = F.create_map(*[F.lit(v) for a in adapters for v in (a.id, a.content_type)])
    adapter = F.col("adapter_id")
    return routed.select(
        "*",
        F.concat(adapter, F.lit(":"), F.col("url")).alias("article_id"),
        F.element_at(facts, adapter).alias("source"),
        F.when(adapter == "fixture.article", "fixture").otherwise("platform").alias("source_kind"),
        F.element_at(platforms, adapter).alias("platform"),
        F.element_at(types, adapter).alias("content_type"),
    )


def audit_hosts(media: DataFrame, allowlist: DataFrame) -> DataFrame:
    """How often media come from hosts nobody declared. Exact hosts, no wildcards."""
    counted = media.select(url_host(F.col("src")).alias("host")).filter("host is not null").groupBy("host").count()
    return counted.join(allowlist.select("host"), "host", "left_anti").withColumnRenamed("count", "n_media")


def adapter_coverage(pages: DataFrame, adapters: list[Adapter]) -> DataFrame:
    """Pages per host and site rule; `unsupported_url` where no rule applies."""
    adapter = route_column(F.col("url"), adapters)
    return (
        pages.select(url_host(F.col("url")).alias("host"), adapter.alias("adapter_id"))
        .withColumn("reason", F.when(F.col("adapter_id").isNull(), "unsupported_url").otherwise(MATCH_REASON))
        .groupBy("host", "adapter_id", "reason")
        .agg(F.count("*").alias("n_pages"))
    )

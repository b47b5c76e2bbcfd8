"""ST9, ST10: quiet pages and media clicks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the readiness check.
MAX_CHECKS = 40
CHECK_MS = 250


def readiness_budget(checks: DataFrame, key: str = "tab_id", max_checks: int = MAX_CHECKS, check_ms: int = CHECK_MS) -> DataFrame:
    """ST9: the outcome of repeated checks: ready at the first check without a reason, else not ready with the last reason.

    checks: key, check_no (from 1), not_ready. Checks beyond the budget are never looked at."""
    ready_at = F.min(F.when(F.col("not_ready").isNull(), F.col("check_no")))
    found = checks.filter(F.col("check_no").between(1, max_checks)).groupBy(key).agg(
        ready_at.alias("ready_at"), F.max("check_no").alias("checked"), F.max_by("not_ready", "check_no").alias("last"))
    ready = F.col("ready_at").isNotNull()
    return found.select(
        key, F.when(ready, "READY").otherwise("NOT_READY").alias("state"), F.when(~ready, F.col("last")).alias("reason"),
        (F.coalesce("ready_at", "checked") * check_ms).alias("waited_ms"))


def stable_window(snapshots: DataFrame, quiet_ms: int, key: str = "page_id", slice_seconds: int = 86_400, seq: str = "seq") -> DataFrame:
    """ST9: for every content change, how long the page then stayed quiet.

    snapshots: key, ts, seq, content_hash. A row opens a span when its hash
    differs from the row before; the span lasts to the next change. Windows run
    per (key, time slice), so a hot page is spread over its slices; the edges of
    a slice are one row each and are linked in a second, small window.
    """
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    cut = snapshots.withColumns({"ms": ms, "slice": F.floor(ms / (1000 * slice_seconds))})
    edges = cut.groupBy(key, "slice").agg(F.max_by("content_hash", F.struct("ts", seq)).alias("last_hash"))
    edges = edges.withColumn("carried", F.lag("last_hash").over(Window.partitionBy(key).orderBy("slice")))
    inner = Window.partitionBy(key, "slice").orderBy("ts", seq)
    rows = cut.withColumn("prev", F.lag("content_hash").over(inner)).withColumn("rn", F.row_number().over(inner))
    linked = rows.join(edges.select(key, "slice", "carried"), [key, "slice"], "left")
    before = F.when(F.col("rn") == 1, F.col("carried")).otherwise(F.col("prev"))
    changes = linked.withColumn("before", before).filter("before is null or before <> content_hash")
    changes = changes.select(key, "slice", "ms", F.col(seq), "content_hash")
    # the next change: inside the slice by lead, across slices by the first change of a later one
    c_inner = Window.partitionBy(key, "slice").orderBy("ms", seq)
    firsts = changes.groupBy(key, "slice").agg(F.min("ms").alias("first_ms"))
    firsts = firsts.withColumn("later_ms", F.lead("first_ms").over(Window.partitionBy(key).orderBy("slice")))
    spans = changes.withColumn("next_ms", F.lead("ms").over(c_inner)).join(firsts.select(key, "slice", "later_ms"), [key, "slice"])
    until = F.coalesce("next_ms", "later_ms")
    quiet = until - F.col("ms")
    return spans.select(
        key, F.col(seq), "content_hash", F.col("ms").alias("changed_at"), quiet.alias("quiet_for"),
        F.coalesce(quiet >= quiet_ms, F.lit(True)).alias("stable"),
    )


def stable_sessions(snapshots: DataFrame, quiet: str = "5 minutes", late: str = "10 minutes", key: str = "page_id") -> DataFrame:
    """ST9 on a stream: activity closes after `quiet` without a snapshot."""
    return snapshots.withWatermark("ts", late).groupBy(key, F.session_window("ts", quiet).alias("s")).agg(
        F.count("*").alias("n_snapshots")
    ).select(key, F.col("s.start").alias("opened"), F.col("s.end").alias("quiet_at"), "n_snapshots")


def media_click_log(events: DataFrame) -> DataFrame:
    """ST10: the click events of a message stream, append only."""
    return events.filter("event_type = 'click'").select("ts", "article_id", "block_id", "href", "src")


def click_counts(clicks: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """ST10: clicks per article and window."""
    source = clicks.withWatermark("ts", late) if clicks.isStreaming else clicks
    return source.groupBy(F.window("ts", width).alias("w"), "article_id").agg(F.count("*").alias("n_clicks")).select(
        F.col("w.start").alias("opened"), "article_id", "n_clicks"
    )

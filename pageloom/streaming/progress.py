"""ST5-ST8: reading progress and page state, latest value per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import progress_percent

PROGRESS = "unit_id string, focus_index int, updated_at bigint"


def parse_progress(raw: DataFrame, json_col: str = "value") -> DataFrame:
    """Saved progress from JSON; text that is no JSON counts as never saved."""
    parsed = F.from_json(F.col(json_col), PROGRESS + ", bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad"})
    rest = [c for c in raw.columns if c != json_col]
    return raw.select(*rest, parsed.alias("p")).filter("p is not null and p.bad is null").select(*rest, "p.unit_id", "p.focus_index", "p.updated_at")


def latest_progress(progress: DataFrame, keys: tuple[str, ...] = ("reader_id", "article_id"), order: tuple[str, ...] = ("updated_at",)) -> DataFrame:
    """ST5: last saved value per key.

    max_by keeps one row per key in partial (sort) aggregates, so a hot key is
    one row per task after them, on a batch and in update mode on a stream alike. Late rows do
    no harm: an older value never wins.
    """
    values = [c for c in progress.columns if c not in keys]
    best = F.max_by(F.struct(*values), F.struct(*order))
    return progress.groupBy(*keys).agg(best.alias("v")).select(*keys, "v.*")


def page_state(events: DataFrame) -> DataFrame:
    """ST8: READY or NOT_READY with its reason per tab, latest wins."""
    return latest_progress(events, keys=("tab_id",), order=("ts", "seq"))


def resume_index(progress: DataFrame, units: DataFrame) -> DataFrame:
    """ST6: index of the saved unit in today's units; 0 when it is gone."""
    at = units.select("article_id", "unit_id", "unit_index")
    return progress.join(at, ["article_id", "unit_id"], "left").withColumn("resume_index", F.coalesce("unit_index", F.lit(0))).drop("unit_index")


def with_percent(df: DataFrame, index: str, total: str) -> DataFrame:
    """ST7."""
    return df.withColumn("percent", progress_percent(F.col(index), F.col(total)))

"""Numbers and dates (T11-T14, T17): metrics, ratios, display dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
DISPLAY_ZONE = "Asia/Shanghai"
METRIC_PATTERN = "[0-9]+(?:\\.[0-9]+)?[KMB万]?"
ARTICLE_METRIC_PATTERN = "(?i)[0-9,.]+(?:\\.[0-9]+)?(?:万|[KMB])?"
METRIC_SCALES = {"K": 1e3, "M": 1e6, "B": 1e9, "万": 1e4}
METRIC_TEXT = "(?i)^(?:[0-9]+(?:\\.[0-9]+)?[KMB万]?|[0-9]+\\s+(?:replies|reposts|likes|bookmarks|views))$"
DATE_TEXT = "^(?i)(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\\s+[0-9]{1,2}$|^[0-9]+月[0-9]+日$"
DURATION_TEXT = "^[0-9]+:[0-9]{2}$"


def round_half_up(c: Column, digits: int = 0) -> Column:
    """Rounds like a browser does: halves go up."""
    scale = float(10**digits)
    return F.floor(c * scale + 0.5) / scale


def metric_label(c: Column) -> Column:
    """The first count in a label, '' when there is none."""
    return F.regexp_extract(F.regexp_replace(c, "\\s+", " "), METRIC_PATTERN, 0)


def article_metric_label(c: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(c, "\\s+", " "), ARTICLE_METRIC_PATTERN, 0)


def metric_value(c: Column) -> Column:
    """`1.2K` -> 1200.0."""
    label = F.regexp_replace(c, ",", "")
    number = F.regexp_extract(label, "^([0-9]+(?:\\.[0-9]+)?)", 1).try_cast("double")
    unit = F.upper(F.regexp_extract(label, "([KMBkmb万])$", 1))
    scale = F.lit(1.0)
    for name, factor in METRIC_SCALES.items():
        scale = F.when(unit == name, F.lit(factor)).otherwise(scale)
    return number * scale


def plain_number(c: Column) -> Column:
    """A double the way scripts print it: no trailing `.0`."""
    whole = c.cast("bigint")
    return F.when(c == whole, whole.cast("string")).otherwise(c.cast("string"))


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def format_metric(c: Column, singular: str, plural: str) -> Column:
    """`1 Like`, `2 Likes`."""
    d = c.cast("double")
    word = F.when(d == 1, F.lit(singular)).otherwise(F.lit(plural))
    return F.when(_finite(d), F.concat(plain_number(d), F.lit(" "), word))


def format_compact_metric(c: Column, singular: str, plural: str) -> Column:
    """Thousands as `1.23K`."""
    d = c.cast("double")
    word = F.when(d == 1, F.lit(singular)).otherwise(F.lit(plural))
    shown = F.when(d >= 1000, F.concat(plain_number(round_half_up(d / 1000, 2)), F.lit("K"))).otherwise(plain_number(d))
    return F.when(_finite(d), F.concat(shown, F.lit(" "), word))


def format_published(ts: Column) -> Column:
    """`8:05 AM · Jan 1, 2024` in the display zone, '' when unknown."""
    local = F.from_utc_timestamp(ts, DISPLAY_ZONE)
    return F.coalesce(F.date_format(local, "h:mm a · MMM d, yyyy"), F.lit(""))


def parse_timestamp(c: Column) -> Column:
    return c.try_cast("timestamp")


def is_date_text(c: Column) -> Column:
    """T14."""
    return F.regexp_like(c, F.lit(DATE_TEXT))


def is_duration_text(c: Column) -> Column:
    """T14."""
    return F.regexp_like(c, F.lit(DURATION_TEXT))


def is_metric_text(c: Column) -> Column:
    return F.regexp_like(c, F.lit(METRIC_TEXT))


def aspect_ratio(width: Column, height: Column) -> Column:
    """Four decimals, only for positive finite sizes."""
    w, h = width.try_cast("double"), height.try_cast("double")
    return F.when(_finite(w) & _finite(h) & (w > 0) & (h > 0), round_half_up(w / h, 4))


def positive_number(c: Column) -> Column:
    d = c.try_cast("double")
    return F.when(_finite(d) & (d > 0), d)


def progress_percent(index: Column, total: Column) -> Column:
    """ST7."""
    return F.floor((index + 1) / F.greatest(total, F.lit(1)) * 100 + 0.5).cast("int")

"""Stored articles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import ARTICLE_JSON


def read_articles(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(good, bad). Bad: not JSON, no id, title or blocks, or a block without id or type."""
    raw = spark.read.schema(ARTICLE_JSON + ", corrupt string").option("columnNameOfCorruptRecord", "corrupt").json(path)
    some = lambda c: F.coalesce(c, F.lit("")) != ""
    whole = F.coalesce(F.forall("blocks", lambda b: some(b["id"]) & some(b["type"])), F.lit(False))
    marked = raw.withColumn(
        "problem",
        F.when(F.col("corrupt").isNotNull(), "corrupt_record").when(~some(F.col("id")), "missing_id")
        .when(~some(F.col("title")), "missing_title").when(F.col("blocks").isNull(), "missing_blocks").when(~whole, "broken_block"),
    )
    return marked.filter("problem is null").drop("problem", "corrupt"), marked.filter("problem is not null")


def upsert_articles(store: DataFrame | None, updates: DataFrame, key: str = "article_id", order: tuple[str, ...] = ("extracted_at",)) -> DataFrame:
    """S3: whole records by id, the last write wins.

    max_by folds the copies of a hot id into one row per task before the shuffle (by a sort within the task).
    """
    both = updates if store is None else store.unionByName(updates)
    rest = [c for c in both.columns if c != key]
    return both.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("v")).select(key, "v.*")


def get_articles(store: DataFrame, ids: DataFrame, key: str = "article_id") -> DataFrame:
    """Wanted ids with their records, nulls when absent."""
    return ids.select(key).join(store, key, "left")


def delete_articles(store: DataFrame, ids: DataFrame, key: str = "article_id") -> DataFrame:
    """S5."""
    return store.join(ids.select(key), key, "left_anti")

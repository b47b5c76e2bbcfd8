"""Shared pieces of the operators: tables, blocks of neighbouring ids, intermediate tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir, written  # noqa: F401


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
TEXTS_PER_BATCH = "2000"


def short_batches(spark: SparkSession) -> None:
    """Arrow batches of a few megabytes of text, on both sides of the socket, unless the session's owner chose a size."""
    if not spark.sparkContext.getConf().contains(ARROW_ROWS):
        spark.conf.set(ARROW_ROWS, TEXTS_PER_BATCH)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    short_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_written(df: DataFrame) -> None:
    """Deletes a table that `written` made, once nothing reads it any more."""
    spark = df.sparkSession
    root = f"{shared_dir(spark)}/".removeprefix("file:")
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if re.search(re.escape(root) + r"[\w-]+-[0-9a-f]{32}$", folder):
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_volume(docs: DataFrame, text: str) -> tuple[int, int]:
    """Rows and bytes of text."""
    row = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(text)).alias("b")).first()
    return row["n"], row["b"] or 0


def block_bounds(docs: DataFrame, id_col: str, n_blocks: int) -> list[int]:
    """Ids that cut the table into about n_blocks runs of neighbouring ids with about as many rows each."""
    if n_blocks < 2:
        return []
    cuts = [i / n_blocks for i in range(1, n_blocks)]
    found = docs.agg(F.percentile_approx(id_col, cuts, max(10_000, 20 * n_blocks)).alias("q")).first()["q"]
    return sorted(set(found or []))


def block_of(id_col: str, text_col: str, bounds: list[int]) -> Column:
    """The number of bounds below the id, by binary search; rows without an id follow in 16 blocks by text hash."""
    steps = 1
    while steps <= len(bounds):
        steps *= 2
    padded = F.array(*[F.lit(b).cast("long") for b in bounds + [2**63 - 1] * (steps - len(bounds))])
    halves = [steps >> i for i in range(1, steps.bit_length())]
    spot = F.lit(0)
    if halves and bounds:
        spot = F.aggregate(
            F.array(*[F.lit(h) for h in halves]), F.lit(0),
            lambda at, step: F.when(F.get(padded, at + step - 1) < F.col(id_col), at + step).otherwise(at),
        )
    return F.when(F.col(id_col).isNull(), F.lit(len(bounds) + 1) + F.pmod(F.xxhash64(text_col), F.lit(16)).cast("int")).otherwise(spot)


def slices(batch, rows: int = 1_000):
    """An Arrow batch in pieces of few rows, so that what goes back is small too."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def bounded_sample(df: DataFrame, id_col: str, limit: int) -> DataFrame:
    """At most `limit` rows, those with the lowest hash of the id. Thinned by that hash first, so tasks send few rows more."""
    scale = 1 << 40
    n = df.count()
    spread = F.pmod(F.xxhash64(id_col), F.lit(scale))
    thin = df if n <= limit else df.filter(spread < int(scale * min(1.0, 1.5 * limit / n)))
    return thin.orderBy(spread, id_col).limit(limit)

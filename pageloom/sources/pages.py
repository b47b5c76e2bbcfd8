"""Page scans, S7: stage dumps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """(page_id, url, html). `fmt='html'` scans a folder of saved pages."""
    if fmt == "html":
        raw = spark.read.text(path, wholetext=True)
        name = F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)\\.html?$", 1)
        return raw.select(
            F.xxhash64(F.col("_metadata.file_path")).alias("page_id"),
            F.concat(F.lit("https://fixture.local/article/"), name).alias("url"),
            F.col("value").alias("html"),
        )
    if fmt == "json":
        return spark.read.schema("page_id bigint, url string, html string").json(path)
    return spark.read.format(fmt).load(path).select("page_id", "url", "html")


def dump_stages(path: str, run: str, **stages: DataFrame) -> None:
    """Rows of each stage as JSON next to their page, partitioned by stage and run. A run that is repeated replaces its own
    stages and no others."""
    for name, df in stages.items():
        rest = [c for c in df.columns if c != "page_id"]
        row = df.select("page_id", F.to_json(F.struct(*rest)).alias("row"), F.lit(name).alias("stage"), F.lit(run).alias("run"))
        row.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("stage", "run").parquet(path)


def read_stage(spark: SparkSession, path: str, stage: str, run: str) -> DataFrame:
    """The rows (page_id, row) that a run dumped of a stage."""
    return spark.read.parquet(path).filter((F.col("stage") == stage) & (F.col("run") == run)).select("page_id", "row")

"""S3-S5, ST5: a table of the latest record per key, kept as Parquet that batches only add to.

Every batch writes one folder of changes, hashed into buckets by key, with deletions as rows of their own; a batch that runs
again replaces its own folder. Readers take the last change of each key. Compaction folds the changes up to a batch into a
base folder, bucket by bucket, and drops what the base replaces. A folder counts once its `_SUCCESS` is there, so a lost
executor or driver leaves nothing half read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType


class KeyedStore:
    """Records of `schema` (DDL, keys included) by `keys`; of two changes the one later by `order` counts, then by batch.

    `path` is a folder that driver and executors share.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: tuple[str, ...], order: tuple[str, ...], buckets: int = 64):
        self.spark, self.path, self.keys, self.order, self.buckets = spark, path.rstrip("/"), keys, order, buckets
        self.schema = spark.createDataFrame([], schema).schema
        self._folder = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._folder.getFileSystem(spark._jsc.hadoopConfiguration())

    def _bucket(self) -> Column:
        return F.pmod(F.hash(*self.keys), F.lit(self.buckets)).alias("bucket")

    def _done(self, kind: str) -> list[int]:
        """Numbers of the finished folders of a kind (`batch` or `base`), ascending."""
        if not self._fs.exists(self._folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._folder)]
        numbers = [int(n.split("=")[1]) for n in names if n.startswith(f"{kind}=")]
        return sorted(n for n in numbers if self._fs.exists(self._path(f"{kind}={n}/_SUCCESS")))

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _changes(self, upto: int | None = None) -> DataFrame:
        """Base and later changes with their bucket and batch."""
        bases = [b for b in self._done("base") if upto is None or b <= upto]
        base = bases[-1] if bases else -1
        folders = [("base", base)] if bases else []
        folders += [("batch", n) for n in self._done("batch") if n > base and (upto is None or n <= upto)]
        stored = StructType([*self.schema.fields, StructField("gone", BooleanType()), StructField("bucket", IntegerType())])
        out = self.spark.createDataFrame([], StructType([*stored.fields, StructField("batch", LongType())]))
        for kind, n in folders:
            read = self.spark.read.schema(stored).parquet(f"{self.path}/{kind}={n}")
            out = out.unionByName(read.withColumn("batch", F.lit(n).cast("bigint")))
        return out

    def _last(self, changes: DataFrame) -> DataFrame:
        """The last change per key. max_by leaves one row per key and task ahead of the exchange."""
        rest = [f.name for f in self.schema if f.name not in self.keys]
        place = F.struct(*self.order, "batch")
        last = changes.groupBy("bucket", *self.keys).agg(F.max_by(F.struct(*rest, "gone"), place).alias("v"))
        return last.select("bucket", *self.keys, *[F.col(f"v.{c}").alias(c) for c in rest], "v.gone")

    def write(self, batch: DataFrame, number: int, deleted: Column | bool = False) -> None:
        """Adds a batch of records, or deletions where `deleted` holds. Only its own buckets get files. The number tells batches
        apart: the same number again replaces the first attempt, or changes nothing once compaction has taken it in."""
        if number <= max(self._done("base"), default=-1):
            return
        gone = F.lit(deleted) if isinstance(deleted, bool) else F.coalesce(deleted, F.lit(False))
        fields = [F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema]
        rows = batch.select(*fields, gone.alias("gone"), self._bucket(), F.lit(number).cast("bigint").alias("batch"))
        self._last(rows).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/batch={number}")

    def sink(self, deleted: Callable[[DataFrame], Column] | None = None) -> Callable[[DataFrame, int], None]:
        """For foreachBatch: the number of the micro-batch is the batch's."""
        return lambda batch, number: self.write(batch, number, False if deleted is None else deleted(batch))

    def read(self) -> DataFrame:
        """All records that are not deleted."""
        return self._last(self._changes()).filter("not gone").drop("gone", "bucket")

    def get(self, ids: DataFrame) -> DataFrame:
        """Wanted keys with their records, nulls when absent. Changes of other buckets are not read: ids name their buckets, and
        the join on them prunes the scan's folders."""
        wanted = ids.select(*self.keys).distinct().withColumn("bucket", self._bucket())
        mine = self._changes().join(F.broadcast(wanted.select("bucket").distinct()), "bucket", "left_semi")
        found = self._last(mine).filter("not gone").drop("gone")
        return wanted.join(found, [*self.keys, "bucket"], "left").drop("bucket")

    def compact(self, upto: int | None = None) -> None:
        """Folds all changes up to a batch (default: the last) into a new base and drops the folders it replaces. Deletions go
        with it, as nothing older is left to hide."""
        numbers = self._done("batch")
        upto = max(numbers, default=-1) if upto is None else upto
        bases = self._done("base")
        if upto >= 0 and upto not in bases and any(n <= upto for n in numbers):
            kept = self._last(self._changes(upto)).filter("not gone")
            kept.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/base={upto}")
        base = max(self._done("base"), default=-1)
        for kind in ("batch", "base"):
            for n in self._done(kind):
                if n < base or (n == base and kind == "batch"):
                    self._fs.delete(self._path(f"{kind}={n}"), True)

"""Operator 4, quality classifier: importance resampling.

Two generative models over hashed words and word pairs, one of the target text and one of the raw text, are sums of
counts per bucket: one pass over all documents, added up per bucket before and after the shuffle. Rows of target text
are marked by a join with the labels, so both models cover their whole text. A second pass gives each document the logarithm of its likelihood ratio. Documents are drawn without replacement by Gumbel top-k: log ratio
plus Gumbel noise, the k greatest stay. The k-th greatest is found exactly by counting leading bits, 16 at a time.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..kernels import ship_by_value
from . import words as wd
from .common import table, written

ship_by_value(__name__)

BUCKETS = 1 << 16
SMOOTHING = 1.0
SEED = 20
PREFIX_BITS = 16


def bucket_runs(texts: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all words and word pairs with the text of each, and words per text."""
    words = wd.split_words(texts, lower=True)
    h = wd.word_hashes(words)
    at = wd.runs_of(words.doc, 2)
    every = np.concatenate([h, wd.run_hashes(h, at, 2)])
    return (every % np.uint64(buckets)).astype(np.int64), np.concatenate([words.doc, words.doc[at]]), words.counts()


def count_batches(batches, buckets: int):
    raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for batch in batches:
        wanted = batch.column(0).to_numpy(zero_copy_only=False)
        for a, b in wd.chunks(batch.column(1)):
            bucket, doc, _ = bucket_runs(batch.column(1).slice(a, b - a), buckets)
            raw += np.bincount(bucket, minlength=buckets)
            target += np.bincount(bucket[wanted[a:b][doc]], minlength=buckets)
    some = np.flatnonzero(raw)
    yield pa.record_batch({"bucket": pa.array(some, pa.int64()), "raw": pa.array(raw[some]), "target": pa.array(target[some])})


def gumbel(ids: pa.Array, seed: int) -> np.ndarray:
    """Gumbel noise drawn from the id, so a lost task draws the same again."""
    h = wd.mix(wd.mix(ids.fill_null(-1).to_numpy().astype(np.uint64)) + np.uint64(seed))
    return -np.log(-np.log(((h >> np.uint64(11)).astype(float) + 0.5) / 2.0**53))


def score_batches(batches, ratios: np.ndarray, seed: int):
    for batch in batches:
        for a, b in wd.chunks(batch.column(1)):
            ids = batch.column(0).slice(a, b - a)
            bucket, doc, n_words = bucket_runs(batch.column(1).slice(a, b - a), len(ratios))
            weight = np.bincount(doc, ratios[bucket], minlength=b - a)
            key = weight + gumbel(ids, seed)
            bits = key.view(np.int64)
            yield pa.record_batch({
                "doc_id": ids, "n_words": pa.array(n_words, pa.int64()), "log_weight": pa.array(weight), "gumbel_key": pa.array(key),
                "place": pa.array(np.where(bits < 0, bits ^ np.int64(2**63 - 1), bits)),  # ascends as the key does
            })


def marked(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """Every text, and whether its doc_id is among `targets` (doc_id, distinct). Rows without doc_id never are; they are
    dealt out by their text. Always one exchange of the text, whatever the number of targets, so none of them is held on
    the driver."""
    wanted = targets.select(F.col("doc_id").cast("long").alias("target_id")).hint("shuffle_hash")  # no sort of the text
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    key = F.coalesce("doc_id", F.xxhash64("text"))
    return own.join(wanted, (key == F.col("target_id")) & F.col("doc_id").isNotNull(), "left").select(
        F.col("target_id").isNotNull().alias("wanted"), "text")


def log_ratios(docs: DataFrame, targets: DataFrame | list[int], buckets: int = BUCKETS) -> np.ndarray:
    """log p_target - log p_raw of each bucket; zeros where there is no target text. targets: a table of distinct doc_id,
    or a list of them."""
    if isinstance(targets, list):
        targets = docs.sparkSession.createDataFrame([(i,) for i in sorted(set(targets))], "doc_id long")
    counted = (
        marked(docs, targets)
        .mapInArrow(lambda batches: count_batches(batches, buckets), "bucket long, raw long, target long")
        .groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()  # at most `buckets` rows
    )
    if not any(r["target"] for r in counted):
        return np.zeros(buckets)
    raw, target = np.full(buckets, SMOOTHING), np.full(buckets, SMOOTHING)
    for r in counted:
        raw[r["bucket"]] += r["raw"]
        target[r["bucket"]] += r["target"]
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def kth_greatest(df: DataFrame, place: str, k: int) -> int | None:
    """The k-th greatest of a whole-number column, by four rounds of counts over its leading bits."""
    if k < 1:
        return None
    found, bits = 0, 64
    rest = df.select((F.col(place).bitwiseXOR(F.lit(-(2**63)))).alias("p"))  # as an unsigned number
    while bits:
        bits -= PREFIX_BITS
        head = F.shiftrightunsigned("p", bits)
        counts = rest.filter(F.shiftrightunsigned("p", bits + PREFIX_BITS) == found).groupBy(head.alias("h")).count() if bits + PREFIX_BITS < 64 else rest.groupBy(head.alias("h")).count()
        for r in sorted(counts.collect(), key=lambda r: -(r["h"] % 2**64)):
            if k <= r["count"]:
                found = r["h"]
                break
            k -= r["count"]
        else:
            return None
    return found ^ -(2**63)


def top_k(df: DataFrame, place: str, k: int, ties: list[str]) -> DataFrame:
    """Adds `kept`: exactly k rows (all if there are fewer) with the greatest `place`, of equals the first by `ties`."""
    n = df.count()
    if k >= n:
        return df.withColumn("kept", F.lit(True))
    least = kth_greatest(df, place, k)
    if least is None:
        return df.withColumn("kept", F.lit(False))
    above = df.filter(F.col(place) > least).count()
    equal = df.filter(F.col(place) == least)
    nth = F.row_number().over(Window.partitionBy(place).orderBy(*ties))
    return df.filter(F.col(place) != least).withColumn("kept", F.col(place) > least).unionByName(
        equal.withColumn("nth", nth).withColumn("kept", F.col("nth") <= k - above).drop("nth"))


def importance_resampling(
    docs: DataFrame, labels: DataFrame, *, keep_share: float | None = None, seed: int = SEED, buckets: int = BUCKETS,
) -> DataFrame:
    """Draws documents that look like the target: those labelled `quality` 1, all of them.

    keep_share is the share of rows to keep, rounded up; unset, it is the target's share of the labelled documents and a
    quarter of the rest. Returns doc_id, n_words, log_weight, gumbel_key and kept.

    Null and empty texts have log weight 0, and so has every text if no document is labelled 1. Equal keys (repeated
    rows of one id and text) are kept in the order of id. Rows without doc_id share one draw of noise. Other columns are
    ignored; an empty table gives an empty result.
    """
    marks = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    shares = marks.agg(F.avg((F.col("quality") > 0).cast("double")).alias("good")).first()["good"]
    ratios = docs.sparkSession.sparkContext.broadcast(log_ratios(docs, marks.filter("quality > 0").select("doc_id"), buckets))  # one number per bucket
    scored = written(
        docs.selectExpr("cast(doc_id as bigint) as doc_id", "text").mapInArrow(
            lambda batches: score_batches(batches, ratios.value, seed),
            "doc_id long, n_words long, log_weight double, gumbel_key double, place long"),
        "importance",
    )
    share = keep_share if keep_share is not None else 0.25 + 0.75 * (1 if shares is None else shares)
    kept = top_k(scored, "place", math.ceil(share * scored.count()), ["doc_id", "n_words"])
    return kept.select("doc_id", "n_words", "log_weight", "gumbel_key", "kept")


def op4_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resampling(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

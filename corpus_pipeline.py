"""Training-text pipeline: documents in, packed token sequences out. Each stage's table is written and read again."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.llm import jaccard_join, language_id, packing, substring_dedup, toxicity
from pageloom.llm.common import shared_dir, short_batches, table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document whose text is clearly of another language than it claims goes; this is how clearly.
WRONG_LANGUAGE = 0.3


def documents(docs: DataFrame) -> DataFrame:
    short_batches(docs.sparkSession)
    return docs.select(*COLUMNS)


def toxic_gone(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents predicted toxic go. Rows without doc_id and empty texts are judged like others."""
    return toxicity.without_toxic(documents(docs), table(spark, sf_dir, "labels"))


def languages_right(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: texts of no language (null, or no letter) go, and those clearly of another language than `lang` says.
    A null lang is taken as it is."""
    return language_id.without_wrong_language(documents(docs), WRONG_LANGUAGE)


def single_rows(docs: DataFrame) -> DataFrame:
    """One row of each (doc_id, text), a missing id being one like others. Only rows whose id occurs again are moved."""
    again = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("doc_id").alias("id"), F.lit(True).alias("again"))
    again = written(again, "repeated-ids")
    n = again.count()
    if not n:
        return docs
    marked = docs.join(F.broadcast(again) if n <= jaccard_join.BROADCAST_IDS else again, F.col("doc_id").eqNullSafe(F.col("id")), "left")
    once = marked.filter("again is null").select(*COLUMNS)
    return once.unionByName(marked.filter("again").select(*COLUMNS).dropDuplicates(["doc_id", "text"]))


def near_copies_gone(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7 on shingles of five words and a similarity of 0.8: of each group the document with the smallest id stays.

    Rows that share a doc_id are one document, which goes or stays with all its texts; of repeated rows one stays. Documents
    that link with nothing stay, and so do rows without doc_id, of which only repeats go. An empty table stays empty."""
    docs = single_rows(documents(docs))
    near = jaccard_join.jaccard_components(docs, shingle=5, percent=80).filter("doc_id <> component_id").select("doc_id").distinct()
    near = written(near, "near-copies")
    gone = F.broadcast(near) if near.count() <= jaccard_join.BROADCAST_IDS else near
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def repeats_gone(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: words of 20-word windows that start earlier go; what is left is the text, joined by single spaces. A
    document that loses all its words goes; one that loses none keeps its text as it is."""
    docs = documents(docs)
    kept = substring_dedup.substring_dedup(docs, carry=["lang", "source", "n_chars"], verbatim=True)
    return kept.filter("n_removed = 0 or n_removed < n_words").select(
        "doc_id", F.col("kept_text").alias("text"), "carry.lang", "carry.source",
        F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("carry.n_chars")).alias("n_chars"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: token pieces of all that is left, packed into sequences of 2048."""
    return packing.best_fit_packing(documents(docs), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxic_gone),
    ("language ID", languages_right),
    ("n-gram Jaccard join", near_copies_gone),
    ("substring dedup", repeats_gone),
    ("best-fit packing", packed),
]

#: Learned models and a tokenizer are beyond SQL; tests hold each stage and the whole against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage reads its predecessor's written table."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{base}/{i}")
        docs = spark.read.schema(out.schema).parquet(f"{base}/{i}")
    return docs

"""Operator 12: the perfect hash by its definition, groups against brute force, awkward tables."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from llm_cases import ROWS, SCHEMA, SF, row
from pyspark.sql import functions as F

from pageloom.llm import exact_dedup as xd


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def brute_force(rows):
    """Multiset of (doc_id, keep_id, group_size, kept, digest)."""
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[hashlib.sha256(normal(text).encode()).digest()].append(doc_id)
    out = []
    for digest, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        stays = ids.index(keep)
        out += [(i, keep, len(ids), at == stays, digest) for at, i in enumerate(ids)]
    return sorted(out, key=repr)


def result(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, bytes(r.digest)) for r in df.collect()), key=repr)


@pytest.mark.parametrize("n", [0, 1, 2, 63, 5000])
def test_perfect_hash_is_minimal_and_strangers_fail_the_byte_check(n):
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(n)]
    parts = xd.parts_of(b"".join(keys))
    levels = xd.perfect_levels(parts)
    slots = xd.slots_of(levels, parts)
    assert sorted(slots.tolist()) == list(range(n))
    strangers = xd.parts_of(b"".join(hashlib.sha256(f"x{i}".encode()).digest() for i in range(1000)))
    held = np.empty_like(parts)
    held[slots] = parts
    got = xd.slots_of(levels, strangers)
    assert not any((held[s] == t).all() for s, t in zip(got, strangers, strict=True) if s >= 0)


def test_digests_that_share_most_bytes_part():
    parts = np.zeros((300, 4), np.uint64)
    parts[:, 3] = np.arange(300)
    assert sorted(xd.slots_of(xd.perfect_levels(parts), parts).tolist()) == list(range(300))


def test_awkward_rows(spark, edge, empty):
    assert result(xd.exact_dedup(edge)) == brute_force([(r[0], r[1]) for r in ROWS])
    assert xd.exact_dedup(empty).count() == 0
    nulls = spark.createDataFrame([row(None, None), row(None, ""), row(None, "a"), row(None, "a")], SCHEMA)
    assert result(xd.exact_dedup(nulls)) == brute_force([(None, None), (None, ""), (None, "a"), (None, "a")])
    white = spark.createDataFrame([row(2, "a\t b"), row(1, "a\n\nb"), row(3, "a b"), row(4, " a b"), row(5, "a\x0bb")], SCHEMA)
    assert result(xd.exact_dedup(white)) == brute_force([(2, "a\t b"), (1, "a\n\nb"), (3, "a b"), (4, " a b"), (5, "a\x0bb")])


def test_small_shards_and_a_hot_text(spark):
    rows = [(i, "same  text" if i % 3 else f"text {i % 700}") for i in range(3000)]
    got = xd.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), shard_digests=20)
    assert result(got) == brute_force(rows)


def test_given_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute_force([(r.doc_id, r.text) for r in docs.collect()])
    assert result(xd.exact_dedup(docs)) == want
    stays = {r.doc_id for r in xd.without_copies(docs).collect()}
    assert stays == {w[0] for w in want if w[3]}


def test_rows_that_stay(spark, edge):
    kept = xd.without_copies(edge)
    assert kept.columns == edge.columns
    assert sorted(normal(r.text) for r in kept.collect()) == sorted({normal(r[1]) for r in ROWS})


def test_an_index_answers_a_later_batch(spark):
    """History wins over smaller ids of a later batch, whose own texts are grouped apart."""
    past = spark.createDataFrame([(10, "a"), (11, "b"), (12, "a")], "doc_id long, text string").select("doc_id", xd.digest_of("text").alias("digest"))
    later = spark.createDataFrame([(1, "a"), (2, "c"), (3, "c"), (None, "b")], "doc_id long, text string").select(
        "doc_id", xd.digest_of("text").alias("digest"))
    got = xd.ask_index(later, xd.build_index(past, 4), 4).groupBy("digest").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("n"))
    assert sorted((r.keep_id, r.n) for r in got.collect()) == [(2, 2), (10, 1), (11, 1)]

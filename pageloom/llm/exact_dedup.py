"""Operator 12, exact dedup: a minimal perfect hash over historical distinct digests answers which texts are known.

1. Every text is normalised and digested once (SHA-256), on the JVM; only (doc_id, digest) goes on from there.
2. The distinct digests of history fall into shards by hash, each of a bounded number of digests. A shard's index is one
   row: the bit arrays of a minimal perfect hash (keys alone in their cell take it, the rest go to the next array), and
   slots with the full digest, the locator of the winner (its doc_id) and the number of rows that have the text.
3. Incoming rows are first added up per Arrow batch, so a text that a third of all rows share is one entry per batch.
   Each entry asks its shard: the perfect hash gives a slot for any digest, member or not, and the digest in the slot is
   compared byte for byte. Members are repeats of the slot's winner; the others are grouped among themselves.
4. The verdict comes back to the rows by digest. A group of more than one in `HOT_GROUPS` of all rows travels by
   broadcast (fewer than `HOT_GROUPS` groups can be that large), all others by a join whose keys are small.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..kernels import ship_by_value
from .common import shuffle_partitions, table, written
from .substring_dedup import pack, unpack
from .words import U, mix

ship_by_value(__name__)

DIGEST_BYTES = 32
SHARD_DIGESTS = 1 << 16
CELLS_PER_KEY = 1.6
HOT_GROUPS = 1_000
GROUP = "digest binary, keep_id long, n long"


def digest_of(text: str) -> Column:
    """SHA-256 of the text, each run of white space replaced by one space; null counts as empty."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", " "), 256))


def parts_of(digests: bytes) -> np.ndarray:
    return np.frombuffer(digests, "<u8").reshape(-1, DIGEST_BYTES // 8)


def cell_of(parts: np.ndarray, level: int, cells: int) -> np.ndarray:
    """Cell of each digest at one level; all bytes of the digest count, so distinct digests part at some level."""
    h = np.full(len(parts), (level + 1) * 0x9E3779B97F4A7C15 % (1 << 64), U)
    for c in range(parts.shape[1]):
        h = mix(h ^ parts[:, c])
    return (h % U(cells)).astype(np.int64)


def perfect_levels(parts: np.ndarray) -> list[np.ndarray]:
    """Bit arrays of a minimal perfect hash over distinct digests: at each level, keys alone in their cell set its bit."""
    levels, left = [], parts
    while len(left):
        cells = 64 * -(-int(len(left) * CELLS_PER_KEY + 1) // 64)
        cell = cell_of(left, len(levels), cells)
        alone = np.bincount(cell, minlength=cells)[cell] == 1
        bits = np.zeros(cells, bool)
        bits[cell[alone]] = True
        levels.append(np.packbits(bits, bitorder="little"))
        left = left[~alone]
    return levels


def slots_of(levels: list[np.ndarray], parts: np.ndarray) -> np.ndarray:
    """Slot of each digest: its rank among the bits set. A digest that is no key gets some slot, or -1."""
    slots, open_, base = np.full(len(parts), -1, np.int64), np.arange(len(parts)), 0
    for i, packed in enumerate(levels):
        ones = np.bitwise_count(packed).astype(np.int64)
        before = np.cumsum(ones) - ones
        cell = cell_of(parts[open_], i, len(packed) * 8)
        byte, bit = packed[cell >> 3], (cell & 7).astype(np.uint8)
        hit = (byte >> bit) & 1 == 1
        rank = before[cell >> 3] + np.bitwise_count(byte & ((np.uint8(1) << bit) - np.uint8(1)))
        slots[open_[hit]] = base + rank[hit]
        open_ = open_[~hit]
        base += int(ones.sum())
    return slots


def digest_bytes(column: pa.ChunkedArray) -> bytes:
    return b"".join(column.to_pylist())


INDEX = pa.schema([("shard", pa.int32()), ("levels", pa.binary()), ("digests", pa.binary()), ("slots", pa.binary())])


def build_shard(key, groups: pa.Table) -> pa.Table:
    """The index of one shard's distinct digests as one row."""
    digests = digest_bytes(groups["digest"])
    parts = parts_of(digests)
    levels = perfect_levels(parts)
    order = np.empty(len(parts), np.int64)
    order[slots_of(levels, parts)] = np.arange(len(parts))
    known = np.array([v is not None for v in groups["keep_id"].to_pylist()], np.uint8)
    slots = [groups["keep_id"].fill_null(0).to_numpy()[order], known[order], groups["n"].to_numpy()[order]]
    return pa.table({
        "shard": [key[0].as_py()], "levels": [pack(levels)], "digests": [np.ascontiguousarray(parts[order]).tobytes()], "slots": [pack(slots)],
    }, schema=INDEX)


def ask_shard(key, entries: pa.Table, index: pa.Table) -> pa.Table:
    """Entries of one shard with the winner of their slot where the slot's digest is theirs, byte for byte."""
    keep = np.array([0 if v is None else v for v in entries["keep_id"].to_pylist()], np.int64)
    known = np.array([v is not None for v in entries["keep_id"].to_pylist()], bool)
    if index.num_rows and entries.num_rows:
        asked = parts_of(digest_bytes(entries["digest"]))
        held = parts_of(index["digests"][0].as_py())
        winner, has_id, _ = unpack(index["slots"][0].as_py())
        slot = slots_of(unpack(index["levels"][0].as_py()), asked)
        member = slot >= 0
        member[member] = (held[slot[member]] == asked[member]).all(axis=1)
        keep[member] = winner[slot[member]]
        known[member] = has_id[slot[member]] == 1
    return pa.table({"digest": entries["digest"], "keep_id": pa.array(keep, pa.int64(), mask=~known), "n": entries["n"]})


def add_up(batches):
    """Rows of a batch with equal digests as one entry: smallest id and number of rows."""
    for batch in batches:
        t = pa.Table.from_batches([batch]).group_by("digest").aggregate([("doc_id", "min"), ([], "count_all")])
        yield from pa.table({"digest": t["digest"], "keep_id": t["doc_id_min"], "n": t["count_all"].cast(pa.int64())}).to_batches()


def shard_column(shards: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int").alias("shard")


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """The index over rows (doc_id, digest): a row per shard. It can be written and asked by later batches, with the same
    number of shards."""
    groups = history.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    return groups.select(shard_column(shards), "*").groupBy("shard").applyInArrow(
        lambda k, t: build_shard(k, t), "shard int, levels binary, digests binary, slots binary")


def listed(batches):
    """The groups that an index holds, slot by slot."""
    for batch in batches:
        for digests, slots in zip(batch["digests"].to_pylist(), batch["slots"].to_pylist(), strict=True):
            winner, has_id, n = unpack(slots)
            keys = pa.FixedSizeBinaryArray.from_buffers(pa.binary(DIGEST_BYTES), len(n), [None, pa.py_buffer(digests)])
            yield pa.record_batch({"digest": keys.cast(pa.binary()), "keep_id": pa.array(winner, pa.int64(), mask=has_id == 0), "n": pa.array(n)})


def ask_index(incoming: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """Entries (digest, keep_id, n) of the incoming rows (doc_id, digest): keep_id is the winner in the index for members,
    else the entry's own smallest id. The entries of one digest are still to be added up."""
    entries = incoming.select("doc_id", "digest").mapInArrow(add_up, GROUP).select(shard_column(shards), "*")
    return entries.groupBy("shard").cogroup(index.groupBy("shard")).applyInArrow(lambda k, a, b: ask_shard(k, a, b), GROUP)


def groups_of(own: DataFrame, shards: int) -> DataFrame:
    """Groups (digest, keep_id, n) of rows (doc_id, digest). The lower half of the ids is history and goes into the index, the
    rest is looked up; a member's winner has the smaller id, so the cut never shows in the result."""
    cut = own.agg(F.percentile_approx("doc_id", 0.5)).first()[0]
    past = F.coalesce(F.col("doc_id") <= F.lit(cut), F.lit(False)) if cut is not None else F.lit(False)
    index = written(build_index(own.filter(past), shards), "digest-index")
    entries = ask_index(own.filter(~past), index, shards)
    return index.mapInArrow(listed, GROUP).unionByName(entries).groupBy("digest").agg(
        F.min("keep_id").alias("keep_id"), F.sum("n").alias("n"))


def exact_dedup(docs: DataFrame, *, shard_digests: int = SHARD_DIGESTS) -> DataFrame:
    """Groups of equal texts and the row of each that stays.

    Returns a row per input row: doc_id, keep_id (smallest doc_id of the group), group_size (rows of the group), kept, and
    digest (32 bytes). Texts are equal when they are after replacing each run of white space by one space; a null text
    counts as empty. Of repeated rows with one doc_id and text exactly one is kept. Rows without doc_id come after all
    others: one of them is kept only in a group without any doc_id, and keep_id is null there. Texts of any length are
    digested whole; an empty table gives an empty result; other columns are ignored, whatever their names.

    A shard holds about `shard_digests` digests of history (48 bytes each) and the entries that ask for them.
    """
    spark = docs.sparkSession
    own = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest_of("text").alias("digest")), "digests")
    n_rows = own.count()
    groups = written(groups_of(own, max(shuffle_partitions(spark), -(-n_rows // shard_digests))), "digest-groups")
    groups = groups.select("digest", "keep_id", F.col("n").alias("group_size"))

    rows = own.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("copies"))
    hot = groups.filter(F.col("group_size") > max(1, n_rows // HOT_GROUPS))
    cold = groups.filter(F.col("group_size") <= max(1, n_rows // HOT_GROUPS))
    judged = rows.join(F.broadcast(hot), "digest").unionByName(
        rows.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(cold, "digest"))
    each = judged.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return each.select(
        "doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "digest")


def without_copies(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of equal texts, the one that `exact_dedup` keeps. Of rows alike in doc_id and text any one
    stays."""
    winners = exact_dedup(docs).filter("kept").select(F.col("doc_id").alias("__keep"), F.col("digest").alias("__digest"))
    own = docs.withColumn("__own", digest_of("text"))
    near = own.join(winners, (F.col("__own") == F.col("__digest")) & F.col("doc_id").eqNullSafe(F.col("__keep")), "left_semi")
    return near.dropDuplicates(["__own"]).select(*docs.columns)


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


SQL = r"""
with normal as (
    select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents
), groups as (
    select text_sha256, min(doc_id) as keep_id, count(*) as group_size from normal group by text_sha256
)
select doc_id, keep_id, group_size::bigint as group_size, doc_id = keep_id as kept, text_sha256 from normal join groups using (text_sha256)
"""

"""Operator 8, best-fit packing: vector best-fit of token pieces into sequences.

Texts become token pieces once (a written table of a few numbers per piece). Pieces of one length are alike, so the
packing is decided on the count of each length (at most `capacity` numbers, whatever the input): lengths descend, and
bins with the same content stand for each other, with their number. The decision is a short list of segments "pieces
number a to b of length L go to bins from s, k each, at offset o". Every piece then finds its place from its number
among the pieces of its length, which is counted per part of the table and length, never over one whole length.
"""

from __future__ import annotations

import os
import sys
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..kernels import ship_by_value
from . import words as wd
from .common import shuffle_partitions, table, written

ship_by_value(__name__)

CAPACITY = 2048
# With these two a sequence is never full before its tokens are, so in the registered query only tokens bind: a piece has a
# token at least, and the squares of lengths sum to no more than the square of their sum. Smaller values are parameters.
MAX_DOCS = CAPACITY
MAX_COST = CAPACITY * CAPACITY
WEIGHTS = (1.0, 0.01, 0.01)
END_ID = 0
CACHE_WORDS = 400_000
CHUNK_BYTES = 4 << 20


@dataclass
class Bins:
    """`count` bins from number `first`, alike in what is left of tokens, documents and attention cost."""

    first: int
    count: int
    tokens: int
    docs: int
    cost: int


@dataclass
class Segment:
    """Pieces `rank` .. of one length: `each` to a bin, bins from `bin`, the first of a bin at `offset`."""

    length: int
    rank: int
    each: int
    bin: int
    offset: int


def plan_bins(
    lengths: dict[int, int], capacity: int = CAPACITY, max_docs: int = MAX_DOCS, max_cost: int = MAX_COST,
    weights: tuple[float, float, float] = WEIGHTS, rule: str = "norm",
) -> tuple[list[Segment], int]:
    """Where the pieces of each length go, and the number of bins.

    Long pieces first. Of the bins that can take a piece under all three capacities, `norm` picks those with the least
    weighted norm of what would be left, `dot` those with the greatest weighted dot product of room and demand. A piece
    that no bin can take opens one; one that alone breaks a capacity is refused.
    """
    scale = np.array([capacity, max_docs, max_cost], float)
    weight = np.array(weights)
    groups: list[Bins] = []
    room = np.empty((0, 3))
    segments, bins = [], 0
    for length in sorted(lengths, reverse=True):
        need = np.array([length, 1, length * length], float)
        if (need > scale).any():
            raise ValueError(f"a piece of {length} tokens breaks a capacity by itself")
        rank, left = 0, lengths[length]
        while left:
            fits = np.flatnonzero((room >= need).all(axis=1)) if len(room) else []
            if len(fits):
                if rule == "norm":
                    score = (weight * ((room[fits] - need) / scale) ** 2).sum(axis=1)
                    pick = int(fits[np.argmin(score)])
                else:
                    score = (weight * (room[fits] / scale) * (need / scale)).sum(axis=1)
                    pick = int(fits[np.argmax(score)])
                group = groups.pop(pick)
                room = np.delete(room, pick, axis=0)
            else:
                each = min(capacity // length, max_docs, max_cost // (length * length))
                group = Bins(bins, -(-left // each), capacity, max_docs, max_cost)
                bins += group.count
            each = min(group.tokens // length, group.docs, group.cost // (length * length))
            if len(fits) and rule == "dot":
                each = 1  # a bin that took a piece has less room, so the next one goes elsewhere
            full = min(group.count, left // each)
            taken = []
            if full:
                taken.append((group.first, full, each))
            if full < group.count and left - full * each:
                taken.append((group.first + full, 1, left - full * each))
            used = 0
            for first, count, k in taken:
                segments.append(Segment(length, rank, k, first, capacity - group.tokens))
                rank, left, used = rank + count * k, left - count * k, used + count
                groups.append(Bins(first, count, group.tokens - k * length, group.docs - k, group.cost - k * length * length))
            if used < group.count:
                groups.append(Bins(group.first + used, group.count - used, group.tokens, group.docs, group.cost))
            new = groups[len(room):]
            room = np.vstack([room, [[g.tokens, g.docs, g.cost] for g in new]])
    return segments, bins


LETTER, DIGIT, SIGN, OTHER = 1, 2, 3, 4


def byte_kinds(raw: np.ndarray) -> np.ndarray:
    """What each byte is to the vocabulary's word pattern. Letters are ASCII ones and those of Latin-1; what the pattern or the
    normaliser treats in ways of its own (other characters, apostrophes, control bytes, `<|`) is OTHER."""
    table = np.full(256, OTHER, np.uint8)
    table[33:127] = SIGN
    table[48:58] = DIGIT
    for first in (65, 97):
        table[first:first + 26] = LETTER
    table[ord("'")] = OTHER
    kinds = table[raw]
    lead = np.flatnonzero(raw[:-1] == 0xC3) if len(raw) else np.empty(0, np.int64)
    second = raw[lead + 1]
    lead = lead[(second >= 0x80) & (second <= 0xBF) & (second != 0x97) & (second != 0xB7)]
    kinds[lead] = kinds[lead + 1] = LETTER
    if len(raw):
        kinds[:-1][(raw[:-1] == ord("<")) & (raw[1:] == ord("|"))] = OTHER
    return kinds


def lower_latin(raw: np.ndarray) -> np.ndarray:
    lower = wd.lower_ascii(raw)
    second = np.zeros(len(raw), bool)
    second[1:] = raw[:-1] == 0xC3
    return lower + ((second & (raw >= 0x80) & (raw <= 0x9E) & (raw != 0x97)).astype(np.uint8) << 5)


def units_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The stretches that the vocabulary encodes one by one, and the text of each: runs of letters or of signs, in lower case,
    and single digits. A white-space separated word with anything else in it is one stretch, as written."""
    raw, offsets = wd.byte_view(texts)
    inside = wd.is_word_byte(raw)
    words = wd.split_mask(raw, offsets, inside)
    kinds = byte_kinds(raw)
    others = np.concatenate([[0], np.cumsum(kinds == OTHER)])
    whole = others[words.end] > others[words.start]
    change = np.zeros(len(raw) + 1, np.int8)
    np.add.at(change, words.start[whole], 1)
    np.add.at(change, words.end[whole], -1)
    as_written = np.cumsum(change[:-1], dtype=np.int8) > 0
    begin = np.zeros(len(raw), bool)
    begin[1:] = (kinds[1:] != kinds[:-1]) | (kinds[1:] == DIGIT)
    begin &= ~as_written & inside
    begin[words.start] = True
    start = np.flatnonzero(begin)
    word = np.searchsorted(words.start, start, "right") - 1
    end = np.minimum(np.append(start[1:], len(raw)), words.end[word]) if len(start) else start
    data = np.where(as_written, raw, lower_latin(raw))[inside]
    ends = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(data)]), words.doc[word]


class Encoder:
    """Ids of stretches, as little-endian 32-bit numbers. The ids of up to two generations of `CACHE_WORDS` stretches are kept;
    when the younger is full, it takes the place of the older."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def __call__(self, stretches: list[bytes]) -> list[bytes]:
        fresh = []
        for s in stretches:
            if s not in self.young:
                if s in self.old:
                    self.young[s] = self.old[s]
                else:
                    fresh.append(s)
        for i in range(0, len(fresh), 50_000):
            part = fresh[i:i + 50_000]
            for s, found in zip(part, self.tokenizer.encode_batch_fast([s.decode() for s in part], add_special_tokens=False), strict=True):
                self.young[s] = np.array(found.ids, "<u4").tobytes()
        ids = [self.young[s] for s in stretches]
        if len(self.young) > CACHE_WORDS:
            self.old, self.young = self.young, {}
        return ids


def ids_of(texts: pa.Array, encoder: Encoder, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts in a row, `end_id` after each, and where each text's ids end."""
    units, doc = units_of(texts)
    coded = units.dictionary_encode()
    known = encoder(coded.dictionary.to_pylist())
    sizes = np.array([len(k) // 4 for k in known] + [1], np.int64)
    flat = np.frombuffer(b"".join(known) + np.array([end_id], "<u4").tobytes(), "<u4")
    sequence = np.full(len(units) + len(texts), len(known), np.int64)  # the last one is the end of a text
    sequence[np.arange(len(units)) + doc] = coded.indices.to_numpy()
    size = sizes[sequence]
    ends = np.cumsum(size)
    take = np.repeat((np.cumsum(sizes) - sizes)[sequence] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
    last = np.cumsum(np.bincount(doc, minlength=len(texts)) + 1) - 1
    return flat[take], ends[last]


def token_pieces(batches, vocabulary: str, capacity: int, end_id: int):
    """Arrow batches of (doc_id, text) to rows of pieces."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    held = sys.__dict__.setdefault("_pageloom_encoders", {})
    key = zlib.crc32(vocabulary.encode())
    if key not in held:
        held.clear()
        held[key] = Encoder(vocabulary)
    for batch in batches:
        rows, pieces, starts, lengths, sums = [], [], [], [], []
        for a, b in wd.chunks(batch.column(1), CHUNK_BYTES):
            ids, ends = ids_of(batch.column(1).slice(a, b - a), held[key], end_id)
            data, begin = memoryview(ids.tobytes()), 0
            for row, end in enumerate(ends.tolist(), a):
                for piece, at in enumerate(range(begin, end, capacity)):
                    stop = min(at + capacity, end)
                    rows.append(row)
                    pieces.append(piece)
                    starts.append(at - begin)
                    lengths.append(stop - at)
                    sums.append(zlib.crc32(data[4 * at:4 * stop]))
                begin = end
        yield pa.record_batch({
            "doc_id": batch.column(0).take(pa.array(rows, pa.int64())), "piece": pa.array(pieces, pa.int32()),
            "start": pa.array(starts, pa.int64()), "length": pa.array(lengths, pa.int64()), "ids_crc32": pa.array(sums, pa.int64()),
        })


def tokenize(docs: DataFrame, vocabulary_file: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Token pieces of every document: doc_id, piece, start, length, ids_crc32. The vocabulary travels with the tasks."""
    with open(vocabulary_file, encoding="utf-8") as f:
        vocabulary = f.read()
    shipped = docs.sparkSession.sparkContext.broadcast(vocabulary)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        lambda batches: token_pieces(batches, shipped.value, capacity, end_id),
        "doc_id long, piece int, start long, length long, ids_crc32 long",
    )


def place(batches, key: np.ndarray, segments: np.ndarray):
    """Sequence and offset of each piece from its length and its number among the pieces of that length."""
    for batch in batches:
        length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
        own = segments[np.searchsorted(key, (length << 44) + rank, "right") - 1]
        _, first, each, start, offset = own.T
        at = rank - first
        names = [c for c in batch.schema.names if c != "rank"]
        yield pa.record_batch(
            [batch.column(batch.schema.get_field_index(c)) for c in names]
            + [pa.array(start + at // each, pa.int64()), pa.array(offset + at % each * length, pa.int64())],
            names=[*names, "sequence_id", "offset"],
        )


def pack_pieces(
    pieces: DataFrame, *, capacity: int = CAPACITY, max_docs: int = MAX_DOCS, max_cost: int = MAX_COST,
    weights: tuple[float, float, float] = WEIGHTS, rule: str = "norm",
) -> DataFrame:
    """Adds sequence_id and offset to a table of pieces (doc_id, piece, start, length, ids_crc32), which is read twice."""
    counted = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    segments, _ = plan_bins(counted, capacity, max_docs, max_cost, weights, rule)
    rows = np.array([[s.length, s.rank, s.each, s.bin, s.offset] for s in segments] or np.empty((0, 5)), np.int64)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    key = (rows[:, 0] << 44) + rows[:, 1]

    parts = max(16, shuffle_partitions(pieces.sparkSession))
    parted = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)).cast("int"))
    before = parted.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")).select(
        "part", "length",
        F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
    )
    within = parted.withColumn("own", F.row_number().over(Window.partitionBy("part", "length").orderBy("doc_id", "piece", "ids_crc32")))
    ranked = within.join(before, ["part", "length"]).select(*pieces.columns, (F.col("before") + F.col("own") - 1).alias("rank"))
    return ranked.mapInArrow(
        lambda batches: place(batches, key, rows), f"{pieces.schema.simpleString()[7:-1]}, sequence_id bigint, offset bigint",
    )


def best_fit_packing(docs: DataFrame, vocabulary_file: str, *, capacity: int = CAPACITY, end_id: int = END_ID, **limits) -> DataFrame:
    """Packs all documents into as few sequences of at most `capacity` tokens as best-fit finds.

    A document is its ids, then `end_id`; null and empty texts are `end_id` alone. Only longer ones are cut, into pieces
    of `capacity`, the last of which may be shorter. Returns a row per piece: doc_id, piece, start (ids of its document
    before it), length, ids_crc32 (of the ids as little-endian 32-bit numbers), sequence_id, offset (gapless from 0).
    Rows that share a doc_id, or have none, are packed one by one. Other columns are ignored; an empty table gives an
    empty result. `limits` are those of `plan_bins`. A very long text is tokenized whole by one task, which needs about 100
    bytes a token of it. Bins that leave the same score are alike, and the first made of them takes the piece.
    """
    pieces = written(tokenize(docs, vocabulary_file, capacity, end_id), "token-pieces")
    return pack_pieces(pieces, capacity=capacity, **limits)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return best_fit_packing(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))

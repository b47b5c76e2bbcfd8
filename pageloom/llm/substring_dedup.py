"""Operator 1, substring dedup: a Count-min prefilter, then exact grouping of the windows it estimates as repeated.

Documents lie in blocks of neighbouring ids (one exchange of the text, read three times):

1. Each block sketches its windows. A sketch is cut into shards by window hash, sized for the whole input's windows, so
   no task holds all of it. Partial sketches are sorted cell lists; a shard's task adds them up and answers each block
   with one bit per cell: counted twice or more. Adding never undercounts, so no repeated window is lost.
2. Each block sends the distinct windows whose cells all say "twice", once each, to the shard that groups them exactly
   by a 96-bit hash. A window shared by a third of all documents is one entry per block there, not one per document.
   The shard answers which of a block's windows occur in an earlier block.
3. Each block marks the windows that start earlier, in an earlier block or further up in its own, and removes the words
   they cover.
"""

from __future__ import annotations

import struct
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..kernels import ship_by_value
from . import words as wd
from .common import block_bounds, block_of, shuffle_partitions, table, text_volume

ship_by_value(__name__)

WINDOW = 20
BLOCK_BYTES = 12 << 20
SHARD_WINDOWS = 1 << 22
CELLS_PER_WINDOW = 4
SKETCH_ROWS = 2


def pack(arrays: list[np.ndarray]) -> bytes:
    """Arrays as one compressed value; bytes of equal weight lie together, so small numbers cost little."""
    parts = [struct.pack("<I", len(arrays))]
    for a in arrays:
        parts.append(struct.pack("<cIQ", a.dtype.char.encode(), a.itemsize, len(a)))
        parts.append(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(value: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(value)
    at, out = 4, []
    for _ in range(struct.unpack_from("<I", raw)[0]):
        kind, size, n = struct.unpack_from("<cIQ", raw, at)
        at += struct.calcsize("<cIQ")
        planes = np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).view(np.dtype(kind.decode())).reshape(n))
        at += n * size
    return out


def gaps(ascending: np.ndarray) -> np.ndarray:
    return np.diff(ascending, prepend=ascending.dtype.type(0))


def in_order(block: pa.Table) -> pa.Table:
    return block.sort_by([("doc_id", "ascending"), ("text", "ascending")])


def windows_of(texts: pa.Array, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words per text, index of each window's first word among all words, and two hashes of each window."""
    counts, firsts, ones, twos, base = [], [], [], [], 0
    for a, b in wd.chunks(texts):
        words = wd.split_words(texts.slice(a, b - a))
        at = wd.runs_of(words.doc, window)
        ones.append(wd.run_hashes(wd.word_hashes(words, 0), at, window, 0))
        twos.append((wd.run_hashes(wd.word_hashes(words, 1), at, window, 1) >> np.uint64(32)).astype(np.uint32))
        counts.append(words.counts())
        firsts.append(at + base)
        base += len(words.doc)
    join = lambda xs, kind: np.concatenate(xs).astype(kind, copy=False) if xs else np.empty(0, kind)
    return join(counts, np.int64), join(firsts, np.int64), join(ones, np.uint64), join(twos, np.uint32)


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    return (h % np.uint64(shards)).astype(np.int64)


def cells_of(h: np.ndarray, width: int) -> list[np.ndarray]:
    """One cell per sketch row."""
    return [(wd.mix(h + np.uint64(0x9E3779B97F4A7C15 * (r + 1) % (1 << 64))) % np.uint64(width)).astype(np.uint32) for r in range(SKETCH_ROWS)]


def by_shard(h: np.ndarray, shards: int):
    """Indices of the hashes of each shard that has any."""
    shard = shard_of(h, shards)
    order = np.argsort(shard, kind="stable")
    cuts = np.searchsorted(shard[order], np.arange(shards + 1))
    for s in range(shards):
        if cuts[s] < cuts[s + 1]:
            yield s, order[cuts[s]:cuts[s + 1]]


def sketch_block(key, block: pa.Table, *, window: int, shards: int, width: int) -> pa.Table:
    """Partial sketches of one block, a row per shard: cells of each row and whether the block alone fills them twice."""
    _, _, h, _ = windows_of(block["text"].combine_chunks(), window)
    rows = {"shard": [], "block": [], "payload": []}
    for s, at in by_shard(h, shards):
        arrays = []
        for cells in cells_of(h[at], width):
            cell, n = np.unique(cells, return_counts=True)
            arrays += [gaps(cell), np.packbits(n > 1)]
        rows["shard"].append(s)
        rows["block"].append(key[0].as_py())
        rows["payload"].append(pack(arrays))
    return pa.table(rows, schema=pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("payload", pa.binary())]))


def merge_sketches(key, parts: pa.Table, *, width: int) -> pa.Table:
    """Adds up one shard's partial sketches (counts stop at two) and tells each block which of its cells reach two."""
    full = [np.zeros(width, np.uint8) for _ in range(SKETCH_ROWS)]
    payloads = parts["payload"]
    for value in payloads:
        arrays = unpack(value.as_py())
        for r, counts in enumerate(full):
            cell = np.cumsum(arrays[2 * r], dtype=np.uint32)
            more = 1 + np.unpackbits(arrays[2 * r + 1], count=len(cell))
            counts[cell] = np.minimum(counts[cell] + more, 2)
    replies = []
    for value in payloads:
        arrays = unpack(value.as_py())
        replies.append(pack([np.packbits(full[r][np.cumsum(arrays[2 * r], dtype=np.uint32)] > 1) for r in range(SKETCH_ROWS)]))
    return pa.table(
        {"block": parts["block"], "shard": parts["shard"], "reply": replies},
        schema=pa.schema([("block", pa.int32()), ("shard", pa.int32()), ("reply", pa.binary())]),
    )


def distinct_windows(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes ascending, first index of each, and for each window whether it is the first of its hash."""
    order = np.argsort(h, kind="stable")
    ascending = h[order]
    new = np.ones(len(h), bool)
    new[1:] = ascending[1:] != ascending[:-1]
    first = np.zeros(len(h), bool)
    first[order[new]] = True
    return ascending[new], order[new], first


def candidates(key, block: pa.Table, replies: pa.Table, *, window: int, shards: int, width: int) -> pa.Table:
    """Distinct windows of one block that the merged sketch estimates as repeated, a row per shard."""
    _, _, h, h2 = windows_of(in_order(block)["text"].combine_chunks(), window)
    keys, at, _ = distinct_windows(h)
    answers = dict(zip(replies["shard"].to_pylist(), replies["reply"].to_pylist(), strict=True))
    rows = {"shard": [], "block": [], "payload": []}
    for s, own in by_shard(keys, shards):
        likely = np.ones(len(own), bool)
        for bits, cells in zip(unpack(answers[s]), cells_of(keys[own], width), strict=True):
            cell, back = np.unique(cells, return_inverse=True)
            likely &= np.unpackbits(bits, count=len(cell))[back].astype(bool)
        if likely.any():
            own = own[likely]
            rows["shard"].append(s)
            rows["block"].append(key[0].as_py())
            rows["payload"].append(pack([keys[own], h2[at[own]]]))
    return pa.table(rows, schema=pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("payload", pa.binary())]))


def group_exactly(key, parts: pa.Table) -> pa.Table:
    """One shard's candidate windows of all blocks: which of each block's windows an earlier block has too."""
    values = [unpack(v.as_py()) for v in parts["payload"]]
    sizes = np.array([len(v[0]) for v in values], np.int64)
    h, h2 = (np.concatenate([v[i] for v in values]) for i in (0, 1))
    block = np.repeat(parts["block"].to_numpy(), sizes)
    del values
    order = np.lexsort((block, h2, h))
    same = np.zeros(len(h), bool)
    same[1:] = (h[order][1:] == h[order][:-1]) & (h2[order][1:] == h2[order][:-1])
    earlier = np.zeros(len(h), bool)
    earlier[order] = same
    at = np.concatenate([[0], np.cumsum(sizes)])
    hits = [h[a:b][earlier[a:b]] for a, b in zip(at[:-1], at[1:], strict=True)]
    some = [i for i, x in enumerate(hits) if len(x)]
    return pa.table(
        {"block": parts["block"].take(pa.array(some, pa.int64())), "shard": parts["shard"].take(pa.array(some, pa.int64())),
         "reply": [pack([rank_gaps(hits[i])]) for i in some]},
        schema=pa.schema([("block", pa.int32()), ("shard", pa.int32()), ("reply", pa.binary())]),
    )


def rank_gaps(keys: np.ndarray) -> np.ndarray:
    return gaps(np.sort(keys))


def remove_repeats(key, block: pa.Table, replies: pa.Table, *, window: int, verbatim: bool) -> pa.Table:
    """Texts of one block without the words of windows that start earlier."""
    block = in_order(block)
    texts = block["text"].combine_chunks()
    counts, first_word, h, _ = windows_of(texts, window)
    keys, _, first = distinct_windows(h)
    known = [np.cumsum(unpack(v.as_py())[0], dtype=np.uint64) for v in replies["reply"]]
    seen = np.isin(h, np.concatenate(known)) if known else np.zeros(len(h), bool)
    begins = first_word[seen | ~first]
    cover = np.zeros(int(counts.sum()) + 1, np.int32)
    np.add.at(cover, begins, 1)
    np.add.at(cover, begins + window, -1)
    keep = np.cumsum(cover[:-1]) == 0
    ends = np.concatenate([[0], np.cumsum(counts)])
    kept_before = np.concatenate([[0], np.cumsum(keep)])
    removed = counts - (kept_before[ends[1:]] - kept_before[ends[:-1]])
    out = []
    for i, text in enumerate(texts):
        if verbatim and not removed[i]:
            out.append(None if text.as_py() is None else text.as_py().encode())
            continue
        words = (text.as_py() or "").encode().split()
        if removed[i]:
            words = [w for w, k in zip(words, keep[ends[i]:ends[i + 1]].tolist(), strict=True) if k]
        out.append(b" ".join(words))
    result = {"doc_id": block["doc_id"], "kept_text": pa.array(out, pa.binary()).cast(pa.string()),
              "n_words": pa.array(counts, pa.int64()), "n_removed": pa.array(removed, pa.int64())}
    return pa.table(result | ({"carry": block["carry"]} if "carry" in block.column_names else {}))


def substring_dedup(
    docs: DataFrame, *, window: int = WINDOW, carry: list[str] | None = None, verbatim: bool = False, block_bytes: int = BLOCK_BYTES,
    shard_windows: int = SHARD_WINDOWS,
) -> DataFrame:
    """Removes every word covered by a `window` of consecutive words that also starts earlier in the table.

    Earlier means a smaller doc_id, or the same document and an earlier start. Windows are judged on the input.

    Returns a row per input row: doc_id, kept_text (kept words joined by one space), n_words, n_removed, and a struct
    `carry` of the named columns if any are named. With `verbatim` a text that loses nothing is kept_text as it stands. A null or empty text has no words and gives an empty kept_text.
    Rows without doc_id come after all others. Rows that share a doc_id count as separate documents ordered by text.
    Other columns are ignored, whatever their names. An empty table gives an empty result.

    Windows are equal if 96 bits of hash are; a block (about `block_bytes` of text) and a shard (about `shard_windows`
    windows) each fit one task.
    """
    spark = docs.sparkSession
    n_rows, volume = text_volume(docs, "text")
    blocks = max(shuffle_partitions(spark), -(-volume // block_bytes))
    bounds = block_bounds(docs, "doc_id", min(blocks, max(1, n_rows)))
    shards = max(1, -(-volume // 6 // shard_windows))
    width = max(1 << 10, min(shard_windows, volume // 6 // shards + 1) * CELLS_PER_WINDOW)
    own = docs.select(
        block_of("doc_id", "text", bounds).cast("int").alias("block"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text"),
        *([F.struct(*carry).alias("carry")] if carry else []),
    ).repartition(blocks, "block")
    sizes = {"window": window, "shards": shards, "width": width}

    # functions with keywords fixed have no signature of two or three plain arguments, which Spark looks at
    sketch, merge = partial(sketch_block, **sizes), partial(merge_sketches, width=width)
    likely, clean = partial(candidates, **sizes), partial(remove_repeats, window=window, verbatim=verbatim)

    # all three readings need the very same columns, or Spark would deal the text out again
    sketches = own.groupBy("block").applyInArrow(lambda k, t: sketch(k, t), "shard int, block int, payload binary")
    estimates = sketches.groupBy("shard").applyInArrow(lambda k, t: merge(k, t), "block int, shard int, reply binary")
    found = own.groupBy("block").cogroup(estimates.groupBy("block")).applyInArrow(
        lambda k, a, b: likely(k, a, b), "shard int, block int, payload binary")
    repeats = found.groupBy("shard").applyInArrow(lambda k, t: group_exactly(k, t), "block int, shard int, reply binary")
    schema = "doc_id long, kept_text string, n_words long, n_removed long"
    if carry:
        schema += f", carry {own.schema['carry'].dataType.simpleString()}"
    return own.groupBy("block").cogroup(repeats.groupBy("block")).applyInArrow(lambda k, a, b: clean(k, a, b), schema)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = r"""
with words as (
    select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), starts as (
    select doc_id, unnest(generate_series(1, len(w) - 19)) as p, w from words where len(w) >= 20
), windows as (
    select doc_id, p, array_to_string(w[p:p + 19], ' ') as key from starts
), firsts as (
    select key, min((doc_id, p)) as first from windows group by key having count(*) > 1
), covered as (
    select distinct doc_id, unnest(generate_series(p, p + 19)) as i
    from windows join firsts using (key) where (doc_id, p) <> first
), gone as (
    select doc_id, list(i) as gone from covered group by doc_id
)
select doc_id, len(w)::bigint as n_words, coalesce(len(gone), 0)::bigint as n_removed,
    sha256(array_to_string(case when gone is null then w
        else list_filter(w, lambda x, i: not list_contains(gone, i)) end, ' ')) as kept_sha256
from words left join gone using (doc_id)
"""

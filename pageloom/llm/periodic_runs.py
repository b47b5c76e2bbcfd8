"""Operator 11, periodic runs: difference-cover extensions and a harmonic grid.

A run is a maximal stretch of words that repeats with a smallest period q at least four times over (six words at least).

* A run of period p and length 4p or more holds a position x with x and x + p in it among every 3p neighbours, so it shows
  at one of the positions 0, 3p, 6p, ... of its text. Over all p these are about n log n / 3 pairs (x, x + p).
* How far a pair agrees to the right comes from a difference cover D modulo V: only suffixes that start at residues in D
  are sorted. Two positions reach such suffixes after the same few words (fewer than V), which are compared one by one;
  from there the answer is a range minimum over the neighbours' common prefixes (sparse table). To the left the same holds
  for the reversed words.
* A pair that agrees p + right + left words in all is the run itself, and of periods with one stretch the smallest counts.

Texts of a batch are laid end to end with a number of its own after each, so all steps are array operations over many
texts at once. Texts whose pairs disagree within a few words have no run and are left out before anything is sorted.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..kernels import ship_by_value
from . import words as wd
from .common import slices, table

ship_by_value(__name__)

#: A perfect difference set: every difference modulo 31 occurs between two of its members.
V = 31
COVER = (0, 4, 10, 23, 24, 26)
REPEATS = 4
LEAST_WORDS = 6
GRID_POINTS = 1 << 20
FEW_WORDS = 6

RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def in_cover() -> np.ndarray:
    flags = np.zeros(V, bool)
    flags[list(COVER)] = True
    return flags


def cover_starts() -> np.ndarray:
    """For each difference d, a member x of the cover for which x + d is one too."""
    first = np.zeros(V, np.int64)
    for x in COVER:
        for y in COVER:
            first[(y - x) % V] = x
    return first


def agree(w: np.ndarray, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many words from i and from j are equal, at most `most`, compared one by one."""
    got = np.zeros(len(i), np.int64)
    live, t = np.flatnonzero(most > 0), 0
    while len(live):
        live = live[w[i[live] + t] == w[j[live] + t]]
        got[live] += 1
        t += 1
        live = live[most[live] > t]
    return got


class Extensions:
    """Longest common extensions to the right of pairs of positions in one sequence of numbers."""

    def __init__(self, w: np.ndarray):
        n = len(w)
        top = int(w.max()) + 1 if n else 0
        self.w = np.concatenate([w.astype(np.int64), top + np.arange(V)])  # nothing equals what follows the end
        self.starts = cover_starts()
        self.at = np.flatnonzero(in_cover()[np.arange(n + 1) % V])
        self.number = np.full(n + 1, -1, np.int64)
        self.number[self.at] = np.arange(len(self.at))
        self._sort(n)

    def _sort(self, n: int) -> None:
        """Ranks of the sampled suffixes by doubling, and common prefixes of neighbours in their order."""
        at, m = self.at, len(self.at)
        first = np.ascontiguousarray(self.w[at[:, None] + np.arange(V)].astype(">u4")).view(f"S{4 * V}").ravel()
        ranks, length = [np.unique(first, return_inverse=True)[1].astype(np.int64)], V
        while ranks[-1].max() + 1 < m:
            rank, far = ranks[-1], at + length
            after = np.where(far <= n, rank[self.number[np.minimum(far, n)]] + 1, 0)
            ranks.append(np.unique(rank * (m + 1) + after, return_inverse=True)[1].astype(np.int64))
            length *= 2
        self.rank = ranks[-1]
        order = np.empty(m, np.int64)
        order[self.rank] = np.arange(m)
        a, b = at[order[:-1]], at[order[1:]]
        lcp = np.zeros(m - 1, np.int64)
        for k in reversed(range(len(ranks) - 1)):
            step = (V << k) * (ranks[k][self.number[a]] == ranks[k][self.number[b]])
            a, b, lcp = a + step, b + step, lcp + step
        lcp += agree(self.w, a, b, np.full(m - 1, V))
        self.least = [lcp.astype(np.int32)]
        while 2 << len(self.least) - 1 <= m - 1:
            half, last = 1 << len(self.least) - 1, self.least[-1]
            self.least.append(np.minimum(last[:-half], last[half:]))

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        shift = (self.starts[(j - i) % V] - i) % V
        got = agree(self.w, i, j, shift)
        full = np.flatnonzero(got == shift)
        a, b = (self.rank[self.number[x[full] + shift[full]]] for x in (i, j))
        low, high = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        for k in np.unique(level):
            own = level == k
            least = self.least[k]
            got[full[own]] += np.minimum(least[low[own]], least[high[own] - (1 << k)])
        return got


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts c0, c1, ... the owner of each of the c0 + c1 + ... items and its number among its owner's."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def grid(first: np.ndarray, size: np.ndarray):
    """Pairs (x, p) of texts that begin at `first` and have `size` numbers, about GRID_POINTS at a time, with the text of each."""
    most = np.where(size >= LEAST_WORDS, size // REPEATS, 0)
    doc, p = spread(most)
    p = p + 1
    counts = 1 + (size[doc] - p - 1) // (3 * p)
    total = np.concatenate([[0], np.cumsum(counts)])
    row = 0
    while row < len(doc):
        stop = max(row + 1, int(np.searchsorted(total, total[row] + GRID_POINTS, "right")) - 1)
        owner, k = spread(counts[row:stop])
        owner += row
        yield doc[owner], first[doc[owner]] + 3 * p[owner] * k, p[owner]
        row = stop


def end_to_end(codes: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all texts with one of its own after each text, and where each text begins."""
    w = np.empty(len(codes) + len(size), np.int64)
    first = np.cumsum(size) - size + np.arange(len(size))
    ends = first + size
    inside = np.ones(len(w), bool)
    inside[ends] = False
    w[inside] = codes
    w[ends] = (int(codes.max()) + 1 if len(codes) else 0) + np.arange(len(size))
    return w, first


def hopeful(codes: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Texts with a pair that agrees as far as a run's pair must, as seen within a few words on both sides."""
    w, first = end_to_end(codes, size)
    edge = np.arange(FEW_WORDS) + (int(w.max()) + 1 if len(w) else 0)
    w = np.concatenate([edge, w, edge + FEW_WORDS])
    back = w[::-1]
    good = np.zeros(len(size), bool)
    for doc, x, p in grid(first + FEW_WORDS, size):
        same = np.flatnonzero(w[x] == w[x + p])
        same = same[~good[doc[same]]]
        doc, x, p = doc[same], x[same], p[same]
        most = np.full(len(x), FEW_WORDS)
        right = agree(w, x, x + p, most)
        left = agree(back, len(w) - x, len(w) - x - p, most)
        enough = (right + left + p >= np.maximum(LEAST_WORDS, REPEATS * p)) | (right == FEW_WORDS) | (left == FEW_WORDS)
        good[doc[enough]] = True
    return good


def runs_of(codes: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All runs of texts given as word numbers laid end to end: text, start within it, length and period, ordered."""
    none = np.empty(0, np.int64)
    texts = np.flatnonzero(hopeful(codes, size))
    if not len(texts):
        return none, none, none, none
    wanted = np.zeros(len(size), bool)
    wanted[texts] = True
    w, first = end_to_end(codes[np.repeat(wanted, size)], size[texts])
    right, left = Extensions(w), Extensions(w[::-1])
    found = []
    for doc, x, p in grid(first, size[texts]):
        same = np.flatnonzero(w[x] == w[x + p])
        doc, x, p = doc[same], x[same], p[same]
        ahead = right(x, x + p)
        behind = left(len(w) - x - p, len(w) - x)
        long = p + ahead + behind >= np.maximum(LEAST_WORDS, REPEATS * p)
        found.append(np.stack([doc, x - behind - first[doc], p + ahead + behind, p])[:, long])
    runs = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.empty((4, 0), np.int64)
    # of equal stretches the smallest period comes first
    new = np.ones(runs.shape[1], bool)
    new[1:] = (runs[:3, 1:] != runs[:3, :-1]).any(axis=0)
    doc, start, length, period = runs[:, new]
    order = np.lexsort((period, start, doc))
    return texts[doc[order]], start[order], length[order], period[order]


def word_array(words: wd.Words) -> pa.Array:
    """The words as an Arrow array of their own."""
    inside = np.zeros(len(words.raw) + 1, np.int8)
    np.add.at(inside, words.start, 1)
    np.add.at(inside, words.end, -1)
    data = words.raw[np.cumsum(inside[:-1], dtype=np.int8) > 0]
    ends = np.concatenate([[0], np.cumsum(words.end - words.start)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(words.start), [None, pa.py_buffer(ends), pa.py_buffer(data)])


def texts_of(words: pa.Array, picked: np.ndarray, size: np.ndarray) -> pa.Array:
    """The picked words joined by one space, `size` of them for each text."""
    lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(size)]).astype(np.int32), words.take(pa.array(picked)))
    return pc.binary_join(lists, b" ").cast(pa.string())


def read_texts(ids: pa.Array, texts: pa.Array, tail: Callable | None) -> pa.RecordBatch:
    words = wd.split_words(texts)
    size = words.counts()
    each = word_array(words)
    first = np.cumsum(size) - size
    at = np.arange(len(each))
    if tail is not None:
        for d, doc_id in enumerate(ids.to_pylist()):
            change = tail(doc_id, int(size[d])) if size[d] else None
            if change is not None:
                a, p = change
                own = np.arange(size[d] - a)
                at[first[d] + a:first[d] + size[d]] = first[d] + a + own % p
    codes = each.dictionary_encode().indices.to_numpy(zero_copy_only=False)[at]
    doc, start, length, period = runs_of(codes, size)

    cover = np.zeros(len(each) + 1, np.int64)
    np.add.at(cover, first[doc] + start + period, 1)
    np.add.at(cover, first[doc] + start + length, -1)
    keep = np.cumsum(cover[:-1]) == 0
    kept = np.bincount(np.repeat(np.arange(len(size)), size)[keep], minlength=len(size))
    ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(size)))]).astype(np.int32)
    runs = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(x) for x in (start, length, period)], ["start", "length", "period"]))
    return pa.record_batch({
        "doc_id": ids, "n_words": pa.array(size, pa.int64()), "runs": runs.cast(RUNS),
        "collapsed_text": texts_of(each, at[keep], kept),
    })


def read_batches(batches, *, tail: Callable | None):
    for batch in batches:
        ids, texts = batch["doc_id"], batch["text"]
        for a, b in wd.chunks(texts):
            yield from slices(read_texts(ids.slice(a, b - a), texts.slice(a, b - a), tail))


def periodic_runs(docs: DataFrame, *, tail: Callable[[int | None, int], tuple[int, int] | None] | None = None) -> DataFrame:
    """All periodic runs of every text.

    Returns a row per input row: doc_id, n_words, runs (array of start, length and period in words, by start, then period)
    and collapsed_text: the words, joined by one space, without those that a run holds after its first period. A null text
    counts as empty: no words, no runs, an empty collapsed_text. doc_id may be null or repeat; each row is judged alone.
    Runs that overlap are all listed. An empty table gives an empty result; other columns are ignored, whatever their names.

    `tail`, called with a row's doc_id and number of words, may name a position a and a period p: the words from a on are
    then read as the p words from a over and over (for trials on texts with known runs).

    A text is one row and is read whole by one task, which needs about 150 bytes a word of its longest text; texts are
    otherwise read a megabyte at a time.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed_text string"
    return own.mapInArrow(partial(read_batches, tail=tail), schema)


def repeated_tail(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """The contract's damage: a tenth of the documents end in a period that depends on their id."""
    if doc_id is None:
        return None
    g, rest = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if rest:
        return None
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(table(spark, sf_dir, "documents"), tail=repeated_tail)
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return found.select("doc_id", "runs", "collapsed_text", best.alias("best"), F.concat_ws("\n", lines).alias("lines")).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"), F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat("lines", F.lit("\n"))).otherwise(F.lit("")), 256).alias("runs_sha256"),
        F.sha2("collapsed_text", 256).alias("collapsed_sha256"))

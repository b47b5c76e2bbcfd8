"""Vectorised word work on Arrow string arrays, as used inside tasks.

A word is a run of bytes other than space and 0x09-0x0D. Texts are read in place from the Arrow buffer, so no Python
object is made per word. Hashes are polynomials modulo 2^64 over random byte values, mixed at the end; prefix sums give
the hash of any word or run of words in constant time.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from ..kernels import ship_by_value

ship_by_value(__name__)

U = np.uint64
CHUNK_BYTES = 1 << 20


def byte_view(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and n + 1 offsets into them; null is read as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, width)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES):
    """Row ranges of about `limit` bytes of text; a longer text is a range of its own. What earlier batches took of Arrow's
    memory goes back first."""
    pa.default_memory_pool().release_unused()
    _, offsets = byte_view(texts)
    row, n = 0, len(offsets) - 1
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, stop
        row = stop


@dataclass
class Words:
    """Words of some texts: byte spans [start, end), and the text of each."""

    raw: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray

    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=len(self.offsets) - 1)


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    return raw + (((raw >= 65) & (raw <= 90)).astype(np.uint8) << 5)


def is_word_byte(raw: np.ndarray) -> np.ndarray:
    return (raw != 32) & ((raw < 9) | (raw > 13))


def split_mask(raw: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> Words:
    """Maximal runs of `inside` bytes that do not cross from one text into the next."""
    n = len(raw)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    after = np.empty(n, bool)
    if n:
        before[0], before[1:] = False, inside[:-1]
        after[-1], after[:-1] = False, inside[1:]
    start = np.flatnonzero(inside & (~before | edge[:n]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return Words(raw, offsets, start, end, np.searchsorted(offsets, start, "right") - 1)


def split_words(texts: pa.Array, lower: bool = False) -> Words:
    raw, offsets = byte_view(texts)
    if lower:
        raw = lower_ascii(raw)
    return split_mask(raw, offsets, is_word_byte(raw))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit (the splitmix64 finaliser)."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, kept between calls in this process."""
    held = getattr(sys, "_pageloom_powers", None)
    if held is None:
        held = sys._pageloom_powers = {}
    table = held.get(base)
    if table is None or len(table) < n:
        table = np.ones(max(n, CHUNK_BYTES // 4), U)
        table[1:] = U(base)
        table = held[base] = np.multiply.accumulate(table)
    return table[:n]


def span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Hashes of values[start:end] for many spans; the length is part of the hash."""
    n = len(values)
    inverse = pow(base, -1, 1 << 64)
    total = np.zeros(n + 1, U)
    np.cumsum(values * powers(base, n), out=total[1:])
    h = (total[end] - total[start]) * powers(inverse, n + 1)[start]
    return mix(h + (end - start).astype(U) * U(0x9E3779B97F4A7C15))


def byte_values(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed * 0xD6E8FEB86659FD93 % (1 << 64)))


BASES = (0x5851F42D4C957F2D, 0x2545F4914F6CDD1D, 0x369DEA0F31A53F85)


def word_hashes(words: Words, seed: int = 0) -> np.ndarray:
    return span_hashes(byte_values(seed)[words.raw], words.start, words.end, BASES[seed])


def runs_of(doc: np.ndarray, k: int) -> np.ndarray:
    """Indices of words that start k consecutive words of one text."""
    if len(doc) < k:
        return np.empty(0, np.int64)
    return np.flatnonzero(doc[:len(doc) - k + 1] == doc[k - 1:])


def run_hashes(hashes: np.ndarray, first: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hashes of the k words from each index of `first`."""
    return span_hashes(hashes, first, first + k, BASES[(seed + 1) % 3])

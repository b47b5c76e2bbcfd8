"""Operator 5, SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives Viterbi.

One pass over the characters: at each position the automaton's output links give every piece that ends there, longest
first, and each relaxes the best score of the position. The best segmentation has the greatest sum of piece scores; of
equal sums the one whose last piece is longer, from the end backwards. A character that is no piece costs ten less than
the worst piece and is spelled in byte pieces.

No piece goes on with a space sign after another character, nor over a character that occurs in no piece, so a text's
segmentation is those of its parts "spaces and what follows them" in a row; the ids of a part are kept and reused.
"""

from __future__ import annotations

import re
import sys
import zlib
from dataclasses import astuple, dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..kernels import ship_by_value
from .common import table

ship_by_value(__name__)

SPACE = "▁"
PENALTY = 10.0
CACHE_PARTS = 300_000
SCHEMA = "doc_id long, ids array<int>, n_ids long, score double"


@dataclass
class Vocabulary:
    """Pieces with scores by id; `bytes_at` has the ids of the 256 byte pieces."""

    pieces: list[str]
    scores: list[float]
    normal: list[bool]
    bytes_at: list[int]

    @staticmethod
    def read(model_file: str) -> Vocabulary:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=model_file)
        ids = range(m.get_piece_size())
        pieces = [m.id_to_piece(i) for i in ids]
        special = [m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i) for i in ids]
        return Vocabulary(pieces, [m.get_score(i) for i in ids], [not s for s in special], [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)])


class Encoder:
    """Segments texts with one vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        v = vocabulary
        own = [(p, s, i) for i, (p, s, n) in enumerate(zip(v.pieces, v.scores, v.normal, strict=True)) if n]
        self.automaton = ahocorasick.Automaton()
        for piece, score, i in own:
            self.automaton.add_word(piece, (len(piece), score, i))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s, _ in own), default=0.0) - PENALTY
        self.bytes_at = v.bytes_at
        together = any(SPACE in p.lstrip(SPACE) for p, _, _ in own)
        newline = any("\n" in p for p, _, _ in own)
        self.parts = re.compile("(?s).+" if together else rf"{SPACE}+[^{SPACE}]*|[^{SPACE}]+" if newline else rf"{SPACE}+[^{SPACE}\n]*|\n+|[^{SPACE}\n]+")
        self.known: dict[str, tuple[bytes, float]] = {}
        self.spelled = [p.replace(SPACE, " ").encode() if n else b"" for p, n in zip(v.pieces, v.normal, strict=True)]
        for byte, i in enumerate(v.bytes_at):
            self.spelled[i] = bytes([byte])

    def segment(self, part: str) -> tuple[bytes, float]:
        """Best ids (32-bit little-endian) and score of a part, in one pass of the automaton."""
        n = len(part)
        best = [0.0] + [-float("inf")] * n
        back: list[tuple[int, int]] = [(0, 0)] * (n + 1)
        done = 0  # positions up to here have their best score

        def settle(stop: int) -> None:
            nonlocal done
            while done < stop:
                done += 1
                if part[done - 1] not in self.automaton and best[done - 1] + self.unknown > best[done]:
                    best[done] = best[done - 1] + self.unknown
                    back[done] = (1, -1)

        for last, (size, score, i) in self.automaton.iter(part):
            if last > done:
                settle(last)
            total = best[last + 1 - size] + score
            if total > best[last + 1]:
                best[last + 1] = total
                back[last + 1] = (size, i)
        settle(n)
        ids: list[int] = []
        at = n
        while at:
            size, i = back[at]
            ids.extend([i] if i >= 0 else [self.bytes_at[b] for b in reversed(part[at - 1].encode())])
            at -= size
        return np.array(ids[::-1], "<i4").tobytes(), best[n]

    def encode(self, text: str) -> tuple[bytes, float]:
        if not text:
            return b"", 0.0
        if len(self.known) > CACHE_PARTS:
            self.known.clear()
        known, out, score = self.known, [], 0.0
        for part in self.parts.findall(SPACE + text.replace(" ", SPACE)):
            found = known.get(part)
            if found is None:
                found = known[part] = self.segment(part)
            out.append(found[0])
            score += found[1]
        return b"".join(out), score

    def decode(self, ids: np.ndarray) -> str:
        """Control and unknown pieces spell nothing; bytes that are no UTF-8 become U+FFFD; one leading space goes."""
        spelled = self.spelled
        text = b"".join([spelled[i] for i in ids.tolist()]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def encoder_of(vocabulary: Vocabulary) -> Encoder:
    """The encoder of this process, built once for a vocabulary."""
    held = sys.__dict__.setdefault("_pageloom_encoders", {})
    key = zlib.crc32("\n".join(vocabulary.pieces).encode())
    if key not in held:
        held.clear()
        held[key] = Encoder(vocabulary)
    return held[key]


def encode_batches(batches, vocabulary: tuple, check: bool):
    encoder = encoder_of(Vocabulary(*vocabulary))
    for batch in batches:
        texts = [t.as_py() or "" for t in batch.column(1)]
        for a in range(0, len(texts), 1_000):
            own = texts[a:a + 1_000]
            found = [encoder.encode(t) for t in own]
            sizes = np.array([len(ids) // 4 for ids, _ in found], np.int64)
            flat = np.frombuffer(b"".join(ids for ids, _ in found), "<i4")
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            columns = {
                "doc_id": batch.column(0).slice(a, len(own)), "ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                "n_ids": pa.array(sizes), "score": pa.array([s for _, s in found], pa.float64()),
            }
            if check:
                columns["round_trip"] = pa.array([
                    encoder.decode(flat[x:y]) == t.replace(SPACE, " ") for t, x, y in zip(own, ends[:-1], ends[1:], strict=True)], pa.bool_())
            yield pa.record_batch(columns)


def decode_batches(batches, vocabulary: tuple):
    encoder = encoder_of(Vocabulary(*vocabulary))
    for batch in batches:
        texts = [None if ids.as_py() is None else encoder.decode(np.array(ids.as_py(), np.int64)) for ids in batch.column(1)]
        yield pa.record_batch({"doc_id": batch.column(0), "text": pa.array(texts, pa.string())})


def encode(docs: DataFrame, model_file: str, *, check: bool = False) -> DataFrame:
    """ids, n_ids and score of every text, with `check` also whether decoding gives the text back.

    A space sign in a text is read as a space. Null and empty texts have no ids and score 0. Repeated rows and rows
    without doc_id are encoded like others. Other columns are ignored; an empty table gives an empty result."""
    shipped = docs.sparkSession.sparkContext.broadcast(astuple(Vocabulary.read(model_file)))  # plain lists, which any node can read
    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "text").mapInArrow(
        lambda batches: encode_batches(batches, shipped.value, check), SCHEMA + (", round_trip boolean" if check else ""))


def decode(tokens: DataFrame, model_file: str) -> DataFrame:
    """doc_id and text of every row of (doc_id, ids); null ids give a null text."""
    shipped = tokens.sparkSession.sparkContext.broadcast(astuple(Vocabulary.read(model_file)))  # plain lists, which any node can read
    return tokens.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(
        lambda batches: decode_batches(batches, shipped.value), "doc_id long, text string")


def op5_piece_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), check=True)

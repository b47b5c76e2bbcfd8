"""Operator 6, toxicity: compression-distance classification with two zstandard dictionaries.

Both dictionaries end in the same common words of ordinary text; the toxic one begins with passages that mark toxic
text. So an ordinary window compresses alike with both, and only a window with toxic passages comes out shorter with
the toxic dictionary. Windows are eight words of the whole text. How many windows gain one, two or more bytes becomes a
probability by a logistic calibration on labelled documents.

Learning uses a bounded sample of labelled documents; scoring is one narrow pass over the text.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..kernels import ship_by_value
from .common import bounded_sample, slices, table, written

ship_by_value(__name__)

SAMPLE_DOCS = 10_000  # labelled documents that dictionaries and calibration are learned from, at most
WINDOW_WORDS = 8
GRAM = 5  # characters of the pieces that toxic passages are put together from
MIN_DOCS = 3  # toxic documents that a piece must come from
CONTRAST = 5.0  # times as common in toxic documents as in ordinary ones, at least
SIGNIFICANCE = 40.0  # of that difference, as a log-likelihood ratio
TOXIC_BYTES = 4_096
ORDINARY_BYTES = 8_192
TOXIC_AT = 0.7
GAINS = (1, 2, 3)

#: Words are letters: a-z (A-Z become these) and everything beyond ASCII.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(LETTERS).split()


def pieces_of(words: set[bytes]) -> set[str]:
    framed = [f" {w.decode()} " for w in words]
    return {f[k:k + GRAM] for f in framed for k in range(len(f) - GRAM + 1)}


def copy_key(words: list[bytes]) -> int:
    """The least hash of five words in a row: alike in most near copies."""
    return min((zlib.crc32(b" ".join(words[i:i + 5])) for i in range(max(1, len(words) - 4))), default=0)


def key_batches(batches):
    for batch in batches:
        keys = [copy_key(words_of(t.as_py())) for t in batch.column(1)]
        yield pa.record_batch([batch.column(0), pa.array(keys, pa.int64())], names=["doc_id", "key"])


def word_batches(batches, toxic: set[int]):
    """Distinct words and pieces of sampled documents: in how many of each label, and how often in ordinary ones."""
    for batch in batches:
        docs, counts = {(kind, label): Counter() for kind in "wp" for label in (0, 1)}, Counter()
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            label, own = int(doc_id in toxic), words_of(text.as_py())
            docs["w", label].update(w.decode() for w in set(own))
            docs["p", label].update(pieces_of(set(own)))
            if not label:
                counts.update(own)
        for kind in "wp":
            items = list(docs[kind, 0].keys() | docs[kind, 1].keys())
            yield pa.record_batch({
                "kind": pa.array([kind] * len(items), pa.string()), "item": pa.array(items, pa.string()),
                "toxic_docs": pa.array([docs[kind, 1][x] for x in items], pa.int64()), "other_docs": pa.array([docs[kind, 0][x] for x in items], pa.int64()),
                "other_count": pa.array([counts[x.encode()] if kind == "w" else 0 for x in items], pa.int64()),
            })


def passages(words: list[tuple[str, int]], grams: set[str]) -> list[str]:
    """Stretches of words (framed by spaces) that lie under toxic pieces, the most common first, none within another."""
    weight: Counter = Counter()
    for word, n in words:
        framed = f" {word} "
        under = [False] * len(framed)
        for k in range(len(framed) - GRAM + 1):
            if framed[k:k + GRAM] in grams:
                under[k:k + GRAM] = [True] * GRAM
        for run in "".join(c if u else "\n" for c, u in zip(framed, under, strict=True)).split("\n"):
            if run:
                weight[run] += n
    kept: list[str] = []
    size = 0
    for run, n in sorted(weight.items(), key=lambda x: (-x[1], x[0])):
        if n < MIN_DOCS or size + len(run.encode()) + 1 > TOXIC_BYTES:
            break
        if not any(run in other for other in kept):
            kept.append(run)
            size += len(run.encode()) + 1
    return kept


def learn_dictionaries(docs: DataFrame, toxic_ids: list[int], other_ids: list[int]) -> tuple[bytes, bytes]:
    """Content of the toxic and the ordinary dictionary, each of a few kilobytes."""
    toxic = set(toxic_ids)
    sample = docs.filter(F.col("doc_id").isin(toxic_ids + other_ids)).selectExpr("cast(doc_id as bigint) as doc_id", "text")
    counted = sample.mapInArrow(
        lambda batches: word_batches(batches, toxic), "kind string, item string, toxic_docs long, other_docs long, other_count long")
    items = written(counted.groupBy("kind", "item").agg(*[F.sum(c).alias(c) for c in ("toxic_docs", "other_docs", "other_count")]), "label-words")
    words = items.filter("kind = 'w'").withColumnRenamed("item", "word")

    n_toxic, n_other = max(1, len(toxic_ids)), max(1, len(other_ids))
    share = n_toxic / (n_toxic + n_other)
    t, o = F.col("toxic_docs"), F.col("other_docs")
    ratio = (t / n_toxic) / ((o + 0.5) / n_other)
    surprise = 2 * (t * F.log(t / ((t + o) * share)) + F.when(o > 0, o * F.log(o / ((t + o) * (1 - share)))).otherwise(0.0))
    marks = (
        items.filter("kind = 'p'").filter((t >= MIN_DOCS) & (ratio >= CONTRAST) & (surprise >= SIGNIFICANCE))
        .orderBy(F.desc("toxic_docs"), "item").limit(20_000).select(F.col("item").alias("piece"))
    )
    grams = {r["piece"] for r in marks.collect()}
    framed = F.concat(F.lit(" "), F.col("word"), F.lit(" "))
    pieces = F.transform(F.sequence(F.lit(1), F.greatest(F.length(framed) - GRAM + 1, F.lit(1))), lambda i: framed.substr(i, F.lit(GRAM)))
    found = words.filter("toxic_docs > 0").select("word", "toxic_docs", F.explode(pieces).alias("piece")).join(marks, "piece", "left_semi")
    found = found.select("word", "toxic_docs").distinct().orderBy(F.desc("toxic_docs"), "word").limit(20_000)
    toxic_words = [(r["word"], r["toxic_docs"]) for r in found.collect()]
    common = [r["word"] for r in words.orderBy(F.desc("other_count"), "word").limit(ORDINARY_BYTES // 2).collect()]

    ordinary = b""
    for word in common:  # the most common word lies nearest to what is compressed
        if len(ordinary) + len(word.encode()) + 1 > ORDINARY_BYTES:
            break
        ordinary = b" " + word.encode() + ordinary
    marked = "\n".join(reversed(passages(toxic_words, grams))).encode()
    return marked + b"\n" + ordinary + b" ", b"\n" + ordinary + b" "


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    """Frames without header fields; matches of five bytes or more, so chance matches save nothing."""
    parameters = zstandard.ZstdCompressionParameters(
        format=zstandard.FORMAT_ZSTD1_MAGICLESS, window_log=17, write_content_size=False, write_checksum=False, write_dict_id=False,
        strategy=zstandard.STRATEGY_LAZY2, min_match=5, hash_log=15, chain_log=15, search_log=6, target_length=64)
    dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(compression_params=parameters)
    return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=parameters)


def window_gains(text: str | None, toxic: zstandard.ZstdCompressor, ordinary: zstandard.ZstdCompressor) -> list[int]:
    """Bytes by which each window is shorter with the toxic dictionary."""
    words = words_of(text)
    windows = [b" " + b" ".join(words[i:i + WINDOW_WORDS]) + b" " for i in range(0, len(words), WINDOW_WORDS)]
    return [len(ordinary.compress(w)) - len(toxic.compress(w)) for w in windows]


def gain_counts(texts: pa.Array, toxic: zstandard.ZstdCompressor, ordinary: zstandard.ZstdCompressor) -> list[np.ndarray]:
    """Of each text: windows, and those that gain so many bytes or more."""
    rows = []
    for text in texts:
        gains = window_gains(text.as_py(), toxic, ordinary)
        rows.append([len(gains), *(sum(g >= k for g in gains) for k in GAINS)])
    return list(np.array(rows, np.int64).reshape(len(rows), 1 + len(GAINS)).T)


def gain_batches(batches, contents: tuple[bytes, bytes]):
    toxic, ordinary = map(compressor, contents)
    for batch in batches:
        columns = gain_counts(batch.column(1), toxic, ordinary)
        yield pa.record_batch([batch.column(0), *map(pa.array, columns)], names=["doc_id", "n_windows", *(f"gain_{k}" for k in GAINS)])


def probability(weights: np.ndarray, counts: list[np.ndarray]) -> np.ndarray:
    x = np.column_stack(features(dict(zip(["n_windows", *(f"gain_{k}" for k in GAINS)], counts, strict=True))))
    return 1 / (1 + np.exp(-np.clip(weights[0] + x @ weights[1:], -30, 30)))


def scored_slices(batches, model: tuple[bytes, bytes, np.ndarray] | None):
    """Slices of batches that have a text column, with their scores."""
    compressors = None if model is None else (compressor(model[0]), compressor(model[1]))
    for batch in batches:
        at = batch.schema.get_field_index("text")
        for part in slices(batch):
            yield part, np.zeros(part.num_rows) if model is None else probability(model[2], gain_counts(part.column(at), *compressors))


def score_batches(batches, model: tuple[bytes, bytes, np.ndarray] | None):
    """The columns beside the text, and the score."""
    for part, score in scored_slices(batches, model):
        part = part.drop_columns(["text"])
        yield pa.record_batch([*part.columns, pa.array(score, pa.float64())], names=[*part.schema.names, "score"])


def keep_batches(batches, model: tuple[bytes, bytes, np.ndarray] | None, toxic_at: float):
    for part, score in scored_slices(batches, model):
        yield part.filter(pa.array(score < toxic_at))


def features(counts: dict) -> list[np.ndarray]:
    """What the calibration sees of each document."""
    n = np.maximum(np.asarray(counts["n_windows"], float), 1)
    return [f for k in GAINS for f in (np.log1p(np.asarray(counts[f"gain_{k}"], float)), np.asarray(counts[f"gain_{k}"], float) / n)]


def calibrate(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weights (the constant first) of a logistic model, by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (p - y) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def held_out() -> Column:
    """Documents whose labels are never learned from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, *, sample_docs: int = SAMPLE_DOCS) -> tuple[bytes, bytes, np.ndarray] | None:
    """Both dictionaries and the calibration, from documents that are labelled and not held out; None without both labels."""
    marks = (
        labels.filter("toxic is not null and doc_id is not null").filter(~held_out())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    )
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(marks, "doc_id").distinct()
    marked = {r["doc_id"]: int(r["toxic"] > 0) for r in bounded_sample(known, "doc_id", sample_docs).collect()}
    own = docs.filter(F.col("doc_id").isin(list(marked))).selectExpr("cast(doc_id as bigint) as doc_id", "text")
    keys = own.mapInArrow(key_batches, "doc_id long, key long")
    # one of each group of near copies, or a copied document's words would pass for common ones
    kept = {r["doc_id"] for r in keys.groupBy("key").agg(F.min("doc_id").alias("doc_id")).collect()}
    sample = {i: t for i, t in marked.items() if i in kept}
    toxic, other = ([i for i, t in sample.items() if t == label] for label in (1, 0))
    if not toxic or not other:
        return None
    contents = learn_dictionaries(docs, toxic, other)
    counts = ", ".join(f"gain_{k} long" for k in GAINS)
    learned = own.mapInArrow(lambda batches: gain_batches(batches, contents), f"doc_id long, n_windows long, {counts}").toPandas()
    learned = learned.sort_values(list(learned.columns))
    return *contents, calibrate(np.column_stack(features(learned)), learned["doc_id"].map(marked).to_numpy(float))


def scored(docs: DataFrame, labels: DataFrame, row: Column, *, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """`row` and score of every document."""
    model = learn(docs, labels, sample_docs=sample_docs)
    plain = docs.select("text", row.alias("row"))
    kind = plain.schema["row"].dataType.simpleString()
    return plain.mapInArrow(lambda batches: score_batches(batches, model), f"row {kind}, score double")


def without_toxic(docs: DataFrame, labels: DataFrame, *, toxic_at: float = TOXIC_AT) -> DataFrame:
    """The rows of docs, with all their columns, whose score is below `toxic_at`."""
    model = learn(docs, labels)
    return docs.mapInArrow(lambda batches: keep_batches(batches, model, toxic_at), docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, *, sample_docs: int = SAMPLE_DOCS, toxic_at: float = TOXIC_AT) -> DataFrame:
    """Toxicity of every document, learned from `labels.toxic` of documents that are not held out.

    Returns doc_id, held_out, score (0 to 1) and predicted (1 if score is at least `toxic_at`). A null or empty text has
    no window and gets the score of "nothing found". Without both labels in the sample all scores are 0. Rows that share
    a doc_id are scored one by one and learned from together; a document with several labels is toxic if one says so; rows
    without doc_id are scored, never learned from. Other columns are ignored; an empty table gives an empty result.
    """
    row = F.struct(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"))
    return scored(docs, labels, row, sample_docs=sample_docs).select(
        "row.doc_id", "row.held_out", "score", (F.col("score") >= toxic_at).cast("int").alias("predicted"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

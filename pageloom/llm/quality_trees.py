"""Operator 2, quality rules: base rules, and gradient-boosted trees over document statistics.

Statistics are counted over whole texts in one narrow pass, with numpy over the bytes of many texts at once. The trees
are grown on a bounded sample of labelled documents, with splits that would break a feature's stated direction refused,
and flattened into node arrays; scoring walks all trees of many documents level by level.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..kernels import ship_by_value
from . import words as wd
from .common import bounded_sample, table, written

ship_by_value(__name__)

SYMBOLS = b"#*$%&|<>"
SAMPLE_DOCS = 20_000  # labelled documents the trees are grown on, at most
MIN_WORDS = 50
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
EXTRA = ["n_chars", "n_lines", "n_upper", "n_digits", "n_marks"]
FEATURES = [
    "log_words", "chars_per_word", "symbols_per_word", "dup_line_share", "repeat_share", "upper_share", "digit_share",
    "marks_per_word", "words_per_line",
]
#: -1: more of it never makes a document better.
DIRECTIONS = {"symbols_per_word": -1, "dup_line_share": -1, "repeat_share": -1}


@dataclass
class Trees:
    """Nodes of all trees in a row. A leaf's children are itself; value is 0 elsewhere."""

    root: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of the good label, rows of x at a time."""
        at = np.broadcast_to(self.root, (len(x), len(self.root))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            go_left = x[rows, self.feature[at]] <= self.threshold[at]
            at = np.where(go_left, self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(axis=1))))


def grow(
    x: np.ndarray, y: np.ndarray, directions: np.ndarray, *, n_trees: int = 60, depth: int = 4, rate: float = 0.2,
    bins: int = 64, min_docs: int = 20, ridge: float = 1.0,
) -> Trees:
    """Second-order boosting of the logistic loss on binned features.

    A feature with direction -1 (+1) is only split where the left leaf is not below (above) the right one, and the two
    sides' later leaves are kept on their side of the middle, so the score is monotonic in it.
    """
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    raw = np.full(len(y), base)
    roots, feature, threshold, left, right, value = [], [], [], [], [], []

    def node() -> int:
        at = len(feature)
        feature.append(0), threshold.append(0.0), left.append(at), right.append(at), value.append(0.0)
        return at

    def split(rows: np.ndarray, g: np.ndarray, h: np.ndarray, low: float, high: float, level: int) -> int:
        at = node()
        total_g, total_h = g[rows].sum(), h[rows].sum()
        leaf = float(np.clip(-total_g / (total_h + ridge), low, high))
        best = (1e-6, None)
        if level < depth and len(rows) >= 2 * min_docs:
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                b = binned[rows, f]
                gl = np.cumsum(np.bincount(b, g[rows], len(c) + 1))[:-1]
                hl = np.cumsum(np.bincount(b, h[rows], len(c) + 1))[:-1]
                nl = np.cumsum(np.bincount(b, minlength=len(c) + 1))[:-1]
                wl = np.clip(-gl / (hl + ridge), low, high)
                wr = np.clip(-(total_g - gl) / (total_h - hl + ridge), low, high)
                loss = lambda w, g, h: g * w + 0.5 * (h + ridge) * w * w
                gain = loss(leaf, total_g, total_h) - loss(wl, gl, hl) - loss(wr, total_g - gl, total_h - hl)
                ok = (nl >= min_docs) & (len(rows) - nl >= min_docs) & (directions[f] * (wr - wl) >= 0)
                gain = np.where(ok, gain, -np.inf)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], (f, k, wl[k], wr[k]))
        if best[1] is None:
            value[at] = rate * leaf
            raw[rows] += value[at]
            return at
        f, k, wl, wr = best[1]
        feature[at], threshold[at] = f, float(cuts[f][k])
        goes = binned[rows, f] <= k
        middle = (wl + wr) / 2
        bounds_l, bounds_r = (low, high), (low, high)
        if directions[f] > 0:
            bounds_l, bounds_r = (low, middle), (middle, high)
        elif directions[f] < 0:
            bounds_l, bounds_r = (middle, high), (low, middle)
        left[at] = split(rows[goes], g, h, *bounds_l, level + 1)
        right[at] = split(rows[~goes], g, h, *bounds_r, level + 1)
        return at

    every = np.arange(len(y))
    for _ in range(n_trees if len(y) else 0):
        p = 1 / (1 + np.exp(-raw))
        roots.append(split(every, p - y, p * (1 - p), -np.inf, np.inf, 0))
    return Trees(*(np.array(v) for v in (roots, feature, threshold, left, right, value)), base, depth)


def per_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def salted(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    return wd.mix(h + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def repeat_flags(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: whether it occurs twice or more, and whether this is its first place."""
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys), bool)
    same[1:] = keys[order][1:] == keys[order][:-1]
    twice = same.copy()
    twice[:-1] |= same[1:]
    repeated, first = np.empty(len(keys), bool), np.empty(len(keys), bool)
    repeated[order], first[order] = twice, ~same
    return repeated, first


def text_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """COUNTS and EXTRA of every text."""
    raw, offsets = wd.byte_view(texts)
    n = len(offsets) - 1
    inside = wd.is_word_byte(raw)
    starts_char = (raw & 0xC0) != 0x80
    words = wd.split_mask(raw, offsets, inside)

    lines = wd.split_mask(raw, offsets, raw != 10)
    filled = np.concatenate([[0], np.cumsum(inside)])
    has_word = filled[lines.end] > filled[lines.start]
    line_doc = lines.doc[has_word]
    line_keys = wd.span_hashes(wd.byte_values(0)[raw], lines.start[has_word], lines.end[has_word], wd.BASES[0])
    _, first_line = repeat_flags(salted(line_keys, line_doc))

    at = wd.runs_of(words.doc, 3)
    grams = wd.run_hashes(wd.word_hashes(words), at, 3)
    repeated, _ = repeat_flags(salted(grams, words.doc[at]))
    cover = np.zeros(len(words.doc) + 1, np.int32)
    np.add.at(cover, at[repeated], 1)
    np.add.at(cover, at[repeated] + 3, -1)

    kind = np.zeros(256, np.uint8)
    kind[65:91], kind[48:58], kind[list(b".,!?;:")] = 1, 2, 3
    kinds = kind[raw]
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    return {
        "n_words": words.counts(),
        "word_chars": per_text(inside & starts_char, offsets),
        "n_symbols": per_text(symbol[raw], offsets),
        "n_dup_lines": np.bincount(line_doc[~first_line], minlength=n),
        "n_repeat_words": np.bincount(words.doc[np.cumsum(cover[:-1]) > 0], minlength=n),
        "n_chars": per_text(starts_char, offsets),
        "n_lines": np.bincount(line_doc, minlength=n),
        "n_upper": per_text(kinds == 1, offsets),
        "n_digits": per_text(kinds == 2, offsets),
        "n_marks": per_text(kinds == 3, offsets),
    }


def count_batches(batches):
    for batch in batches:
        for a, b in wd.chunks(batch.column(1)):
            counts = text_counts(batch.column(1).slice(a, b - a))
            yield pa.record_batch([batch.column(0).slice(a, b - a), *(pa.array(v, pa.int64()) for v in counts.values())], names=["doc_id", *counts])


def document_counts(docs: DataFrame) -> DataFrame:
    """doc_id, COUNTS and EXTRA of every document."""
    fields = ", ".join(f"{c} long" for c in [*COUNTS, *EXTRA])
    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "text").mapInArrow(count_batches, f"doc_id long, {fields}")


def features(counts: pd.DataFrame | dict) -> np.ndarray:
    c = {k: np.asarray(counts[k], float) for k in [*COUNTS, *EXTRA]}
    words, chars, lines = (np.maximum(c[k], 1) for k in ("n_words", "word_chars", "n_lines"))
    return np.stack([
        np.log1p(c["n_words"]), c["word_chars"] / words, c["n_symbols"] / words, c["n_dup_lines"] / lines, c["n_repeat_words"] / words,
        c["n_upper"] / chars, c["n_digits"] / chars, c["n_marks"] / words, c["n_words"] / lines,
    ], axis=1)


def learn(counts: DataFrame, labels: DataFrame, *, sample_docs: int = SAMPLE_DOCS, **growth) -> Trees | None:
    """Trees from labelled documents (label `quality`, 1 is good); None where there is no label."""
    marks = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = bounded_sample(counts.join(marks, "doc_id"), "doc_id", sample_docs).toPandas().sort_values(["doc_id", *COUNTS])
    if not len(sample):
        return None
    directions = np.array([DIRECTIONS.get(f, 0) for f in FEATURES])
    return grow(features(sample), (sample["quality"].to_numpy() > 0).astype(float), directions, **growth)


def score_batches(batches, trees: Trees | None):
    for batch in batches:
        good = trees.score(features({c: batch.column(batch.schema.get_field_index(c)) for c in [*COUNTS, *EXTRA]})) if trees else np.ones(len(batch))
        yield pa.record_batch([*batch.columns, pa.array(good, pa.float64())], names=[*batch.schema.names, "score"])


def quality_rules(docs: DataFrame, labels: DataFrame, *, keep_at: float = 0.5, sample_docs: int = SAMPLE_DOCS, **growth) -> DataFrame:
    """Base rules and the trees' verdict for every document.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed (fewer than 50 words, or
    more than half of the words in repeated 3-word windows), score (the trees' probability of quality 1) and kept (not
    base_failed and score at least `keep_at`; without any label only the base rules count).

    Null and empty texts have no words and fail. Rows that share a doc_id, or have none, are judged one by one; a
    document with several labels counts as its lowest. Other columns are ignored; an empty table gives an empty result.
    """
    counts = written(document_counts(docs), "text-counts")
    trees = learn(counts, labels, sample_docs=sample_docs, **growth)
    fields = counts.schema.simpleString()[7:-1]
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counts.mapInArrow(lambda batches: score_batches(batches, trees), f"{fields}, score double").select(
        "doc_id", *COUNTS, failed.alias("base_failed"), "score", (~failed & (F.col("score") >= keep_at)).alias("kept"))


def op2_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

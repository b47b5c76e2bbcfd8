"""Operator 10, language ID: rank-order profiles compared by out-of-place distance.

A language's profile is the order of its most frequent n-grams (one to three letters, with word edges) in a bounded
sample of labelled documents, over all letters of all scripts. A document is read whole, its n-grams are ordered the same way, and the language whose
profile is the least out of place wins. Learning collects a few hundred n-grams per language; predicting is one narrow
pass over the text.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..kernels import ship_by_value
from .common import slices, table
from .words import chunks

ship_by_value(__name__)

TOP = 300
SAMPLE_DOCS = 2_000  # labelled documents per language that a profile is learned from, at most
UNKNOWN = "und"
Model = tuple[list[str], str, np.ndarray, np.ndarray]  # languages, alphabet, codes of all profiles, profiles
SHIFT = 6  # bits of a letter's number in a small alphabet
CODES = (1 << SHIFT) + (1 << 2 * SHIFT) + (1 << 3 * SHIFT)


def letter_table(alphabet: str, apart: bool = False) -> np.ndarray:
    """For each code point: 0 no letter, 1 .. n its place in the alphabet. Any other letter is 63, or with `apart` has a
    number of its own after the alphabet's."""
    held = sys.__dict__.setdefault("_pageloom_letters", {})
    if "any" not in held:
        held["any"] = np.array([i for i in range(0x110000) if chr(i).isalpha()])
    if (alphabet, apart) not in held:
        own = np.zeros(0x110000, np.int32)
        places = np.array([ord(c) for c in alphabet], np.int64)
        others = np.setdiff1d(held["any"], places)
        own[others] = len(places) + 1 + np.arange(len(others)) if apart else (1 << SHIFT) - 1
        own[places] = np.arange(1, len(places) + 1)
        held[alphabet, apart] = own
    return held[alphabet, apart]


def bits_of(letters: np.ndarray) -> int:
    """Bits of a letter's number: 6 for a small alphabet, 18 for all letters."""
    held = sys.__dict__.setdefault("_pageloom_letter_bits", {})
    if id(letters) not in held:
        held[id(letters)] = (letters, max(SHIFT, int(letters.max()).bit_length()))  # held, so the id stays its own
    return held[id(letters)][1]


def symbols(texts: list[str], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letter numbers of all texts in a row with a 0 before and between them and two after, and the text of each."""
    lowered = [t.lower() for t in texts]
    points = np.frombuffer("\n".join(["", *lowered, "", ""]).encode("utf-32-le", "surrogatepass"), "<u4")
    doc = np.repeat(np.arange(len(texts) + 2), np.array([*map(len, lowered), 0, 0]) + 1)
    return letters[points].astype(np.int64), doc


def gram_counts(texts: list[str], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text and n-gram: text, code, count; and whether a text has a letter at all. In the order of text and code."""
    bits = bits_of(letters)
    room = 1 << (61 - 3 * bits)  # texts whose number fits beside a code
    if len(texts) > room:
        parts = [gram_counts(texts[at:at + room], letters) for at in range(0, len(texts), room)]
        docs = [part[0] + k * room for k, part in enumerate(parts)]
        return np.concatenate(docs), *(np.concatenate([part[k] for part in parts]) for k in (1, 2, 3))
    s, doc = symbols(texts, letters)
    a, b, c = s[:-2], s[1:-1], s[2:]
    code_bits = 3 * bits + 1
    at = doc[1:-1] << code_bits
    two, three = 1 << bits, (1 << bits) + (1 << 2 * bits)
    letter = b > 0
    left = letter | (a > 0)
    pair_at = np.where(a > 0, doc[:-2], doc[1:-1]) << code_bits  # a 0 after a text is the next one's, the pair is not
    keys = np.concatenate([
        (at + b)[letter],
        (pair_at + two + (a << bits) + b)[left],
        (at + three + (a << 2 * bits) + (b << bits) + c)[letter],
    ])
    keys.sort()
    new = np.flatnonzero(np.diff(keys, prepend=-1))
    keys, counts = keys[new], np.diff(new, append=len(keys))
    some = np.zeros(len(texts), bool)
    some[doc[1:-1][letter]] = True
    return keys >> code_bits, keys & ((1 << code_bits) - 1), counts, some


def ranked(doc: np.ndarray, code: np.ndarray, count: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The `top` n-grams of each text with their ranks; the more frequent first, of equals the lower code."""
    order = np.lexsort((code, -count, doc))
    doc, code = doc[order], code[order]
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    rank = np.arange(len(doc)) - np.repeat(first, np.diff(first, append=len(doc)))
    near = rank < top
    return doc[near], code[near], rank[near]


def distances(
    texts: list[str], letters: np.ndarray, profiles: np.ndarray, top: int, known: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    """Out-of-place distance of each text (row) to each profile (column), and whether it has a letter.

    profiles: for each language and code the rank, or `top` where the code is not in the profile, which costs `top`. Its
    columns are the codes `known`, in order, and a last one for all others; without `known`, a column's number is its code."""
    doc, code, count, some = gram_counts(texts, letters)
    doc, code, rank = ranked(doc, code, count, top)
    if known is not None:
        at = np.searchsorted(known, code)
        code = np.where(np.append(known, -1)[at] == code, at, len(known))
    out = np.zeros((len(texts), len(profiles)))
    for i, profile in enumerate(profiles):
        place = profile[code]
        cost = np.where(place < top, np.abs(place - rank), top)
        out[:, i] = np.bincount(doc, cost, minlength=len(texts))
    return out, some


def learn_batches(batches, alphabet: str):
    letters = letter_table(alphabet, apart=True)
    for batch in batches:
        for a, b in chunks(batch.column(1)):
            langs = batch.column(0).slice(a, b - a).to_pylist()
            texts = [t.as_py() or "" for t in batch.column(1).slice(a, b - a)]
            doc, code, count, _ = gram_counts(texts, letters)
            names = sorted(set(langs))
            place = {x: i for i, x in enumerate(names)}
            lang = np.array([place[x] for x in langs], np.int64)[doc]
            order = np.lexsort((code, lang))
            lang, code, count = lang[order], code[order], count[order]
            new = np.flatnonzero((np.diff(lang, prepend=-1) != 0) | (np.diff(code, prepend=-1) != 0))
            if len(new):
                yield pa.record_batch({
                    "lang": pa.array([names[k] for k in lang[new].tolist()], pa.string()), "code": pa.array(code[new], pa.int64()),
                    "n": pa.array(np.add.reduceat(count, new).astype(np.int64)),
                })


def predicted_slices(batches, languages: list[str], alphabet: str, known: np.ndarray, profiles: np.ndarray, top: int):
    """Slices of batches that have a text column, with the language and score of each text."""
    letters = letter_table(alphabet, apart=True)
    for batch in batches:
        column = batch.schema.get_field_index("text")
        for part in slices(batch):
            langs, scores = [], []
            texts = part.column(column)
            for a, b in chunks(texts):
                far, some = distances([t.as_py() or "" for t in texts.slice(a, b - a)], letters, profiles, top, known)
                for row, letter in zip(far, some, strict=True):
                    if not letter or not languages:
                        langs.append(UNKNOWN)
                        scores.append(0.0)
                        continue
                    best = int(np.argmin(row))
                    rest = np.delete(row, best)
                    langs.append(languages[best])
                    scores.append(float(1 - row[best] / rest.min()) if len(rest) and rest.min() > 0 else float(not len(rest)))
            yield part, langs, scores


def predict_batches(batches, *model):
    for part, langs, scores in predicted_slices(batches, *model):
        yield pa.record_batch([part.column(part.schema.get_field_index("row")), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                              names=["row", "lang_pred", "score"])


def keep_batches(batches, least_score: float, *model):
    for part, langs, scores in predicted_slices(batches, *model):
        said = part.column(part.schema.get_field_index("lang")).to_pylist()
        yield part.filter(pa.array([
            found != UNKNOWN and (lang is None or lang == found or score < least_score)
            for lang, found, score in zip(said, langs, scores, strict=True)], pa.bool_()))


def sampled(labelled: DataFrame, limit: int) -> DataFrame:
    """At most `limit` documents of each language, by hash of their id. Thinned before the ranks, so no rank sees a
    whole language."""
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not counts:
        return labelled
    spread = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / F.lit(1 << 40)
    rate = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 1.5 * limit / n))])
    thin = labelled.withColumn("spread", spread).filter(F.col("spread") < F.element_at(rate, F.col("lang")))
    order = Window.partitionBy("lang").orderBy("spread", "doc_id", F.xxhash64("text"))
    return thin.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= limit).select("lang", "text")


def learn_profiles(labelled: DataFrame, *, sample_docs: int = SAMPLE_DOCS, top: int = TOP) -> Model:
    """The model from labelled (doc_id, text, lang), lang not null. Its alphabet has all letters of the sample, the most
    frequent first; it only gives n-grams that are equally frequent their order."""
    sample = sampled(labelled.select("doc_id", "text", "lang"), sample_docs)
    found = (
        sample.select(F.explode(F.split(F.lower("text"), "")).alias("c")).filter(F.col("c").rlike(r"^\p{L}$"))
        .groupBy("c").count().orderBy(F.desc("count"), "c").collect()
    )
    alphabet = "".join(r["c"] for r in found if len(r["c"]) == 1)
    counts = sample.mapInArrow(lambda batches: learn_batches(batches, alphabet), "lang string, code long, n long")
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    best = (
        counts.groupBy("lang", "code").agg(F.sum("n").alias("n"))
        .withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= top).collect()
    )
    languages = sorted({r["lang"] for r in best})
    known = np.array(sorted({r["code"] for r in best}), np.int64)
    profiles = np.full((len(languages), len(known) + 1), top, np.int32)
    row, column = {x: i for i, x in enumerate(languages)}, {x: i for i, x in enumerate(known.tolist())}
    for r in best:
        profiles[row[r["lang"]], column[r["code"]]] = r["nth"] - 1
    return languages, alphabet, known, profiles


def held_out() -> Column:
    """Documents never learned from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, model: Model, row: Column, top: int = TOP) -> DataFrame:
    """lang_pred and score beside `row` for every row of docs."""
    languages, alphabet, known, profiles = model
    shipped = docs.sparkSession.sparkContext.broadcast((known, profiles))  # languages times their n-grams
    plain = docs.select("text", row.alias("row"))
    kind = plain.schema["row"].dataType.simpleString()
    return plain.mapInArrow(
        lambda batches: predict_batches(batches, languages, alphabet, *shipped.value, top),
        f"row {kind}, lang_pred string, score double",
    )


def learn(docs: DataFrame, *, sample_docs: int = SAMPLE_DOCS, top: int = TOP) -> Model:
    """A model from the documents that are labelled and not held out."""
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    return learn_profiles(labelled, sample_docs=sample_docs, top=top)


def without_wrong_language(docs: DataFrame, least_score: float) -> DataFrame:
    """The rows of docs, with all their columns, but texts of no language and those that are of another language than
    `lang` says by a score of `least_score` or more."""
    languages, alphabet, known, profiles = learn(docs)
    shipped = docs.sparkSession.sparkContext.broadcast((known, profiles))  # languages times their n-grams
    return docs.mapInArrow(lambda batches: keep_batches(batches, least_score, languages, alphabet, *shipped.value, TOP), docs.schema)


def language_id(docs: DataFrame, *, sample_docs: int = SAMPLE_DOCS, top: int = TOP) -> DataFrame:
    """The language of every document, learned from (text, lang) of documents that are not held out.

    Returns doc_id, held_out, lang_pred, score. score is how much nearer the best profile is than the next (0 to 1; 1 if
    only one language was learned). A text that is null or has no letter is `und` with score 0, and so is every text if
    no document has a language. Equally near languages go to the first by name. Rows that share a doc_id are judged one
    by one; rows without one are not learned from. Other columns are ignored; an empty table gives an empty result.
    """
    model = learn(docs, sample_docs=sample_docs, top=top)
    row = F.struct(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"))
    return identify(docs, model, row, top).select("row.doc_id", "row.held_out", "lang_pred", "score")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))

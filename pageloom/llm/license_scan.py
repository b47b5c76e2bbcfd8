"""Operator 9, license scans: fuzzy search for short notices.

A notice that occurs with at most k edits has one of k + 1 parts unharmed. All parts of all notices go into one
automaton, each hit gives a candidate place, and only there the regex library's bounded-error matching decides, with
the number of edits and the span. Exact phrases are found beside it. Every text is read whole in one narrow pass.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from ..kernels import ship_by_value
from .common import table

ship_by_value(__name__)

# Phrases that count wherever their words stand in a row, and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Short notices as words, their labels and the edits they may have: about one for every twelve characters.
NOTICES = [
    ("licensed under the apache license version 2 0", "apache", 3),
    ("released under the mit license", "mit", 2),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", 6),
    ("this work is licensed under the gnu general public license version 3", "gpl", 5),
    ("under the terms of the gnu general public license", "gpl", 4),
    ("under the terms of the gnu lesser general public license", "lgpl", 4),
    ("licensed under cc by nc 4 0", "cc-by", 2),
    ("licensed under a creative commons attribution", "cc-by", 3),
    ("redistribution and use in source and binary forms", "bsd", 4),
    ("subject to the terms of the mozilla public license", "mpl", 4),
]

#: Bytes of words: a-z (A-Z become these), 0-9 and everything beyond ASCII. All others part words.
WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def parts_of(notice: str, edits: int) -> list[tuple[int, str]]:
    """edits + 1 parts of about equal length, with their places in the notice."""
    cuts = [len(notice) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def seeds_of(notices: list[tuple[str, str, int]]) -> ahocorasick.Automaton:
    seeds: dict[str, list[tuple[int, int]]] = {}
    for i, (notice, _, edits) in enumerate(notices):
        for at, part in parts_of(notice, edits):
            seeds.setdefault(part, []).append((i, at))
    automaton = ahocorasick.Automaton()
    for part, uses in seeds.items():
        automaton.add_word(part, (len(part), uses))
    automaton.make_automaton()
    return automaton


def matchers(notices: list[tuple[str, str, int]]) -> list[regex.Pattern]:
    """Whole-word matches of a notice with at most its edits, the fewest edits first."""
    return [regex.compile(rf"(?b)(?<![^ ])(?:{regex.escape(n, special_only=True)}){{e<={k}}}(?![^ ])") for n, _, k in notices]


def candidate_places(words: str, notices, automaton) -> dict[int, list[tuple[int, int]]]:
    """Per notice the short ranges in which a match must lie, by its seeds. Places that edits alone set apart are one."""
    begins: dict[int, list[int]] = {}
    for last, (size, uses) in automaton.iter(words):
        for i, at in uses:
            begins.setdefault(i, []).append(last + 1 - size - at)
    places: dict[int, list[tuple[int, int]]] = {}
    for i, found in begins.items():
        notice, _, edits = notices[i]
        found.sort()
        first = found[0]
        for begin, following in zip(found, [*found[1:], None], strict=True):
            if following is None or following - first > edits:
                places.setdefault(i, []).append((max(0, first - edits - 1), min(len(words), begin + len(notice) + edits + 1)))
                first = following
    return places


def fuzzy_spans(words: str, notices, automaton, patterns) -> list[tuple[int, int, int, int]]:
    """(notice, edits, start, end) in a text of words joined by single spaces, without overlaps of one notice: of
    overlapping ones that with the fewest edits stays, then the one further in front. In the order of notices, then of places.

    Every place is searched in its own short range; one that overlaps a better match is searched again beside it."""
    found = []
    for i, ranges in sorted(candidate_places(words, notices, automaton).items()):
        heap: list[tuple[int, int, int, int, int]] = []

        def look(a: int, b: int) -> None:
            if (m := patterns[i].search(words, a, b)) is not None and m.end() > m.start():
                heapq.heappush(heap, (sum(m.fuzzy_counts), m.start(), m.end(), a, b))

        for a, b in ranges:
            look(a, b)
        starts: list[int] = []  # matches that stay, in order
        ends: list[int] = []
        edits: list[int] = []
        while heap:
            n, start, end, a, b = heapq.heappop(heap)
            k = bisect_right(starts, start)
            if k and ends[k - 1] > start:
                k -= 1
            if k < len(starts) and starts[k] < end and ends[k] > start:
                look(a, min(b, starts[k]))
                look(max(a, ends[k]), b)
                continue
            starts.insert(k, start)
            ends.insert(k, end)
            edits.insert(k, n)
        found += [(i, n, start, end) for n, start, end in zip(edits, starts, ends, strict=True)]
    return found


def word_starts(words: str) -> np.ndarray:
    """Places of the spaces, so that the number of a word is how many lie before it."""
    return np.flatnonzero(np.frombuffer(words.encode("utf-32-le"), np.uint32) == 32)


def phrase_starts(words: str) -> list[tuple[int, str]]:
    """(place of the first word, label) of every place of a phrase."""
    framed, out = f" {words} ", []
    for phrase, label in PHRASES.items():
        at = framed.find(f" {phrase} ")
        while at >= 0:
            out.append((at, label))
            at = framed.find(f" {phrase} ", at + 1)
    return out


def scan_batches(batches, notices: list[tuple[str, str, int]]):
    automaton, patterns = seeds_of(notices), matchers(notices)
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            parts = (text.as_py() or "").encode().translate(WORD_BYTES).split()
            words = b" ".join(parts).decode()
            base = phrase_starts(words)
            fuzzy = fuzzy_spans(words, notices, automaton, patterns)
            spaces = word_starts(words) if base or fuzzy else None
            number = lambda at: int(np.searchsorted(spaces, at))  # noqa: B023, E731
            starts = [number(at) for at, _ in base]
            base_labels = {label for _, label in base}
            rows.append({
                "doc_id": doc_id, "n_words": len(parts), "n_base": len(base),
                "first_word": min(starts, default=None), "last_word": max(starts, default=None),
                "base_labels": ",".join(sorted(base_labels)),
                "labels": ",".join(sorted(base_labels | {notices[i][1] for i, *_ in fuzzy})),
                "score": 1.0 if base else max((1 - e / (notices[i][2] + 1) for i, e, *_ in fuzzy), default=0.0),
                "spans": [
                    {"label": notices[i][1], "edits": e, "first_word": number(a + (words[a:a + 1] == " ")),
                     "last_word": number(b - (words[b - 1:b] == " ")), "matched": words[a:b].strip()}
                    for i, e, a, b in fuzzy
                ],
            })
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([
            ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
            ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
            ("spans", pa.list_(pa.struct([
                ("label", pa.string()), ("edits", pa.int32()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("matched", pa.string())]))),
        ]))


def license_scan(docs: DataFrame, notices: list[tuple[str, str, int]] | None = None) -> DataFrame:
    """License labels of every document.

    Words are runs of a-z (A-Z lower-cased), 0-9 and characters beyond ASCII. Returns doc_id, n_words, n_base (places of
    the exact phrases), first_word and last_word (the smallest and largest start, else null), base_labels and labels
    (distinct, sorted, joined by commas; labels adds those of notices found with edits), score (1 with a phrase, else
    1 - edits / (bound + 1) of the best notice, else 0) and spans: label, edits, first and last word, matched words.

    Null and empty texts have no words and no labels. Repeated rows and rows without doc_id are scanned like others. Other
    columns are ignored; an empty table gives an empty result. Labels are sorted, and of notices that match with equally many
    edits all are listed. Memory is that of one Arrow batch of texts; a long text costs its length and its notices.
    """
    notices = NOTICES if notices is None else notices
    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "text").mapInArrow(
        lambda batches: scan_batches(batches, notices),
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
        "spans array<struct<label:string,edits:int,first_word:bigint,last_word:bigint,matched:string>>",
    )


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))

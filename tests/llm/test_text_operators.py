"""Operators 1, 3, 5, 8 and 9 against plain Python, and on awkward tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from llm_cases import ROWS, SF
from pyspark.sql import functions as F

from pageloom.llm import license_scan, merkle, packing, piece_tokens, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def repeats_by_hand(rows, window=20):
    """(doc_id, kept words) with rows in the order of id, missing ids last."""
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    seen, out = set(), []
    for doc_id, text in ordered:
        own = words(text)
        gone = set()
        for i in range(len(own) - window + 1):
            key = tuple(own[i:i + window])
            if key in seen:
                gone |= set(range(i, i + window))
            seen.add(key)
        out.append((doc_id, " ".join(w for i, w in enumerate(own) if i not in gone), len(own), len(gone)))
    return Counter(out)


@pytest.mark.parametrize("shard_windows", [1 << 22, 5_000])
def test_substring_dedup_on_awkward_rows(edge, shard_windows):
    got = substring_dedup.substring_dedup(edge, carry=["lang", "block"], shard_windows=shard_windows)
    assert got.columns == ["doc_id", "kept_text", "n_words", "n_removed", "carry"]
    assert Counter(tuple(r)[:4] for r in got.collect()) == repeats_by_hand([r[:2] for r in ROWS])
    assert {r["carry"]["block"] for r in got.collect()} == {7}


def test_substring_dedup_with_a_crowded_sketch_and_small_blocks(spark):
    rng = random.Random(5)
    vocabulary = [f"v{i}" for i in range(40)]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randint(20, 60))] for _ in range(6)]
    rows = []
    for i in range(120):
        body = [rng.choice(vocabulary) for _ in range(rng.randint(0, 90))]
        for _ in range(rng.randint(0, 2)):
            at = rng.randint(0, len(body))
            body[at:at] = rng.choice(passages)
        rows.append((i * 3 % 121, " ".join(body)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = substring_dedup.substring_dedup(docs, block_bytes=3_000, shard_windows=200)
    assert Counter(map(tuple, got.collect())) == repeats_by_hand(rows)


def test_sketch_never_undercounts():
    h = np.random.default_rng(1).integers(0, 1 << 63, 3_000).astype(np.uint64)
    from pageloom.llm.substring_dedup import SKETCH_ROWS, cells_of
    for cells in cells_of(np.concatenate([h, h[:100]]), 512):
        counts = np.bincount(cells.astype(np.int64), minlength=512)
        assert (counts[cells[:100].astype(np.int64)] >= 2).all()
    assert SKETCH_ROWS == 2


def test_packed_arrays_come_back():
    arrays = [np.array([], np.uint32), np.array([1, 5, 9], np.uint64), np.array([255], np.uint8)]
    assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(arrays, substring_dedup.unpack(substring_dedup.pack(arrays)), strict=True))


def tree_by_hand(text):
    def sha(x):
        return hashlib.sha256(x.encode()).hexdigest()
    space, word = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
    shown, roots, leaves = "", "", set()
    for section in text.split("\n\n"):
        body, digests = "", ""
        for paragraph in section.split("\n"):
            runs = re.findall(rf"{space}*(?:{word}+{space}*){{1,8}}", paragraph) if re.search(word, paragraph) else [paragraph]
            own = [sha(r) for r in runs]
            leaves |= set(own)
            p = sha("P" + "".join(own))
            digests += p
            body += "P" + p[:12] + "".join("L" + d[:12] for d in own)
        s = sha("S" + digests)
        roots += s
        shown += "S" + s[:12] + body
    return "R" + sha("R" + roots) + shown, leaves


def test_fingerprints_on_awkward_rows(edge):
    got = {(r["doc_id"], r["n_chars"]): r for r in merkle.fingerprints(edge).collect()}
    rows = [(i, t or "") for i, t, *_ in ROWS]
    assert merkle.fingerprints(edge).count() == len(rows)
    ordered = sorted([r for r in rows if r[0] is not None])
    following = {ordered[i]: ordered[(i + 1) % len(ordered)][1] for i in range(len(ordered)) if ordered[i][0] != 8}
    for (doc_id, text), after in following.items():
        r = got[doc_id, len(text)]
        cut = len(text) // 4
        edited = text[:len(text) - cut] + after[:cut]
        fp, leaves = tree_by_hand(text)
        efp, edited_leaves = tree_by_hand(edited)
        assert (r["fingerprint"], r["edited_fingerprint"]) == (fp, efp)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["near_edited"] == pytest.approx(2 * len(leaves & edited_leaves) / (len(leaves) + len(edited_leaves)))
    assert got[3, len(ROWS[0][1])]["fingerprint"] == got[5, len(ROWS[0][1])]["fingerprint"]


def test_fingerprints_of_one_document_and_of_none(spark, empty):
    one = spark.createDataFrame([(4, "a b c d")], "doc_id long, text string")
    assert merkle.fingerprints(one).first()["edited_sha256"] == hashlib.sha256(b"a b c a").hexdigest()
    assert merkle.fingerprints(empty).count() == 0


def test_next_text_across_many_blocks(spark):
    rows = [(i * 7, f"text {i}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["next_text"] for r in merkle.with_next_text(docs, block_bytes=64).collect()}
    assert got == {i * 7: f"text {(i + 1) % 200}" for i in range(200)}


def test_differing_branches_name_the_edited_paragraph(spark):
    texts = [("a b\nc d\n\ne f\ng h", "a b\nc d\n\ne f\ng X"), ("a", "a"), ("a\nb", "a")]
    df = spark.createDataFrame(texts, "x string, y string")
    df = merkle.with_fingerprint(merkle.with_fingerprint(df, F.col("x"), "fx"), F.col("y"), "fy")
    found = [[tuple(b) for b in r["d"]] for r in df.select(merkle.differing_branches(F.col("fx"), F.col("fy")).alias("d")).collect()]
    assert found == [[(1, 1)], [], [(0, 1)]]


def test_fingerprint_plan_has_no_python(spark):
    plan = merkle.op3_merkle_fingerprints(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.fixture(scope="module")
def encoder():
    return piece_tokens.Encoder(piece_tokens.Vocabulary.read(public_tokenizers.path("piece_bpe_32k.model")))


def viterbi_by_hand(text, vocabulary, unknown):
    """Best (score, ids) of a text by trying every piece at every place; of equal scores the longer last piece."""
    table = {p: (s, i) for i, (p, s, n) in enumerate(zip(vocabulary.pieces, vocabulary.scores, vocabulary.normal, strict=True)) if n}
    text = "▁" + text.replace(" ", "▁")
    best = [(0.0, [])]
    for end in range(1, len(text) + 1):
        options = []
        for start in range(max(0, end - 16), end):
            part = text[start:end]
            if part in table:
                options.append((best[start][0] + table[part][0], best[start][1] + [table[part][1]]))
            elif end - start == 1:
                options.append((best[start][0] + unknown, best[start][1] + [vocabulary.bytes_at[b] for b in part.encode()]))
        top = max(s for s, _ in options)
        best.append(next(o for o in options if o[0] == top))
    return best[-1]


def test_pieces_equal_a_plain_viterbi(encoder):
    v = piece_tokens.Vocabulary.read(public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(3)
    texts = ["Hello  world", " x\n y ", "日本😀 ☃", "   many    spaces", "naïve\tœuvre", "the theand inthe"]
    texts += ["".join(rng.choice("etaoinshr  \n.,éß😀") for _ in range(rng.randint(1, 60))) for _ in range(60)]
    for text in texts:
        ids, score = encoder.encode(text)
        want, want_ids = viterbi_by_hand(text, v, encoder.unknown)
        assert np.frombuffer(ids, "<i4").tolist() == want_ids
        assert score == want


def test_pieces_round_trip_on_awkward_rows(edge, empty):
    model = public_tokenizers.path("piece_bpe_32k.model")
    encoded = piece_tokens.encode(edge, model, check=True)
    assert encoded.count() == len(ROWS) and encoded.filter("not round_trip").count() == 0
    back = Counter((r["doc_id"], r["text"]) for r in piece_tokens.decode(encoded, model).collect())
    assert back == Counter((i, (t or "").replace("▁", " ")) for i, t, *_ in ROWS)
    assert piece_tokens.encode(empty, model).count() == 0


def test_pieces_of_a_vocabulary_that_crosses_words():
    v = piece_tokens.Vocabulary(["▁", "a", "a▁b", "b", *[f"<0x{i:02X}>" for i in range(256)]], [-1.0, -1.0, -1.0, -1.0] + [0.0] * 256,
                                [True] * 4 + [False] * 256, list(range(4, 260)))
    assert np.frombuffer(piece_tokens.Encoder(v).encode("a b")[0], "<i4").tolist() == [0, 2]


def check_packing(rows, capacity=2048):
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing_on_awkward_rows(edge, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    rows = packing.best_fit_packing(edge, path).collect()
    check_packing(rows)
    want = Counter()
    for doc_id, text, *_ in ROWS:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for piece, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at:at + 2048]
            want[doc_id, piece, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    assert packing.best_fit_packing(empty, path).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_bins_keep_every_capacity(rule):
    rng = random.Random(2)
    lengths = Counter(rng.randint(1, 77) for _ in range(900))
    segments, bins = packing.plan_bins(dict(lengths), 100, 4, 6_000, rule=rule)
    load, placed = {}, Counter()
    for length in lengths:
        own = sorted((s for s in segments if s.length == length), key=lambda s: s.rank)
        for rank in range(lengths[length]):
            s = [s for s in own if s.rank <= rank][-1]
            number = s.bin + (rank - s.rank) // s.each
            load.setdefault(number, []).append((s.offset + (rank - s.rank) % s.each * length, length))
            placed[length] += 1
    assert placed == lengths and len(load) == bins
    for own in load.values():
        assert len(own) <= 4 and sum(x for _, x in own) <= 100 and sum(x * x for _, x in own) <= 6_000
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length


def test_a_piece_beyond_a_capacity_is_refused():
    with pytest.raises(ValueError):
        packing.plan_bins({11: 1}, 10, 5, 1_000)


def test_packing_is_near_the_least_number_of_sequences(spark):
    rows = packing.op8_best_fit_packing(spark, SF).collect()
    assert check_packing(rows) <= -(-sum(r["length"] for r in rows) // 2048) + 1


def test_license_scan_on_awkward_rows(spark, edge, empty):
    texts = [
        "Licensed under the Apache License, Version 2.0.", "x MIT License mit-license y", "Licenced under the Apache Licence Version 2.1",
        "gnu general public license gnu general public license", "nothing", None, "", "CC BY-NC 4.0", "cc byx mit licenses",
        "word " * 30_000 + "released under the MIT license",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in license_scan.license_scan(docs).collect()}
    base = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for i, text in enumerate(texts):
        own = base.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
        places = [(at, label) for phrase, label in license_scan.PHRASES.items() for at in range(len(own)) if own[at:at + len(phrase.split())] == phrase.split()]
        r = got[i]
        assert (r["n_words"], r["n_base"]) == (len(own), len(places))
        assert (r["first_word"], r["last_word"]) == (min((a for a, _ in places), default=None), max((a for a, _ in places), default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places}))
    assert got[2]["labels"] == "apache" and got[2]["n_base"] == 0 and 0 < got[2]["score"] < 1 and got[2]["spans"][0]["edits"] == 3
    assert [got[i]["labels"] for i in (4, 5, 6, 8)] == ["", "", "", ""] and got[7]["labels"] == "cc-by"
    assert got[9]["first_word"] == 30_003 and got[9]["spans"][0]["first_word"] == 30_000
    assert license_scan.license_scan(edge).count() == len(ROWS) and license_scan.license_scan(empty).count() == 0


def test_seeds_lose_no_notice_within_its_edits():
    notice, label, edits = license_scan.NOTICES[0]
    automaton, patterns = license_scan.seeds_of(license_scan.NOTICES), license_scan.matchers(license_scan.NOTICES)
    rng = random.Random(9)
    for _ in range(200):
        chars = list(notice)
        for _ in range(rng.randint(0, edits)):
            at = rng.randrange(1, len(chars) - 1)
            kind = rng.choice("ids")
            if kind == "i":
                chars.insert(at, rng.choice("abcz"))
            elif kind == "d":
                del chars[at]
            else:
                chars[at] = rng.choice("abcz")
        text = f"some words before {''.join(chars)} and after"
        assert any(license_scan.NOTICES[i][1] == label for i, *_ in license_scan.fuzzy_spans(text, license_scan.NOTICES, automaton, patterns))


def test_license_scan_finds_lists_of_notices():
    automaton, patterns = license_scan.seeds_of(license_scan.NOTICES), license_scan.matchers(license_scan.NOTICES)

    def spans(text, i=1):
        return [(e, text[a:b].strip()) for n, e, a, b in license_scan.fuzzy_spans(text, license_scan.NOTICES, automaton, patterns) if n == i]
    exact, one, two = "released under the mit license", "released under the mit licens", "releesed under the mit licens"
    assert spans(f"{one} x {exact} tail") == [(1, one), (0, exact)]
    assert spans(f"{two} {one} {exact} {two} {one}") == [(2, two), (1, one), (0, exact), (2, two), (1, one)]
    assert spans(f"x {one} {exact}y {exact}") == [(1, one), (1, exact + "y"), (0, exact)]
    rng = random.Random(3)
    for _ in range(50):
        own = [rng.choice([exact, one, two]) for _ in range(rng.randint(1, 6))]
        assert [x for _, x in spans(" ".join(y for x in own for y in [x, "and"] * rng.randint(1, 1)))] == own


@pytest.mark.parametrize("name", ["op1_substring_dedup", "op3_merkle_fingerprints", "op7_jaccard_join"])
def test_queries_equal_their_sql(spark, name):
    from pageloom.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.sql(ORACLES[name])
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    rounded = lambda rows: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows)
    assert rounded(map(tuple, got.select(*columns).collect())) == rounded(want.select(*columns).fetchall())

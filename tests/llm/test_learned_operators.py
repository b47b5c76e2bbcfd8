"""Operators 2, 4, 6, 7 and 10 and the pipeline, against plain Python and held-out labels."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from llm_cases import OTHER, PLAIN, ROWS, SF, row
from pyspark.sql import functions as F

from pageloom.llm import components, jaccard_join, language_id, quality_trees, resampling, toxicity
from pageloom.llm.common import table

SMALL = SF.replace("sf0.001", "sf0.01")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def counts_by_hand(text):
    own = words(text)
    grams = [tuple(own[i:i + 3]) for i in range(len(own) - 2)]
    often = Counter(grams)
    covered = {j for i, g in enumerate(grams) if often[g] > 1 for j in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return (len(own), sum(map(len, own)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


def test_text_counts(spark, edge, labels):
    texts = ["a b c a b c", "x\nx\n x\n\n\nx", "é # $ <b>", None, "", "a b\na b\na b", " ".join(["one two three four"] * 30), "\r\n\r\n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: tuple(r[c] for c in quality_trees.COUNTS) for r in quality_trees.quality_rules(docs, labels).collect()}
    assert got == {i: counts_by_hand(t) for i, t in enumerate(texts)}
    rows = quality_trees.quality_rules(edge, labels, min_docs=1, n_trees=3).collect()
    assert Counter((r["doc_id"], *(r[c] for c in quality_trees.COUNTS)) for r in rows) == Counter((i, *counts_by_hand(t)) for i, t, *_ in ROWS)
    assert all(r["base_failed"] == (r["n_words"] < 50 or 2 * r["n_repeat_words"] > r["n_words"]) and not (r["base_failed"] and r["kept"]) for r in rows)


def test_quality_without_labels_or_rows(edge, empty, no_labels):
    rows = quality_trees.quality_rules(edge, no_labels).collect()
    assert all(r["kept"] != r["base_failed"] for r in rows)
    assert quality_trees.quality_rules(empty, no_labels).count() == 0


def test_trees_are_monotonic_and_flat_scoring_equals_walking():
    rng = np.random.default_rng(4)
    x = rng.random((1_500, 4))
    y = (x[:, 0] + np.sin(9 * x[:, 1]) - 0.8 * x[:, 2] + rng.normal(0, 0.3, 1_500) > 0.2).astype(float)
    trees = quality_trees.grow(x, y, np.array([1, 0, -1, 0]), n_trees=25, min_docs=5)
    assert ((trees.score(x) > 0.5) == y).mean() > 0.85
    for feature, sign in ((0, 1), (2, -1)):
        line = np.repeat(rng.random((40, 1, 4)), 50, axis=1)
        line[:, :, feature] = np.linspace(-0.1, 1.1, 50)
        scores = trees.score(line.reshape(-1, 4)).reshape(40, 50)
        assert (sign * np.diff(scores, axis=1) >= -1e-12).all()

    def walk(v):
        total = trees.base
        for at in trees.root.tolist():
            while trees.left[at] != at:
                at = trees.left[at] if v[trees.feature[at]] <= trees.threshold[at] else trees.right[at]
            total += trees.value[at]
        return 1 / (1 + np.exp(-total))
    assert np.allclose([walk(v) for v in x[:100]], trees.score(x[:100]))


def test_quality_on_held_out_labels(spark):
    docs, marks = (table(spark, SF.replace("sf0.001", "sf0.1"), name) for name in ("documents", "labels"))
    rows = quality_trees.quality_rules(docs, marks.filter("doc_id % 2 = 0")).join(marks.filter("doc_id % 2 = 1"), "doc_id").collect()
    assert np.mean([(r["score"] >= 0.5) == (r["quality"] == 1) for r in rows]) > 0.95


def test_resampling_ratios_and_top_k(spark, edge, empty, labels, no_labels):
    docs = spark.createDataFrame([(1, "good words here"), (2, "good words too"), (3, "### $$$ ###"), (4, None), (5, "")], "doc_id long, text string")
    ratios = resampling.log_ratios(docs, [1, 2], 1 << 10)
    raw, target = np.ones(1 << 10), np.ones(1 << 10)
    import pyarrow as pa
    for doc_id, text in ((1, "good words here"), (2, "good words too"), (3, "### $$$ ###")):
        bucket, _, _ = resampling.bucket_runs(pa.array([text]), 1 << 10)
        np.add.at(raw, bucket, 1)
        if doc_id < 3:
            np.add.at(target, bucket, 1)
    assert np.allclose(ratios, np.log(target / target.sum()) - np.log(raw / raw.sum()))

    rows = resampling.importance_resampling(edge, labels, keep_share=0.5).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, *_ in ROWS)
    kept = [r["gumbel_key"] for r in rows if r["kept"]]
    assert len(kept) == -(-len(ROWS) // 2) and min(kept) >= max(r["gumbel_key"] for r in rows if not r["kept"])
    assert all(r["log_weight"] == 0 for r in resampling.importance_resampling(edge, no_labels).collect())
    assert resampling.importance_resampling(empty, labels).count() == 0


def test_resampling_counts_every_target_text(spark):
    docs = spark.range(21_000).selectExpr("id as doc_id", "concat('word', id, ' tail', id) as text")
    every = docs.selectExpr("doc_id", "1 as quality")
    assert {r["log_weight"] for r in resampling.importance_resampling(docs, every).collect()} == {0.0}  # target text is raw text


def test_resampling_never_marks_rows_without_id(spark):
    docs = spark.createDataFrame([(1, "good words"), (None, "good words"), (None, None), (1, "more"), (2, "bad")], "doc_id long, text string")
    hashes = [r["h"] for r in docs.selectExpr("xxhash64(text) as h").collect()]
    targets = spark.createDataFrame([(i,) for i in {1, *hashes}], "doc_id long")
    assert Counter(map(tuple, resampling.marked(docs, targets).collect())) == Counter(
        [(True, "good words"), (False, "good words"), (False, None), (True, "more"), (False, "bad")])


def test_kth_greatest_over_any_numbers(spark):
    rng = random.Random(1)
    values = [rng.randint(-(2**63), 2**63 - 1) for _ in range(300)] + [0, 0, -1, 5, 5, 5, 2**63 - 1, -(2**63)]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "place long, id long")
    for k in (1, 2, 150, len(values)):
        assert resampling.kth_greatest(df, "place", k) == sorted(values, reverse=True)[k - 1]
    ties = spark.createDataFrame([(7, i) for i in range(20)] + [(9, 50)], "place long, id long")
    assert {r["id"] for r in resampling.top_k(ties, "place", 4, ["id"]).filter("kept").collect()} == {50, 0, 1, 2}


def test_resampling_prefers_the_target(spark):
    rows = resampling.op4_importance_resampling(spark, SMALL).join(table(spark, SMALL, "labels"), "doc_id").collect()
    assert np.mean([r["kept"] for r in rows if r["quality"] == 1]) > 0.98
    assert np.mean([r["kept"] for r in rows if r["quality"] == 0]) < 0.6


def test_toxicity_on_held_out_labels(spark):
    found = toxicity.op6_toxicity(spark, SMALL)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = found.join(table(spark, SMALL, "labels"), "doc_id").filter("held_out").collect()
    assert np.mean([r["predicted"] == r["toxic"] for r in rows]) > 0.9
    assert np.mean([r["predicted"] for r in rows if r["toxic"] == 0]) < 0.03
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)


def test_toxicity_never_sees_held_out_labels(spark):
    docs, marks = table(spark, SF, "documents"), table(spark, SF, "labels")
    turned = marks.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = (sorted(map(tuple, toxicity.toxicity(docs, m).collect())) for m in (marks, turned))
    assert one == two


def test_toxicity_on_awkward_rows(edge, empty, labels, no_labels):
    rows = toxicity.toxicity(edge, labels).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, *_ in ROWS) and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["score"] for r in toxicity.toxicity(edge, no_labels).collect()} == {0.0}
    assert toxicity.toxicity(empty, labels).count() == 0
    assert toxicity.without_toxic(edge, no_labels).columns == edge.columns


def test_toxic_dictionary_shortens_only_marked_windows():
    toxic, ordinary = map(toxicity.compressor, (b" dreadfulword \n the of and to in that is was ", b"\n the of and to in that is was "))
    assert toxicity.window_gains("the of dreadfulword and to in that is", toxic, ordinary)[0] >= 2
    assert toxicity.window_gains("the of and to in that is was", toxic, ordinary) == [0]
    assert toxicity.window_gains(None, toxic, ordinary) == []


def shingles(text, k):
    own = [w.translate({c: c + 32 for c in range(65, 91)}) for w in words(text)]
    return {tuple(own[i:i + k]) for i in range(max(1, len(own) - k + 1))} if own else set()


def components_by_hand(rows, k, percent):
    sets = [(i, shingles(t, k)) for i, t in rows]
    up = {i: i for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return Counter((i, len(s), root(i)) for i, s in sets)


def near_copies(seed, groups=12, size=14):
    rng = random.Random(seed)
    rows, at = [], 0
    for _ in range(groups):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.choice([1, 2, 4, 20, 60, 200]))]
        for _ in range(rng.randint(1, size)):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
                own[rng.randrange(len(own))] = f"e{rng.randint(0, 10_000)}"
            rows.append((at * 11 % 1_009, " ".join(own) if rng.random() < 0.9 else " ".join(own).upper()))
            at += 1
    return rows


@pytest.mark.parametrize(("k", "percent", "chunk"), [(3, 90, 1_024), (3, 90, 4), (5, 80, 5)])
def test_jaccard_components_equal_all_pairs(spark, k, percent, chunk):
    rows = near_copies(percent + chunk)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = jaccard_join.jaccard_components(docs, shingle=k, percent=percent, chunk=chunk)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert Counter(map(tuple, got.collect())) == components_by_hand(rows, k, percent)


def test_jaccard_join_on_awkward_rows(spark, edge, empty):
    got = Counter(map(tuple, jaccard_join.jaccard_components(edge).collect()))
    rows = [(i, t) for i, t, *_ in ROWS if i is not None]
    want = components_by_hand(list(dict.fromkeys(rows)), 3, 90)
    want[8, 1, 8] += 1  # a repeated row
    want[None, 68, None] += 1
    assert got == want
    assert jaccard_join.jaccard_components(empty).count() == 0
    several = spark.createDataFrame([(1, PLAIN), (2, PLAIN), (2, OTHER), (3, OTHER), (4, "x y z")], "doc_id long, text string")
    assert {(r["doc_id"], r["component_id"]) for r in jaccard_join.jaccard_components(several).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4)}


def test_trees_join_what_all_pairs_do():
    rng = np.random.default_rng(8)
    for percent in (80, 90):
        sets = []
        for _ in range(60):
            base = rng.integers(0, 1 << 62, rng.choice([5, 30, 90, 170])).astype(np.uint64)
            for _ in range(rng.integers(1, 6)):
                own = base.copy()
                own[:rng.integers(0, max(1, len(own) // 8))] = rng.integers(0, 1 << 62)
                sets.append(np.unique(own))
        sizes = np.array([len(s) for s in sets])
        maps = [jaccard_join.bitmap(s, w) for s, w in zip(sets, jaccard_join.bitmap_width(sizes).tolist(), strict=True)]
        forest = jaccard_join.Forest()
        trees = jaccard_join.by_width(np.arange(len(sets)), sizes, maps, sets, np.arange(len(sets)))
        for w, tree in trees.items():
            jaccard_join.traverse(tree, tree, True, percent, forest)
            if w // 2 in trees:
                jaccard_join.traverse(tree.halved(), trees[w // 2], False, percent, forest)
        want = jaccard_join.Forest()
        for i, a in enumerate(sets):
            for j in range(i):
                both = len(np.intersect1d(a, sets[j]))
                if 100 * both >= percent * (len(a) + len(sets[j]) - both):
                    want.join(i, j)
        assert [forest.root(i) for i in range(len(sets))] == [want.root(i) for i in range(len(sets))]


def test_connected_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 150)] + [(300, 200), (300, 201), (7, 7)]
    found = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    want = {i: 0 for i in range(1, 61)} | {i: 100 for i in range(101, 150)} | {201: 200, 300: 200}
    assert found == want


def test_language_id_on_held_out_documents(spark):
    found = language_id.op10_language_id(spark, SMALL)
    rows = found.join(table(spark, SMALL, "documents").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in rows]) > 0.98 and all(0 <= r["score"] <= 1 for r in rows)


def test_language_id_on_awkward_rows(edge, empty):
    rows = language_id.language_id(edge).collect()
    found = {(r["doc_id"], r["lang_pred"]) for r in rows}
    assert {(2, "und"), (4, "und"), (6, "und"), (11, "und")} <= found and (9, "und") not in found
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, *_ in ROWS)
    assert language_id.language_id(empty).count() == 0
    assert {r["lang_pred"] for r in language_id.language_id(edge.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_languages_of_rare_letters_are_told_apart(spark):
    rng = random.Random(2)
    letters = {"many": "".join(map(chr, [*range(0x61, 0x7B), *range(0x3B1, 0x3C9), *range(0x430, 0x450)])), "hi": "कखगघचछजझटठ", "bn": "কখগঘচছজঝটঠ"}

    def text(lang, n):
        return " ".join("".join(rng.choice(letters[lang]) for _ in range(4)) for _ in range(n))
    rows = [(i, text(lang, 200 if lang == "many" else 30), lang) for i in range(120) for lang in [rng.choice(["many", "hi", "bn"])]]
    found = language_id.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    said = {i: lang for i, _, lang in rows}
    assert all(r["lang_pred"] == said[r["doc_id"]] for r in found) and sum(r["held_out"] for r in found) > 10


def test_grams_of_many_texts_over_all_letters():
    letters = language_id.letter_table("ab", apart=True)
    texts = ["", "ab ক", "कख", "x" * 3] * 100
    doc, code, count, some = language_id.gram_counts(texts, letters)
    for i in (0, 1, 2, 3, 127, 128, 129, 399):
        _, alone, n, _ = language_id.gram_counts([texts[i]], letters)
        assert code[doc == i].tolist() == alone.tolist() and count[doc == i].tolist() == n.tolist()
    assert some.tolist() == [bool(t) for t in texts]
    assert len({x for i in (1, 2, 3) for x in code[doc == i].tolist()}) == sum(len(set(code[doc == i].tolist())) for i in (1, 2, 3))


def test_out_of_place_distance_by_hand():
    letters, top = language_id.letter_table("abcdefghijklmnopqrstuvwxyz"), 25
    texts = ["the cat sat on the mat", "", "xx yy 12"]
    code = {c: i for i, c in enumerate(" abcdefghijklmnopqrstuvwxyz")}

    def ranks(text):
        text = "".join(c if c.isalpha() else " " for c in text.lower())
        grams = Counter()
        for i, b in enumerate(text):
            a, c = (text[i - 1] if i else " "), (text[i + 1] if i + 1 < len(text) else " ")
            if b != " ":
                grams[code[b]] += 1
                grams[64 + 4096 + (code[a] << 12) + (code[b] << 6) + code[c]] += 1
            if a != " " or b != " ":
                grams[64 + (code[a] << 6) + code[b]] += 1
        if text and text[-1] != " ":
            grams[64 + (code[text[-1]] << 6)] += 1
        return {g: i for i, (g, _) in enumerate(sorted(grams.items(), key=lambda x: (-x[1], x[0]))[:top])}
    profile = np.full((1, language_id.CODES), top, np.int64)
    own = ranks("that hat on the cat and the mat sat there")
    for g, i in own.items():
        profile[0, g] = i
    far, some = language_id.distances(texts, letters, profile, top)
    assert far[:, 0].tolist() == [sum(abs(own[g] - i) if g in own else top for g, i in ranks(t).items()) for t in texts]
    assert some.tolist() == [True, False, True]


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    base = [row(i, t, lang) for i, t, lang in [
        (1, OTHER, "en"), (2, OTHER, "en"), (3, OTHER + " and some more words here", "en"), (4, None, "en"), (5, "12 34", "fr"), (6, PLAIN, None),
        (7, "fresh start " + " ".join(OTHER.split()[10:40]) + " fresh end", "en"), (8, " ".join(OTHER.split()[5:30]), "en")]]
    from llm_cases import SCHEMA
    docs = spark.createDataFrame(base, SCHEMA)
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "language ID", "n-gram Jaccard join", "substring dedup", "best-fit packing"]
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == corpus_pipeline.COLUMNS
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        kept.append({r["doc_id"] for r in docs.collect()})
    assert kept == [{1, 2, 3, 4, 5, 6, 7, 8}, {1, 2, 3, 6, 7, 8}, {1, 6, 7, 8}, {1, 6, 7}]
    left = {r["doc_id"]: (r["text"], r["n_chars"]) for r in docs.collect()}
    assert left[7] == ("fresh start fresh end", 21) and left[6][0] == PLAIN
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert {r["doc_id"] for r in packed.collect()} == {1, 6, 7}


def test_pipeline_on_the_smallest_tables(spark):
    import corpus_pipeline

    first, second = (sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, SF).collect()) for _ in range(2))
    assert first == second and first
    assert corpus_pipeline.ORACLE_SQL is None


def test_pipeline_stages_on_awkward_tables(spark, edge, empty, labels, no_labels, tmp_path):
    """Empty tables, repeated rows, missing ids, nulls in every column: no stage fails, repeats are judged once."""
    import corpus_pipeline

    labels.write.parquet(str(tmp_path / "some" / "labels.parquet"))
    no_labels.write.parquet(str(tmp_path / "none" / "labels.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path / "none")).count() == 0
        stage(spark, edge, str(tmp_path / "some")).collect()
    rows = [(1, PLAIN), (1, PLAIN), (2, PLAIN), (None, PLAIN), (None, PLAIN), (3, None), (3, None), (4, OTHER), (4, "another text")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.near_copies_gone(spark, docs, str(tmp_path))
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=repr) == sorted(
        [(1, PLAIN), (None, PLAIN), (3, None), (4, OTHER), (4, "another text")], key=repr)

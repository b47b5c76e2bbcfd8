"""Operator 3, document fingerprints [native]: a Merkle tree over sections, paragraphs and runs of words.

A text is cut into sections (at empty lines), those into paragraphs (lines), and those into runs of eight words, which
are the leaves. Each node's digest is the SHA-256 of its children's, so equal roots mean equal texts, and a walk down
the unequal digests of two trees ends at the edits. All of it is column expressions: the only exchange deals documents
out in blocks of neighbouring ids, where a window finds each document's successor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import block_bounds, block_of, shuffle_partitions, table, text_volume

RUN_WORDS = 8
SHOWN = 12  # hex digits of a digest that a fingerprint shows below the root
BLOCK_BYTES = 12 << 20
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"
RUNS = rf"{SPACE}*(?:{WORD}+{SPACE}*){{1,{RUN_WORDS}}}"


def leaf_digests(text: Column) -> Column:
    """Digests of the runs of each paragraph of each section: array<array<array<string>>>."""
    def runs(paragraph: Column) -> Column:
        return F.when(paragraph.rlike(WORD), F.regexp_extract_all(paragraph, F.lit(RUNS), F.lit(0))).otherwise(F.array(paragraph))

    return F.transform(F.split(text, "\n\n", -1), lambda section: F.transform(
        F.split(section, "\n", -1), lambda paragraph: F.transform(runs(paragraph), lambda run: F.sha2(run, 256))))


def parent(kind: str, children: Column) -> Column:
    return F.sha2(F.concat(F.lit(kind), F.array_join(children, "")), 256)


def short(kind: str, digest: Column) -> Column:
    return F.concat(F.lit(kind), F.substring(digest, 1, SHOWN))


def with_fingerprint(df: DataFrame, text: Column, name: str) -> DataFrame:
    """Adds `name`, "R" and the root's 64 digits, then in reading order S, P and L with the first digits of each section,
    paragraph and run; and `name`_leaves, the distinct leaf digests. A step per level, so no level is computed twice."""
    a, b, c = f"{name}__0", f"{name}__1", f"{name}__2"
    df = df.withColumn(a, leaf_digests(text))
    df = df.withColumn(b, F.transform(a, lambda s: F.transform(s, lambda p: parent("P", p))))
    df = df.withColumn(c, F.transform(b, lambda s: parent("S", s)))
    bodies = F.zip_with(a, b, lambda runs, digests: F.array_join(F.zip_with(
        runs, digests, lambda own, d: F.concat(short("P", d), F.array_join(F.transform(own, lambda x: short("L", x)), ""))), ""))
    sections = F.zip_with(c, bodies, lambda d, body: F.concat(short("S", d), body))
    return df.withColumns({
        name: F.concat(F.lit("R"), parent("R", F.col(c)), F.array_join(sections, "")),
        f"{name}_leaves": F.array_distinct(F.flatten(F.flatten(a))),
    }).drop(a, b, c)


def likeness(leaves: Column, others: Column) -> Column:
    """Twice the shared distinct leaves by the sum of both sides' (0 to 1)."""
    return 2 * F.size(F.array_intersect(leaves, others)) / (F.size(leaves) + F.size(others))


def differing_branches(one: Column, other: Column) -> Column:
    """Where two fingerprints differ, as array<struct<section, paragraph>> numbered from 0: only unequal sections are
    gone into, and of those only paragraphs with unequal digests are named. Missing branches differ."""
    def sections(fp: Column) -> Column:
        return F.regexp_extract_all(fp, F.lit("S[^S]*"), F.lit(0))

    def paragraphs(section: Column) -> Column:
        return F.regexp_extract_all(F.coalesce(section, F.lit("")), F.lit(rf"P([0-9a-f]{{{SHOWN}}})"), F.lit(1))

    def unequal(a: Column, b: Column, at: Column) -> Column:
        pairs = F.arrays_zip(paragraphs(a).alias("a"), paragraphs(b).alias("b"))
        marked = F.transform(pairs, lambda x, i: F.when(~x["a"].eqNullSafe(x["b"]), F.struct(at.alias("section"), i.alias("paragraph"))))
        return F.filter(marked, lambda x: x.isNotNull())

    both = F.arrays_zip(sections(one).alias("a"), sections(other).alias("b"))
    return F.flatten(F.transform(both, lambda x, i: F.when(
        F.substring(x["a"], 1, SHOWN + 1).eqNullSafe(F.substring(x["b"], 1, SHOWN + 1)), F.array().cast("array<struct<section:int,paragraph:int>>"),
    ).otherwise(unequal(x["a"], x["b"], i).cast("array<struct<section:int,paragraph:int>>"))))


def with_next_text(docs: DataFrame, *, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, text and next_text: the text of the next doc_id, after the last of the first.

    One exchange in blocks of neighbouring ids. The first document of each block also visits the block before it, so
    a block's last row finds its successor there. Rows that share a doc_id follow each other by text. A row without
    doc_id has no place in the order and is its own successor."""
    n_rows, volume = text_volume(docs, "text")
    blocks = max(shuffle_partitions(docs.sparkSession), -(-volume // block_bytes))
    bounds = block_bounds(docs, "doc_id", min(blocks, max(1, n_rows)))
    own = docs.select(
        block_of("doc_id", "text", bounds).cast("int").alias("block"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    firsts = own.filter("doc_id is not null").groupBy("block").agg(F.min("doc_id").alias("first")).orderBy("block").collect()
    before = {r["first"]: firsts[i - 1]["block"] for i, r in enumerate(firsts)}  # one entry per block
    visits = F.array(F.struct(F.col("block"), F.lit(False).alias("guest")))
    if before:
        homes = F.create_map(*[F.lit(x) for first, block in before.items() for x in (F.lit(first).cast("long"), block)])
        visits = F.when(F.col("doc_id").isin(list(before)), F.array(
            F.struct(F.col("block"), F.lit(False).alias("guest")), F.struct(F.element_at(homes, F.col("doc_id")).alias("block"), F.lit(True).alias("guest")),
        )).otherwise(visits)
    dealt = own.select(F.inline(visits), "doc_id", "text").repartition(blocks, "block")
    order = Window.partitionBy("block").orderBy("guest", F.col("doc_id").asc_nulls_last(), "text")
    following = F.when(F.col("doc_id").isNull(), F.col("text")).otherwise(F.lead("text").over(order))
    return dealt.withColumn("next_text", following).filter("not guest").select("doc_id", "text", "next_text")


def fingerprints(docs: DataFrame, *, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Fingerprints of every document and of its edited text.

    The edited text is the text with its last floor(n_chars / 4) code points replaced by the first as many (or all) of
    the next document's. Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and
    near_next (`likeness` to the edited text's and to the next document's fingerprint), and differing, the paragraphs in which
    both trees differ (`differing_branches`). A very long text is one row, whole in one task.

    Null texts are read as empty: one leaf, the empty run. A table of one document is its own successor; an empty table
    gives an empty result. Other columns are ignored. See `with_next_text` for repeated and missing ids."""
    pairs = with_next_text(docs, block_bytes=block_bytes).withColumn("n_chars", F.length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), F.col("n_chars").cast("int") - cut), F.col("next_text").substr(F.lit(1), cut))
    df = pairs.withColumn("edited", edited)
    df = with_fingerprint(df, F.col("text"), "fingerprint")
    df = with_fingerprint(df, F.col("edited"), "edited_fingerprint")
    df = df.withColumn("next_leaves", F.array_distinct(F.flatten(F.flatten(leaf_digests(F.col("next_text"))))))
    return df.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint_leaves"), F.col("edited_fingerprint_leaves")).alias("near_edited"),
        likeness(F.col("fingerprint_leaves"), F.col("next_leaves")).alias("near_next"),
        differing_branches(F.col("fingerprint"), F.col("edited_fingerprint")).alias("differing"),
    )


def op3_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    branches = F.array_join(F.transform("differing", lambda b: F.concat_ws(".", b["section"], b["paragraph"])), ",")
    return fingerprints(table(spark, sf_dir, "documents")).withColumn("differing", branches)


def _sql_tree(text: str) -> str:
    runs = rf"case when regexp_matches(p, '{WORD}') then regexp_extract_all(p, '{RUNS}') else [p] end"
    return rf"list_transform(string_split({text}, e'\n\n'), lambda s: list_transform(string_split(s, e'\n'), lambda p: list_transform({runs}, lambda r: sha256(r))))"


def _sql_fingerprint(tree: str) -> str:
    p = "sha256('P' || array_to_string(p, ''))"
    s = f"sha256('S' || array_to_string(list_transform(s, lambda p: {p}), ''))"
    body = f"'P' || {p}[:{SHOWN}] || array_to_string(list_transform(p, lambda r: 'L' || r[:{SHOWN}]), '')"
    return (
        f"'R' || sha256('R' || array_to_string(list_transform({tree}, lambda s: {s}), '')) || "
        f"array_to_string(list_transform({tree}, lambda s: 'S' || {s}[:{SHOWN}] || array_to_string(list_transform(s, lambda p: {body}), '')), '')"
    )


def _sql_near(a: str, b: str) -> str:
    return f"2.0 * len(list_intersect({a}, {b})) / (len({a}) + len({b}))"


def _sql_differing(a: str, b: str) -> str:
    """Section.paragraph wherever the runs differ."""
    paragraphs = f"greatest(coalesce(len({a}[i + 1]), 0), coalesce(len({b}[i + 1]), 0))"
    named = f"list_transform(range({paragraphs}), lambda j: case when {a}[i + 1][j + 1] is distinct from {b}[i + 1][j + 1] then i || '.' || j end)"
    return f"array_to_string(list_filter(flatten(list_transform(range(greatest(len({a}), len({b}))), lambda i: {named})), lambda x: x is not null), ',')"


SQL = rf"""
with texts as (
    select doc_id, coalesce(text, '') as text from documents
), pairs as (
    select *, coalesce(lead(text) over (order by doc_id), first_value(text) over (order by doc_id)) as next_text,
        length(text)::bigint as n_chars
    from texts
), edits as (
    select *, left(text, n_chars - n_chars // 4) || left(next_text, n_chars // 4) as edited from pairs
), trees as (
    select *, {_sql_tree('text')} as t, {_sql_tree('edited')} as e, {_sql_tree('next_text')} as x from edits
), leaves as (
    select *, list_distinct(flatten(flatten(t))) as tl, list_distinct(flatten(flatten(e))) as el, list_distinct(flatten(flatten(x))) as xl from trees
)
select doc_id, n_chars, sha256(edited) as edited_sha256, {_sql_fingerprint('t')} as fingerprint,
    {_sql_fingerprint('e')} as edited_fingerprint, {_sql_near('tl', 'el')} as near_edited, {_sql_near('tl', 'xl')} as near_next,
    {_sql_differing('t', 'e')} as differing
from leaves
"""

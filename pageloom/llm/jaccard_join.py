"""Operator 7, n-gram Jaccard join by signature trees.

1. One pass gives each document its shingle set's size, a 128-bit fingerprint of the set and a bitmap of about four bits
   per shingle. Documents with equal sets are one class from here on, stood for by its smallest id.
2. Under one order of all shingles (the very common last, then by hash) two sets that link share at least e + 1 shingles
   of their prefixes, e growing with the set. Prefixes are dealt out by shingle and sorted; a class stays only if enough
   of its prefix occurs in other classes too. Passages that many documents share do not keep them.
3. Classes that share a prefix shingle meet at that shingle's smallest class, their leader. A class goes to few leaders,
   as near copies share most shingles. In groups beyond `chunk` members each chunk meets the group's smallest class first,
   and only what is not connected with that meets the other chunks.
4. In each group signature trees hold OR-combined bitmaps and size ranges; a dual traversal skips node pairs whose
   greatest possible overlap is too small, and classes that are already connected. What is left may link; its connected
   components are the candidate groups.
5. The sets of candidates, once each, meet in their candidate group. The same traversal then compares exactly.
6. Connected components over the links, and back to all documents by fingerprint.

Only edges that connect something leave a task, never all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..kernels import ship_by_value
from . import words as wd
from .common import shuffle_partitions, table, written
from .components import connected_components

ship_by_value(__name__)

SHINGLE = 3
PERCENT = 90
CHUNK = 1_024
BITS_PER_TOKEN = 4
LEAF = 32
FANOUT = 8
BATCH_TOKENS = 1 << 21
COMMON_SHARE = 1_000  # a shingle in one of so many documents counts as common
MAX_SEEN = 1 << 18  # fingerprints a task remembers so as not to send a copy's prefix twice
BROADCAST_IDS = 1 << 20  # so many ids at most are broadcast
MAX_COMMON = 1 << 16  # so many of the most common ones are put last; the order changes no result


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct shingles of each text, ascending; a shorter text is one shingle, of fewer words."""
    words = wd.split_words(texts, lower=True)
    h = wd.word_hashes(words)
    at = wd.runs_of(words.doc, k)
    grams, doc = wd.run_hashes(h, at, k), words.doc[at]
    counts = words.counts()
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        ends = np.cumsum(counts)
        whole = wd.span_hashes(h, ends[short] - counts[short], ends[short], wd.BASES[1])
        grams, doc = np.concatenate([grams, whole]), np.concatenate([doc, short])
    order = np.lexsort((grams, doc))
    grams, doc = grams[order], doc[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], grams[new]


def common_batches(batches, k: int):
    """Shingles common among any few thousand documents in a row, with their document counts there."""
    held: list[np.ndarray] = []
    docs = size = 0

    def report():
        tokens = np.sort(np.concatenate(held)) if held else np.empty(0, np.uint64)
        at = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])) if len(tokens) else np.empty(0, np.int64)
        n = np.diff(at, append=len(tokens))
        often = n >= max(3, docs // COMMON_SHARE)
        return pa.record_batch({"token": pa.array(tokens[at][often].view(np.int64)), "n": pa.array(n[often], pa.int64())})

    for batch in batches:
        for a, b in wd.chunks(batch.column(0)):
            _, grams = shingle_sets(batch.column(0).slice(a, b - a), k)
            held.append(grams)
            docs, size = docs + b - a, size + len(grams)
            if size >= BATCH_TOKENS:
                yield report()
                held, docs, size = [], 0, 0
    yield report()


def extra(n, percent: int):
    """Shingles beyond the first that linked sets share in their prefixes."""
    return n * (100 - percent) // 100


def prefix_size(n: np.ndarray, percent: int) -> np.ndarray:
    """Two sets that link overlap in at least percent of either, so prefixes this long share extra + 1 shingles of the
    smaller one's."""
    return np.minimum(n, n + (-percent * n // 100) + 1 + extra(n, percent))


def bitmap_width(n: np.ndarray) -> np.ndarray:
    """Bits of a set's bitmap: a power of two, BITS_PER_TOKEN for each token or a little more."""
    return 1 << np.maximum(6, np.ceil(np.log2(np.maximum(n, 1) * BITS_PER_TOKEN)).astype(np.int64))


def bitmap(tokens: np.ndarray, width: int) -> np.ndarray:
    """One bit per token by its low bits, so that halves OR-ed together are the bitmap of half the width."""
    own = np.zeros(width, bool)
    own[(wd.mix(tokens) & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(own, bitorder="little").view(np.uint64)


def fingerprint(grams: np.ndarray, ends: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit sum over each set, by place in `ends`."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(wd.mix(grams + np.uint64(salt * 0x9E3779B97F4A7C15 % (1 << 64))))])
    return (total[ends[1:]] - total[ends[:-1]]).view(np.int64)


def digest_batches(batches, k: int):
    """Size, fingerprint and bitmap of each document's shingle set."""
    for batch in batches:
        for a, b in wd.chunks(batch.column(1)):
            doc, grams = shingle_sets(batch.column(1).slice(a, b - a), k)
            n = np.bincount(doc, minlength=b - a)
            ends = np.concatenate([[0], np.cumsum(n)])
            bits = [bitmap(grams[x:y], w).tobytes() for x, y, w in zip(ends[:-1], ends[1:], bitmap_width(n).tolist(), strict=True)]
            yield pa.record_batch({
                "doc_id": batch.column(0).slice(a, b - a), "n_shingles": pa.array(n, pa.int64()), "fp1": pa.array(fingerprint(grams, ends, 1)),
                "fp2": pa.array(fingerprint(grams, ends, 2)), "bits": pa.array(bits, pa.binary()),
            })


def prefix_batches(batches, k: int, percent: int, common: np.ndarray, rank: np.ndarray):
    """(shingle, fingerprint) for the prefix of each distinct set of a batch; copies next to each other leave once."""
    seen: set[int] = set()
    for batch in batches:
        for a, b in wd.chunks(batch.column(0)):
            doc, grams = shingle_sets(batch.column(0).slice(a, b - a), k)
            n = np.bincount(doc, minlength=b - a)
            ends = np.concatenate([[0], np.cumsum(n)])
            fp = fingerprint(grams, ends, 1)
            fresh = np.array([x not in seen and not seen.add(x) for x in fp.tolist()], bool) & (n > 0)
            if len(seen) > MAX_SEEN:
                seen.clear()
            if len(common):
                spot = np.minimum(np.searchsorted(common, grams), len(common) - 1)
                place = np.where(common[spot] == grams, rank[spot], 0)
                grams = grams[np.lexsort((grams, place, doc))]
            p = np.where(fresh, prefix_size(n, percent), 0)
            pick = np.repeat(ends[:-1], p) + np.arange(int(p.sum())) - np.repeat(np.cumsum(p) - p, p)
            yield pa.record_batch({"token": pa.array(grams[pick].view(np.int64)), "fp1": pa.array(np.repeat(fp, p))})


def shared_batches(batches):
    """From (token, fp1) in this order: for each token of several sets the sets and the first of them, their leader."""
    held: list[np.ndarray] = []

    def out(token: np.ndarray, fp: np.ndarray):
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (fp[1:] != fp[:-1])
        token, fp = token[new], fp[new]
        first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.empty(0, np.int64)
        n = np.diff(first, append=len(token))
        several = np.repeat(n > 1, n)
        return pa.record_batch({"fp1": pa.array(fp[several]), "leader": pa.array(np.repeat(fp[first], n)[several])})

    last = None
    for batch in batches:
        token, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(token):
            continue
        if last is not None and token[0] == last[0][0] and token[-1] == token[0]:
            held.append(fp)  # one token goes on over whole batches: only its distinct sets are kept
            if sum(map(len, held)) > BATCH_TOKENS:
                yield pa.record_batch({"fp1": pa.array(np.concatenate(held)), "leader": pa.array(np.full(sum(map(len, held)), last[1][0]))})
                held.clear()
            continue
        if last is not None:
            token, fp = np.concatenate([last[0], np.full(sum(map(len, held)), last[0][0], np.int64), token]), np.concatenate([last[1], *held, fp])
            held.clear()
        cut = int(np.searchsorted(token, token[-1])) if len(token) else 0  # the last token may go on in the next batch
        yield out(token[:cut], fp[:cut])
        last = (token[cut:], fp[cut:])
    if last is not None:
        yield out(np.concatenate([last[0], np.full(sum(map(len, held)), last[0][0], np.int64)]), np.concatenate([last[1], *held]))


def set_batches(batches, k: int):
    """The shingle set of each text (sorted 64-bit hashes), beside the columns after the text."""
    for batch in batches:
        for a, b in wd.chunks(batch.column(0)):
            doc, grams = shingle_sets(batch.column(0).slice(a, b - a), k)
            ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=b - a))])
            sets = pa.array([grams[x:y].tobytes() for x, y in zip(ends[:-1], ends[1:], strict=True)], pa.binary())
            yield pa.record_batch([*(c.slice(a, b - a) for c in batch.columns[1:]), sets], names=[*batch.schema.names[1:], "tokens"])


class Tree:
    """A signature tree over sets with bitmaps of one width: leaves of up to LEAF members, nodes of up to FANOUT children.

    Of each node: the OR of its bitmaps, its range of sizes, and the most tokens of a member beyond its set bits
    (`slack`). A set of the node shares at most slack + common bits with any set of another node."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, bits: np.ndarray, sets: list[np.ndarray] | None):
        order = np.lexsort((*bits.T[:2], sizes))
        self.ids, self.sizes, self.bits = ids[order], sizes[order], bits[order]
        self.sets = None if sets is None else [sets[i] for i in order]
        self.slack = self.sizes - np.bitwise_count(self.bits).sum(axis=1).astype(np.int64)
        level = {"or": self.bits, "low": self.sizes, "high": self.sizes, "slack": self.slack}
        self.levels = []
        while not self.levels or len(level["low"]) > 1:
            cuts = np.arange(0, len(level["low"]), FANOUT if self.levels else LEAF)
            level = {"or": np.bitwise_or.reduceat(level["or"], cuts), "low": level["low"][cuts],
                     "high": np.maximum.reduceat(level["high"], cuts), "slack": np.maximum.reduceat(level["slack"], cuts)}
            self.levels.append(level)

    def halved(self) -> Tree:
        """The same sets with bitmaps of half the width, to meet sets of that width."""
        words = self.bits.shape[1] // 2
        return Tree(self.ids, self.sizes, self.bits[:, :words] | self.bits[:, words:], self.sets)

    def members(self, leaf: int) -> slice:
        return slice(leaf * LEAF, min(len(self.ids), (leaf + 1) * LEAF))


def needed(a, b, percent: int):
    """Least overlap of sets of sizes a and b that link: 100 * overlap >= percent * union."""
    return -(-percent * (a + b) // (100 + percent))


def may_link(x: dict, i: int, y: dict, j: int, percent: int) -> bool:
    least = needed(x["low"][i] + y["low"][j], 0, percent)
    shared = int(np.bitwise_count(x["or"][i] & y["or"][j]).sum())
    return min(x["high"][i], y["high"][j], x["slack"][i] + shared, y["slack"][j] + shared) >= least


class Forest:
    """Union-find over ids; the root of a tree is its smallest id."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        at = x
        while (above := self.up.get(at, at)) != at:
            at = above
        while (above := self.up.get(x, x)) != at:
            self.up[x] = at
            x = above
        return at

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)


def traverse(left: Tree, right: Tree, same: bool, percent: int, forest: Forest) -> None:
    """Joins all linked members of two trees (of one with itself if same) in the forest."""
    stack = [(len(left.levels) - 1, 0, len(right.levels) - 1, 0)]
    while stack:
        la, a, lb, b = stack.pop()
        x, y = left.levels[la], right.levels[lb]
        if not may_link(x, a, y, b, percent):
            continue
        if la == lb == 0:
            join_leaves(left, right, a, b, same and a == b, percent, forest)
            continue
        down_a = range(a, a + 1) if la < lb or not la else range(a * FANOUT, min((a + 1) * FANOUT, len(left.levels[la - 1]["low"])))
        down_b = range(b, b + 1) if lb < la or not lb else range(b * FANOUT, min((b + 1) * FANOUT, len(right.levels[lb - 1]["low"])))
        na, nb = (la - (la >= lb and la > 0)), (lb - (lb >= la and lb > 0))
        stack.extend((na, i, nb, j) for i in down_a for j in down_b if not same or na != nb or i <= j)


def join_leaves(left: Tree, right: Tree, a: int, b: int, own: bool, percent: int, forest: Forest) -> None:
    """Joins the members of two leaves that may link; where the trees hold sets, those that do."""
    sa, sb = left.members(a), right.members(b)
    shared = np.bitwise_count(left.bits[sa][:, None, :] & right.bits[sb][None, :, :]).sum(axis=2).astype(np.int64)
    most = shared + np.minimum(left.slack[sa][:, None], right.slack[sb][None, :])
    most = np.minimum(most, np.minimum(left.sizes[sa][:, None], right.sizes[sb][None, :]))
    fits = most >= needed(left.sizes[sa][:, None], right.sizes[sb][None, :], percent)
    if own:
        fits &= np.tri(*fits.shape, -1, dtype=bool).T
    for i, j in np.argwhere(fits).tolist():
        i, j = i + sa.start, j + sb.start
        one, two = int(left.ids[i]), int(right.ids[j])
        if forest.root(one) == forest.root(two):
            continue
        if left.sets is not None and right.sets is not None:
            s, t = left.sets[i], right.sets[j]
            both = np.concatenate([s, t])
            both.sort()
            if np.count_nonzero(both[1:] == both[:-1]) < needed(len(s), len(t), percent):
                continue
        forest.join(one, two)


def by_width(ids: np.ndarray, sizes: np.ndarray, bitmaps: list[np.ndarray], sets: list[np.ndarray] | None, at: np.ndarray) -> dict[int, Tree]:
    """A tree of the members of each bitmap width (in bits)."""
    width = np.array([len(bitmaps[i]) for i in at], np.int64) * 64
    trees = {}
    for w in np.unique(width).tolist():
        own = at[width == w]
        trees[w] = Tree(ids[own], sizes[own], np.stack([bitmaps[i] for i in own]), None if sets is None else [sets[i] for i in own])
    return trees


def group_edges(key, rows: pa.Table, percent: int) -> pa.Table:
    """Edges (each member to the smallest it is connected with) of one group, or of one pair of its chunks."""
    _, one, two = (k.as_py() for k in key)
    chunk, ids = rows["chunk"].to_numpy(), rows["rep"].to_numpy()
    if "tokens" in rows.column_names:
        sets = [np.frombuffer(v.as_py(), np.uint64) for v in rows["tokens"]]
        sizes = np.array([len(s) for s in sets], np.int64)
        bitmaps = [bitmap(s, w) for s, w in zip(sets, bitmap_width(sizes).tolist(), strict=True)]
    else:
        sets, sizes = None, rows["n_shingles"].to_numpy()
        bitmaps = [np.frombuffer(v.as_py(), np.uint64) for v in rows["bits"]]
    forest = Forest()
    left = by_width(ids, sizes, bitmaps, sets, np.flatnonzero(chunk == one))
    right = left if one == two else by_width(ids, sizes, bitmaps, sets, np.flatnonzero(chunk == two))
    for w, tree in left.items():  # sets that link differ by less than a factor of two in size
        if w in right:
            traverse(tree, right[w], one == two, percent, forest)
        if w // 2 in right:
            traverse(tree.halved(), right[w // 2], False, percent, forest)
        if one != two and w * 2 in right:
            traverse(tree, right[w * 2].halved(), False, percent, forest)
    edges = [(x, forest.root(x)) for x in forest.up]
    return pa.table({"a": pa.array([x for x, _ in edges], pa.int64()), "b": pa.array([r for _, r in edges], pa.int64())})


def common_shingles(docs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """At most MAX_COMMON common shingles, ascending, and for each the place of its frequency."""
    rows = (
        docs.select("text").mapInArrow(lambda batches: common_batches(batches, k), "token long, n long")
        .groupBy("token").agg(F.sum("n").alias("n")).filter("n >= 16").orderBy(F.desc("n"), "token").limit(MAX_COMMON).collect()
    )
    tokens = np.array([r["token"] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], np.array([r["n"].bit_length() for r in rows], np.int64)[order]


def of_wanted(df: DataFrame, wanted: DataFrame, n_wanted: int) -> DataFrame:
    """Rows of df whose `rep` is wanted (one row per rep). Few reps are broadcast, so df stays where it is; more are joined."""
    return df.join(F.broadcast(wanted) if n_wanted <= BROADCAST_IDS else wanted.hint("shuffle_merge"), "rep", "left_semi")


def meet(rows: DataFrame, group: str, percent: int) -> DataFrame:
    """Edges from the rows (group, one, two, chunk, rep, ...) that meet."""
    return rows.groupBy(group, "one", "two").applyInArrow(lambda key, own: group_edges(key, own, percent), "a long, b long")


def group_links(members: DataFrame, payload: DataFrame, group: str, percent: int, chunk: int) -> DataFrame:
    """Edges that connect all members (group, rep) of each group that link. payload: what is compared, a row per rep.

    A group of up to `chunk` members meets in one task. Of a larger one each chunk meets by itself first, together with the
    group's root (its smallest rep), so members like the root are connected after moving once. Only members that are not
    connected with the root then meet the other chunks, in chunks of their own.
    """
    sizes = members.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("root"))
    great = written(sizes.filter(F.col("n") > chunk).withColumn("chunks", F.ceil(F.col("n") / chunk).cast("int")), "great-groups")
    zero = F.lit(0)
    if not great.head(1):
        return meet(members.select(group, "rep", zero.alias("one"), zero.alias("two"), zero.alias("chunk")).join(payload, "rep"), group, percent)
    payload = written(payload, "compared")
    few = F.broadcast if great.count() <= BROADCAST_IDS else (lambda df: df)
    known = great.select(group, "root", "chunks")
    small = members.join(few(known), group, "left_anti").select(group, "rep", zero.alias("chunk"))
    chunk_of = F.pmod(F.xxhash64("rep", zero), F.col("chunks")).cast("int")
    parts = members.join(few(known), group).select(group, "rep", "chunks", chunk_of.alias("chunk"))
    roots = known.select(group, F.col("root").alias("rep"), F.explode(F.sequence(zero, F.col("chunks") - 1)).alias("chunk"))
    alone = small.unionByName(parts.select(group, "rep", "chunk")).unionByName(roots).distinct()
    alone = alone.select(group, "rep", F.col("chunk").alias("one"), F.col("chunk").alias("two"), "chunk")
    first = written(meet(alone.join(payload, "rep"), group, percent), "group-edges")

    found = connected_components(first, "a", "b")
    homes = known.join(found, found["node"] == known["root"], "left").select(group, F.coalesce("component", "root").alias("root_in"))
    placed = parts.join(few(homes), group).join(found, found["node"] == parts["rep"], "left")
    rest = written(placed.filter(F.coalesce("component", "rep") != F.col("root_in")).select(group, "rep", "chunks"), "unconnected")
    counts = rest.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("rest_chunks"))
    mine = rest.join(few(counts), group).withColumn("chunk", -1 - F.pmod(F.xxhash64("rep", F.lit(1)), F.col("rest_chunks")).cast("int"))
    mine = mine.select(group, "rep", F.col("chunk").alias("one"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("two"), "chunk")
    others = parts.join(few(counts), group).select(
        group, "rep", F.explode(F.sequence(-F.col("rest_chunks"), F.lit(-1))).alias("one"), F.col("chunk").alias("two"), "chunk")
    second = meet(mine.unionByName(others).join(payload, "rep"), group, percent)
    return first.unionByName(second)


def candidate_groups(docs: DataFrame, digest: DataFrame, *, k: int, percent: int, chunk: int) -> DataFrame:
    """node and component of classes that may link, but for the smallest of each component."""
    shipped = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, k))
    classes = digest.filter("n_shingles > 0 and doc_id is not null").groupBy("fp1", "fp2", "n_shingles").agg(F.min("doc_id").alias("rep"))
    tokens = docs.filter("doc_id is not null").select("text").mapInArrow(
        lambda batches: prefix_batches(batches, k, percent, *shipped.value), "token long, fp1 long")
    sorted_tokens = tokens.repartition(shuffle_partitions(docs.sparkSession), "token").sortWithinPartitions("token", "fp1")
    shared = sorted_tokens.mapInArrow(shared_batches, "fp1 long, leader long")
    met = shared.groupBy("fp1").agg(F.count(F.lit(1)).alias("shared"), F.collect_set("leader").alias("leaders")).join(classes, "fp1")
    smaller = -F.floor(-F.col("n_shingles") * percent / 100)  # the least size of a set that links
    enough = F.col("shared") > F.floor(smaller * (100 - percent) / 100)
    members = written(met.filter(enough).select("rep", F.explode("leaders").alias("leader")), "leader-members")
    several = members.groupBy("leader").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("leader")
    members = members.join(several, "leader")
    members = written(members, "leader-groups")
    wanted = members.select("rep").distinct()
    bits = of_wanted(digest.select(F.col("doc_id").alias("rep"), "fp1", "n_shingles", "bits"), wanted, wanted.count())
    bits = bits.join(classes.select("rep", "fp1"), ["rep", "fp1"]).dropDuplicates(["rep", "fp1"]).drop("fp1")
    return connected_components(group_links(members, bits, "leader", percent, chunk), "a", "b")


def link_edges(docs: DataFrame, digest: DataFrame, *, k: int, percent: int, chunk: int) -> DataFrame:
    """Edges between classes that connect all that link."""
    found = candidate_groups(docs, digest, k=k, percent=percent, chunk=chunk)
    members = found.select(F.col("component").alias("home"), F.col("node").alias("rep")).unionByName(
        found.select(F.col("component").alias("home"), F.col("component").alias("rep")).distinct())
    members = written(members, "candidate-groups")  # a class is in one of them
    texts = of_wanted(docs.select(F.col("doc_id").cast("long").alias("rep"), "text"), members.select("rep"), members.count())
    sets = texts.select("text", "rep").mapInArrow(lambda batches: set_batches(batches, k), "rep long, tokens binary")
    return group_links(members, sets.filter(F.length("tokens") > 0), "home", percent, chunk)


def jaccard_components(docs: DataFrame, *, shingle: int = SHINGLE, percent: int = PERCENT, chunk: int = CHUNK) -> DataFrame:
    """Near-duplicate components of documents: sets of distinct shingles of `shingle` words (A-Z lower-cased) link when
    100 * intersection >= percent * union.

    Returns doc_id, n_shingles and component_id, the smallest doc_id that links lead to. A text of fewer words is one
    shingle. Null and empty texts have no shingles and link with nothing. Rows that share a doc_id are one document of
    several texts: links of either count for both. Rows without doc_id link with nothing and have no component. Other
    columns are ignored; an empty table gives an empty result. Sets are compared by 64-bit hashes of shingles. `percent`
    is above 50.
    """
    if not 50 < percent <= 100:
        raise ValueError("percent must be above 50 and at most 100")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    digest = written(plain.mapInArrow(
        lambda batches: digest_batches(batches, shingle), "doc_id long, n_shingles long, fp1 long, fp2 long, bits binary"), "shingle-digests")
    edges = link_edges(plain, digest, k=shingle, percent=percent, chunk=chunk)
    classes = digest.filter("n_shingles > 0 and doc_id is not null").groupBy("fp1", "fp2", "n_shingles").agg(F.min("doc_id").alias("rep"))
    keyed = digest.drop("bits").join(classes, ["fp1", "fp2", "n_shingles"], "left")
    # a document is connected with its class, also where one id has several texts
    again = digest.filter("n_shingles > 0 and doc_id is not null").groupBy("doc_id").agg(
        F.min(F.struct("fp1", "fp2", "n_shingles")).alias("one"), F.max(F.struct("fp1", "fp2", "n_shingles")).alias("two")).filter("one <> two")
    twice = keyed.join(again.select("doc_id"), "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    found = connected_components(edges.unionByName(twice), "a", "b")
    named = classes.join(found, classes["rep"] == found["node"], "left").select(
        "fp1", "fp2", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    return digest.drop("bits").join(named, ["fp1", "fp2", "n_shingles"], "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "doc_id")).alias("component_id"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


SQL = r"""
with recursive words as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
    from documents
), starts as (
    select doc_id, w, unnest(generate_series(1, greatest(len(w) - 2, 1))) as i from words where len(w) > 0
), shingles as (
    select distinct doc_id, array_to_string(w[i:i + 2], ' ') as s from starts
), sizes as (
    select doc_id, count(*) as n from shingles group by doc_id
), shared as (
    select a.doc_id as x, b.doc_id as y, count(*) as common
    from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2
), links as (
    select x, y from shared join sizes p on p.doc_id = x join sizes q on q.doc_id = y
    where 100 * common >= 90 * (p.n + q.n - common)
), edges as (
    select x, y from links union all select y, x from links
), reach as (
    select x, y from edges
    union
    select r.x, e.y from reach r join edges e on r.y = e.x
)
select w.doc_id, coalesce(any_value(n), 0)::bigint as n_shingles, least(w.doc_id, min(y)) as component_id
from words w left join sizes using (doc_id) left join reach on reach.x = w.doc_id group by w.doc_id
"""

"""Operator 13, conversation structure repair: cheapest edits by iterative-deepening A*.

A conversation is right when the initials of its roles read `(s?(ua)+)?`. Each row is kept, given another role or deleted, and
empty rows are inserted. The search goes depth first through the edits in ASCII order (D, I, K, R) under a cost bound and
raises the bound to the least cost that was cut off. A table holds, for every failed state (row, role state), the least
budget that it may still succeed with; so the first path accepted is the cheapest and, of those, the ASCII-least.

A search grows with bound times rows, so longer conversations are searched in segments of `SEGMENT` rows, for each role state
to enter with and each to leave with. Insertions belong to the row they stand before. Two cheapest paths through a segment
are then never the beginning of one another, so a path's rank among those that enter alike decides every tie, and segments
compose like matrices of (cost, rank): the result is the same as that of one search.

Rows without their texts are sorted by (conv_id, turn) in range partitions, so a conversation that holds a third of all rows
is spread over tasks. What lies within a partition is finished there; conversations cut by its ends send one matrix per
partition to a fold and get back which states to enter and leave with. Texts move once, to be read in order with the
edits; a conversation's hash runs through its rows one after the other and holds none of them.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..kernels import ship_by_value
from .common import shuffle_partitions, table, written

ship_by_value(__name__)

RANGE_ROWS = 200_000
SEGMENT = 24
MEMO = 200_000
NEVER = 1 << 60

#: A row as a number: 4 * (place of its initial in INITIALS, 3 for others) + fault.
INITIALS = "sua"
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
#: Role states: nothing yet, after s, after u, after a pair. What each initial leads to, and what an inserted row does.
START, SYSTEM, USER, PAIR = range(4)
STEP = ((SYSTEM, USER, None), (None, USER, None), (None, None, PAIR), (None, USER, None))
WANTED = (USER, USER, PAIR, USER)
ROLE = {USER: "user", PAIR: "assistant"}
#: Insertions that complete what a state leaves open.
TAIL = ("", "II", "I", "")
DELETE_COST, INSERT_COST, ROLE_COST, CUT_COST = 4, 3, 3, 3
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
COUNT_FIELDS = ", ".join(f"{c} long" for c in COUNTS)


def edits(codes: bytes, i: int, q: int, goal: int | None):
    """Edits possible at row i in role state q, in ASCII order: letter, cost, next row, next state. After the last row only
    a whole conversation (goal None) still inserts."""
    n = len(codes)
    if i == n:
        if goal is None:
            yield "I", INSERT_COST, i, WANTED[q]
        return
    initial, fault = divmod(codes[i], 4)
    yield "D", DELETE_COST, i + 1, q
    yield "I", INSERT_COST, i, WANTED[q]
    if fault in (BLANK, DUPLICATE):
        return
    more = CUT_COST if fault == TRUNCATED else 0
    if initial < 3 and STEP[q][initial] is not None:
        yield "K", more, i + 1, STEP[q][initial]
    yield "R", ROLE_COST + more, i + 1, WANTED[q]


def least_cost(code: int) -> int:
    """No edit of the row costs less."""
    initial, fault = divmod(code, 4)
    if fault in (BLANK, DUPLICATE):
        return DELETE_COST
    return min(DELETE_COST, (CUT_COST if fault == TRUNCATED else 0) + (ROLE_COST if initial == 3 else 0))


def search(codes: bytes, enter: int, goal: int | None) -> tuple[int, str]:
    """Cost and ASCII-least of the cheapest edits that lead from state `enter` to state `goal`, or to a whole conversation."""
    n = len(codes)
    ahead = [0] * (n + 1)
    for i in reversed(range(n)):
        ahead[i] = ahead[i + 1] + least_cost(codes[i])
    need: dict[tuple[int, int], int] = {}
    bound = ahead[0]
    while True:
        path: list[str] = []
        # one entry per open state: row, state, budget, edits still to try, least budget seen to be needed
        stack = [[0, enter, bound, edits(codes, 0, enter, goal), NEVER]]
        while stack:
            top = stack[-1]
            i, q, left = top[:3]
            if i == n and (q in (START, PAIR) if goal is None else q == goal):
                return bound, "".join(path)
            for letter, cost, j, r in top[3]:
                least = cost + need.get((j, r), ahead[j])
                if least <= left:
                    path.append(letter)
                    stack.append([j, r, left - cost, edits(codes, j, r, goal), NEVER])
                    break
                top[4] = min(top[4], least)
            else:
                need[i, q] = top[4]
                stack.pop()
                if stack:
                    below = stack[-1]
                    below[4] = min(below[4], below[2] - left + top[4])
                    path.pop()
        bound = need[0, enter]


def reachable(codes: bytes, enter: int, leave: int) -> bool:
    """Nothing leads back to the start, and to the state after s only a kept s."""
    if leave == START:
        return enter == START
    if leave == SYSTEM:
        return enter == SYSTEM or enter == START and any(c in (FINE, TRUNCATED) for c in codes)
    return True


class Paths:
    """Searches of segments, each done once."""

    def __init__(self):
        self.memo: dict[tuple, tuple[int, str]] = {}

    def __call__(self, codes: bytes, enter: int, goal: int | None) -> tuple[int, str]:
        key = codes, enter, goal
        if key not in self.memo:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[key] = search(codes, enter, goal)
        return self.memo[key]

    def row(self, codes: bytes, enter: int) -> list[tuple[int, int]]:
        """(cost, rank of its path) for every state to leave with."""
        found = {q: self(codes, enter, q) for q in range(4) if reachable(codes, enter, q)}
        rank = {q: k for k, q in enumerate(sorted(found, key=lambda q: found[q][1]))}
        return [(found[q][0], rank[q]) if q in found else (NEVER, NEVER) for q in range(4)]


def segments(codes: bytes) -> list[bytes]:
    return [codes[i:i + SEGMENT] for i in range(0, len(codes), SEGMENT)]


def follow(so_far: list[tuple[int, int]], following: list[list[tuple[int, int]]]) -> tuple[list[tuple[int, int]], list[int]]:
    """One row of (cost, rank) times a matrix; also the state in between that each way out takes."""
    best = []
    for q in range(4):
        best.append(min((so_far[m][0] + following[m][q][0], so_far[m][1], following[m][q][1], m) for m in range(4)))
    rank = {b[1:3]: k for k, b in enumerate(sorted(best, key=lambda b: b[1:3]))}
    return [(b[0], rank[b[1:3]]) if b[0] < NEVER else (NEVER, NEVER) for b in best], [b[3] for b in best]


def unit(enter: int) -> list[tuple[int, int]]:
    return [(0, 0) if q == enter else (NEVER, NEVER) for q in range(4)]


def chain(matrices, enter: int) -> tuple[list[tuple[int, int]], list[list[int]]]:
    """The row of `enter` through all matrices, with the states in between."""
    row, between = unit(enter), []
    for matrix in matrices:
        row, middle = follow(row, matrix)
        between.append(middle)
    return row, between


def states(between: list[list[int]], leave: int) -> list[int]:
    """The states on the way to `leave`, the first to enter with, the last is `leave`."""
    out = [leave]
    for middle in reversed(between):
        out.append(middle[out[-1]])
    return out[::-1]


def matrix_of(codes: bytes, paths: Paths) -> list[list[tuple[int, int]]]:
    """A stretch's (cost, rank) for every state to enter and to leave with."""
    parts = [[paths.row(s, q) for q in range(4)] for s in segments(codes)]
    return [chain(parts, q)[0] for q in range(4)]


def trace(codes: bytes, enter: int, leave: int, paths: Paths) -> str:
    """The edits of a stretch between two states."""
    own = segments(codes)
    way = states(chain([[paths.row(s, q) for q in range(4)] for s in own], enter)[1], leave)
    return "".join(paths(s, a, b)[1] for s, a, b in zip(own, way[:-1], way[1:], strict=True))


def best_end(row: list[tuple[int, int]]) -> int:
    """The state to leave a whole conversation with, insertions after the last row included."""
    return min(range(4), key=lambda q: (row[q][0] + INSERT_COST * len(TAIL[q]), row[q][1]))


def repair(codes: bytes, paths: Paths) -> tuple[int, str]:
    """Cost and edits of a whole conversation."""
    if len(codes) <= SEGMENT:
        return paths(codes, START, None)
    row = chain(([paths.row(s, q) for q in range(4)] for s in segments(codes)), START)[0]
    q = best_end(row)
    return row[q][0] + INSERT_COST * len(TAIL[q]), trace(codes, START, q, paths) + TAIL[q]


def illegal_pair(a: int, b: int) -> bool:
    """a and b as places of initials in INITIALS."""
    return (a, b) not in ((0, 1), (1, 2), (2, 1))


class Stretch:
    """Rows of one conversation in one range partition, in order."""

    def __init__(self, conv_id: int | None, part: int, pos: int, first: bool):
        self.conv_id, self.part, self.pos, self.first = conv_id, part, pos, first
        self.codes = bytearray()
        self.low = self.high = None
        self.turns = 0

    def add(self, turn: int | None, code: int) -> None:
        self.codes.append(code)
        if turn is not None:
            self.turns += turn != self.high
            self.high = turn
            self.low = turn if self.low is None else self.low

    def counts(self) -> dict:
        faults = [c % 4 for c in self.codes]
        initials = [c // 4 for c in self.codes]
        return {"blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE), "truncated": faults.count(TRUNCATED),
                "illegal": sum(map(illegal_pair, initials, initials[1:]))}

    def row(self, last: bool, paths: Paths) -> dict:
        """A finished conversation, or the matrix of one that a partition's end may cut."""
        codes = bytes(self.codes)
        out = {"conv_id": self.conv_id, "part": self.part, "pos": self.pos, "cut": self.first or last, "low": self.low, "high": self.high,
               "turns": self.turns, **self.counts()}
        if out["cut"]:
            flat = [v for row in matrix_of(codes, paths) for cell in row for v in cell]
            return out | {"codes": codes, "matrix": flat, "first_initial": codes[0] // 4, "last_initial": codes[-1] // 4}
        cost, audit = repair(codes, paths)
        return out | {"audit": audit, "cost": cost, "gaps": gap(self.low, self.high, self.turns)}


def gap(low: int | None, high: int | None, turns: int) -> int:
    """Turns missing between the lowest and the highest, at most the largest long."""
    return 0 if low is None else min(high - low + 1 - turns, (1 << 63) - 1)


STRETCH = pa.schema([
    ("conv_id", pa.int64()), ("part", pa.int32()), ("pos", pa.int64()), ("cut", pa.bool_()), ("audit", pa.string()),
    *[(c, pa.int64()) for c in COUNTS], ("codes", pa.binary()), ("matrix", pa.list_(pa.int64())),
    ("first_initial", pa.int32()), ("last_initial", pa.int32()), ("low", pa.int64()), ("high", pa.int64()), ("turns", pa.int64()),
])
STRETCH_FIELDS = (
    f"conv_id long, part int, pos long, cut boolean, audit string, {COUNT_FIELDS}, codes binary, matrix array<long>, first_initial int, "
    "last_initial int, low long, high long, turns long"
)


def as_batches(rows, schema: pa.Schema, size: int = 2_000):
    """Dictionaries as Arrow batches."""
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def read_stretches(batches):
    """Rows by (part, pos), each first of its kind in its conversation preceded by a marker: a row per stretch."""
    def rows():
        paths, stretch, first_here = Paths(), None, None
        for batch in batches:
            for part, pos, kind, conv_id, turn, code in zip(*[batch[c].to_pylist() for c in ("part", "pos", "kind", "conv_id", "turn", "code")], strict=True):
                if kind == 0:
                    first_here = pos
                    continue
                if stretch is None or (part, conv_id) != (stretch.part, stretch.conv_id):
                    if stretch is not None:
                        yield stretch.row(stretch.part != part, paths)
                    stretch = Stretch(conv_id, part, pos, stretch is None or stretch.part != part)
                fault = code % 4
                stretch.add(turn, code - fault + DUPLICATE if fault != BLANK and pos != first_here else code)
        if stretch is not None:
            yield stretch.row(True, paths)

    yield from as_batches(rows(), STRETCH)


CHOICE = pa.schema([("pos", pa.int64()), ("enter", pa.int32()), ("leave", pa.int32()), ("tail", pa.string()), *[(c, pa.int64()) for c in COUNTS]])
CHOICE_FIELDS = f"pos long, enter int, leave int, tail string, {COUNT_FIELDS}"


def fold(stretches: list[dict]):
    """All stretches of one conversation in order: the states of each; the counts go with the last one."""
    matrices = ([[(m[8 * a + 2 * b], m[8 * a + 2 * b + 1]) for b in range(4)] for a in range(4)] for m in (s["matrix"] for s in stretches))
    row, between = chain(matrices, START)
    leave = best_end(row)
    way = states(between, leave)
    total = {c: sum(s[c] for s in stretches) for c in ("blank", "duplicate", "truncated", "illegal")}
    total["illegal"] += sum(illegal_pair(a["last_initial"], b["first_initial"]) for a, b in zip(stretches, stretches[1:], strict=False))
    total["cost"] = row[leave][0] + INSERT_COST * len(TAIL[leave])
    dated = [s for s in stretches if s["low"] is not None]
    turns = sum(s["turns"] for s in dated) - sum(a["high"] == b["low"] for a, b in zip(dated, dated[1:], strict=False))
    total["gaps"] = gap(dated[0]["low"], dated[-1]["high"], turns) if dated else 0
    for k, s in enumerate(stretches):
        last = k == len(stretches) - 1
        yield {"pos": s["pos"], "enter": way[k], "leave": way[k + 1], "tail": TAIL[leave] if last else "", **(total if last else dict.fromkeys(COUNTS, 0))}


def fold_cut(batches):
    """Stretches by (conv_id, part), without their codes."""
    def rows():
        held: list[dict] = []
        for batch in batches:
            for s in batch.to_pylist():
                if held and held[-1]["conv_id"] != s["conv_id"]:
                    yield from fold(held)
                    held = []
                held.append(s)
        if held:
            yield from fold(held)

    yield from as_batches(rows(), CHOICE)


AUDIT = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("audit", pa.string()), *[(c, pa.int64()) for c in COUNTS]])
AUDIT_FIELDS = f"conv_id long, part int, audit string, {COUNT_FIELDS}"


def trace_cut(batches):
    def rows():
        paths = Paths()
        for batch in batches:
            for s in batch.to_pylist():
                yield {k: s[k] for k in ("conv_id", "part", *COUNTS)} | {"audit": trace(s["codes"], s["enter"], s["leave"], paths) + s["tail"]}

    yield from as_batches(rows(), AUDIT)


def row_digest() -> Column:
    """SHA-256 of role and text."""
    return F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))


def row_code() -> Column:
    initial = F.substring("role", 1, 1)
    place = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    fault = F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), BLANK).when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), TRUNCATED).otherwise(FINE)
    return (place * 4 + fault).cast("int")


def edits_of(rows: DataFrame) -> DataFrame:
    """The edits of each conversation, a row per stretch: conv_id, part, audit and the counts, all on one of its rows."""
    spark = rows.sparkSession
    narrow = rows.select("conv_id", "turn", row_digest().alias("digest"), row_code().alias("code"), F.monotonically_increasing_id().alias("tie"))
    parts = max(shuffle_partitions(spark), -(-rows.count() // RANGE_ROWS))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("digest"), F.col("tie")]
    placed = written(narrow.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(
        "conv_id", "turn", "digest", "code", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("pos")), "conversation-rows")
    firsts = placed.groupBy("conv_id", "digest").agg(F.min(F.struct("pos", "part")).alias("first")).select(
        F.col("first.part").alias("part"), F.col("first.pos").alias("pos"), F.lit(0).alias("kind"),
        F.lit(None).cast("long").alias("conv_id"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("int").alias("code"))
    marked = placed.select("part", "pos", F.lit(1).alias("kind"), "conv_id", "turn", "code").unionByName(firsts)
    stretches = written(marked.repartition("part").sortWithinPartitions("part", "pos", "kind").mapInArrow(read_stretches, STRETCH_FIELDS), "stretches")

    cut = stretches.filter("cut")
    ways = cut.drop("codes", "audit", "gaps", "cost").repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(fold_cut, CHOICE_FIELDS)
    traced = cut.select("conv_id", "part", "pos", "codes").join(ways, "pos").mapInArrow(trace_cut, AUDIT_FIELDS)
    return stretches.filter("not cut").select("conv_id", "part", "audit", *COUNTS).unionByName(traced)


def in_order(rows: DataFrame, every: DataFrame) -> DataFrame:
    """Edits and rows of each conversation one after the other: first its edits (kind 0), then its rows by turn (kind 1)."""
    zero = F.lit(0).cast("long")
    known = every.select("conv_id").distinct().select("conv_id", F.lit(-1).alias("part"), F.lit("").alias("audit"), *[zero.alias(c) for c in COUNTS])
    plan = edits_of(rows).unionByName(known).withColumn("kind", F.lit(0))
    lines = rows.select("conv_id", F.lit(0).alias("part"), F.lit(1).alias("kind"), "turn", row_digest().alias("digest"), "role", "text")
    both = plan.unionByName(lines, allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "part", F.col("turn").asc_nulls_first(), "digest").drop("digest")


def conversations(batches):
    """(conv_id, counts, audit, lines) of each conversation, where lines yields (turn, edit, role, text) as rows arrive."""
    def entries():
        for batch in batches:
            columns = ("conv_id", "kind", "turn", "role", "text", "audit", *COUNTS)
            yield from zip(*[batch[c].to_pylist() for c in columns], strict=True)

    stream = entries()
    ahead = next(stream, None)
    while ahead is not None:
        conv_id, counts, pieces = ahead[0], [0] * len(COUNTS), []
        while ahead is not None and ahead[0] == conv_id and ahead[1] == 0:
            counts = [a + b for a, b in zip(counts, ahead[6:], strict=True)]
            pieces.append(ahead[5])
            ahead = next(stream, None)
        audit = "".join(pieces)

        def lines():
            nonlocal ahead
            state = START
            for edit in audit:
                if edit == "I":
                    state = WANTED[state]
                    yield None, edit, ROLE[state], ""
                    continue
                _, _, turn, role, text = ahead[:5]
                ahead = next(stream, None)
                if edit == "K":
                    state = STEP[state][INITIALS.index(role[0])]
                elif edit == "R":
                    state = WANTED[state]
                    role = ROLE[state]
                yield turn, edit, role, text

        yield conv_id, counts, audit, lines()


VERDICT = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in COUNTS], ("audit", pa.string()), ("repaired_sha256", pa.string())])
ROWS = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("turn", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])


def judge(batches):
    def rows():
        for conv_id, counts, audit, lines in conversations(batches):
            digest, between = hashlib.sha256(), b""
            for _, edit, role, text in lines:
                if edit != "D":
                    digest.update(between + f"{role}:{text}".encode())
                    between = b"\n"
            yield {"conv_id": conv_id, "audit": audit, "repaired_sha256": digest.hexdigest(), **dict(zip(COUNTS, counts, strict=True))}

    yield from as_batches(rows(), VERDICT)


def rewrite(batches):
    def rows():
        for conv_id, _, _, lines in conversations(batches):
            kept = ((turn, edit, role, text) for turn, edit, role, text in lines if edit != "D")
            for place, (turn, edit, role, text) in enumerate(kept):
                yield {"conv_id": conv_id, "place": place, "turn": turn, "edit": edit, "role": role, "text": text}

    yield from as_batches(rows(), ROWS, 500)


def normal(rows: DataFrame) -> DataFrame:
    """The four columns in use, a null role or text as one space."""
    filled = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *filled)


def repair_conversations(rows: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """Faults of each conversation and the cheapest edits that mend its roles.

    Returns a row per conv_id of `rows`, and of `every` if given: conv_id, gaps, blank, duplicate, truncated, illegal, cost,
    audit and repaired_sha256 (of `role:text` lines joined by a newline). Rows go by turn, null turns first, rows of one turn
    by digest of role and text, so repeated rows stand together. A null role or text counts as one space, rows without
    conv_id make up one conversation, and a role that does not begin with s, u or a cannot be kept. An id without rows
    gets zeros, an empty audit and the hash of nothing; an empty table gives an empty result; other columns are ignored,
    whatever their names.

    Texts of any length are read one at a time. The hash of one conversation is a sequential matter and runs in one task, which
    holds its audit (a letter per edit) and no row; the search is dealt out by ranges of rows.
    """
    rows = normal(rows)
    known = rows if every is None else rows.select("conv_id").unionByName(every.select(F.col("conv_id").cast("long").alias("conv_id")))
    fields = f"conv_id long, {COUNT_FIELDS}, audit string, repaired_sha256 string"
    return in_order(rows, known).mapInArrow(judge, fields)


def repaired_rows(rows: DataFrame) -> DataFrame:
    """The mended conversations: conv_id, place (from 0), turn (null for inserted rows), edit, role, text. As to null, ties
    and the rest, see `repair_conversations`."""
    rows = normal(rows)
    return in_order(rows, rows).mapInArrow(rewrite, "conv_id long, place long, turn long, edit string, role string, text string")


def damaged(rows: DataFrame) -> DataFrame:
    """The contract's damage, by a hash of conv_id and turn."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(key) % 20
    text = F.coalesce(F.col("text"), F.lit(" "))
    return rows.select("conv_id", "turn", "role", text.alias("text"), kind.alias("kind")).filter("kind <> 0").select(
        "conv_id", "turn",
        F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.coalesce(F.col("role"), F.lit(" "))).alias("role"),
        F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return repair_conversations(damaged(rows), rows)


SQL = r"""
with recursive bits as (
    select i::ubigint as i, 0 as k, i::ubigint as c from range(256) r(i)
    union all
    select i, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end from bits where k < 8
), crc as (
    select list(c order by i) as t from bits where k = 8
), source as (
    select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
        coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as key from conversations
), kinds as (
    select conv_id, turn, role, text, xor(list_reduce(
        list_prepend(4294967295::ubigint, list_transform(string_split(key, ''), lambda x: ascii(x)::ubigint)),
        lambda c, b: xor(t[(xor(c, b) & 255)::int + 1], c >> 8)), 4294967295::ubigint) % 20 as kind from source, crc
), damaged as (
    select conv_id, turn, case when kind = 4 then 'user' else role end as role,
        case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
        unnest(case when kind = 3 then [0, 1] else [0] end) as copy from kinds where kind <> 0
), placed as (
    select conv_id, turn, role, text, row_number() over (
        partition by conv_id order by turn nulls first, sha256(length(role) || ':' || role || text)) as i from damaged
), judged as (
    select conv_id, turn, role, text, i, role[1] as initial,
        case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'blank'
            when row_number() over (partition by conv_id, role, text order by i) > 1 then 'duplicate'
            when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') then 'truncated' else '' end as fault,
        lead(role[1]) over (partition by conv_id order by i) as following
    from placed
), counted as (
    select conv_id, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
        count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
        count(*) filter (fault = 'truncated') as truncated,
        count(*) filter (following is not null and initial || following not in ('su', 'ua', 'au')) as illegal
    from judged group by conv_id
), steps(q, initial, r) as (
    values ('', 's', 's'), ('', 'u', 'u'), ('s', 'u', 'u'), ('u', 'a', 'a'), ('a', 'u', 'u')
), inserts(q, edits, r) as (
    values ('', '', ''), ('', 'I', 'u'), ('', 'II', 'a'), ('s', '', 's'), ('s', 'I', 'u'), ('s', 'II', 'a'), ('u', '', 'u'), ('u', 'I', 'a'),
        ('a', '', 'a'), ('a', 'I', 'u')
), wanted(q, r) as (
    values ('', 'u'), ('s', 'u'), ('u', 'a'), ('a', 'u')
), moves as (
    select conv_id, i, n.q, n.edits || 'D' as edits, 3 * length(n.edits) + 4 as cost, n.r from judged, inserts n
    union all
    select conv_id, i, n.q, n.edits || 'K', 3 * length(n.edits) + case when fault = 'truncated' then 3 else 0 end, s.r
    from judged j, inserts n, steps s where fault not in ('blank', 'duplicate') and s.q = n.r and s.initial = j.initial
    union all
    select conv_id, i, n.q, n.edits || 'R', 3 * length(n.edits) + case when fault = 'truncated' then 6 else 3 end, w.r
    from judged, inserts n, wanted w where fault not in ('blank', 'duplicate') and w.q = n.r
), paths as (
    select conv_id, 0::bigint as i, '' as q, (0, '') as best from counted
    union all
    select m.conv_id, m.i, m.r, min((p.best[1] + m.cost, p.best[2] || m.edits))
    from paths p join moves m on m.conv_id is not distinct from p.conv_id and m.i = p.i + 1 and m.q = p.q group by m.conv_id, m.i, m.r
), tails(q, edits) as (
    values ('', ''), ('s', 'II'), ('u', 'I'), ('a', '')
), finished as (
    select p.conv_id, min((best[1] + 3 * length(edits), best[2] || edits)) as best
    from paths p join counted c on p.conv_id is not distinct from c.conv_id and p.i = c.n join tails using (q) group by p.conv_id
), letters as (
    select conv_id, unnest(string_split(best[2], '')) as edit, generate_subscripts(string_split(best[2], ''), 1) as k
    from finished where best[2] <> ''
), numbered as (
    select conv_id, edit, k, count(*) filter (edit <> 'I') over w as i, count(*) filter (edit <> 'D') over w as place
    from letters window w as (partition by conv_id order by k)
), lines as (
    select l.conv_id, l.k, l.edit, l.place, j.role, j.text, first_value(case when l.edit = 'K' and j.initial = 's' then 1 else 0 end) over (
        partition by l.conv_id order by l.place, l.edit = 'D') as shift
    from numbered l left join judged j on j.conv_id is not distinct from l.conv_id and j.i = l.i and l.edit <> 'I' where l.edit <> 'D'
), repaired as (
    select conv_id, sha256(string_agg(case when edit = 'K' then role when (place + shift) % 2 = 1 then 'user' else 'assistant' end
        || ':' || coalesce(text, ''), chr(10) order by k)) as repaired_sha256 from lines group by conv_id
)
select a.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate,
    coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal, coalesce(best[1], 0)::bigint as cost,
    coalesce(best[2], '') as audit, coalesce(repaired_sha256, sha256('')) as repaired_sha256
from (select distinct conv_id from conversations) a
left join counted c on c.conv_id is not distinct from a.conv_id left join finished f on f.conv_id is not distinct from a.conv_id
left join repaired r on r.conv_id is not distinct from a.conv_id
"""

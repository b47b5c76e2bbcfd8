"""Reading units, protected spans, navigation."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import CJK_MARKS, WS, normalize_text
from ..kernels import ship_by_value

ship_by_value(__name__)

# Fixed values of the splitter.
SHORT_UNIT = 18
TARGET_UNIT = 62
LINE_WIDTH = 64
STRONG = "。！？!?."
MEDIUM = "；;"
WEAK = "，,、：:"
CLOSING = "”’\"'）)】]》"
BRACKETS = ["()", "（）", "[]", "【】"]
FILE_EXTENSIONS = [
    "txt", "pdf", "docx", "doc", "xlsx", "xls", "pptx", "ppt", "html", "htm", "css", "js", "json", "xml", "yaml",
    "yml", "csv", "log",
]
URL = r"(?i)https?://[^%s]+" % WS
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
IPV4 = rf"\b{OCTET}(?:\.{OCTET}){{3}}(?::[0-9]{{1,5}})?(?:/(?:3[0-2]|[12]?[0-9]))?\b"
HIDDEN_PATH = r"~?/?(?:\.[A-Za-z0-9_-]+/)+(?:[A-Za-z0-9._~:/?#@!$&'()*+,;=%-]+)?"
FILE_NAME = (
    rf"(?i)(?:^|(?<=[{WS}(\[{{（【]))(?:[A-Za-z0-9_-]+)?\.(?:{'|'.join(FILE_EXTENSIONS)})(?=$|[{WS},，。；;、)）\]}}】])"
)
EMOJI = "©®‼⁉™ℹ↔-↪⌚-⏿Ⓜ▪-➿⤴⤵⬅-⭕〰〽㊗㊙\U0001f000-\U0001faff"

UNIT = "array<struct<text:string,start:int,end:int>>"


# ---- kernel --------------------------------------------------------------
_SPACES = re.compile(f"[{WS}]+")
# (cheap hint that must be present, pattern): most texts hold none of these
_PROTECT = [
    (re.compile("://"), re.compile(URL, re.A)),
    (re.compile(r"[0-9]\.[0-9]"), re.compile(IPV4, re.A)),
    (re.compile("/"), re.compile(HIDDEN_PATH, re.A)),
    (re.compile(rf"(?i)\.(?:{'|'.join(FILE_EXTENSIONS)})"), re.compile(FILE_NAME, re.A)),
]
_INNER_DOT = re.compile(r"(?<=[A-Za-z0-9_])\.(?=[A-Za-z0-9_])")
_ONE_EMOJI = f"[{EMOJI}][︎️\U0001f3fb-\U0001f3ff]*"
# what may follow a break mark and still belongs to the unit in front of it
_TAIL = re.compile(
    f"[.。!?！？]*[{re.escape(CLOSING)}]*"
    f"(?:[{WS}]*(?:{_ONE_EMOJI}(?:‍[︎️\U0001f3fb-\U0001f3ff]*{_ONE_EMOJI})*|[.。!?！？])[{re.escape(CLOSING)}]*)*"
)
_MARKS = {name: re.compile(f"[{re.escape(chars)}]") for name, chars in (("strong", STRONG), ("medium", MEDIUM), ("weak", WEAK))}
_WIDE = re.compile("[ᄀ-ᇿ⺀-⿟々〇〡-〩〸-〻ぁ-ゖゝ-ゟァ-ヺ"
                   "ヽ-ヿㄱ-ㆎㇰ-㈞㉠-㉾㋐-㋾㌀-㍗㐀-䶿一-鿿ꥠ-ꥼ"
                   "가-ퟻ豈-龎ｦ-ｯｱ-ﾝﾠ-ￜ\U0001b000-\U0001b167\U00020000-\U000323af]")
_WORD = re.compile("[A-Za-z0-9_]")


def default_width(text: str) -> float:
    """T6 for one text, as the column form counts it."""
    space = sum(text.count(c) for c in WS)
    word = len(_WORD.findall(text))
    mark = sum(text.count(c) for c in ",.;:!?")
    cjk = sum(text.count(c) for c in CJK_MARKS)
    wide = len(_WIDE.findall(text))
    return space * 0.5 + word + mark * 0.5 + cjk + wide * 2 + (len(text) - space - word - mark - cjk - wide) * 1.5


# filled on first use in a worker; a decorator object would tie the kernel to an installed module
_TABLE: list[np.ndarray] = []


def _weights() -> np.ndarray:
    """Twice the default width of every code point, the last entry for all above the table."""
    if not _TABLE:
        table = np.full(0x32400, 3, dtype=np.uint8)
        text = "".join(map(chr, range(0xD800))) + "\0" * 0x800 + "".join(map(chr, range(0xE000, len(table))))
        for chars, weight in ((_WIDE, 4), (_WORD, 2)):
            table[[m.start() for m in chars.finditer(text)]] = weight
        for marks, weight in ((CJK_MARKS, 2), (",.;:!?", 1), (WS, 1)):
            table[[ord(c) for c in marks]] = weight
        _TABLE.append(table)
    return _TABLE[0]


def _width_sums(text: str) -> np.ndarray:
    """Running default width: the width of a slice is a difference of two entries."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    table = _weights()
    sums = np.zeros(len(codes) + 1)
    np.cumsum(table[np.minimum(codes, len(table) - 1)], out=sums[1:])
    return sums / 2


def _bracketed(text: str, pair: str) -> Iterator[tuple[int, int]]:
    """From each opening bracket to the next closing one; the first that finds none ends the search."""
    end = 0
    while (start := text.find(pair[0], end)) >= 0 and (close := text.find(pair[1], start + 1)) >= 0:
        end = close + 1
        yield start, end


def _protected(text: str) -> tuple[list[int], list[int]]:
    """Merged protected spans as sorted starts and ends."""
    spans = [m.span() for hint, p in _PROTECT if hint.search(text) for m in p.finditer(text)]
    spans = sorted(spans + [span for pair in BRACKETS for span in _bracketed(text, pair)])
    starts: list[int] = []
    ends: list[int] = []
    for start, end in spans:
        if ends and start <= ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    return starts, ends


def _cut(text: str, level: str, base: int) -> list[tuple[int, int]]:
    """Spans between the break marks of one level, outer white space left out."""
    starts, ends = _protected(text)
    inner = {m.start() for m in _INNER_DOT.finditer(text)} if level == "strong" else set()
    pieces, begin, pos = [], 0, 0
    while True:
        m = _MARKS[level].search(text, pos)
        if m is None:
            break
        at = m.start()
        k = bisect_right(starts, at) - 1
        if at in inner or (k >= 0 and at < ends[k]):
            pos = at + 1
            continue
        pos = _TAIL.match(text, at + 1).end()
        pieces.append((begin, pos))
        begin = pos
    pieces.append((begin, len(text)))
    out = []
    for a, b in pieces:
        body = text[a:b]
        left = len(body) - len(body.lstrip(WS))
        body = body.strip(WS)
        if body:
            out.append((base + a + left, base + a + left + len(body)))
    return out


def _join(spans: list[tuple[int, int]], fits: Callable[[tuple[int, int], tuple[int, int]], bool]) -> list[tuple[int, int]]:
    """Greedy: the pending span grows while `fits(pending, next)`."""
    out: list[tuple[int, int]] = []
    for span in spans:
        if out and fits(out[-1], span):
            out[-1] = (out[-1][0], span[1])
        else:
            out.append(span)
    return out


def _coalesce(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Short clauses lean on their neighbours."""
    paired, i = [], 0
    while i < len(spans):
        if spans[i][1] - spans[i][0] < SHORT_UNIT and i + 1 < len(spans):
            paired.append((spans[i][0], spans[i + 1][1]))
            i += 2
        else:
            paired.append(spans[i])
            i += 1
    out = _join(paired, lambda p, n: p[1] - p[0] < SHORT_UNIT or n[1] - p[0] <= TARGET_UNIT)
    if len(out) > 1 and out[-1][1] - out[-1][0] < SHORT_UNIT:
        last = out.pop()
        out[-1] = (out[-1][0], last[1])
    return out


def split_text(text: str, width: Callable[[str], float] | None = None, limit: float = LINE_WIDTH) -> list[tuple[int, int]]:
    """Unit spans over an already normalized text.

    In normalized text a gap between neighbours is one space, so a joined unit
    is always the slice from its first to its last offset.
    """
    spans: list[tuple[int, int]] = []
    for a, b in _cut(text, "strong", 0):
        for c, d in _cut(text[a:b], "medium", a):
            spans += [(c, d)] if d - c <= TARGET_UNIT else _coalesce(_cut(text[c:d], "weak", c))
    if width is not None:
        return _join(spans, lambda p, n: width(text[p[0]:n[1]]) <= limit)
    sums = _width_sums(text)
    return _join(spans, lambda p, n: sums[n[1]] - sums[p[0]] <= limit)


def split_udf(width: Callable[[str], float] | None = None, limit: float = LINE_WIDTH):
    """Arrow UDF text -> units; `width` may be any measuring function."""
    @F.arrow_udf(UNIT)
    def split(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            offsets, texts, starts, ends = [0], [], [], []
            for raw in batch.to_pylist():
                text = _SPACES.sub(" ", raw or "").strip(" ")
                for a, b in split_text(text, width, limit) if text else []:
                    texts.append(text[a:b])
                    starts.append(a)
                    ends.append(b)
                offsets.append(len(texts))
            columns = [pa.array(texts, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())]
            units = pa.StructArray.from_arrays(columns, names=["text", "start", "end"])
            yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), units)

    return split


# ---- operators -----------------------------------------------------------
def split_units(df: DataFrame, text_col: str, width: Callable[[str], float] | None = None, limit: float = LINE_WIDTH) -> DataFrame:
    """One row per unit with offsets into the normalized text. Narrow.

    The outer explode keeps the planner from testing the array's size in a
    second run of the kernel below.
    """
    units = df.withColumn("units", split_udf(width, limit)(F.col(text_col)))
    rest = [c for c in df.columns if c != text_col]
    rows = units.select(*rest, F.posexplode_outer("units").alias("unit_pos", "u")).filter("u is not null")
    return rows.select(*rest, "unit_pos", "u.*")


def protected_spans(df: DataFrame, text_col: str) -> DataFrame:
    """R2: what must not be cut, as a (kind, value) table. JVM side only."""
    rest = [c for c in df.columns if c != text_col]
    flat = df.select(*rest, normalize_text(F.col(text_col)).alias("flat"))
    text = F.col("flat")
    none = F.expr("cast(array() as array<string>)")
    # (kind, cheap hint that must be present, pattern)
    rules = [
        ("url", F.contains(text, F.lit("://")), URL),
        ("ip", F.regexp_like(text, F.lit("[0-9]\\.[0-9]")), IPV4),
        ("hidden_path", F.contains(text, F.lit("/")), HIDDEN_PATH),
        ("file", F.regexp_like(text, F.lit(f"(?i)\\.(?:{'|'.join(FILE_EXTENSIONS)})")), FILE_NAME),
    ]
    found = [(kind, F.when(hint, F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(none)) for kind, hint, p in rules]
    for pair in BRACKETS:
        # up to the last closing bracket every opening one finds its end, so no search runs through the rest for nothing
        closed = F.regexp_extract(text, rf"(?s)^.*\{pair[1]}", 0)
        values = F.regexp_extract_all(closed, F.lit(rf"\{pair[0]}[^\{pair[1]}]*\{pair[1]}"), F.lit(0))
        found.append((f"bracket_{pair}", F.when(F.contains(text, F.lit(pair[0])), values).otherwise(none)))
    found = F.array(*[F.struct(F.lit(kind).alias("kind"), values.alias("values")) for kind, values in found])
    kinds = flat.select(*rest, F.explode(found).alias("k"))
    return kinds.select(*rest, F.col("k.kind").alias("kind"), F.explode("k.values").alias("value"))


SEPARATOR = "\x1e"


def sentence_candidates(df: DataFrame, text_col: str) -> DataFrame:
    """Cheap split after strong marks; dots inside words never break."""
    text = normalize_text(F.col(text_col))
    tail = f"[.。!?！？]*[{re.escape(CLOSING)}]*"
    marked = F.regexp_replace(text, f"((?:[。！？!?]|(?<![A-Za-z0-9_])\\.|\\.(?![A-Za-z0-9_])){tail})", f"$1{SEPARATOR}")
    pieces = F.filter(F.transform(F.split(marked, SEPARATOR), lambda p: F.trim(p)), lambda p: p != "")
    rest = [c for c in df.columns if c != text_col]
    return df.select(*rest, F.posexplode_outer(pieces).alias("sentence_pos", "sentence")).filter("sentence is not null")


def paragraphs_of(documents: DataFrame, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents as paragraph blocks: one per line."""
    lines = F.transform(F.split(F.col(text_col), "\n"), lambda line: line)
    return documents.select(
        F.col(doc_col).alias("page_id"), F.posexplode(lines).alias("block_pos", "text")
    ).select(
        "page_id", "block_pos", F.concat(F.lit("b"), F.col("block_pos").cast("string")).alias("block_id"),
        F.lit("paragraph").alias("type"), "text", F.lit(None).cast("array<struct<text:string>>").alias("items"),
    )


def build_units(blocks: DataFrame, width: Callable[[str], float] | None = None, limit: float = LINE_WIDTH) -> DataFrame:
    """Units of every block in one pass; dividers have none.

    Paragraph: split units (a text with line breaks stays whole). List: one per
    item. Anything else: the block itself.
    """
    text = F.coalesce("text", F.lit(""))
    whole = F.array(F.struct(text.alias("text"), F.lit(0).alias("start"), F.length(text).alias("end")))
    is_text = F.col("type") == "paragraph"
    # only paragraphs travel to the kernel with their text
    split = split_udf(width, limit)(F.when(is_text & ~F.contains(text, F.lit("\n")), text))
    empty = F.expr(f"cast(array() as {UNIT})")
    items = F.transform("items", lambda i: F.struct(i["text"].alias("text"), F.lit(0).alias("start"), F.length(i["text"]).alias("end")))
    one = F.array(F.struct(F.lit(None).cast("string").alias("text"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end")))
    units = (
        F.when(F.col("type") == "divider", empty)
        .when(is_text & F.contains(text, F.lit("\n")), whole)
        .when(is_text, F.col("split"))
        .when(F.col("type") == "list", items)
        .otherwise(one)
    )
    role = F.when(is_text, "body").when(F.col("type") == "list", "list-item")
    rows = blocks.withColumn("split", split).select(
        "page_id", "block_pos", "block_id", F.col("type").alias("block_type"), role.alias("role"),
        F.posexplode_outer(units).alias("n", "u"),
    ).filter("u is not null")
    suffix = (
        F.when(F.col("role") == "body", F.concat(F.lit("-u"), F.col("n") + 1))
        .when(F.col("role") == "list-item", F.concat(F.lit("-item-"), F.col("n") + 1))
        .otherwise(F.lit("-block"))
    )
    return rows.select(
        "page_id", "block_pos", "block_id", F.concat("block_id", suffix).alias("unit_id"),
        F.when(F.col("role").isNull(), "block").otherwise("reading-text").alias("unit_type"),
        "block_type", "role", "n", "u.text", "u.start", "u.end",
    )


def index_units(units: DataFrame) -> DataFrame:
    """Position of a unit in its article. An article is one document, so a partition is bounded by it."""
    w = Window.partitionBy("page_id").orderBy("block_pos", "n")
    return units.withColumn("unit_index", F.row_number().over(w) - 1)


def unit_context(indexed: DataFrame, text_col: str = "text") -> DataFrame:
    """A unit with its neighbours."""
    w = Window.partitionBy("page_id").orderBy("unit_index")
    return indexed.withColumns({"previous": F.lag(text_col).over(w), "next": F.lead(text_col).over(w)})


RANGE_BUCKET = 256


def clip_annotations(units: DataFrame, ranges: DataFrame) -> DataFrame:
    """Ranges cut to the units they overlap.

    Units: page_id, block_id, unit_id, start, end. Ranges: page_id, block_id,
    start, end and anything else. Both sides are spread over fixed buckets of the
    text and joined on (block, bucket), so a long block never pairs all with all;
    the pair is kept in the first bucket both touch.
    """
    def bucketed(df: DataFrame, prefix: str) -> DataFrame:
        first = F.floor(F.col(f"{prefix}_start") / RANGE_BUCKET)
        last = F.floor((F.greatest(F.col(f"{prefix}_end") - 1, F.col(f"{prefix}_start"))) / RANGE_BUCKET)
        return df.withColumn(f"{prefix}_first", first).withColumn("bucket", F.explode(F.sequence(first, last)))

    u = bucketed(units.select("page_id", "block_id", "unit_id", F.col("start").alias("u_start"), F.col("end").alias("u_end")), "u")
    r = bucketed(ranges.withColumnsRenamed({"start": "r_start", "end": "r_end"}), "r")
    pairs = u.join(r, ["page_id", "block_id", "bucket"]).filter(
        (F.col("r_end") > F.col("u_start")) & (F.col("r_start") < F.col("u_end"))
        & (F.col("bucket") == F.greatest("u_first", "r_first"))
    )
    clipped = pairs.withColumns({"start": F.greatest("r_start", "u_start"), "end": F.least("r_end", "u_end")})
    return clipped.filter(F.col("end") > F.col("start")).drop("u_start", "u_end", "r_start", "r_end", "u_first", "r_first", "bucket")


RUN = "struct<text:string,start:int,end:int,annotated:boolean,href:string,bold:boolean>"


def text_runs(text: Column, ranges: Column) -> Column:
    """Plain and annotated pieces in order; they join to the text.

    A range that starts before the cursor is skipped and must not move it.
    """
    def run(a: Column, b: Column, annotated: Column, href: Column, bold: Column) -> Column:
        return F.struct(
            F.substring(text, a + 1, b - a).alias("text"), a.alias("start"), b.alias("end"), annotated.alias("annotated"),
            href.alias("href"), bold.alias("bold"),
        ).cast(RUN)

    none, no = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    zero = F.struct(F.lit(0).alias("cursor"), F.expr(f"cast(array() as array<{RUN}>)").alias("runs"))
    ordered = F.array_sort(F.filter(ranges, lambda r: r["end"] > r["start"]), lambda a, b: (a["start"] - b["start"]).cast("int"))

    def step(acc: Column, r: Column) -> Column:
        gap = F.when(r["start"] > acc["cursor"], F.array(run(acc["cursor"], r["start"], F.lit(False), none, no))).otherwise(
            F.expr(f"cast(array() as array<{RUN}>)")
        )
        grown = F.concat(acc["runs"], gap, F.array(run(r["start"], r["end"], F.lit(True), r["href"], r["bold"])))
        return F.when(r["start"] < acc["cursor"], acc).otherwise(F.struct(r["end"].alias("cursor"), grown.alias("runs")))

    def close(acc: Column) -> Column:
        rest = F.when(
            acc["cursor"] < F.length(text), F.array(run(acc["cursor"], F.length(text), F.lit(False), none, no))
        ).otherwise(F.expr(f"cast(array() as array<{RUN}>)"))
        return F.concat(acc["runs"], rest)

    whole = F.filter(F.array(run(F.lit(0), F.length(text), F.lit(False), none, no)), lambda r: r["end"] > 0)
    return F.coalesce(F.aggregate(ordered, zero, step, close), whole)  # without ranges the text is one plain run


MOVES = {"next": 1, "previous": -1}


def replay_navigation(moves: DataFrame, units: DataFrame, slice_seconds: int = 3_600, salts: int = 32) -> DataFrame:
    """Where a reader ends up after their moves.

    moves: reader_id, article_id, ts, seq, move (next, previous, first, last,
    set), target. units: article_id, n_units. Every move is x -> min(hi, max(lo,
    x + add)), and chains of such steps are again one such step. So a log is
    folded per time slice first, then over the slices; no reader's whole log is
    ever in one group. A much-read article is joined in `salts` parts, dealt out
    by reader and slice.
    """
    at = F.floor(F.unix_timestamp("ts") / slice_seconds)
    parts = units.filter("n_units > 0").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    known = moves.withColumn("salt", F.pmod(F.xxhash64("reader_id", at), F.lit(salts)).cast("int")).join(parts, ["article_id", "salt"])
    top = F.col("n_units") - 1
    jump = F.when(F.col("move") == "first", 0).when(F.col("move") == "last", top).when(
        F.col("move") == "set", F.greatest(F.lit(0), F.least(top, F.col("target")))
    )
    add = F.coalesce(F.create_map(*[F.lit(v) for kv in MOVES.items() for v in kv])[F.col("move")], F.lit(0))
    step = known.select(
        "reader_id", "article_id", "ts", "seq", at.alias("slice"),
        F.when(jump.isNull(), add).otherwise(0).cast("bigint").alias("add"),
        F.coalesce(jump, F.lit(0)).cast("bigint").alias("lo"), F.coalesce(jump, top).cast("bigint").alias("hi"),
    )

    def fold(steps: Column) -> Column:
        start = F.struct(
            F.lit(0).cast("bigint").alias("add"), F.lit(-(1 << 60)).cast("bigint").alias("lo"), F.lit(1 << 60).cast("bigint").alias("hi")
        )

        def after(f: Column, g: Column) -> Column:
            """First f, then g."""
            clamp = lambda x: F.least(g["hi"], F.greatest(g["lo"], x + g["add"]))
            return F.struct((f["add"] + g["add"]).alias("add"), clamp(f["lo"]).alias("lo"), clamp(f["hi"]).alias("hi"))

        return F.aggregate(steps, start, after)

    keys = ["reader_id", "article_id"]
    per_slice = step.groupBy(*keys, "slice").agg(
        fold(F.array_sort(F.collect_list(F.struct("ts", "seq", "add", "lo", "hi")))).alias("f"), F.count("*").alias("n_moves")
    ).select(*keys, "slice", "f.*", "n_moves")
    whole = per_slice.groupBy(*keys).agg(
        fold(F.array_sort(F.collect_list(F.struct("slice", "add", "lo", "hi")))).alias("f"), F.sum("n_moves").alias("n_moves")
    )
    position = F.least(F.col("f.hi"), F.greatest(F.col("f.lo"), F.col("f.add")))
    return whole.select(*keys, position.alias("position"), "n_moves")

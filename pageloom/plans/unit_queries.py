"""Registered queries of reading units, each with its SQL twin beside it. The splitter's twin keeps protected marks out of sight
by private characters of the same length, cuts with regular expressions, and folds clauses and lines with list_reduce."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions.text import ASCII_MARKS, CJK_MARKS, SPACE, WS
from ..functions.udtf import register_table_functions
from ..operators import units as un
from .more_queries import query
from .oracles import OCTET, ORACLES, SOLID, WIDE, norm, protected_twin
from .queries import documents, table

#: The documents as they are, and with their signs of junk spelled as marks, brackets and wide characters.
SPELLED = [("plain", "", ""), ("spelled", "#$%&*|=+", ";()：，。】【")]
BREAKS = "。！？!?.；;，,、：:"
HIDDEN = "".join(chr(0xE000 + i) for i in range(len(BREAKS)))
CUT = chr(0x1E)
CLOSING = re.sub(r"([\]\[\\])", r"\\\1", un.CLOSING).replace("'", "''")
# the given rows hold no emoji, which may follow a mark too
TAIL = f"[.。!?！？]*[{CLOSING}]*(?:[{WS}]*[.。!?！？][{CLOSING}]*)*"
PROTECTED = [f"(?i)https?://[^{WS}]+", f"\\b{OCTET}(?:\\.{OCTET}){{3}}(?::[0-9]{{1,5}})?(?:/(?:3[0-2]|[12]?[0-9]))?\\b"]
PROTECTED += [f"{a}[^{b}]*{b}" for a, b in (("\\" + p[0], "\\" + p[1]) if p.isascii() else p for p in un.BRACKETS)]


def hidden(t: str, pattern: str) -> str:
    """t with the break marks inside each match of a pattern hidden."""
    parts, hits = f"string_split_regex({t}, '{pattern}')", f"regexp_extract_all({t}, '{pattern}')"
    return f"list_reduce(list_transform(range(1, len({parts}) + 1), lambda i: {parts}[i] || coalesce(translate({hits}[i], '{BREAKS}', '{HIDDEN}'), '')), lambda a, b: a || b)"


def cut(x: str, marks: str) -> str:
    return f"string_split(regexp_replace({x}, '([{marks}]{TAIL})', '\\1{CUT}', 'g'), '{CUT}')"


def pieces(of: str, into: str, keys: str, marks: str) -> str:
    """Pieces of `body` with their start; outer spaces left out, empty pieces dropped."""
    return f"""
    {into}_raw as (select {keys}, start, unnest({cut("body", marks)}) as p, generate_subscripts({cut("body", marks)}, 1) as {into}_no from {of}),
    {into}_at as (select *, start + sum(length(p)) over (partition by {keys} order by {into}_no) - length(p) as piece_start from {into}_raw),
    {into} as (select {keys}, {into}_no, piece_start + length(p) - length(ltrim(p, ' ')) as start, trim(p, ' ') as body from {into}_at where trim(p, ' ') <> '')"""


def width(x: str) -> str:
    count = lambda chars: f"length(regexp_replace({x}, '[^{chars}]', '', 'g'))"
    space, word, mark, cjk, wide = count(WS), count("A-Za-z0-9_"), count(ASCII_MARKS), count(CJK_MARKS), count(WIDE)
    rest = f"(length({x}) - {space} - {word} - {mark} - {cjk} - {wide})"
    return f"({space} * 0.5 + {word} + {mark} * 0.5 + {cjk} + {wide} * 2 + {rest} * 1.5)"


NO_SPANS = "[]::struct(s bigint, e bigint, w double)[]"


def fold(items: str, step: str) -> str:
    """Spans {s, e, w} folded in order; `step` makes the next state from a.out, a.last (the pending span, if any) and x."""
    state = lambda last, out: f"{{'s': 0::bigint, 'e': 0::bigint, 'w': 0::double, 'last': {last}, 'out': {out}}}"
    none = f"{{'s': null::bigint, 'e': null::bigint, 'w': null::double}}"
    wrapped = f"list_transform({items}, lambda x: {{'s': x.s, 'e': x.e, 'w': x.w, 'last': {none}, 'out': {NO_SPANS}}})"
    return f"list_reduce({wrapped}, lambda a, x: {step}, {state(none, NO_SPANS)})"


def grow(fits: str) -> str:
    """The pending span takes in the next one while it fits, else it is done."""
    one = "{'s': x.s, 'e': x.e, 'w': x.w}"
    joined = "{'s': a.last.s, 'e': x.e, 'w': a.last.w + x.w + case when x.s > a.last.e then 0.5 else 0 end}"
    state = lambda last, out: f"{{'s': 0::bigint, 'e': 0::bigint, 'w': 0::double, 'last': {last}, 'out': {out}}}"
    return f"case when a.last.s is null then {state(one, 'a.out')} when {fits} then {state(joined, 'a.out')} else {state(one, 'list_append(a.out, a.last)')} end"


SHORT = un.SHORT_UNIT
PAIRS = (  # a short clause takes the next one, whatever its length, and is done then
    "case when a.last.s is not null then {'s': 0::bigint, 'e': 0::bigint, 'w': 0::double, 'last': {'s': null::bigint, 'e': null::bigint, 'w': null::double}, "
    "'out': list_append(a.out, {'s': a.last.s, 'e': x.e, 'w': 0::double})} "
    f"when x.e - x.s < {SHORT} then {{'s': 0::bigint, 'e': 0::bigint, 'w': 0::double, 'last': {{'s': x.s, 'e': x.e, 'w': x.w}}, 'out': a.out}} "
    "else {'s': 0::bigint, 'e': 0::bigint, 'w': 0::double, 'last': a.last, 'out': list_append(a.out, {'s': x.s, 'e': x.e, 'w': x.w})} end"
)
CLAUSES = grow(f"(a.last.e - a.last.s < {SHORT} or x.e - a.last.s <= {un.TARGET_UNIT})")
LINES = grow(f"a.last.w + x.w + case when x.s > a.last.e then 0.5 else 0 end <= {un.LINE_WIDTH}")


def ended(folded: str) -> str:
    return f"case when ({folded}).last.s is null then ({folded}).out else list_append(({folded}).out, ({folded}).last) end"


def r1_twin() -> str:
    given = " union all ".join(
        f"select doc_id, '{name}' as variant, {norm(f'''translate(text, '{a}', '{b}')''') if a else norm('text')} as t from documents" for name, a, b in SPELLED)
    masks, last = "", "n"
    for i, pattern in enumerate(PROTECTED):
        masks += f"m{i} as (select doc_id, variant, t, {hidden('body' if i else 't', pattern)} as body from {last}), "
        last = f"m{i}"
    inner = "([A-Za-z0-9_])\\.([A-Za-z0-9_])"
    dot = HIDDEN[BREAKS.index(".")]
    return f"""
    with n as (select * from ({given}) where t <> ''), {masks}
    top as (select doc_id, variant, 0::bigint as start,
      regexp_replace(regexp_replace(body, '{inner}', '\\1{dot}\\2', 'g'), '{inner}', '\\1{dot}\\2', 'g') as body from {last}),
    {pieces("top", "strong", "doc_id, variant", "。！？!?.")},
    {pieces("strong", "medium", "doc_id, variant, strong_no", "；;")},
    long as (select * from medium where length(body) > {un.TARGET_UNIT}),
    {pieces("long", "weak", "doc_id, variant, strong_no, medium_no", "，,、：:")},
    clauses as (select doc_id, variant, list({{'s': start::bigint, 'e': (start + length(body))::bigint, 'w': 0::double}} order by start) as spans
      from weak group by doc_id, variant, strong_no, medium_no),
    paired as (select doc_id, variant, {fold("spans", PAIRS)} as f from clauses),
    paired_out as (select doc_id, variant, {ended("f")} as spans from paired),
    leaned as (select doc_id, variant, {fold("spans", CLAUSES)} as f from paired_out),
    leaned_out as (select doc_id, variant, {ended("f")} as spans from leaned),
    tailed as (select doc_id, variant, case when len(spans) > 1 and spans[-1].e - spans[-1].s < {SHORT}
      then list_append(spans[1:len(spans) - 2], {{'s': spans[-2].s, 'e': spans[-1].e, 'w': 0::double}}) else spans end as spans from leaned_out),
    flat as (select doc_id, variant, unnest(spans) as x from tailed),
    spans as (select doc_id, variant, x.s as s, x.e as e from flat union all
      select doc_id, variant, start, start + length(body) from medium where length(body) <= {un.TARGET_UNIT}),
    sized as (select s.*, substr(t, (s + 1)::bigint, (e - s)::bigint) as u, t from spans s join n using (doc_id, variant)),
    measured as (select doc_id, variant, s, e, {width("u")}::double as w from sized),
    lists as (select doc_id, variant, list({{'s': s::bigint, 'e': e::bigint, 'w': w}} order by s) as spans from measured group by 1, 2),
    lined as (select doc_id, variant, {fold("spans", LINES)} as f from lists),
    lined_out as (select doc_id, variant, {ended("f")} as spans from lined),
    units as (select doc_id, variant, unnest(spans) as x, generate_subscripts(spans, 1) - 1 as unit_pos from lined_out)
    select doc_id, variant, unit_pos::bigint as unit_pos, x.s::bigint as "start", x.e::bigint as "end", substr(t, x.s + 1, x.e - x.s) as text
    from units join n using (doc_id, variant)"""


@query(r1_twin())
def r1_split_units(spark, d):
    """Units of every document, as it is and spelled with more kinds of marks."""
    t = documents(spark, d)
    variants = F.explode(F.array(*[
        F.struct(F.lit(name).alias("variant"), (F.translate("text", a, b) if a else F.col("text")).alias("text")) for name, a, b in SPELLED]))
    rows = t.select("doc_id", variants.alias("v")).select("doc_id", "v.variant", "v.text")
    u = un.split_units(rows, "text")
    return u.select("doc_id", "variant", F.col("unit_pos").cast("bigint").alias("unit_pos"), F.col("start").cast("bigint").alias("start"),
                    F.col("end").cast("bigint").alias("end"), "text")


MARKED = """concat('see https://a.test/', cast(doc_id as varchar(20)), '?x=(1) or ~/.conf/.d', cast(doc_id as varchar(20)), '/x.y (a ', lang, ') [b [', source,
    '] 【c', cast(doc_id as varchar(20)), '】 （d） ( open 10.0.0.', cast(doc_id % 300 as varchar(20)), ':80 and 10.1.1.1/', cast(doc_id % 40 as varchar(20)),
    ' notes-', cast(doc_id as varchar(20)), '.txt, (.JSON) a.pdfx ', lang)"""


@query(f"""
    with n as (select doc_id, {norm(MARKED)} as t from documents), {protected_twin("n", "doc_id")}
    select doc_id, kind, value, count(*) as n from spans group by 1, 2, 3""")
def r2_spans_of_every_kind(spark, d):
    marked = table(spark, d, "documents").select("doc_id", F.expr(MARKED).alias("text"))
    return un.protected_spans(marked, "text").groupBy("doc_id", "kind", "value").agg(F.count(F.lit(1)).alias("n"))


# ---- table functions in SQL ---------------------------------------------------
def sql_tables(spark, d, *names: str) -> None:
    register_table_functions(spark)
    for name in names:
        table(spark, d, name).createOrReplaceTempView(f"given_{name}")


@query(ORACLES["h1_parse_nodes"])
def f4_parse_pages(spark, d):
    """Elements per tag by the table function over a partitioned table."""
    sql_tables(spark, d, "pages")
    return spark.sql("""
        select id as page_id, tag, count(*) as n
        from parse_pages(table(select page_id as id, html from given_pages) partition by id) group by id, tag""")


@query(f"""
    select doc_id, length({SOLID.format('text')})::bigint as n_solid, length({norm('text')})::bigint as last_end from documents where {norm('text')} <> ''""")
def f4_split_texts(spark, d):
    """The function of a table. It is called once per group, so 64 neighbouring documents share one."""
    sql_tables(spark, d, "documents")
    return spark.sql(f"""
        select id as doc_id, sum(length(regexp_replace(text, '{SPACE}+', ''))) as n_solid, cast(max(end) as bigint) as last_end
        from split_texts(table(select doc_id as id, text from given_documents) partition by (id div 64)) group by id""")


@query(f"""
    select conv_id, turn, length({SOLID.format('text')})::bigint as n_solid, length({norm('text')})::bigint as last_end from conversations
    where {norm('text')} <> ''""")
def f4_split_turns(spark, d):
    """The function of one value, joined laterally to each turn."""
    sql_tables(spark, d, "conversations")
    return spark.sql(f"""
        select c.conv_id, c.turn, sum(length(regexp_replace(u.text, '{SPACE}+', ''))) as n_solid, cast(max(u.end) as bigint) as last_end
        from given_conversations c, lateral split_units(c.text) u group by c.conv_id, c.turn""")

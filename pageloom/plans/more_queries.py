"""Registered queries of column functions, each with its SQL twin beside it. Inputs are spelled from given rows in SQL that
both engines read the same way."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions import css, media
from ..functions import numbers as num
from ..functions import text as txt
from ..functions import urls
from ..operators import articles as art
from ..operators.blocks import make_block
from ..operators.merge import block_equivalence_key, merge_extractions
from ..operators import media_links as links
from ..operators import reports as rep
from ..operators import units as un
from ..session import shared_dir
from ..sources.articles import read_articles
from ..streaming import captures as cap
from ..streaming import stability as stab
from .queries import table

IMAGE_FIELDS = [tuple(f.split(":", 1)) for f in schema.IMAGE.removeprefix("struct<").removesuffix(">").split(",")]
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(fn):
        QUERIES[fn.__name__] = fn
        ORACLES[fn.__name__] = sql
        return fn
    return add


K = "cast(get_json_object(props, '$.k') as bigint)"
SQL_K = "cast(json_extract_string(props, '$.k') as bigint)"


def events(spark, d, **spelled: str) -> DataFrame:
    """Events with k and further columns as SQL text."""
    e = table(spark, d, "events").withColumn("k", F.expr(K))
    return e.withColumns({name: F.expr(sql) for name, sql in spelled.items()})


def sql_events(**spelled: str) -> str:
    own = "".join(f", {sql} as {name}" for name, sql in spelled.items())
    return f"e0 as (select *, {SQL_K} as k from events), e as (select *{own} from e0)"


# ---- URLs ----------------------------------------------------------------
POST = "concat('https://', case k % 4 when 0 then 'x.com' when 1 then 'twitter.com' when 2 then 'x.com.evil.io' else 'm.x.com' end, '/user', cast(user_id as varchar(20)), case when event_id % 2 = 0 then '/status/' else '/article/' end, cast(event_id as varchar(20)), case when event_id % 3 = 0 then '/' when event_id % 7 = 0 then '/photo/1' else '' end)"


@query(f"""
    with {sql_events(url=POST)}, p as (select event_id, k % 4 < 2 and not (event_id % 3 <> 0 and event_id % 7 = 0) as ok, user_id from e)
    select event_id, case when ok then event_id::varchar end as post_id, case when ok then 'user' || user_id end as handle,
        case when ok then 'https://x.com/user' || user_id || '/article/' || event_id end as canonical from p""")
def u3_post_parts(spark, d):
    url = F.col("url")
    return events(spark, d, url=POST).select(
        "event_id", urls.post_id(url).alias("post_id"), urls.post_handle(url).alias("handle"), urls.post_canonical(url).alias("canonical"))


HREF = "concat(case k % 6 when 0 then 'https://a.test/' when 1 then '/' when 2 then 'mailto:' when 3 then '//b.test/' when 4 then 'javascript:' else '?q=' end, 'p', cast(event_id as varchar(20)))"


@query(f"""
    with {sql_events(href=HREF)}
    select event_id, case k % 6 when 0 then href when 1 then 'https://base.test' || href when 3 then 'https:' || href
        when 5 then 'https://base.test/dir/page' || href end as url from e""")
def u5_safe_url(spark, d):
    return events(spark, d, href=HREF).select("event_id", urls.safe_url(F.col("href"), F.lit("https://base.test/dir/page?old=1#f")).alias("url"))


HOSTED = "concat('https://', case k % 7 when 0 then 'www.youtube.com' when 1 then 'youtu.be' when 2 then 'x.com' when 3 then 'm.x.com' when 4 then 'mobile.twitter.com' when 5 then 'me.substack.com' else 'vimeo.com' end, '/v/', cast(event_id as varchar(20)))"


@query(f"""
    with {sql_events(href=HOSTED)}, p as (select event_id, case when k % 7 < 2 then 'youtube' when k % 7 < 5 then 'x' when k % 7 = 5 then 'substack' else 'generic' end as provider from e)
    select event_id, provider, case provider when 'youtube' then 'YouTube' when 'x' then 'X' when 'substack' then 'Substack' else 'Embed' end as label from p""")
def u6_embed_provider(spark, d):
    provider = urls.embed_provider(F.col("href"))
    return events(spark, d, href=HOSTED).select("event_id", provider.alias("provider"), urls.provider_name(provider).alias("label"))


IMAGE = "concat(case when k % 3 = 0 then 'https://img.test/media/' else 'https://pbs.twimg.com/media/' end, cast(event_id as varchar(20)), case k % 5 when 0 then '' when 1 then '?format=jpg' when 2 then '?name=small' when 3 then '?format=png&name=360x360' else '?name=small&x=1#top' end)"


@query(f"""
    with {sql_events(src=IMAGE)}
    select event_id, case when k % 3 = 0 then src when k % 5 = 0 then src || '?name=orig' when k % 5 = 1 then src || '&name=orig'
        else regexp_replace(src, 'name=[a-z0-9]+', 'name=orig') end as src from e""")
def u8_upgrade_image_url(spark, d):
    return events(spark, d, src=IMAGE).select("event_id", urls.upgrade_image_url(F.col("src")).alias("src"))


# ---- texts ---------------------------------------------------------------
@query("""
    select doc_id, trim(regexp_replace(chr(10) || chr(13) || replace(text, chr(10), chr(13) || chr(10)) || chr(13), '\\r\\n?', chr(10), 'g'), chr(10)) as code
    from documents""")
def t3_normalize_code(spark, d):
    spelled = F.concat(F.lit("\n\r"), F.replace(F.col("text"), F.lit("\n"), F.lit("\r\n")), F.lit("\r"))
    return table(spark, d, "documents").select("doc_id", txt.normalize_code(spelled).alias("code"))


SNIPPET = "case k % 6 when 0 then '  <div>x</div>' when 1 then 'pub struct A' when 2 then 'let b = fn go' when 3 then 'npm install y' when 4 then 'cd /tmp' else 'plain words' end"
LANG_CLASS = "case when event_id % 4 = 0 then 'language-TS' when event_id % 4 = 1 then '' end"


@query(f"""
    with {sql_events(code=SNIPPET)}
    select event_id, case when event_id % 4 = 0 then 'ts' when event_id % 3 = 0 then 'rust code' when k % 6 = 0 then 'xml' when k % 6 < 3 then 'rust'
        when k % 6 < 5 then 'shell' else 'text' end as language from e""")
def t8_code_language(spark, d):
    e = events(spark, d, code=SNIPPET, lang_class=LANG_CLASS, header="case when event_id % 3 = 0 then '  Rust   code ' end")
    return e.select("event_id", media.code_language(F.col("lang_class"), F.col("header"), F.col("code")).alias("language"))


DATES = "case k % 6 when 0 then '3h' when 1 then '12:34' when 2 then 'Jan 5' when 3 then '1:02:03' when 4 then '12.5K' else 'hello' end"


@query(f"""
    with {sql_events(label=DATES)}
    select event_id, k % 6 = 2 as date, k % 6 = 1 as duration, k % 6 = 4 as metric from e""")
def t14_kinds_of_labels(spark, d):
    label = F.col("label")
    return events(spark, d, label=DATES).select(
        "event_id", num.is_date_text(label).alias("date"), num.is_duration_text(label).alias("duration"), num.is_metric_text(label).alias("metric"))


STYLE = "concat('Color : red;; font-size:', cast(k as varchar(20)), 'px; broken; Text-Align:  center ;color:#', cast(event_id % 1000 as varchar(20)), case when event_id % 2 = 0 then ';font-weight:normal' else ';font-weight: 700' end, ';padding-bottom:', cast(k + 1 as varchar(20)), '%')"


@query(f"""
    with {sql_events(style=STYLE)}
    select event_id, 'color=red|font-size=' || k || 'px|text-align=center|color=#' || event_id % 1000 || '|font-weight=' ||
        case when event_id % 2 = 0 then 'normal' else '700' end || '|padding-bottom=' || (k + 1) || '%' as declarations from e""")
def t15_parse_style(spark, d):
    pairs = F.transform(css.parse_style(F.col("style")), lambda x: F.concat_ws("=", x["property"], x["value"]))
    return events(spark, d, style=STYLE).select("event_id", F.array_join(pairs, "|").alias("declarations"))


@query(f"""
    with {sql_events(style=STYLE)}
    select event_id, case k % 3
        when 0 then 'color: red; font-size: ' || k || 'px; text-align: center; color: #' || event_id % 1000 || '; font-weight: ' || w
        when 1 then 'color: red; font-size: ' || k || 'px; text-align: center; color: #' || event_id % 1000 || '; font-weight: ' || w
        else 'text-align: center' end as style
    from (select *, case when event_id % 2 = 0 then 'normal' else '700' end as w from e where k is not null)""")
def t16_filter_style(spark, d):
    k, no = F.col("k"), F.lit(False)
    context = {"link": no, "emphasis": no, "readable": k % 3 == 0, "code": k % 3 == 1, "table": no, "preformatted": no}
    return events(spark, d, style=STYLE).filter("k is not null").select(
        "event_id", css.filter_style(F.col("style"), context, {"preserve_props": ["Text-Align"]}).alias("style"))


@query(f"""
    with {sql_events(style=STYLE)}
    select event_id, floor(1000000.0 / (k + 1) + 0.5) / 10000 as ratio from e where k >= 0""")
def t18_padding_ratio(spark, d):
    return events(spark, d, style=STYLE).filter("k >= 0").select("event_id", css.padding_ratio(F.col("style")).alias("ratio"))


BACKGROUND = "concat('background:url(', case k % 3 when 0 then '' when 1 then '\"' else '&quot;' end, 'https://i.test/', cast(event_id as varchar(20)), '?a=1&amp;b=2', case k % 3 when 0 then '' when 1 then '\"' else '&quot;' end, case when event_id % 5 = 0 then '' else ')' end)"


@query(f"""
    with {sql_events()}
    select event_id, case when event_id % 5 <> 0 then 'https://i.test/' || event_id || '?a=1&b=2' end as url from e""")
def t19_background_url(spark, d):
    return events(spark, d, style=BACKGROUND).select("event_id", css.background_url(F.col("style")).alias("url"))


CDN = "concat('https://cdn.test/image/w_', cast(k + 1 as varchar(20)), ',h_', cast(event_id % 50 + 1 as varchar(20)), ',c_', case when event_id % 2 = 0 then 'limit' else 'fill' end, case when event_id % 3 = 0 then ',g_auto' else '' end, '/x.png')"


@query(f"""
    with {sql_events()}
    select event_id, floor((k + 1)::double / (event_id % 50 + 1) * 10000 + 0.5) / 10000 as ratio, case when event_id % 2 = 0 then 'contain' else 'cover' end as fit,
        case when event_id % 3 = 0 then 'center center' end as place, event_id % 2 = 0 and event_id % 4 = 0 as bleeds from e where k >= 0""")
def t20_cdn_image_meta(spark, d):
    meta = media.cdn_image_meta(F.col("src"), F.col("event_id") % 4 == 0)
    e = events(spark, d, src=CDN).filter("k >= 0").select("event_id", meta.alias("m"))
    return e.select("event_id", F.col("m.aspect_ratio").alias("ratio"), F.col("m.object_fit").alias("fit"), F.col("m.object_position").alias("place"),
                    F.col("m.visual_bleed_mode").isNotNull().alias("bleeds"))


SRCSET = "concat(case when event_id % 3 = 0 then ' , ' else '' end, 'https://s.test/', cast(event_id as varchar(20)), '.png ', cast(k as varchar(20)), 'w, https://s.test/big.png 2x')"


@query(f"with {sql_events()} select event_id, 'https://s.test/' || event_id || '.png' as src from e where k is not null")
def t21_first_srcset(spark, d):
    return events(spark, d, srcset=SRCSET).filter("k is not null").select("event_id", media.first_srcset(F.col("srcset")).alias("src"))


# ---- units, media, articles, reports --------------------------------------
def document_units(spark, d) -> DataFrame:
    """Each line of a document as a unit of it."""
    lines = table(spark, d, "documents").select(F.col("doc_id").alias("page_id"), F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return lines.select("page_id", F.lit("b").alias("block_id"), "n", F.length("line").alias("len"))


@query("""
    with lines as (select doc_id as page_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as n from documents),
    u as (select page_id, n, coalesce(sum(length(line) + 1) over (partition by page_id order by n rows between unbounded preceding and 1 preceding), 0) as s, length(line) as l from lines),
    r as (select doc_id as page_id, unnest([10, 200, 900]) as s from documents), q as (select page_id, s, s + 300 as e from r)
    select u.page_id, u.n::bigint as unit, greatest(u.s, q.s)::bigint as "start", least(u.s + l, q.e)::bigint as "end"
    from u join q on u.page_id = q.page_id and q.e > u.s and q.s < u.s + l where least(u.s + l, q.e) > greatest(u.s, q.s)""")
def r5_clip_annotations(spark, d):
    u = document_units(spark, d)
    start = F.coalesce(F.sum(F.col("len") + 1).over(Window.partitionBy("page_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    units = u.withColumn("start", start).select("page_id", "block_id", F.col("n").cast("string").alias("unit_id"), "start", (F.col("start") + F.col("len")).alias("end"))
    ranges = table(spark, d, "documents").select(
        F.col("doc_id").alias("page_id"), F.lit("b").alias("block_id"), F.explode(F.array(*map(F.lit, (10, 200, 900)))).alias("start"))
    clipped = un.clip_annotations(units, ranges.withColumn("end", F.col("start") + 300))
    return clipped.select("page_id", F.col("unit_id").cast("bigint").alias("unit"), F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"))


@query("""
    select doc_id, case when length(text) <= 20 then '01' else '010' end as kinds, text as joined from documents""")
def r6_text_runs(spark, d):
    link = F.struct(F.lit(5).alias("start"), F.lit(20).alias("end"), F.lit("h").alias("href"), F.lit(None).cast("boolean").alias("bold"))
    inner = F.struct(F.lit(7).alias("start"), F.lit(30).alias("end"), F.lit("i").alias("href"), F.lit(True).alias("bold"))
    runs = un.text_runs(F.col("text"), F.array(inner, link))
    t = table(spark, d, "documents").select("doc_id", runs.alias("runs"))
    return t.select(
        "doc_id", F.array_join(F.transform("runs", lambda r: F.when(r["annotated"], "1").otherwise("0")), "").alias("kinds"),
        F.array_join(F.transform("runs", lambda r: r["text"]), "").alias("joined"))


@query("""
    with l as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as n,
        len(string_split(text, chr(10))) as lines from documents),
    kept as (select * from l where lines > 1 or length(line) >= 40)
    select doc_id as article_id, count(*) as n_blocks, sha256(string_agg(line, '|' order by n)) as texts, bool_and(lines = 1) as clean_only
    from kept group by 1""")
def a5_merged_blocks(spark, d):
    """Documents of one line have no primary blocks, so their clean block passes through."""
    lines = un.paragraphs_of(table(spark, d, "documents")).withColumnRenamed("page_id", "article_id")
    block = make_block("paragraph", text=F.col("text"))
    rows = lines.select("article_id", "block_pos", "block_id", block.alias("block"))
    by_article = Window.partitionBy("article_id")
    primary = rows.withColumn("lines", F.count(F.lit(1)).over(by_article)).filter("lines > 1").drop("lines")
    clean = rows.filter(F.length("block.text") >= 40).withColumn("block_pos", F.row_number().over(by_article.orderBy("block_pos")) - 1)
    merged, stats = merge_extractions(primary, clean)
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("order", F.col("block.text").alias("text")))), lambda x: x["text"]), "|")
    found = merged.groupBy("article_id").agg(F.count(F.lit(1)).alias("n_blocks"), F.sha2(texts, 256).alias("texts"))
    return found.join(stats.select("article_id", (F.col("replaced") + F.col("fallback") == 0).alias("clean_only")), "article_id")


@query(f"""
    with {sql_events()}, m as (select k % 50 as page_id, event_id as link_id, case when event_id % 3 = 0 then '' else 'https://p.test/a/' || event_id % 9 end as href from e where k is not null),
    media as (select distinct k % 50 as page_id, event_id % 9 as n from e where event_type <> 'click' and k is not null)
    select m.page_id, link_id, case when media.n is not null then m.href when m.href <> '' then m.href end as href,
        case when media.n is not null then 'https://i.test/' || media.n when m.href <> '' then 'https://i.test/own' end as src
    from m left join media on m.page_id = media.page_id and m.href = 'https://p.test/a/' || media.n""")
def m2_lookup_media(spark, d):
    e = events(spark, d).filter("k is not null").withColumn("page_id", F.col("k") % 50)
    media_rows = e.filter("event_type <> 'click'").select("page_id", (F.col("event_id") % 9).alias("n")).distinct()
    inventory = media_rows.select(
        "page_id", F.col("n").alias("block_pos"), F.lit(0).alias("item_pos"), F.concat(F.lit("https://p.test/a/"), "n").alias("href"),
        F.concat(F.lit("https://i.test/"), "n").alias("src"), F.lit("alt").alias("alt"))
    bases = media_rows.select("page_id", F.lit("https://p.test/").alias("base_url")).distinct()
    asked = e.select(
        "page_id", F.col("event_id").alias("link_id"), F.when(F.col("event_id") % 3 == 0, "").otherwise(F.concat(F.lit("/a/"), F.col("event_id") % 9)).alias("rel"),
        F.lit("https://p.test/x").alias("base_url"), F.lit("https://i.test/own").alias("image_src"), F.lit("").alias("image_alt"))
    asked = asked.withColumn("href", F.when(F.col("rel") != "", F.concat(F.lit("https://p.test"), "rel")).otherwise(""))
    return links.lookup_media(asked, links.media_keys(inventory, bases)).select("page_id", "link_id", "href", "src")


@query(f"""
    with {sql_events()} select 'c' || k % 17 as component, count(*) as n_seen from e where k % 17 >= 5 group by 1""")
def g6_component_coverage(spark, d):
    seen = events(spark, d).select(F.concat(F.lit("c"), F.col("k") % 17).alias("component")).filter("component is not null")
    known = seen.filter("cast(substring(component, 2) as int) < 5").distinct()
    return rep.component_coverage(seen, known)


@query(f"""
    with {sql_events()}
    select event_id, case when k % 5 <> 0 or event_id % 2 = 0 then case when k % 5 <> 0 then 'n' || k else case when event_id % 2 = 0 then 'flat' end end end as name,
        event_id % 3 = 0 and value > 0 as with_metrics from e where k is not null and (k % 5 <> 0 or event_id % 2 = 0)""")
def a9_canonical_header(spark, d):
    e = events(spark, d).filter("k is not null")
    none = F.lit(None).cast("string")
    flag = F.lit(None).cast("boolean")
    rows = e.select(
        "event_id", F.struct(F.when(F.col("k") % 5 != 0, F.concat(F.lit("n"), "k")).alias("name"), none.alias("handle"), none.alias("avatar_url"),
                             none.alias("profile_url"), flag.alias("verified")).alias("author"),
        F.when(F.col("event_id") % 2 == 0, F.lit("flat")).alias("author_name"), none.alias("author_handle"), none.alias("author_avatar_url"),
        none.alias("canonical_url"), flag.alias("author_verified"), none.alias("published_at_text"),
        F.when(F.col("event_id") % 3 == 0, F.create_map(F.lit("likes"), F.when(F.col("value") > 0, "5").otherwise(""))).alias("engagement"),
        F.lit(None).cast("map<string,string>").alias("metrics"))
    h = art.canonical_header(rows)
    return h.filter("header is not null").select("event_id", F.col("header.name").alias("name"), F.col("header_metrics").isNotNull().alias("with_metrics"))


@query(f"""
    with {sql_events()}, c as (select user_id as tab_id, row_number() over (partition by user_id order by ts, event_id) as n,
      case when event_id % 97 = 0 then null else 'reason-' || k end as why from e where k is not null),
    s as (select tab_id, min(n) filter (why is null) as ready_at, max(n) as checked, arg_max(why, n) as last from c where n <= 40 group by 1)
    select tab_id, case when ready_at is null then 'NOT_READY' else 'READY' end as state, case when ready_at is null then last end as reason,
        coalesce(ready_at, checked) * 250 as waited_ms from s""")
def st9_readiness_budget(spark, d):
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    e = events(spark, d).filter("k is not null").withColumn("check_no", n)
    why = F.when(F.col("event_id") % 97 != 0, F.concat(F.lit("reason-"), "k"))
    return stab.readiness_budget(e.select(F.col("user_id").alias("tab_id"), "check_no", why.alias("not_ready"))).withColumn(
        "waited_ms", F.col("waited_ms").cast("bigint"))


# ---- captures ------------------------------------------------------------
REQUEST = "concat('https://video.test/amplify_video/', cast(k as varchar(20)), case event_id % 5 when 0 then '/pl/playlist.m3u8' when 1 then '/pl/avc1/480x270/a.m3u8' when 2 then '/pl/avc1/1280x720/a.m3u8' when 3 then '/pl/mp4a/32000/c.m3u8' else '/vid/x.mp4' end, '?t=', cast(event_id as varchar(20)))"
SQL_SLOTS = f"""{sql_events(url=REQUEST)},
    slots as (select *, case event_id % 5 when 0 then 'master' when 3 then 'audio' else 'variant' end as slot,
      case event_id % 5 when 0 then '' when 1 then '480x270' when 2 then '1280x720' else '32000' end as label from e where event_id % 5 < 4 and k is not null),
    latest as (select user_id as tab_id, k::varchar as video_id, slot, label, arg_max(url, (ts, event_id)) as url from slots group by all)"""


def requests(spark, d) -> DataFrame:
    return events(spark, d, url=REQUEST).filter("k is not null").select(F.col("user_id").alias("tab_id"), "ts", F.col("event_id").alias("seq"), "url", "event_type")


@query(f"with {SQL_SLOTS} select * from latest")
def st1_latest_slots(spark, d):
    return cap.latest_slots(requests(spark, d)).select("tab_id", "video_id", "slot", "label", "url")


@query(f"""
    with {sql_events()}, cleared as (select user_id, max(ts) as gone from e where event_type = 'view' group by 1)
    select user_id as tab_id, count(*) as n from e left join cleared using (user_id) where k is not null and (gone is null or ts > gone) group by 1""")
def st2_drop_before_navigation(spark, d):
    kept = cap.drop_before_navigation(requests(spark, d), table(spark, d, "events").filter("event_type = 'view'").select(F.col("user_id").alias("tab_id"), "ts"))
    return kept.groupBy("tab_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
    with {SQL_SLOTS}, v as (
      select tab_id, video_id, max(url) filter (slot = 'master') as master, max(url) filter (label = '1280x720') as big, max(url) filter (label = '480x270') as small,
        max(url) filter (slot = 'audio') as audio from latest group by 1, 2)
    select tab_id, video_id, coalesce(master, big, small, '') as src, audio, (big is not null)::int + (small is not null)::int as n_variants from v""")
def st4_choose_source(spark, d):
    chosen = cap.choose_source(cap.captured_videos(cap.latest_slots(requests(spark, d))))
    return chosen.select("tab_id", "video_id", "src", F.col("hls.audio").alias("audio"), F.size("hls.video_playlists").alias("n_variants"))


@query(f"""
    with {SQL_SLOTS}, v as (select distinct tab_id, video_id from latest), players as (select event_id as player_id, user_id as tab_id, k from e where k is not null)
    select player_id, p.tab_id, v.video_id from players p left join v on v.tab_id = p.tab_id and v.video_id = (case when player_id % 4 = 0 then -1 else k end)::varchar""")
def st3_match_videos(spark, d):
    players = events(spark, d).filter("k is not null").select(
        F.col("event_id").alias("player_id"), F.col("user_id").alias("tab_id"), F.lit(None).cast("string").alias("poster"),
        F.when(F.col("event_id") % 4 == 0, "blob:none").otherwise(F.concat(F.lit("https://v.test/amplify_video/"), "k", F.lit("/x"))).alias("src"))
    videos = cap.captured_videos(cap.latest_slots(requests(spark, d)))
    return cap.match_videos(players, videos)


# ---- blocks spelled from lines and events ----------------------------------
NORMAL = "length(trim(regexp_replace(line, '[\\t\\n\\x0B\\f\\r ]+', ' ', 'g'), ' '))"


@query(f"""
    with l as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as n from documents),
    s as (select doc_id, n % 5 as kind, {NORMAL} as len from l)
    select doc_id, sum(case kind when 0 then len when 1 then len when 2 then 2 * len when 3 then len when 4 then len end)::bigint as text_length,
        sum(case kind when 0 then len when 1 then len when 2 then 2 * len when 3 then case when len = 0 then 2 else len + 3 end when 4 then len end)::bigint as strict_length
    from s group by 1""")
def a2_block_text_length(spark, d):
    """Lines as paragraph, quote, list of two, code and table blocks in turn."""
    lines = un.paragraphs_of(table(spark, d, "documents"))
    text = F.col("text")
    item = F.struct(text.alias("text"))
    kinds = [
        make_block("paragraph", text=text), make_block("quote", text=text),
        make_block("list", items=F.transform(F.array(item, item), lambda i: F.struct(i["text"].alias("text"), F.lit(None).cast(schema.ANNOTATIONS).alias("annotations"), F.lit(None).cast(schema.STYLE).alias("style")))),
        make_block("code", text=text, code=F.struct(F.lit("ts").alias("language"), F.lit(None).cast("array<string>").alias("tokens"))),
        make_block("table", table=F.struct(F.array(F.array(F.struct(
            text.alias("text"), F.lit(False).alias("header"), F.lit(1).alias("col_span"), F.lit(1).alias("row_span"), F.lit(None).cast(schema.STYLE).alias("style")))).alias("rows"),
            F.lit(1).alias("column_count"))),
    ]
    block = F.element_at(F.array(*kinds), (F.col("block_pos") % 5 + 1).cast("int"))
    sized = lines.select(F.col("page_id").alias("doc_id"), block.alias("b"))
    total = lambda c: F.sum(c).cast("bigint")
    return sized.groupBy("doc_id").agg(
        total(art.block_text_length(F.col("b"))).alias("text_length"), total(art.block_text_length(F.col("b"), strict=True)).alias("strict_length"))


@query(f"""
    with {sql_events()}, m as (select k % 40 as page_id, event_id as pos, 'https://p.test/i/' || event_id % 30 || case when event_id % 4 = 0 then '#f' else '' end as href, event_id from e where k is not null),
    f as (select *, min(pos) over (partition by page_id, event_id % 30) as first_bare from m)
    select page_id, pos as block_pos, href from f where pos = first_bare""")
def m1_media_list(spark, d):
    """Linked images in reading order; one whose address an earlier one had, fragment aside, is left out."""
    e = events(spark, d).filter("k is not null")
    href = F.concat(F.lit("https://p.test/i/"), F.col("event_id") % 30, F.when(F.col("event_id") % 4 == 0, "#f").otherwise(""))
    image = F.struct(*[(href if f == "href" else F.lit("https://i.test/x.png") if f == "src" else F.lit(None)).cast(t).alias(f) for f, t in IMAGE_FIELDS])
    blocks = e.select((F.col("k") % 40).alias("page_id"), F.col("event_id").alias("block_pos"), make_block("image", image=image).alias("b")).select("page_id", "block_pos", "b.*")
    pages = blocks.select("page_id").distinct().withColumns({"base_url": F.lit("https://p.test/"), "cover": F.lit(None).cast(schema.IMAGE)})
    return links.media_list(links.media_inventory(pages, blocks), pages).select("page_id", "block_pos", "href")


@query(f"""
    with {sql_events()}
    select event_id, case when k % 4 = 0 then 'kept'
        else concat_ws(',', case when event_id % 2 = 0 then 'text' end, case k % 4 when 1 then 'photo' when 2 then 'photo-group' when 3 then case when event_id % 5 = 0 then 'article-cover' end end) end as kinds
    from e where k is not null""")
def a8_upgrade_posts(spark, d):
    """Old records by turns with items, one photo, two photos, or a cover at most."""
    e = events(spark, d).filter("k is not null")
    k, photo = F.col("k") % 4, F.struct(*[F.lit("p").cast("string").alias(f) for f in ("src", "display_src", "alt", "href")])
    kept = F.from_json(F.lit('[{"type":"kept"}]'), f"array<{schema.ITEM}>")
    posts = e.select(
        "event_id", F.when(F.col("event_id") % 2 == 0, "some words").otherwise("").alias("excerpt"), F.lit(None).cast(schema.VIDEO).alias("video"),
        F.when(k == 1, F.array(photo)).when(k == 2, F.array(photo, photo)).alias("photos"),
        F.when((k == 3) & (F.col("event_id") % 5 == 0), "https://i.test/c").alias("cover_url"), F.lit("t").alias("title"), F.lit("h").alias("href"),
        F.when(k == 0, kept).alias("items"))
    return art.upgrade_posts(posts).select("event_id", F.array_join(F.transform("items", lambda i: i["type"]), ",").alias("kinds"))


# ---- code tokens, equivalence keys, stored articles ------------------------------------------------
CODE = "concat('const a', cast(k as varchar(20)), ' = \"s', cast(k as varchar(20)), '\"; return ', cast(event_id as varchar(20)), '; // note ', cast(k as varchar(20)))"
HTML = "concat('<div class=\"c', cast(k as varchar(20)), '\">t', cast(event_id as varchar(20)), '</div>')"
NOTES = "concat('# Head ', cast(k as varchar(20)), chr(10), '- item', chr(10), 'plain ', cast(event_id as varchar(20)))"
TOKEN_KINDS = [("ts", CODE), ("html", HTML), ("md", NOTES)]


@query(f"""
    with {sql_events()}, t as (select event_id, k, unnest(case event_id % 3
        when 0 then ['keyword:const', 'string:"s' || k || '"', 'keyword:return', 'number:' || event_id, 'comment:// note ' || k]
        when 1 then ['tag:<div', 'keyword:class', 'string:"c' || k || '"', 'punctuation:>', 'tag:</div', 'punctuation:>']
        else ['punctuation:#', 'heading: Head ' || k, 'punctuation:-'] end) as token,
        generate_subscripts(case event_id % 3 when 0 then [1,2,3,4,5] when 1 then [1,2,3,4,5,6] else [1,2,3] end, 1) - 1 as pos from e where k is not null)
    select event_id, pos::bigint as pos, token from t""")
def t9_code_tokens(spark, d):
    pick = lambda i: F.coalesce(*[F.when(F.col("event_id") % 3 == n, c[i]) for n, c in enumerate(
        [(F.lit(lang), F.expr(sql)) for lang, sql in TOKEN_KINDS])])
    e = events(spark, d).filter("k is not null")
    tokens = media.code_tokens(pick(1), pick(0))
    rows = e.select("event_id", F.posexplode(tokens).alias("pos", "t"))
    return rows.select("event_id", F.col("pos").cast("bigint").alias("pos"), F.concat_ws(":", "t.kind", "t.token").alias("token"))


SQL_SAME = f"trim(regexp_replace(regexp_replace(line, '[{txt.WS}]+', ' ', 'g'), ' +([{txt.PUNCTUATION_AFTER_SPACE}])', '\\1', 'g'), ' ')"


@query(f"""
    with l as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as n from documents),
    s as (select doc_id, n % 4 as kind, case when n % 4 = 1 then n % 3 + 1 end as level, case when n % 4 = 3 then null else {SQL_SAME} end as body from l)
    select doc_id, count(*) as n_blocks, count(distinct (kind, level, body)) as n_different from s group by 1""")
def a6_equivalence_keys(spark, d):
    """Lines as paragraphs, headings, quotes and dividers in turn: how many blocks of a document say something of their own."""
    lines = un.paragraphs_of(table(spark, d, "documents"))
    text = F.col("text")
    kinds = [make_block("paragraph", text=text), make_block("heading", text=text, level=(F.col("block_pos") % 3 + 1).cast("int")),
             make_block("quote", text=text), make_block("divider")]
    block = F.element_at(F.array(*kinds), (F.col("block_pos") % 4 + 1).cast("int"))
    keyed = lines.select(F.col("page_id").alias("doc_id"), block_equivalence_key(block).alias("key"))
    return keyed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_blocks"), F.countDistinct("key").alias("n_different"))


@query("""
    select doc_id % 6 as kind, case doc_id % 6 when 1 then 'missing_title' when 2 then 'missing_blocks' when 3 then 'broken_block' when 4 then 'corrupt_record'
        when 5 then 'missing_id' else 'good' end as outcome, count(*) as n from documents group by 1, 2""")
def s2_read_articles(spark, d):
    """Documents written as stored articles, one JSON object a line, most kinds of them broken in some way, and read again."""
    kind = F.col("doc_id") % 6
    some = lambda c, k: F.when(kind != k, c)
    block = F.struct(F.lit("b").alias("id"), some(F.lit("paragraph"), 3).alias("type"), F.substring("text", 1, 200).alias("text"))
    article = F.to_json(F.struct(some(F.col("doc_id").cast("string"), 5).alias("id"), some(F.col("lang"), 1).alias("title"),
                                 F.col("doc_id").alias("extractedAt"), some(F.array(block), 2).alias("blocks")))
    line = F.when(kind == 4, F.concat(F.lit('{"extractedAt":'), "doc_id")).otherwise(article)
    path = f"{shared_dir(spark)}/articles-{uuid.uuid4().hex}"
    table(spark, d, "documents").select(line.alias("value")).write.text(path)
    good, bad = read_articles(spark, path)
    # a broken line keeps nothing but its own text
    number = F.coalesce("extractedAt", F.regexp_extract("corrupt", "([0-9]+)$", 1).try_cast("bigint")) % 6
    seen = bad.select(number.alias("kind"), F.col("problem").alias("outcome"))
    return good.select((F.col("extractedAt") % 6).alias("kind"), F.lit("good").alias("outcome")).unionByName(seen).groupBy("kind", "outcome").agg(
        F.count(F.lit(1)).alias("n"))

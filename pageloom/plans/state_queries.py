"""Registered queries of stores and streams over the given events, each with its SQL twin beside it. Streams read the table as a
source, run to its end and leave their result in a store."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir
from ..sources.keyed_store import KeyedStore
from ..sources.pages import dump_stages, read_stage
from ..streaming import captures as cap
from ..streaming import progress as prog
from .more_queries import REQUEST, SQL_SLOTS, query, sql_events
from .queries import table

VERSION = "article_id bigint, ts timestamp, event_id bigint, event_type string, value double"


def store_of(spark, schema: str, keys: tuple[str, ...], order: tuple[str, ...]) -> KeyedStore:
    return KeyedStore(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}", schema, keys, order, buckets=8)


def _filled(spark, d) -> KeyedStore:
    """Events as versions of articles, in three batches of which one is repeated; great values of the last batch are deletions."""
    rows = table(spark, d, "events").select(F.col("user_id").alias("article_id"), "ts", "event_id", "event_type", "value")
    store = store_of(spark, VERSION, ("article_id",), ("ts", "event_id"))
    store.write(rows.filter("event_id % 3 = 0"), 0)
    for _ in range(2):
        store.write(rows.filter("event_id % 3 = 1"), 1)
    store.compact(0)
    store.write(rows.filter("event_id % 3 = 2"), 2, F.col("value") > 250)
    return store


LAST = """last as (select user_id, arg_max(struct_pack(event_id, event_type, value), (ts, event_id)) as v from events group by 1),
    kept as (select user_id as article_id, v.event_id as event_id, v.event_type as event_type, v.value as value from last
      where not (v.event_id % 3 = 2 and coalesce(v.value > 250, false)))"""


@query(f"with {LAST} select * from kept")
def s3_keyed_store(spark, d):
    store = _filled(spark, d)
    store.compact()
    return store.read().select("article_id", "event_id", "event_type", "value")


@query(f"""
    with {LAST}, asked as (select distinct user_id * 2 as article_id from events)
    select a.article_id, event_id, event_type, value from asked a left join kept k on k.article_id = a.article_id""")
def s4_store_lookup(spark, d):
    ids = table(spark, d, "events").select((F.col("user_id") * 2).alias("article_id")).distinct()
    return _filled(spark, d).get(ids).select("article_id", "event_id", "event_type", "value")


def event_stream(spark, d) -> DataFrame:
    """The events table as a stream; the pattern makes a source of a single file as well as of a folder."""
    schema = table(spark, d, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{d}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))
    return events.withColumn("k", F.expr("cast(get_json_object(props, '$.k') as bigint)"))


def run_into(stream: DataFrame, store: KeyedStore) -> DataFrame:
    """Runs a stream to the end of its source; what its sink holds then."""
    out = stream.writeStream.outputMode("update").foreachBatch(store.sink()).trigger(availableNow=True)
    run = out.option("checkpointLocation", f"{store.path}-checkpoint").start()
    run.awaitTermination()
    return store.read()


@query(f"""
    with {SQL_SLOTS.replace(", latest as", ", all_slots as")},
    moves as (select user_id as tab_id, max((ts, event_id)) as gone from e where event_type = 'view' and event_id % 7 = 0 group by 1),
    seen as (select user_id as tab_id, k::varchar as video_id, slot, label, url, ts, event_id from slots
      union all select user_id, k::varchar, 'poster', '', 'https://img.test/' || event_id, ts, event_id from e where event_type = 'purchase' and k is not null and event_id % 2 = 0),
    kept as (select seen.* from seen left join moves using (tab_id) where gone is null or (ts, event_id) > gone)
    select tab_id, video_id, arg_max(url, (ts, event_id)) filter (slot = 'master') as master, arg_max(url, (ts, event_id)) filter (label = '480x270') as small,
        arg_max(url, (ts, event_id)) filter (label = '1280x720') as big, arg_max(url, (ts, event_id)) filter (slot = 'audio') as audio,
        arg_max(url, (ts, event_id)) filter (slot = 'poster') as poster from kept group by 1, 2""")
def st3_stream_captures(spark, d):
    """Requests, posters and navigations as three streams: what each tab holds at their end."""
    e = lambda: event_stream(spark, d)
    tab, seq = F.col("user_id").alias("tab_id"), F.col("event_id").alias("seq")
    asked = e().filter("k is not null").select(tab, "ts", seq, F.expr(REQUEST).alias("url"))
    moves = e().filter("event_type = 'view' and event_id % 7 = 0").select(tab, "ts", seq)
    poster = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("https://img.test/"), "event_id")).otherwise("")
    posters = e().filter("event_type = 'purchase' and k is not null").select(tab, "ts", seq, F.col("k").cast("string").alias("video_id"), poster.alias("poster"))
    changes = cap.stream_slots(asked, moves, posters, late="365 days", idle="3650 days")
    keys = ("tab_id", "video_id", "slot", "label")
    store = store_of(spark, "tab_id bigint, video_id string, slot string, label string, url string, ts timestamp, version bigint", keys, ("version",))
    videos = cap.captured_videos(cap.latest_entries(run_into(changes, store)))
    variant = lambda label: F.try_element_at("variants", F.lit(label))
    return videos.select("tab_id", "video_id", "master", variant("480x270").alias("small"), variant("1280x720").alias("big"),
                         F.try_element_at("audio", F.lit("32000")).alias("audio"), "poster")


@query(f"""
    with {sql_events()}, p as (select user_id as reader_id, k % 20 as article_id, event_id, epoch_us(ts) // 1000 as updated_at, 'b' || k % 7 || '-u' || k as unit_id
      from e where k is not null and event_id % 11 <> 0)
    select reader_id, article_id, arg_max(unit_id, (updated_at, event_id)) as unit_id, max(updated_at) as updated_at from p group by 1, 2""")
def st5_stream_progress(spark, d):
    """Saved progress as a stream of JSON, some of it broken, into a store of the last value per reader and article."""
    unit = F.concat(F.lit("b"), F.col("k") % 7, F.lit("-u"), "k")
    saved = F.to_json(F.struct(unit.alias("unit_id"), F.col("k").cast("int").alias("focus_index"), F.unix_millis("ts").alias("updated_at")))
    raw = event_stream(spark, d).filter("k is not null").select(
        F.col("user_id").alias("reader_id"), (F.col("k") % 20).alias("article_id"), "event_id",
        F.when(F.col("event_id") % 11 == 0, F.concat(F.lit("{"), "event_id")).otherwise(saved).alias("value"))
    keys, order = ("reader_id", "article_id"), ("updated_at", "event_id")
    store = store_of(spark, "reader_id bigint, article_id bigint, event_id bigint, unit_id string, updated_at bigint", keys, order)
    latest = prog.latest_progress(prog.parse_progress(raw).drop("focus_index"), keys, order)
    return run_into(latest, store).select("reader_id", "article_id", "unit_id", "updated_at")


@query("""
    select page_id, 'pages' as stage, url as value from pages union all select page_id, 'sizes', length(html)::varchar from pages where page_id % 2 = 0""")
def s7_stage_dumps(spark, d):
    """Two stages of a run dumped twice, the second time another choice of rows for one of them."""
    p, path = table(spark, d, "pages"), f"{shared_dir(spark)}/stages-{uuid.uuid4().hex}"
    sizes = p.select("page_id", F.length("html").cast("string").alias("value"))
    dump_stages(path, "first", pages=p.select("page_id", F.col("url").alias("value")), sizes=sizes)
    dump_stages(path, "second", sizes=sizes)
    dump_stages(path, "first", sizes=sizes.filter("page_id % 2 = 0"))
    dumped = [read_stage(spark, path, s, "first").withColumn("stage", F.lit(s)) for s in ("pages", "sizes")]
    return dumped[0].unionByName(dumped[1]).select("page_id", "stage", F.get_json_object("row", "$.value").alias("value"))

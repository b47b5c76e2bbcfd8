"""ST1-ST4: video playlists seen on the network, per tab and video."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..kernels import ship_by_value
from ..schema import HLS

ship_by_value(__name__)

# Fixed values.
VIDEO_ID = "amplify_video/([0-9]+)/"
POSTER_ID = "amplify_video(?:_thumb)?/([0-9]+)"
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1
STORE_CONF = "spark.sql.streaming.stateStore.providerClass"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def classify_requests(requests: DataFrame) -> DataFrame:
    """Playlist requests as (tab, video, slot, label, url); everything else is dropped. `seq` orders requests of one
    moment; without that column the greater URL is the later one."""
    if "seq" not in requests.columns:
        requests = requests.withColumn("seq", F.lit(0))
    url = F.col("url")
    resolution = F.regexp_extract(url, "/([0-9]+x[0-9]+)/", 1)
    bitrate = F.regexp_extract(url, "/pl/mp4a/([^/]+)/", 1)
    slot = (
        F.when(url.contains("/pl/playlist.m3u8"), "master")
        .when(url.contains("/pl/avc1/"), F.when(resolution != "", "variant"))
        .when(url.contains("/pl/mp4a/"), F.when(bitrate != "", "audio"))
    )
    label = F.when(slot == "variant", resolution).when(slot == "audio", bitrate).otherwise(F.lit(""))
    kept = requests.filter((F.col("tab_id") >= 0) & url.contains(".m3u8") & F.regexp_like(url, F.lit(VIDEO_ID)))
    return kept.select(
        "tab_id", "ts", "seq", F.regexp_extract(url, VIDEO_ID, 1).alias("video_id"), slot.alias("slot"), label.alias("label"), "url"
    ).filter("slot is not null")


def latest_slots(requests: DataFrame) -> DataFrame:
    """ST1: last URL per (tab, video, slot, label). Partial aggregates absorb a hot tab."""
    return classify_requests(requests).groupBy("tab_id", "video_id", "slot", "label").agg(
        F.max_by("url", F.struct("ts", "seq", "url")).alias("url"), F.max("ts").alias("ts")
    )


def drop_before_navigation(requests: DataFrame, navigations: DataFrame) -> DataFrame:
    """ST2, batch: a navigation clears what its tab captured before. One aggregated row per tab joins.

    `seq` orders rows of one moment, a null seq comes first. A navigation without that column is the last of its moment."""
    place = lambda df, other: F.struct("ts", (
        F.coalesce(F.col("seq").cast("bigint"), F.lit(LOWEST)) if "seq" in df.columns else F.lit(other)).alias("seq"))
    last = navigations.groupBy("tab_id").agg(F.max(place(navigations, HIGHEST)).alias("cleared_at"))
    joined = requests.withColumn("place", place(requests, LOWEST)).join(last, "tab_id", "left")
    return joined.filter(F.col("cleared_at").isNull() | (F.col("place") > F.col("cleared_at"))).drop("cleared_at", "place")


def poster_entries(posters: DataFrame) -> DataFrame:
    """ST3: posters (tab_id, ts, video_id, poster) as entries of the slot `poster`."""
    if "seq" not in posters.columns:
        posters = posters.withColumn("seq", F.lit(0))
    some = posters.filter("coalesce(poster, '') <> '' and coalesce(video_id, '') <> ''")
    return some.select("tab_id", "ts", "seq", "video_id", F.lit("poster").alias("slot"), F.lit("").alias("label"), F.col("poster").alias("url"))


def latest_entries(entries: DataFrame) -> DataFrame:
    """ST1-ST3, from the changes of `stream_slots`: the last state of each entry that is not cleared."""
    last = F.max_by(F.struct("url", "ts"), "version")
    return entries.groupBy("tab_id", "video_id", "slot", "label").agg(last.alias("v")).select(
        "tab_id", "video_id", "slot", "label", "v.*").filter("url is not null")


def captured_videos(slots: DataFrame, posters: DataFrame | None = None) -> DataFrame:
    """ST1+ST3: one row per (tab, video): master, variants and audio by label, poster. `slots` may hold posters as entries of
    their own (`poster_entries`); `posters` adds rows of (tab_id, ts, video_id, poster)."""
    slots = slots.select("tab_id", "video_id", "slot", "label", "url")
    if posters is not None:
        latest = poster_entries(posters).groupBy("tab_id", "video_id", "slot", "label").agg(F.max_by("url", F.struct("ts", "seq", "url")).alias("url"))
        slots = slots.unionByName(latest)
    pick = lambda kind: F.map_from_entries(F.array_compact(F.collect_list(F.when(F.col("slot") == kind, F.struct("label", "url")))))
    one = lambda kind: F.max(F.when(F.col("slot") == kind, F.col("url")))
    return slots.groupBy("tab_id", "video_id").agg(
        one("master").alias("master"), pick("variant").alias("variants"), pick("audio").alias("audio"), one("poster").alias("poster"))


def _area(label: Column) -> Column:
    w = F.coalesce(F.regexp_extract(label, "^([0-9]+)x", 1).try_cast("bigint"), F.lit(0))
    h = F.coalesce(F.regexp_extract(label, "x([0-9]+)$", 1).try_cast("bigint"), F.lit(0))
    return w * h


def choose_source(videos: DataFrame) -> DataFrame:
    """ST4: variants by area, best audio bitrate, master first, else the largest variant."""
    variants = F.transform(F.map_entries("variants"), lambda e: F.struct((-_area(e["key"])).alias("o"), e["key"].alias("key"), e["value"].alias("value")))
    playlists = F.transform(F.array_sort(variants), lambda e: F.struct(
        e["key"].alias("resolution"), F.regexp_extract(e["key"], "^([0-9]+)x", 1).try_cast("int").alias("width"),
        F.regexp_extract(e["key"], "x([0-9]+)$", 1).try_cast("int").alias("height"), e["value"].alias("url"),
    ))
    audio = F.array_max(F.transform(F.map_entries("audio"), lambda e: F.struct(e["key"].try_cast("double").alias("o"), e["value"].alias("url"))))
    staged = videos.withColumns({"playlists": F.coalesce(playlists, F.slice(playlists, 1, 0)), "best_audio": audio["url"]})
    hls = F.struct(F.col("master").alias("master"), F.col("best_audio").alias("audio"), F.col("playlists").alias("video_playlists")).cast(HLS)
    any_part = F.col("master").isNotNull() | F.col("best_audio").isNotNull() | (F.coalesce(F.size("playlists"), F.lit(0)) > 0)
    return staged.select(
        "tab_id", "video_id", "poster", F.when(any_part, hls).alias("hls"),
        F.coalesce("master", F.get("playlists", F.lit(0))["url"], F.lit("")).alias("src"),
    )


def match_videos(players: DataFrame, videos: DataFrame) -> DataFrame:
    """ST3: players (player_id, tab_id, poster, src) to captures: by id first, by equal poster for the rest."""
    ids = F.array_compact(F.array(*[
        F.nullif(F.regexp_extract(F.col(c), POSTER_ID, 1), F.lit("")) for c in ("poster", "src")
    ]))
    keyed = players.withColumn("k", F.explode_outer(
        F.transform(ids, lambda v, i: F.struct(i.alias("pos"), v.alias("video_id")))
    ))
    v = videos.withColumnRenamed("poster", "captured_poster")
    by_id = keyed.join(
        v.withColumnRenamed("video_id", "vid"), (F.col("k.video_id") == F.col("vid")) & (keyed["tab_id"] == v["tab_id"]), "left"
    ).groupBy("player_id").agg(F.min_by(F.struct("vid", "captured_poster"), F.when(F.col("vid").isNotNull(), F.col("k.pos"))).alias("m"))
    first = v.filter("captured_poster is not null").groupBy("tab_id", "captured_poster").agg(F.min("video_id").alias("poster_vid"))
    base = players.join(by_id, "player_id", "left")
    rest = base.join(first, (base["poster"] == first["captured_poster"]) & (base["tab_id"] == first["tab_id"]), "left")
    return rest.select("player_id", players["tab_id"], F.coalesce("m.vid", "poster_vid").alias("video_id"))


ENTRY = "video_id string, slot string, label string"
HELD = "at bigint, seq bigint, url string"
CHANGE = "video_id string, slot string, label string, url string, at bigint, version bigint"


class TabCaptures(StatefulProcessor):
    """What one tab has captured: an entry per (video, slot, label) with its last URL, posters among them.

    A navigation clears all entries up to its moment. Rows may come in any order: an entry gives way only to a later one, and
    what is older than the last navigation never comes back. A tab without rows for `idle_ms` of event time is forgotten.
    """

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getMapState("entries", ENTRY, HELD)
        self.cleared = handle.getValueState("cleared", "at bigint, seq bigint")
        self.version = handle.getValueState("version", "version bigint")

    def handleInputRows(self, key, rows, timerValues):
        # every call to the state is a round trip, and a tab seen for the first time holds nothing to ask for
        known = self.version.exists()
        cleared = tuple(self.cleared.get()) if known and self.cleared.exists() else None
        last, newest, seen = None, {}, LOWEST
        for r in rows:  # of the rows of one entry only the last can matter
            place = (r.at, r.seq)
            seen = max(seen, r.at)
            if r.slot is None:
                last = place if last is None else max(last, place)
                continue
            name, held = (r.video_id, r.slot, r.label), (*place, r.url)
            if name not in newest or held > newest[name]:
                newest[name] = held
        out = []
        if last is not None and (cleared is None or last > cleared):
            cleared = last
            self.cleared.update(cleared)
            out += self.clear_up_to(cleared) if known else []
        for name, held in newest.items():
            if cleared is not None and held[:2] <= cleared:
                continue
            if not known or not self.entries.containsKey(name) or held > tuple(self.entries.getValue(name)):
                self.entries.updateValue(name, held)
                out.append((*name, held[2], held[0]))
        for timer in list(self.handle.listTimers()) if known else []:
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max(seen // 1000, timerValues.getCurrentWatermarkInMs()) + self.idle_ms)
        return self.numbered(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        changes = list(self.numbered(key, self.clear_up_to((HIGHEST, HIGHEST))))
        for state in (self.entries, self.cleared, self.version):
            state.clear()
        return iter(changes)

    def clear_up_to(self, place):
        """Drops entries up to a place; what changes by that."""
        gone = [(tuple(name), held[0]) for name, held in self.entries.iterator() if tuple(held[:2]) <= place] if self.entries.exists() else []
        for name, _ in gone:
            self.entries.removeKey(name)
        return [(*name, None, at) for name, at in gone]

    def numbered(self, key, changes):
        version = self.version.get()[0] if self.version.exists() else 0
        self.version.update((version + len(changes),))
        row = Row("tab_id", *[field.split()[0] for field in CHANGE.split(", ")])
        return (row(*key, *change, version + i + 1) for i, change in enumerate(changes))

    def close(self) -> None:
        pass


def stream_slots(
    requests: DataFrame, navigations: DataFrame | None = None, posters: DataFrame | None = None, *, late: str = "1 hour",
    idle: str = "1 day",
) -> DataFrame:
    """ST1-ST3 on streams: in update mode, each change of a (tab, video, slot, label): its last URL since the tab's last
    navigation, or a null url where it is cleared. `version` numbers the changes of a tab, so the greatest one of an entry is
    its state. Posters are entries of the slot `poster`. Empty posters and ids count for nothing.

    Rows that are `late` behind the newest are dropped by the watermark; tabs without rows for `idle` are forgotten, which
    shows as cleared entries. The state is one map per tab, written entry by entry. Needs the RocksDB state store.

    requests: tab_id, ts, seq, url. navigations: tab_id, ts, seq. posters: tab_id, ts, seq, video_id, poster."""
    spark = requests.sparkSession
    spark.conf.set(STORE_CONF, STORE)
    none = F.lit(None).cast("string")
    columns = ["tab_id", "ts", "seq", "video_id", "slot", "label", "url"]
    seq = F.coalesce(F.col("seq").cast("bigint"), F.lit(LOWEST)).alias("seq")
    parts = [classify_requests(requests).withColumn("seq", seq)]
    if navigations is not None:
        parts.append(navigations.select("tab_id", "ts", seq, *[none.alias(c) for c in ("video_id", "slot", "label", "url")]))
    if posters is not None:
        parts.append(poster_entries(posters).withColumn("seq", seq))
    moment = F.col("ts").cast("timestamp").alias("ts")
    seen = reduce(lambda a, b: a.unionByName(b), [p.select("tab_id", moment, *columns[2:]) for p in parts]).withWatermark("ts", late)
    idle_ms = int(spark.sql(f"select unix_millis(timestamp '1970-01-01 00:00:00Z' + interval {idle})").first()[0])
    tab = f"tab_id {seen.schema['tab_id'].dataType.simpleString()}"
    changes = seen.withColumn("at", F.unix_micros("ts")).groupBy("tab_id").transformWithState(
        TabCaptures(idle_ms), f"{tab}, {CHANGE}", "Update", "EventTime")
    return changes.select("tab_id", "video_id", "slot", "label", "url", F.timestamp_micros("at").alias("ts"), "version")

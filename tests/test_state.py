"""Stores and streams: captures, progress, page state, quiet pages."""

import json
import os
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from pageloom.sources.articles import delete_articles, get_articles, read_articles, upsert_articles
from pageloom.sources.keyed_store import KeyedStore
from pageloom.streaming import captures as cap
from pageloom.streaming import progress as prog
from pageloom.streaming import stability as stab

V = "https://video.twimg.com/amplify_video/{}/pl/{}"


def ts(df):
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def requests(spark):
    rows = [
        (1, "2024-01-01 00:00:01", V.format(7, "playlist.m3u8")), (1, "2024-01-01 00:00:02", V.format(7, "avc1/480x270/a.m3u8")),
        (1, "2024-01-01 00:00:03", V.format(7, "avc1/1280x720/b.m3u8")), (1, "2024-01-01 00:00:04", V.format(7, "mp4a/32000/c.m3u8")),
        (1, "2024-01-01 00:00:05", V.format(8, "avc1/480x270/d.m3u8")), (1, "2024-01-01 00:00:06", V.format(8, "seg.ts")),
        (-1, "2024-01-01 00:00:07", V.format(9, "playlist.m3u8")),
    ]
    return ts(spark.createDataFrame(rows, "tab_id int, ts string, url string"))


def test_captures(spark):
    posters = ts(spark.createDataFrame([(1, "2024-01-01", "7", "p7"), (1, "2024-01-02", "7", "")], "tab_id int, ts string, video_id string, poster string"))
    videos = cap.captured_videos(cap.latest_slots(requests(spark)), posters)
    chosen = {r.video_id: r for r in cap.choose_source(videos).collect()}
    assert set(chosen) == {"7", "8"}
    assert chosen["7"].src.endswith("playlist.m3u8") and chosen["7"].poster == "p7"
    assert [p.resolution for p in chosen["7"].hls.video_playlists] == ["1280x720", "480x270"] and chosen["7"].hls.audio.endswith("c.m3u8")
    assert chosen["8"].src.endswith("d.m3u8")
    players = spark.createDataFrame([("a", 1, "amplify_video_thumb/7/x.jpg", None), ("b", 1, "p7", None), ("c", 1, "zz", None)], "player_id string, tab_id int, poster string, src string")
    assert {r.player_id: r.video_id for r in cap.match_videos(players, videos).collect()} == {"a": "7", "b": "7", "c": None}
    moved = ts(spark.createDataFrame([(1, "2024-01-01 00:00:04")], "tab_id int, ts string"))
    left = cap.latest_slots(cap.drop_before_navigation(requests(spark), moved)).collect()
    assert [(r.video_id, r.slot) for r in left] == [("8", "variant")]


def stream_of(spark, df, folder, tmp_path):
    path = str(tmp_path / folder)
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def drain(query):
    query.processAllAvailable()
    query.stop()


def run_batches(out, name, tmp_path):
    """All micro-batches of a stream, one file of each source a time."""
    q = out.writeStream.outputMode("update").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).start()
    drain(q)


def slow_stream(spark, rows, schema, folder, tmp_path, name="ts"):
    """A stream that brings one row after the other, in the given order."""
    path = tmp_path / folder
    for i, row in enumerate(rows):
        ts(spark.createDataFrame([row], schema)).coalesce(1).write.parquet(str(path / f"{i:03}"))
    order = sorted(path.glob("*/*.parquet"))
    for i, f in enumerate(order):  # the source takes older files first
        os.utime(f, (1_700_000_000 + i, 1_700_000_000 + i))
    full = ts(spark.createDataFrame(rows, schema))
    return spark.readStream.schema(full.schema).option("maxFilesPerTrigger", 1).parquet(str(path / "*")), full


def test_capture_stream_forgets_what_a_navigation_clears(spark, tmp_path):
    seen = requests(spark).withColumn("seq", F.lit(1))
    moved = ts(spark.createDataFrame([(1, "2024-01-01 00:00:04", 2)], "tab_id int, ts string, seq int"))
    run_batches(cap.stream_slots(stream_of(spark, seen, "in", tmp_path), stream_of(spark, moved, "nav", tmp_path)), "cleared", tmp_path)
    assert [(r.video_id, r.slot) for r in cap.latest_entries(spark.table("cleared")).collect()] == [("8", "variant")]


def test_navigation_of_the_same_moment_and_null_seq(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:01", n, V.format(v, "playlist.m3u8")) for v, n in ((1, 1), (2, 2), (3, 3), (4, None))]
    seen = ts(spark.createDataFrame(rows, "tab_id int, ts string, seq int, url string"))
    moved = ts(spark.createDataFrame([(1, "2024-01-01 00:00:01", 2)], "tab_id int, ts string, seq int"))
    batch = cap.latest_slots(cap.drop_before_navigation(seen, moved))
    assert [r.video_id for r in batch.collect()] == ["3"]
    run_batches(cap.stream_slots(stream_of(spark, seen, "in", tmp_path), stream_of(spark, moved, "nav", tmp_path)), "moment", tmp_path)
    assert [r.video_id for r in cap.latest_entries(spark.table("moment")).collect()] == ["3"]


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_equals_batch_whatever_the_order_of_arrival(spark, tmp_path, seed):
    rng = random.Random(seed)
    at = lambda: f"2024-01-01 00:{rng.randint(0, 40):02}:{rng.randint(0, 59):02}"
    kinds = ["playlist.m3u8", "avc1/480x270/{}.m3u8", "avc1/1280x720/{}.m3u8", "mp4a/32000/{}.m3u8"]
    seen = [(rng.randint(1, 2), at(), n, V.format(rng.randint(1, 3), rng.choice(kinds).format(n))) for n in range(8)]
    moved = [(1, at(), 100)]
    posters = [(rng.randint(1, 2), at(), n, str(rng.randint(1, 3)), rng.choice(["", "p1", "p2"])) for n in range(4)]
    s, seen = slow_stream(spark, seen, "tab_id int, ts string, seq int, url string", "in", tmp_path)
    n, moved = slow_stream(spark, moved, "tab_id int, ts string, seq int", "nav", tmp_path)
    p, posters = slow_stream(spark, posters, "tab_id int, ts string, seq int, video_id string, poster string", "posters", tmp_path)
    run_batches(cap.stream_slots(s, n, p), f"any_order_{seed}", tmp_path)
    streamed = cap.captured_videos(cap.latest_entries(spark.table(f"any_order_{seed}")))
    batch = cap.captured_videos(cap.latest_slots(cap.drop_before_navigation(seen, moved)), cap.drop_before_navigation(posters, moved))
    rows = lambda df: sorted(repr(r.asDict()) for r in df.collect())
    assert rows(streamed) == rows(batch) and rows(batch)


class CountedState(dict):
    """A map or value state that counts calls, as each is a round trip to the JVM."""

    calls = 0

    def __getattribute__(self, name):
        if not name.startswith("_") and name != "calls":
            CountedState.calls += 1
        return super().__getattribute__(name)

    def exists(self):
        return len(self) > 0

    def containsKey(self, name):
        return dict.__contains__(self, name)

    def getValue(self, name):
        return self[name]

    def updateValue(self, name, held):
        self[name] = held

    def get(self):
        return self[()]

    def update(self, value):
        self[()] = value


def test_a_new_tab_costs_one_call_per_entry():
    class Handle:
        timers = []

        def getMapState(self, *_):
            return CountedState()

        getValueState = getMapState

        def listTimers(self):
            return iter(self.timers)

        def registerTimer(self, at):
            self.timers.append(at)

        def deleteTimer(self, at):
            self.timers.remove(at)

    class Times:
        def getCurrentWatermarkInMs(self):
            return 0

    seen = Row("tab_id", "at", "seq", "video_id", "slot", "label", "url")
    tab = cap.TabCaptures(1_000)
    tab.init(Handle())
    CountedState.calls = 0
    first = list(tab.handleInputRows((1,), iter([seen(1, i, 0, str(i % 100), "master", "", f"u{i}") for i in range(300)]), Times()))
    assert CountedState.calls <= 100 + 4  # the entries and the number of changes
    assert [(r.video_id, r.url, r.at, r.version) for r in first] == [(str(i), f"u{i + 200}", i + 200, i + 1) for i in range(100)]
    rows = [seen(1, 250, 0, None, None, None, None), seen(1, 240, 0, "9", "master", "", "late"), seen(1, 500, 0, "9", "master", "", "new")]
    tab.entries.iterator = lambda: iter(list(tab.entries.items()))
    tab.entries.removeKey = tab.entries.pop
    second = {(r.video_id, r.url): r.version for r in tab.handleInputRows((1,), iter(rows), Times())}
    assert len(second) == 52 and second["9", "new"] == 152 and ("9", "late") not in second  # 51 entries up to the navigation, and one that is new


def test_idle_tabs_expire(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", 1, V.format(7, "playlist.m3u8")), (2, "2024-01-01 03:00:00", 1, V.format(8, "playlist.m3u8")),
            (2, "2024-01-01 03:00:01", 2, V.format(9, "playlist.m3u8"))]
    s, _ = slow_stream(spark, rows, "tab_id int, ts string, seq int, url string", "in", tmp_path)
    run_batches(cap.stream_slots(s, late="10 minutes", idle="2 hours"), "idle", tmp_path)
    changes = spark.table("idle").orderBy("tab_id", "version").collect()
    assert [(r.tab_id, r.video_id, r.url is None) for r in changes] == [(1, "7", False), (1, "7", True), (2, "8", False), (2, "9", False)]
    assert sorted(r.video_id for r in cap.latest_entries(spark.table("idle")).collect()) == ["8", "9"]


def test_readiness_budget(spark):
    rows = [("a", 1, "x"), ("a", 2, None), ("a", 3, "y"), ("b", 1, "x"), ("b", 2, "z"), ("c", 41, None), ("c", 1, "w")]
    checks = spark.createDataFrame(rows, "tab_id string, check_no int, not_ready string")
    got = {r.tab_id: (r.state, r.reason, r.waited_ms) for r in stab.readiness_budget(checks).collect()}
    assert got == {"a": ("READY", None, 500), "b": ("NOT_READY", "z", 500), "c": ("NOT_READY", "w", 250)}


def test_capture_stream(spark, tmp_path):
    out = cap.stream_slots(stream_of(spark, requests(spark), "in", tmp_path))
    q = out.writeStream.outputMode("update").format("memory").queryName("slots").option("checkpointLocation", str(tmp_path / "cp")).start()
    drain(q)
    assert spark.table("slots").count() == 5


def test_progress(spark, tmp_path):
    raw = spark.createDataFrame([
        (1, "a", json.dumps({"unit_id": "b1-u1", "focus_index": 3, "updated_at": 10})), (1, "a", json.dumps({"unit_id": "b1-u2", "focus_index": 4, "updated_at": 20})),
        (1, "a", json.dumps({"unit_id": "b0", "focus_index": 0, "updated_at": 5})), (2, "a", "{broken"),
    ], "reader_id int, article_id string, value string")
    parsed = prog.parse_progress(raw)
    latest = prog.latest_progress(parsed)
    assert [(r.reader_id, r.unit_id, r.focus_index) for r in latest.collect()] == [(1, "b1-u2", 4)]
    units = spark.createDataFrame([("a", "b1-u2", 9)], "article_id string, unit_id string, unit_index int")
    assert prog.resume_index(latest, units).first().resume_index == 9
    gone = spark.createDataFrame([("a", "zz", 9)], "article_id string, unit_id string, unit_index int")
    assert prog.resume_index(latest, gone).first().resume_index == 0
    stream = prog.latest_progress(prog.parse_progress(stream_of(spark, raw, "raw", tmp_path)))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("progress").option("checkpointLocation", str(tmp_path / "cp")).start()
    drain(q)
    assert [r.unit_id for r in spark.table("progress").collect()] == ["b1-u2"]


def test_store_of_latest_records(spark, tmp_path):
    schema = "reader_id int, article_id string, unit_id string, updated_at long"
    path = tmp_path / "store"
    store = KeyedStore(spark, str(path), schema, ("reader_id", "article_id"), ("updated_at",), buckets=8)
    rows = lambda *r: spark.createDataFrame(list(r), schema)
    have = lambda: sorted((r.reader_id, r.unit_id) for r in store.read().collect())
    assert have() == [] and store.get(rows((1, "a", "", 0))).first().unit_id is None
    store.write(rows(*[(i, "a", "u1", 10) for i in range(6)], (0, "a", "u0", 5)), 0)
    store.write(rows((1, "a", "u2", 20), (2, "a", "old", 3)), 1)
    store.write(rows((1, "a", "u2", 20), (2, "a", "old", 3)), 1)  # a restart
    assert have() == [(0, "u1"), (1, "u2"), (2, "u1"), (3, "u1"), (4, "u1"), (5, "u1")]
    assert len(list(path.glob("batch=1/bucket=*"))) <= 2
    store.write(rows((3, "a", None, 30), (4, "a", "late", 9)), 2, F.col("unit_id").isNull())
    assert have() == [(0, "u1"), (1, "u2"), (2, "u1"), (4, "u1"), (5, "u1")]
    (path / "batch=7").mkdir()  # an attempt without its _SUCCESS
    store.compact(1)
    assert sorted(p.name for p in path.iterdir()) == ["base=1", "batch=2", "batch=7"]
    store.write(rows((5, "a", "again", 99)), 1)  # taken in already
    assert have() == [(0, "u1"), (1, "u2"), (2, "u1"), (4, "u1"), (5, "u1")]
    store.compact()
    store.compact()
    assert sorted(p.name for p in path.iterdir()) == ["base=2", "batch=7"]
    assert have() == [(0, "u1"), (1, "u2"), (2, "u1"), (4, "u1"), (5, "u1")]
    store.write(rows((3, "a", "back", 1)), 3)
    asked = spark.createDataFrame([(1, "a"), (3, "a"), (9, "a"), (9, "a")], "reader_id int, article_id string")
    assert sorted((r.reader_id, r.unit_id) for r in store.get(asked).collect()) == [(1, "u2"), (3, "back"), (9, None)]


def test_store_as_the_sink_of_a_stream(spark, tmp_path):
    s, full = slow_stream(spark, [(i % 3, f"2024-01-01 00:00:0{i}", f"u{i}") for i in range(7)], "reader_id int, ts string, unit_id string", "in", tmp_path)
    for name in ("one", "two"):  # the second query starts anew and finds its batches written
        store = KeyedStore(spark, str(tmp_path / "sunk"), "reader_id int, ts timestamp, unit_id string", ("reader_id",), ("ts",), buckets=4)
        drain(s.writeStream.foreachBatch(store.sink()).option("checkpointLocation", str(tmp_path / name)).start())
        assert sorted((r.reader_id, r.unit_id) for r in store.read().collect()) == [(0, "u6"), (1, "u4"), (2, "u5")]


def test_page_state(spark):
    rows = [(1, "2024-01-01 00:00:00", 0, "NOT_READY", "content_not_stable"), (1, "2024-01-01 00:00:05", 1, "READY", None)]
    df = ts(spark.createDataFrame(rows, "tab_id int, ts string, seq int, state string, reason string"))
    assert [(r.state, r.reason) for r in prog.page_state(df).collect()] == [("READY", None)]


def test_stable_window(spark, tmp_path):
    rows = [(1, f"2024-01-0{1 + i // 4} 00:00:0{i % 4}", i, h) for i, h in enumerate("aabbbbca")]
    df = ts(spark.createDataFrame(rows, "page_id int, ts string, seq int, content_hash string"))
    for width in (1, 3600, 86_400, 10_000_000):
        got = stab.stable_window(df, 1500, slice_seconds=width).orderBy("seq").collect()
        assert [(r.seq, r.stable) for r in got] == [(0, True), (2, True), (6, False), (7, True)]
    out = stab.stable_sessions(stream_of(spark, df, "snaps", tmp_path), "2 seconds", "1 second")
    q = out.writeStream.outputMode("append").format("memory").queryName("sessions").option("checkpointLocation", str(tmp_path / "cp")).start()
    drain(q)
    assert spark.table("sessions").columns == ["page_id", "opened", "quiet_at", "n_snapshots"]


def test_article_store(spark, tmp_path):
    good = {"id": "1", "title": "t", "blocks": [{"id": "b", "type": "paragraph"}]}
    lines = [json.dumps(x) for x in (good, {**good, "title": ""}, {**good, "blocks": [{"id": "b"}]}, {"id": "2", "title": "t"})] + ["{oops"]
    path = tmp_path / "articles.json"
    path.write_text("\n".join(lines))
    ok, bad = read_articles(spark, str(path))
    assert [r.id for r in ok.select("id").collect()] == ["1"]
    assert sorted(r.problem for r in bad.select("problem").collect()) == ["broken_block", "corrupt_record", "missing_blocks", "missing_title"]
    store = spark.createDataFrame([("a", 1, "old"), ("b", 1, "keep")], "article_id string, extracted_at long, title string")
    new = spark.createDataFrame([("a", 2, "new")], "article_id string, extracted_at long, title string")
    merged = upsert_articles(store, new)
    assert {r.article_id: r.title for r in merged.collect()} == {"a": "new", "b": "keep"}
    ids = spark.createDataFrame([("a",), ("z",)], "article_id string")
    assert {r.article_id: r.title for r in get_articles(merged, ids).collect()} == {"a": "new", "z": None}
    assert [r.article_id for r in delete_articles(merged, ids).collect()] == ["b"]

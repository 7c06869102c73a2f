import json

from tracklake.sources import playlists_json as js
from tracklake.sources import store
from tracklake.streaming import popularity


def slices(folder):
    def track(u, pos):
        return {"pos": pos, "track_uri": u, "track_name": u.upper(), "artist_name": "A", "artist_uri": "artist:a", "album_name": "B", "duration_ms": 1000}

    one = {"playlists": [{"pid": 7, "name": "x", "tracks": [track(u, i) for i, u in enumerate(["b", "a", "b", "c", "d"])]}, {"pid": 8, "tracks": [track("a", 0)]}]}
    two = {"playlists": [{"pid": 3, "name": None, "tracks": [track(u, i) for i, u in enumerate(["e", "a", "f", "g", "h"])]}]}
    (folder / "slice.1000.json").write_text(json.dumps(one, indent=1))
    (folder / "slice.2.json").write_text(json.dumps(two))


def test_json_scan(spark, tmp_path):
    slices(tmp_path)
    paths = js.slice_paths(str(tmp_path))
    assert [p.rsplit("/", 1)[1] for p in paths] == ["slice.2.json", "slice.1000.json"] and len(js.slice_paths(str(tmp_path), 1)) == 1
    p = js.read(spark, paths)
    assert {r.pid: r.name for r in p.collect()} == {3: "", 7: "x", 8: ""}
    es = js.entries(p)
    assert {(r.pid, r.track_uri): r.position for r in es.collect() if r.pid == 7} == {(7, "b"): 0, (7, "a"): 1, (7, "c"): 3, (7, "d"): 4}
    cat = {r.track_uri: (r.track_id, r.n_playlists) for r in js.catalog(es).collect()}
    assert [u for u, _ in sorted(cat.items(), key=lambda x: x[1])] == ["e", "a", "f", "g", "h", "b", "c", "d"] and cat["a"] == (1, 2)
    assert set(r.track_uri for r in js.catalog(es, 2).collect()) == {"a"}


def test_store_round_trip(spark, tmp_path):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, name string")
    store.write({"challenges": t}, str(tmp_path), partition={"challenges": ["k"]})
    assert store.read(spark, str(tmp_path), "challenges")["challenges"].where("k = 2").first().name == "b"
    store.write_meta(t.limit(1), str(tmp_path / "meta.json"))
    assert json.loads((tmp_path / "meta.json").read_text())["k"] in (1, 2)
    store.write_model([[1.0, 2.0], [3.0, 4.0]], str(tmp_path / "beta"), spark)
    assert store.read_model(spark, str(tmp_path / "beta")).tolist() == [[1.0, 2.0], [3.0, 4.0]]


def test_stream_equals_batch(spark, tmp_path):
    import datetime as dt

    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), i % 3, "play" if i % 2 else "skip", 1.0) for i in range(120)]
    events = spark.createDataFrame(rows, "event_id int, ts timestamp_ntz, user_id int, event_type string, value double")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = popularity.windowed(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    popularity.start(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = {(r.start, r.event_type): r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.start, r.event_type): r.n for r in popularity.windowed(events).collect()}
    # The last window stays open until the watermark passes it.
    assert got and all(want[k] == n for k, n in got.items()) and len(got) >= len(want) - 2
    assert popularity.sessions(events, "2 hours").count() == 120
    assert popularity.sessions(events, "4 hours").count() == 3

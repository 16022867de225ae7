"""Merge rules and table builds on the edge rows."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tonearm.operators import charts, derive, genres, merge, work
from tonearm.sources import landed

T0 = datetime(2024, 1, 1, 12)
PLAYS = "id long, played_at timestamp_ntz, ms_played int, estimated_ms int, item_kind string, item_uri string, track_id string, source string"


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns or df.columns) for r in df.collect())


def play(i, second, ms=None, uri="spotify:track:a", track=None, source="recent", kind="track"):
    return (i, datetime(2024, 1, 1, 12, second // 60, second % 60), ms, None, kind, uri, track, source)


def test_plays_are_kept_once(spark):
    stored = spark.createDataFrame([play(1, 0, 5), play(2, 1, None)], PLAYS)
    batch = spark.createDataFrame([play(10, 0, 5), play(11, 0, 6), play(12, 1, None), play(13, 2, None), play(14, 2, None), play(15, 0, None)], PLAYS)
    assert rows(merge.new_plays(stored, batch), "id") == [(11,), (13,), (15,)]


def test_polls_give_way_to_an_import(spark):
    plays = spark.createDataFrame([play(1, 0), play(2, 5, 3, source="extended"), play(3, 9)], PLAYS)
    assert rows(merge.superseded_polls_removed(plays, T0, datetime(2024, 1, 1, 12, 0, 5)), "id") == [(2,), (3,)]


TRACKS = "id string, duration_ms int, linked_from_id string, canonical_track_id string"


@pytest.mark.parametrize("gap, want", [(0, None), (100, 100_000), (200, 180_000), (240, 180_000), (241, None)])
def test_estimates(spark, gap, want):
    tracks = spark.createDataFrame([("a", 180_000, None, "c")], TRACKS)
    plays = spark.createDataFrame([play(1, 0, 1, track="a", source="extended"), play(2, gap, track="a")], PLAYS)
    got = {r["id"]: r["estimated_ms"] for r in derive.estimate_durations(plays, tracks).collect()}
    assert got == {1: None, 2: want}


def test_estimates_across_hours_and_without_a_previous_play(spark):
    tracks = spark.createDataFrame([("a", 180_000, None, "c")], TRACKS)
    at = lambda h, m, s: datetime(2024, 1, 1, h, m, s)
    plays = spark.createDataFrame([(1, at(9, 59, 0), None, None, "track", "u", "a", "recent"), (2, at(10, 1, 0), None, None, "track", "u", "a", "recent"), (3, at(15, 0, 0), 7, 3, "track", "u", "a", "extended")], PLAYS)
    got = {r["id"]: r["estimated_ms"] for r in derive.estimate_durations(plays, tracks).collect()}
    assert got == {1: None, 2: 120_000, 3: 3}


def test_links_prefer_the_id_then_the_least_relinked(spark):
    tracks = spark.createDataFrame([("a", 1, None, "x"), ("z", 1, "b", "x"), ("y", 1, "b", "x"), ("b2", 1, "a", "x")], TRACKS)
    plays = spark.createDataFrame([play(1, 0), play(2, 1, uri="spotify:track:b"), play(3, 2, uri="spotify:track:none"), play(4, 3, uri="spotify:episode:a", kind="episode"), play(5, 4, uri="spotify:track:b", track="kept")], PLAYS)
    assert {r["id"]: r["track_id"] for r in derive.link_plays(plays, tracks).collect()} == {1: "a", 2: "y", 3: None, 4: None, 5: "kept"}


def test_play_stats(spark):
    tracks = spark.createDataFrame([("a", 1, None, "x"), ("b", 1, None, None)], TRACKS)
    plays = spark.createDataFrame([play(1, 0, 29_999, track="a"), play(2, 1, 30_000, track="a"), play(3, 2, track="a"), play(4, 3, 1, track="b")], PLAYS)
    assert rows(derive.play_stats(plays, tracks), "canonical_track_id", "plays", "completed_plays", "skips", "ms_played") == [("x", 3, 1, 1, 59_999)]


def library(spark, shuffled=False):
    tracks = [
        ("1", "Song", "al1", 180_000, True, 10, "ISRC1", False, "full"), ("2", "Song - Live", "al2", 180_500, False, 90, "ISRC1", False, "simplified"), ("3", "Other", "al2", 4_999, False, None, "", False, "full"),
        ("4", "Other", "al2", 5_000, False, None, None, False, "full"), ("5", "!", None, 1, False, 3, None, False, "full"), ("6", "file", None, 1, False, 3, "ISRC1", True, "full"), ("7", "Song", "al3", 180_000, False, 50, "ISRC1", False, "full"),
    ]
    t = spark.createDataFrame(tracks[::-1] if shuffled else tracks, "id string, name string, album_id string, duration_ms int, explicit boolean, popularity int, isrc string, is_local boolean, detail_level string")
    credits = spark.createDataFrame([("1", "b", 0), ("1", "a", 1), ("2", "c", 0), ("7", "b", 0), ("3", "a", 0), ("4", "a", 0)], "track_id string, artist_id string, position int")
    overrides = spark.createDataFrame([("7", "own", "x")], "track_id string, canonical_track_id string, reason string")
    albums = spark.createDataFrame([("al1", "album", datetime(2001, 1, 1).date()), ("al2", None, None), ("al3", "album", None)], "id string, album_type string, release_date_start date")
    saved = spark.createDataFrame([("2",)], "track_id string")
    return t, credits, overrides, albums, saved


@pytest.mark.parametrize("shuffled", [False, True])
def test_recordings(spark, shuffled):
    t, credits, overrides, albums, held = library(spark, shuffled)
    keys = derive.recording_keys(t, credits, overrides)
    cid = {r["track_id"]: r["cid"] for r in keys.collect()}
    assert cid["1"] == cid["2"] == "isrc:ISRC1" and cid["7"] == "own" and cid["3"] != cid["4"] and "6" not in cid and cid["5"].startswith("fb:")
    got = {r["id"]: r for r in derive.canonical_tracks(keys, t, credits, albums, held).collect()}
    one = got["isrc:ISRC1"]
    assert (one["representative_track_id"], one["copy_count"], one["max_popularity"], one["isrc"], one["kind"], one["primary_artist_id"]) == ("2", 2, 90, "ISRC1", "isrc", "c")
    assert str(one["earliest_release_date"]) == "2001-01-01" and got["own"]["kind"] == "fallback" and got["own"]["isrc"] is None
    shared = {(r["artist_id"], r["position"], r["on_representative"]) for r in derive.canonical_track_artists(keys, derive.canonical_tracks(keys, t, credits, albums, held), credits).where("canonical_track_id = 'isrc:ISRC1'").collect()}
    assert shared == {("b", 0, False), ("a", 1, False), ("c", 0, True)}


def test_rebuilds_agree_whatever_the_order(spark):
    sums = []
    for shuffled in (False, True):
        t, credits, overrides, albums, held = library(spark, shuffled)
        keys = derive.recording_keys(t, credits, overrides)
        done = derive.canonical_tracks(keys, t, credits, albums, held).repartition(3 + shuffled)
        sums.append((derive.checksum(done, "id", derive.RECORDING_CHECK).first(), derive.text_checksum(done, "id", derive.RECORDING_CHECK).first()))
    assert sums[0] == sums[1]


def test_library(spark):
    at = lambda y: datetime(y, 1, 1)
    saved = spark.createDataFrame([("1", at(2024), None), ("2", at(2021), at(2022)), ("3", at(2020), None)], "track_id string, added_at timestamp_ntz, removed_at timestamp_ntz")
    lists = spark.createDataFrame([("p", True, None), ("q", True, at(2022)), ("r", False, None)], "id string, is_owned boolean, removed_at timestamp_ntz")
    items = spark.createDataFrame([("p", 0, "1", at(2020), False), ("p", 1, "1", at(2023), False), ("p", 2, "4", None, False), ("p", 3, "5", at(2020), True), ("q", 0, "6", at(2020), False), ("r", 0, "7", at(2020), False), ("p", 4, None, at(2020), False)], "playlist_id string, position int, track_id string, added_at timestamp_ntz, is_local boolean")
    got = {r["track_id"]: (r["via_liked"], r["via_owned_playlist"], r["first_added_at"].year, r["owned_playlist_count"]) for r in derive.library_tracks(saved, lists, items).collect()}
    assert got == {"1": (True, True, 2020, 1), "3": (True, False, 2020, 0)}


def test_album_groups(spark):
    albums = spark.createDataFrame([("a", "A", "album", 2, "full", 5), ("b", "B", None, 2, "full", 9), ("c", "C", "album", 3, "full", 1), ("d", "D", "album", None, "full", 1), ("e", "E", "album", 1, "full", 1)], "id string, name string, album_type string, total_tracks int, detail_level string, popularity int").withColumn("release_date_start", F.lit(None).cast("date"))
    tracks = spark.createDataFrame([("1", "a", "x"), ("2", "a", "y"), ("3", "b", "y"), ("4", "b", "x"), ("5", "c", "x"), ("6", "c", "x"), ("7", "c", "y"), ("8", "e", None)], "id string, album_id string, canonical_track_id string")
    complete = derive.album_completeness(albums, tracks)
    assert {r["id"]: r["tracks_complete"] for r in complete.collect()} == {"a": True, "b": True, "c": True, "d": False, "e": True}
    keys = derive.album_group_keys(complete, tracks)
    gid = {r["album_id"]: r["gid"] for r in keys.collect()}
    assert gid["a"] == gid["b"] != gid["c"] and gid["d"] == "alb:d" and gid["e"] == "alb:e"
    credits = spark.createDataFrame([("b", "s", 1), ("b", "t", 0)], "album_id string, artist_id string, position int")
    saved = spark.createDataFrame([], "album_id string, removed_at timestamp_ntz")
    group = derive.album_groups(keys, complete, credits, saved).where(F.col("id") == gid["a"]).first()
    assert (group["representative_album_id"], group["copy_count"], group["track_count"], group["primary_artist_id"], group["kind"]) == ("b", 2, 2, "t", "tracks")  # an unknown type stands first


def test_upserts(spark):
    kind = "id string, name string, tags array<string>, urls map<string,string>, n int, flag boolean"
    stored = spark.createDataFrame([("1", "old", ["a"], {"k": "v"}, 1, True), ("2", "kept", None, None, 2, False)], kind)
    batch = spark.createDataFrame([("1", None, [], {}, 5, False), ("3", "new", ["b"], None, None, None)], kind)
    assert sorted(tuple(r) for r in merge.upsert(stored, batch, ["id"], sticky=("flag",), add=("n",)).collect()) == [("1", "old", ["a"], {"k": "v"}, 6, True), ("2", "kept", None, None, 2, False), ("3", "new", ["b"], None, 0, False)]
    over = merge.upsert(stored, batch.select("id", "name"), ["id"], overwrite=("name",))
    assert {r["id"]: r["name"] for r in over.collect()} == {"1": None, "2": "kept", "3": "new"}


def test_detail_is_never_lost(spark):
    kind = "id string, name string, popularity int, detail_level string"
    stored = spark.createDataFrame([("1", "a", 5, "full"), ("2", "b", None, "simplified")], kind)
    brief = merge.upsert_detail(stored, spark.createDataFrame([("1", "a2", 9, "x"), ("3", "c", 9, "x")], kind), ["id"], "simplified")
    assert {r["id"]: tuple(r)[1:] for r in brief.collect()} == {"1": ("a2", 5, "full"), "2": ("b", None, "simplified"), "3": ("c", None, "simplified")}
    full = merge.upsert_detail(stored, spark.createDataFrame([("2", "b", 7, "x")], kind), ["id"], "full")
    assert {r["id"]: tuple(r)[1:] for r in full.collect()} == {"1": ("a", 5, "full"), "2": ("b", 7, "full")}


def test_children_and_playlists(spark):
    stored = spark.createDataFrame([("p", 0, "a"), ("p", 1, "b"), ("q", 0, "c")], "playlist_id string, position int, track_id string")
    new = spark.createDataFrame([("p", 0, "z"), ("p", 1, "z")], stored.schema)
    assert rows(merge.replace_children(stored, new, "playlist_id")) == [("p", 0, "z"), ("p", 1, "z"), ("q", 0, "c")]
    read = spark.createDataFrame([("p",), ("q",)], "playlist_id string")
    assert rows(merge.replace_playlists(stored, new, read)) == [("p", 0, "z"), ("p", 1, "z")]


def test_playlist_labels(spark):
    kind = "playlist_id string, position int, added_at timestamp_ntz, added_by_id string, is_local boolean, track struct<id:string,type:string,name:string,artist:string>"
    items = spark.createDataFrame([("p", 0, None, None, False, ("t", "track", "n", "a")), ("p", 1, None, None, True, (None, "track", "file", "me")), ("p", 2, None, None, False, ("e", "episode", "ep", None)), ("p", 3, None, None, None, None)], kind)
    assert {r["position"]: (r["track_id"], r["local_name"], r["is_local"]) for r in merge.playlist_rows(items).collect()} == {0: ("t", None, False), 1: (None, "file", True), 2: (None, "ep", False), 3: (None, None, False)}


def test_soft_deletes(spark):
    stored = spark.createDataFrame([("1", None), ("2", T0), ("3", None), ("4", T0)], "id string, removed_at timestamp_ntz")
    now = datetime(2025, 1, 1)
    got = {r["id"]: r["removed_at"] for r in merge.reconcile(stored, spark.createDataFrame([("1",), ("2",)], "id string"), "id", now).collect()}
    assert got == {"1": None, "2": None, "3": now, "4": T0}


def test_smaller_merge_rules(spark):
    one = lambda *r, kind: spark.createDataFrame(list(r), kind)
    assert rows(merge.insert_missing(one(("a",), kind="n string"), one(("a",), ("b",), ("b",), kind="n string"), ["n"])) == [("a",), ("b",)]
    misses = merge.record_misses(one(("a",), ("b",), ("b",), kind="k string"), one(("a", "ok"), kind="k string, status string"), "k", "missing")
    assert rows(misses) == [("a", "ok"), ("b", "missing")] and rows(merge.reset_misses(misses, "missing")) == [("a", "ok")]
    takes = one(("i", "m1", "1999", 5), ("i", "m2", None, 9), ("i", "m3", "1999", 7), ("i", "m0", "1999", 7), kind="isrc string, mbid string, first_release_date string, length_ms int")
    assert rows(merge.chosen_recordings(takes)) == [("i", "m0", 4)]
    assert rows(merge.last_wins(one(("a", 1, "x"), ("a", 2, "y"), kind="k string, seq int, v string"), ["k"], "seq")) == [("a", 2, "y")]
    assert rows(merge.undo_import(one((1, 3), (2, None), kind="id int, import_id long"), 3), "id") == [(2,)]
    assert rows(merge.expired_removed(one((1, T0), (2, None), (3, datetime(2025, 1, 1)), kind="id int, at timestamp_ntz"), "at", datetime(2024, 6, 1)), "id") == [(2,), (3,)]
    payloads = one(("t", "1", T0, "a"), ("t", "1", datetime(2024, 2, 1), "b"), kind="entity_type string, entity_id string, fetched_at timestamp_ntz, payload string")
    assert rows(merge.latest_payloads(payloads), "payload") == [("b",)]
    assert [merge.push_decision("f", n, s, p, "now") for n, s, p in ((0, "f", "now"), (1, "f", "now"), (1, "f", "was"), (1, "g", "now"))] == ["refuse", "skip", "write", "write"]


def test_collections(spark):
    kind = "id string, name string, match string, sort string, track_limit int, auto_sync boolean, updated_at timestamp_ntz"
    t = {"genre_collections": spark.createDataFrame([], kind), "genre_collection_genres": spark.createDataFrame([], "collection_id string, genre string")}
    first, t = genres.create_collection(t, "Ça va!", T0, ["a", "b", "a"])
    second, t = genres.create_collection(t, "Ça va!", T0)
    assert (first, second) == ("c-a-va", "c-a-va-2") and rows(t["genre_collection_genres"]) == [("c-a-va", "a"), ("c-a-va", "b")]
    t |= genres.remove_genre(t, first, "a", T0)
    t["genre_collections"] = genres.update_collection(t, second, {"name": "x", "no_such": 1}, T0)
    assert rows(genres.collection(t, first), "genres") == [(["b"],)] and rows(t["genre_collections"], "id", "name") == [("c-a-va", "Ça va!"), ("c-a-va-2", "x")]
    t |= genres.delete_collection(t, first)
    assert rows(t["genre_collections"], "id") == [("c-a-va-2",)] and rows(t["genre_collection_genres"]) == []


def test_empty_selection(spark):
    kind = "canonical_track_id string, genre string, votes int"
    t = {"track_genres": spark.createDataFrame([("x", "g", 1)], kind)}
    assert genres.matching(t, []).count() == 0 and genres.matching(t, ["g", "h"], "all").count() == 0 and genres.matching(t, ["g", "h"]).count() == 1


def test_run_rates(spark):
    phases = spark.createDataFrame([(1, "a", "running", 50, 100, T0, None), (1, "b", "completed", 5, 5, T0, datetime(2024, 1, 1, 12, 0, 5)), (1, "c", "pending", 0, 9, None, None)], "run_id int, key string, status string, done int, total int, started_at timestamp_ntz, finished_at timestamp_ntz")
    now = datetime(2024, 1, 1, 12, 0, 10)
    got = {r["key"]: (r["rate"], r["eta_seconds"]) for r in work.phase_rates(phases, now).collect()}
    assert got == {"a": (5.0, 10.0), "b": (1.0, None), "c": (None, None)}
    minutes = spark.createDataFrame([(datetime(2024, 1, 1, 11, k), 60 * k) for k in range(1, 6)], "bucket timestamp_ntz, requests long")
    assert work.run_eta(minutes, phases).first()[0] == 59 / 4.0


def test_chart_rest(spark):
    assert [charts.nice_step(0, 100, 10), charts.nice_step(0, 7, 10), charts.nice_step(3, 3, 5)] == [10.0, 0.5, 1.0]
    buckets = spark.createDataFrame([(30, 2), (60, 0), (90, 1)], "v int, n int")
    assert rows(charts.expanded(buckets, "v", "n")) == [(30,), (30,), (90,)]
    lists = spark.createDataFrame([(["Rock"], ["rock", "Pop"]), (None, ["X"])], "own array<string>, other array<string>")
    assert [r["added"] for r in charts.added_genres(lists, "own", "other").collect()] == [["pop"], ["x"]]
    assert charts.lag_in_years(spark.createDataFrame([(1461,)], "d int"), "d").first()["years"] == 4.0


def test_landed_objects(spark, tmp_path):
    (tmp_path / "a.json").write_text(
        '{"played_at":"2024-01-01T10:00:00.900","track":{"id":"t","uri":"spotify:track:t","name":"n","duration_ms":5,"artists":[{"id":"a","name":"A"},{"id":"b","name":"B"},{"id":"a","name":"A"}],"album":{"id":"al","name":"L"},"external_ids":{"isrc":"I"}}}\n'
    )
    items = landed.landed(spark, str(tmp_path), "recently_played")
    got = landed.polled_plays(items).first()
    assert (got["played_at"], got["ms_played"], got["artist_name"], got["album_name"]) == (datetime(2024, 1, 1, 10), None, "A", "L")
    assert rows(landed.flat_credits(items)) == [("t", "a", 0), ("t", "b", 1)]
    track = landed.flat_tracks(items).first()
    assert (track["isrc"], track["explicit"], track["detail_level"], track["album_id"]) == ("I", False, "full", "al")


def test_audio_features(spark):
    analyses = spark.createDataFrame([("m", '{"rhythm":{"bpm":120.5},"tonal":{"key_key":"A"}}', '{"mood_happy":{"all":{"happy":0.8}},"moods_mirex":{"value":"C1"}}')], "mbid string, low string, high string")
    got = {r["recording_mbid"]: r for r in landed.audio_features(spark.createDataFrame([("m",), ("gone",)], "recording_mbid string"), analyses).collect()}
    assert (got["m"]["status"], got["m"]["bpm"], got["m"]["key_key"], got["m"]["happy"], got["m"]["mood_mirex"], got["m"]["sad"]) == ("ok", 120.5, "A", 0.8, "C1", None)
    assert got["gone"]["status"] == "missing" and got["gone"]["bpm"] is None

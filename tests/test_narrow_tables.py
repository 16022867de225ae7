"""Queries build only the tables that they need, and give what the full tables give."""

from collections import ChainMap, Counter

from tonearm.operators import derive, genres
from tonearm.plans.warehouse import Warehouse, heard_plays, library_dates, raw_plays, warehouse

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return Counter(map(tuple, df.collect()))


def test_coded_recordings_are_those_of_canonical_tracks(spark):
    w = warehouse(spark, SF)
    assert rows_of(derive.coded_recordings(w["tracks_landed"], w["canonical_overrides"])) == rows_of(w["canonical_tracks"].where("isrc is not null").select("id", "isrc"))
    tracks = spark.createDataFrame([("a", "X1", False), ("b", "X1", False), ("c", "", False), ("d", None, False), ("e", "X2", True), ("f", "X3", False), ("g", None, False)], "id string, isrc string, is_local boolean")
    fixed = spark.createDataFrame([("f", "fix:1"), ("g", "isrc:X9"), ("e", "isrc:X8")], "track_id string, canonical_track_id string")
    assert rows_of(derive.coded_recordings(tracks, fixed)) == Counter([("isrc:X1", "X1"), ("isrc:X9", "X9")])


def test_genres_are_told_without_lines_and_plays(spark):
    w = Warehouse(spark, SF)
    got = w["track_genres"]
    assert w.sources["track_genres"].isdisjoint({"lineitem", "customer", "events"})
    assert rows_of(got) == rows_of(derive.track_genres(ChainMap(w)))


def test_dates_of_the_library_need_neither_numbered_items_nor_credits(spark):
    w = Warehouse(spark, SF)
    got = rows_of(library_dates(w).select("canonical_track_id", "first_added_at"))
    assert not {"playlist_tracks", "track_artists", "canonical_tracks", "library_canonical"} & w.built.keys()
    full = warehouse(spark, SF)
    assert got == rows_of(full["library_canonical"].select("canonical_track_id", "first_added_at"))
    assert rows_of(w["library_tracks"]) == rows_of(derive.library_tracks(full["saved_tracks"], full["playlists"], full["playlist_tracks"]))
    assert rows_of(w["recording_keys"]) == rows_of(derive.recording_keys(full["tracks_landed"], full["track_artists"], full["canonical_overrides"]))


def test_plays_without_tracks_are_those_of_the_whole_log(spark):
    w, full = Warehouse(spark, SF), warehouse(spark, SF)
    for part in (raw_plays(w).select("id", "played_at", "reason_end"), heard_plays(w).select("id", "played_at", "platform", "ms_played", "estimated_ms")):
        assert rows_of(part) == rows_of(full["plays"].select(*part.columns))
    assert not {"plays", "plays_landed", "tracks"} & w.built.keys()
    assert heard_plays(w).where("estimated_ms is not null").count() > 0


def test_a_donut_of_genres_needs_no_plays(spark):
    w, full = Warehouse(spark, SF), warehouse(spark, SF)
    got = genres.sizes(ChainMap({"library_canonical": library_dates(w)}, w))
    assert rows_of(got) == rows_of(genres.vocabulary(full).select("genre", "tracks"))
    assert "events" not in w.files

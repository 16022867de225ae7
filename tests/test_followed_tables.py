"""Tables kept up to date by changes build only what they need, and join their rows once."""

from collections import Counter

from tonearm.plans import upkeep
from tonearm.plans.warehouse import Warehouse, first_credits, warehouse

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return Counter(map(tuple, df.collect()))


def test_first_credits_of_some_tracks(spark):
    w, full = Warehouse(spark, SF), warehouse(spark, SF)
    wanted = w["tracks_landed"].where("track_number % 3 = 0").selectExpr("id AS track_id")
    got = first_credits(w, wanted).select("track_id", "artist_id", "position")
    want = full["track_artists"].where("position = 0").join(wanted, "track_id", "left_semi").select("track_id", "artist_id", "position")
    assert rows_of(got) == rows_of(want) and got.count() and "track_artists" not in w.built


def test_recordings_by_changes_need_no_numbered_credits_and_join_their_rows_once(spark, monkeypatch):
    w, seen = Warehouse(spark, SF), []
    followed = upkeep.deltas.Maintained.rebuild
    monkeypatch.setattr(upkeep.deltas.Maintained, "rebuild", lambda self, rows, tag: seen.append(rows) or followed(self, rows, tag))
    got = upkeep.recordings(w)
    assert "track_artists" not in w.built
    assert len(seen) == 1 and "Join" not in seen[0]._jdf.queryExecution().optimizedPlan().toString()
    full = warehouse(spark, SF)["canonical_tracks"]
    assert rows_of(got.select(*full.columns)) == rows_of(full)

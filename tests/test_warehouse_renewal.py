"""A warehouse builds anew what comes from changed files, and nothing else."""

import os
import shutil

from tonearm.plans.warehouse import warehouse

SF = "/root/testdata/sf0.001"


def test_tables_of_changed_files_are_built_anew(spark, tmp_path):
    folder = str(tmp_path / "star")
    os.makedirs(folder)
    for n in ("events", "part", "orders", "lineitem", "region", "supplier", "nation"):
        shutil.copy(f"{SF}/{n}.parquet", folder)
        os.chmod(f"{folder}/{n}.parquet", 0o644)
    w = warehouse(spark, folder)
    plays, tracks, artists = w["plays_landed"], w["tracks_landed"], w["track_artists"]
    before = plays.count()
    assert warehouse(spark, folder)["plays_landed"] is plays and w.renew() == []
    half = spark.read.parquet(f"{SF}/events.parquet").where("event_id % 2 = 0")
    half.coalesce(1).write.parquet(str(tmp_path / "half"))
    part = next(f for f in os.listdir(tmp_path / "half") if f.endswith(".parquet"))
    shutil.copy(tmp_path / "half" / part, f"{folder}/events.parquet")
    again = warehouse(spark, folder)
    assert again is w and 0 < again["plays_landed"].count() < before
    assert again["tracks_landed"] is tracks and again["track_artists"] is artists
    assert w.sources["plays_landed"] == {"events"} and w.sources["tracks_landed"] == {"part"} and w.sources["track_artists"] == {"lineitem"}

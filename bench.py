"""Seconds of the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS], as one JSON line.

The derived tables are built first and timed on their own, as a refresh; each query then runs once to
warm up and counts by its second run. Beside the sum, "cold" has the first runs and "import" the seconds
that the log's plays take from export archives (one for each day) into the log.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], os.environ.get("PYTHONPATH", "")])

HEADLINE = [
    "q01_totals", "q03_growth", "q04_top_artists_by_year", "q05_top_artists", "q06_album_completion", "q13_discovery_lag", "q16_streaks", "p1_listening_totals", "p3_listening_by_month", "p4_listening_clock",
    "p9_top_played_tracks", "p10_top_played_artists", "p13_discovery_vs_repeat", "p15_play_log", "e02_library_recordings", "e05_album_index", "e06_playlist_index", "g01_vocabulary", "g05_related_genres", "g10_resolve_tracks", "d13_enrichment_coverage",
]
REFRESH = ["canonical_tracks", "canonical_track_artists", "library_canonical", "plays", "canonical_play_stats", "albums", "album_groups", "track_genres"]


def main() -> None:
    from tonearm.plans import landing, registry
    from tonearm.plans.warehouse import warehouse
    from tonearm.session import session
    from tonearm.sources import history
    from tonearm.streaming.plays import PLAYS

    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session("bench", spark__master=f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    queries, took, cold = registry.queries(), {}, {}
    w = warehouse(spark, folder)
    for name in w.texts:  # landing isn't a part of the refresh
        w[name]
    began = time.time()
    for name in REFRESH:
        w[name]
    took["refresh"] = round(time.time() - began, 3)
    for name in HEADLINE:
        for _ in range(2):
            began = time.time()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            took[name] = round(time.time() - began, 3)
            cold.setdefault(name, took[name])
    archives = landing.exported(w, True)[1]
    began = time.time()
    stored = w["plays_landed"].where("source = 'recent'").select(*(f.split()[0] for f in PLAYS.split(", ")))
    history.import_plays(stored, history.archive_plays(history.archive_entries(spark, archives)), w["tracks"], 9)[0].write.format("noop").mode("overwrite").save()
    imported = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": folder.rsplit("sf", 1)[-1], "cold": cold, "import": imported}))
    spark.stop()


if __name__ == "__main__":
    main()

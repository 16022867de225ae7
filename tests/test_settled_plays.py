"""A change of the log links and estimates as over whole tables, and lays its rows without a pass that samples them."""

import random
from collections import Counter
from datetime import datetime, timedelta

from pyspark.sql import DataFrame

from tonearm.operators import derive
from tonearm.streaming import plays as streams

START = datetime(2024, 1, 1)
NAMES = [c.split()[0] for c in streams.PLAYS.split(", ")]


def rows_of(df):
    return Counter(tuple(r) for r in df.select(*NAMES).collect())


def some(r, k, linked):
    source, kind = r.choice(["recent", "extended", None]), r.choice(["track", "track", "track", "episode", None])
    name = r.choice(["t", "old", "new"]) + str(r.randrange(6))
    row = dict.fromkeys(NAMES) | {"id": k, "played_at": START + timedelta(seconds=60 * r.randrange(3_000)) if r.random() < 0.95 else None, "ms_played": r.choice([None, 40_000]), "estimated_ms": r.choice([None, 7])}
    row |= {"item_kind": kind, "item_uri": f"spotify:track:{name}" if r.random() < 0.95 else None, "source": source, "track_id": f"t{r.randrange(8)}" if linked or r.random() < 0.3 else None}
    return tuple(row[n] for n in NAMES)


def test_settled_plays_are_linked_and_estimated_as_all_plays_are(spark):
    r = random.Random(5)
    tracks = spark.createDataFrame([(f"t{k}", 60_000 * (1 + k % 3) if k else None, f"old{k}" if k % 2 else None) for k in range(6)], "id string, duration_ms int, linked_from_id string")
    plays, linked = (spark.createDataFrame([some(r, k, told) for k in at], streams.PLAYS) for told, at in ((False, range(300)), (True, range(300, 360))))
    lasts = spark.createDataFrame([(START - timedelta(minutes=1),)], "played_at timestamp_ntz")
    want = derive.estimate_durations(derive.link_plays(plays, tracks).unionByName(linked), tracks, lasts)
    assert rows_of(derive.settled_plays(plays, linked, tracks, lasts)) == rows_of(want)


def test_a_change_is_laid_without_sampling(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(DataFrame, "repartitionByRange", None, raising=False)
    monkeypatch.setattr(type(spark.range(1)), "repartitionByRange", None)
    tracks = spark.createDataFrame([("t1", 60_000, None)], "id string, duration_ms int, linked_from_id string")
    log = streams.PlayLog(spark, (tmp_path / "log").as_uri())
    rows = [(k, START + timedelta(hours=k), None, "track", "spotify:track:t1", "recent", None) for k in range(50)]
    log.merge(spark.createDataFrame(rows, "id long, played_at timestamp_ntz, ms_played int, item_kind string, item_uri string, source string, import_id long"), tracks, "one")
    assert log.read().where("track_id = 't1'").count() == 50

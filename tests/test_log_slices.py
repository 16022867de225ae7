"""A log kept in slices gives what a run over the whole log gives, and writes little."""

import json
import os
import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tonearm.operators import derive, merge
from tonearm.sources import history
from tonearm.streaming import plays as streams

START = datetime(2024, 1, 1)
COLUMNS = "id long, played_at timestamp_ntz, ms_played int, item_kind string, item_uri string, source string, import_id long"


@pytest.fixture(scope="module")
def tracks(spark):
    return spark.createDataFrame([(f"t{k}", 60_000 * (1 + k % 5), f"old{k}" if k % 3 == 0 else None) for k in range(12)], "id string, duration_ms int, linked_from_id string")


def play(r, k, days, kind):
    at = START + timedelta(seconds=r.randrange(days * 86_400) // 60 * 60)
    name = r.choice(["t", "old", "new"]) + str(r.randrange(12))
    return (k, at, None if kind == "recent" else r.randrange(200_000), "track" if r.random() < 0.9 else "episode", f"spotify:track:{name}", kind, None if kind == "recent" else 1)


def rows_of(df):
    return Counter(tuple(r) for r in df.select(*(c.split()[0] for c in streams.PLAYS.split(", "))).collect())


def whole_merge(spark, stored, batch, tracks, span=None):
    new = merge.new_plays(stored, batch)
    kinds = {f.name: f.dataType for f in stored.schema.fields}
    shaped = new.select(*((F.col(c) if c in new.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in stored.columns))
    rows = stored.unionByName(shaped)
    if span:
        rows = merge.superseded_polls_removed(rows, *span)
    out = derive.estimate_durations(derive.link_plays(rows, tracks), tracks)
    return spark.createDataFrame(out.collect(), stored.schema)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_late_changes_give_the_same_log(spark, tmp_path, tracks, seed):
    r, log = random.Random(seed), streams.PlayLog(spark, (tmp_path / "log").as_uri())
    whole, k = spark.createDataFrame([], streams.PLAYS), 0
    for step in range(5):
        late = step % 2 == 1
        rows = [play(r, k + i, 12, "extended" if late else "recent") for i in range(r.choice([3, 40]))]
        if step == 4:
            rows = [x for x in rows if x[1] < START + timedelta(days=2)] + rows[:1]
        k += len(rows)
        batch = spark.createDataFrame(rows, COLUMNS)
        span = (min(x[1] for x in rows), min(x[1] for x in rows) + timedelta(days=2)) if late else None
        log.merge(batch, tracks, f"step-{step}", span)
        assert log.merge(batch, tracks, f"step-{step}", span) is None  # delivered again
        whole = whole_merge(spark, whole, batch, tracks, span)
        assert rows_of(log.read()) == rows_of(whole)
    assert len(log.versions()) == 3
    low, high = START + timedelta(days=3, hours=5), START + timedelta(days=4, hours=1)
    assert rows_of(log.window(low, high)) == rows_of(whole.where(F.col("played_at").between(F.lit(low), F.lit(high - timedelta(microseconds=1)))))
    # Tracks that come to be known later link the plays that were open, and change their estimates.
    more = tracks.unionByName(spark.createDataFrame([(f"new{k}", 90_000, None) for k in range(12)], "id string, duration_ms int, linked_from_id string"))
    log.relink(more, "catalog-1")
    assert rows_of(log.read()) == rows_of(derive.estimate_durations(derive.link_plays(whole, more), more))
    assert log.relink(more, "catalog-2") is None


def files(folder):
    return {os.path.join(d, f): os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet") and "/m=" not in d}


def test_a_batch_writes_its_slices_only(spark, tmp_path, tracks):
    log, folder = streams.PlayLog(spark, (tmp_path / "log").as_uri()), str(tmp_path / "log")
    r = random.Random(5)
    log.merge(spark.createDataFrame([play(r, k, 100, "extended") for k in range(3_000)], COLUMNS), tracks, "first")
    before = files(folder)
    at = START + timedelta(days=50, hours=3)
    log.merge(spark.createDataFrame([(9_999, at, None, "track", "spotify:track:t1", "recent", None)], COLUMNS), tracks, "second")
    new = {k: v for k, v in files(folder).items() if k not in before}
    assert len(new) == 1 and all("slice=" in k for k in new) and set(before) <= set(files(folder))
    assert sum(new.values()) < sum(before.values()) / 20
    plan = log.window(at, at + timedelta(hours=1))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("slice=") <= 2 or "1 paths" in plan
    gone, come = log.changes(0, 1)
    assert gone.count() == 0 and [x["id"] for x in come.collect()] == [9_999]


def test_the_play_before_a_slice_is_carried_to_it(spark, tmp_path, tracks):
    log = streams.PlayLog(spark, (tmp_path / "log").as_uri())
    day = lambda d, h, m: START + timedelta(days=d, hours=h, minutes=m)
    row = lambda k, at: (k, at, None, "track", "spotify:track:t4", "recent", None)
    log.merge(spark.createDataFrame([row(1, day(0, 23, 50)), row(2, day(1, 0, 1)), row(3, day(1, 0, 2)), row(4, day(9, 0, 0))], COLUMNS), tracks, "a")
    assert {x["id"]: x["estimated_ms"] for x in log.read().collect()} == {1: None, 2: None, 3: 60_000, 4: None}
    log.merge(spark.createDataFrame([row(5, day(0, 23, 58))], COLUMNS), tracks, "b")
    assert {x["id"]: x["estimated_ms"] for x in log.read().collect()} == {1: None, 5: None, 2: 180_000, 3: 60_000, 4: None}
    assert {x["slice"] - (START - datetime(1970, 1, 1)).days: x["version"] for x in log.manifest()} == {0: 1, 1: 1, 9: 0}


def test_imports_into_the_log(spark, tmp_path, tracks):
    log = streams.PlayLog(spark, (tmp_path / "log").as_uri())
    log.merge(streams.with_ids(spark.createDataFrame([(START + timedelta(hours=h), None, "track", "spotify:track:t1", "recent") for h in (1, 30, 80)], "played_at timestamp_ntz, ms_played int, item_kind string, item_uri string, source string")), tracks, "polls")
    folder = tmp_path / "export"
    folder.mkdir()
    record = lambda h: {"played_at": str(START + timedelta(hours=h)), "ms_played": 1000 * h, "item_kind": "track", "item_uri": "spotify:track:t2"}
    (folder / "Streaming_History_Audio_1.json").write_text(json.dumps([record(2), record(40)]))
    landed = history.folder_plays(spark, str(folder))
    assert history.import_into(log, landed, tracks, 7) is not None and history.import_into(log, landed, tracks, 7) is None
    got = sorted((x["played_at"], x["source"]) for x in log.read().collect())
    assert got == [(START + timedelta(hours=h), s) for h, s in ((1, "recent"), (2, "extended"), (40, "extended"), (80, "recent"))]

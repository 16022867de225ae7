"""Aggregates kept by changes equal those built anew, and touch only the buckets of changed groups."""

import os
import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tonearm.operators import deltas

T0 = datetime(2024, 1, 1)


def shown(df):
    return Counter(tuple(r) for r in df.collect())


def row(r, k):
    return (r.choice(["a", "b", "c", "d", "e", "f", None]), f"t{r.randrange(5)}", k, T0 + timedelta(minutes=r.randrange(6)), r.choice([None, 10, 40_000, 90_000]))


@pytest.mark.parametrize("seed", [3, 4])
def test_inserts_updates_and_deletes(spark, tmp_path, seed):
    r = random.Random(seed)
    rows = {k: row(r, k) for k in range(60)}
    frame = lambda rs: spark.createDataFrame(list(rs), deltas.PLAY_ROWS)
    kept = deltas.Maintained(spark, (tmp_path / "x").as_uri(), deltas.PLAY_ROWS, "id", deltas.PLAY_STATS, buckets=5)
    kept.rebuild(frame(rows.values()), "start")
    for step in range(4):
        gone = [rows.pop(k) for k in r.sample(sorted(rows), 15)]
        come = [row(r, g[2]) for g in gone[:8]] + [row(r, 1000 * (step + 1) + k) for k in range(5)]
        rows |= {c[2]: c for c in come}
        kept.apply(frame(gone), frame(come), f"s{step}")
        kept.apply(frame(gone), frame(come), f"s{step}")  # once more: nothing
        want = deltas.folded(frame(c for c in rows.values() if c[0]), deltas.PLAY_STATS)
        assert shown(kept.read()) == shown(want)
    assert shown(kept.read(["a", "zz"])) == shown(want.where("canonical_track_id = 'a'"))
    # All of a group's rows go, and with them the group.
    of_a = [x for x in rows.values() if x[0] == "a"]
    kept.apply(frame(of_a), frame([]), "no more a")
    assert "a" not in {x[0] for x in kept.read().collect()}


def test_a_change_that_stopped_half_way_is_finished(spark, tmp_path):
    frame = lambda rs: spark.createDataFrame(list(rs), deltas.PLAY_ROWS)
    kept = deltas.Maintained(spark, (tmp_path / "x").as_uri(), deltas.PLAY_ROWS, "id", deltas.PLAY_STATS, buckets=2)
    first, second = ("a", "t", 1, T0, 5), ("a", "t", 2, T0 - timedelta(days=1), 50_000)
    kept.rebuild(frame([first]), "start")
    commit = kept.groups.commit
    kept.groups.commit = lambda *a: (_ for _ in ()).throw(OSError("lost"))
    with pytest.raises(OSError):
        kept.apply(frame([first]), frame([second]), "one")
    kept.groups.commit = commit
    kept.apply(frame([first]), frame([second]), "one")
    assert shown(kept.read()) == shown(deltas.folded(frame([second]), deltas.PLAY_STATS)) and kept.rows.read().count() == 1


def test_only_touched_buckets_are_written_and_read(spark, tmp_path):
    folder = str(tmp_path / "x")
    rows = spark.range(2_000).select(F.concat(F.lit("c"), (F.col("id") % 400).cast("string")).alias("canonical_track_id"), F.lit("t").alias("track_id"), "id", F.lit(T0).alias("played_at"), F.col("id").alias("ms"))
    kept = deltas.Maintained(spark, "file://" + folder, deltas.PLAY_ROWS, "id", deltas.PLAY_STATS, buckets=16)
    kept.rebuild(rows, "start")
    files = lambda: {os.path.join(d, f) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet") and "/m=" not in d}
    before = files()
    kept.apply(rows.where("id = 7"), rows.where("id = 7").withColumn("ms", F.lit(99_999).cast("long")), "one")
    new = files() - before
    assert {f.split("slice=")[1].split("/")[0] for f in new} == {next(iter(new)).split("slice=")[1].split("/")[0]} and len(new) == 2
    gone, come = kept.groups.changes(0, 1)
    assert [x["canonical_track_id"] for x in come.collect()] == ["c7"] == [x["canonical_track_id"] for x in gone.collect()]


def test_members_that_move_to_another_group(spark, tmp_path):
    r = random.Random(9)
    rows = [("a" if x[1] < "t2" else "b", *x[1:]) for x in (row(r, k) for k in range(80))]
    frame = lambda rs: spark.createDataFrame(list(rs), deltas.PLAY_ROWS)
    kept = deltas.Maintained(spark, (tmp_path / "x").as_uri(), deltas.PLAY_ROWS, "id", deltas.PLAY_STATS, buckets=4)
    kept.rebuild(frame(rows), "start")
    moves = spark.createDataFrame([("t1", "a", "b"), ("t3", "b", "new")], "track_id string, was string, now string")
    kept.rekey(moves, "track_id", "regrouped")
    to = {("t1", "a"): "b", ("t3", "b"): "new"}
    want = [(to.get((x[1], x[0]), x[0]), *x[1:]) for x in rows]
    assert shown(kept.read()) == shown(deltas.folded(frame(want), deltas.PLAY_STATS))

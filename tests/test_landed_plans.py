"""Plans of landed tables against their texts, on odd rows too, and what they shuffle."""

from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tonearm.operators import derive, entities
from tonearm.plans import warehouse
from tonearm.sources import driver

SF = "/root/testdata/sf0.001"


def odd(spark):
    """Orders that stand twice, with one customer and with two, days and customers that are null, equal lines, lines without order."""
    t = {n: spark.read.parquet(f"{SF}/{n}.parquet") for n in ("lineitem", "orders")}
    some = t["orders"].where("o_orderkey % 7 = 1")
    t["orders"] = t["orders"].union(some).union(some.withColumn("o_custkey", F.col("o_custkey") + 1)).union(some.withColumn("o_orderdate", F.lit(None).cast(some.schema["o_orderdate"].dataType))).union(some.withColumn("o_custkey", F.lit(None).cast("long")))
    few = t["lineitem"].where("l_orderkey % 5 = 1")
    t["lineitem"] = t["lineitem"].union(few).union(few.withColumn("l_quantity", F.lit(None).cast(few.schema["l_quantity"].dataType))).union(few.withColumn("l_orderkey", F.lit(None).cast("long"))).union(few.withColumn("l_suppkey", F.lit(None).cast("long")))
    return t


@pytest.mark.parametrize("name", sorted(driver.PLANS))
def test_rows_are_those_of_the_text(spark, name):
    t = odd(spark)
    want = spark.sql(driver.TABLES[name], **{n: t[n] for n in warehouse.used(driver.TABLES[name])})
    got = driver.PLANS[name](t)
    assert [(f.name, f.dataType) for f in got.schema] == [(f.name, f.dataType) for f in want.schema]
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def shuffled(spark):
    """Joins that are too large for a broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_warehouse_shuffles_lines_by_order_only(spark, shuffled, monkeypatch):
    monkeypatch.setattr(warehouse, "kept", lambda df, name: df)
    w = warehouse.Warehouse(spark, SF)
    lines = [x for x in plan(w["playlist_tracks"]).splitlines() if "Exchange hashpartitioning" in x]
    assert len(lines) == 5 and sum("o_custkey" in x for x in lines) == 1  # lines, their numbers, orders by key, by customer and by key again
    assert plan(w["track_artists"]).count("Exchange") == 1


def test_keys_read_the_credits_of_tracks_without_a_code(spark):
    tracks = spark.createDataFrame([("a", "Song", 1000, "X1", False), ("b", "Song", 1000, None, False), ("c", "Song", 1000, "", False), ("d", "Song", 1000, None, True)], "id string, name string, duration_ms int, isrc string, is_local boolean")
    credits = spark.createDataFrame([(t, a) for t in "abcd" for a in ("2", "1")], "track_id string, artist_id string")
    fixed = spark.createDataFrame([("c", "fix:1", "by hand")], "track_id string, canonical_track_id string, reason string")
    keys = derive.recording_keys(tracks, credits, fixed)
    got = {r["track_id"]: r["cid"] for r in keys.collect()}
    assert got["a"] == "isrc:X1" and got["c"] == "fix:1" and set(got) == {"a", "b", "c"} and not got["b"].startswith("isrc:")
    assert got["b"] == derive.recording_keys(tracks, credits.where("track_id = 'b'"), fixed).where("track_id = 'b'").first()["cid"]
    assert "LeftSemi" in plan(keys)


def test_artists_are_chosen_before_their_credits_are_counted(spark):
    w = warehouse.warehouse(spark, SF)
    page = entities.artist_index(w, "plays", genre="asia", filters={"followed": "no"})
    assert "Expand" not in plan(page)
    whole = {r["id"]: r for r in entities.artist_index(w, "plays", limit=10_000).collect()}
    asia = {r["artist_id"] for r in w["artist_genres"].where("genre = 'asia'").collect()}
    want = [r for k, r in whole.items() if k in asia and not r["followed"]]
    got = page.collect()
    assert got and all(r["total"] == len(want) for r in got) and all(r.asDict() | {"total": 0} == whole[r["id"]].asDict() | {"total": 0} for r in got)


def test_playlists_are_chosen_before_their_items_are_counted(spark):
    w = warehouse.warehouse(spark, SF)
    assert "LeftSemi" in plan(entities.playlist_index(w, "listened", q="THE", filters={"access": "private"}))

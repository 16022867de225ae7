"""Genre bitmaps against Python sets and against the row-wise operators."""

import random

import pytest
from pyspark.sql import functions as F

from tonearm.operators import bitmaps, genres

MODES = ("any", "all")


@pytest.fixture(scope="module")
def tables(spark):
    r = random.Random(5)
    ids = [f"r{k}" for k in range(300)]
    edges = [(i, g, r.randrange(9)) for i in ids for g in "abcdef" if r.random() < 0.3] * 2 + [("only in tags", "a", 1), ("r0", "everywhere", 1)]
    held = [i for i in ids if r.random() < 0.6]
    t = {
        "canonical_tracks": spark.createDataFrame([(i,) for i in ids], "id string"),
        "track_genres": spark.createDataFrame(edges, "canonical_track_id string, genre string, votes int"),
        "library_canonical": spark.createDataFrame([(i, k % 3 == 0, f"ar{k % 7}", k) for k, i in enumerate(held)], "canonical_track_id string, liked boolean, primary_artist_id string, duration_ms long"),
        "canonical_play_stats": spark.createDataFrame([(i, k, k * 10, None) for k, i in enumerate(held[::2])], "canonical_track_id string, plays long, ms_played long, last_played_at timestamp_ntz"),
        "genre_collections": spark.createDataFrame([("x", "any"), ("y", "all"), ("none", "all"), ("far", "all")], "id string, match string"),
        "genre_collection_genres": spark.createDataFrame([("x", "a"), ("x", "b"), ("y", "a"), ("y", "b"), ("y", "c"), ("far", "a"), ("far", "zz")], "collection_id string, genre string"),
    }
    # Small buckets that run over, so that sets span many bitmaps.
    t["recording_numbers"] = bitmaps.numbered(t["canonical_tracks"].select("id").union(t["track_genres"].select("canonical_track_id")), 40, 16).withColumnRenamed("id", "canonical_track_id").cache()
    t["genre_bitmaps"], t["library_genre_bitmaps"] = bitmaps.genre_bitmaps(t).cache(), bitmaps.library_genre_bitmaps(t).cache()
    return t, edges, set(held)


def shown(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_numbers_are_dense_and_unlike(tables, spark):
    t, edges, _ = tables
    rows = [tuple(r) for r in t["recording_numbers"].collect()]
    assert {r[0] for r in rows} == {r[0] for r in t["canonical_tracks"].collect()} | {e[0] for e in edges}
    assert len({r[1:] for r in rows}) == len(rows) and all(0 <= r[2] < 16 for r in rows) and len({r[1] for r in rows}) > 8
    assert bitmaps.numbered(spark.createDataFrame([(None,), ("a",), ("a",)], "id string")).collect() == [("a", 0, 0)]
    assert bitmaps.numbered(spark.createDataFrame([], "id string")).count() == 0


@pytest.mark.parametrize("match", MODES)
@pytest.mark.parametrize("picked", [["a"], ["a", "b"], ["a", "c", "f"], ["a", "zz"], ["zz"], []])
def test_sets(tables, picked, match):
    t, edges, _ = tables
    sets = [{i for i, g, _ in edges if g == p} for p in picked]
    want = (set.union(*sets) if match == "any" else set.intersection(*sets)) if sets else set()
    got = [r[0] for r in bitmaps.matching(t, picked, match).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    bits = bitmaps.chosen(t["genre_bitmaps"], picked, match)
    assert bits.agg(bitmaps.size()).first()[0] == len(want)
    assert shown(bitmaps.selection_totals(t, picked, match)) == shown(genres.selection_stats(t, picked, match))


@pytest.mark.parametrize("genre", ["a", "everywhere", "zz"])
def test_related(tables, genre):
    t, _, _ = tables
    assert [tuple(r) for r in bitmaps.related_genres(t, genre).collect()] == [tuple(r) for r in genres.related_genres(t, genre).collect()]


def test_coverage_and_collections(tables):
    t, edges, held = tables
    assert bitmaps.coverage(t).collect() == [(len({i for i, _, _ in edges} & held), len(held))]
    assert shown(bitmaps.collections(t)) == shown(genres.list_collections(t))


def test_sizes_of_sets_read_no_ids(tables):
    t, _, _ = tables
    plan = bitmaps.chosen(t["genre_bitmaps"].select("*"), ["a", "b"], "all").agg(bitmaps.size())._jdf.queryExecution().optimizedPlan().toString()
    outer = plan.split("InMemoryRelation")[0]
    assert "Join" not in outer and "canonical_track_id" not in outer


def test_every_bit_is_found(spark):
    numbers = bitmaps.numbered(spark.range(bitmaps.BITS + 5).select(F.col("id").cast("string").alias("id")), 10**6).withColumnRenamed("id", "canonical_track_id").cache()
    assert numbers.select("bucket").distinct().count() == 2
    some = numbers.where("crc32(canonical_track_id) % 3 = 0")
    bits = some.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    assert bitmaps.members(bits, numbers).exceptAll(some.select("canonical_track_id")).isEmpty() and bits.agg(bitmaps.size()).first()[0] == some.count()

"""Genres as bitmaps over the recordings: any-of, all-of and overlaps as operations on bits.

Recordings have numbers in buckets of about PER_BUCKET, each genre one bitmap for each bucket that it has
recordings in. A set of genres then reads a few kilobytes for each 20 000 recordings in place of a row for
each recording and genre, and sizes are counted without looking at ids. t: tables by name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .genres import library_edges, list_collections, selection_stats

# Fixed value: the bits of a bitmap of Spark's bitmap functions.
BITS = 32_768
PER_BUCKET = 20_000


def numbered(ids: DataFrame, per_bucket: int = PER_BUCKET, bits: int = BITS) -> DataFrame:
    """id, bucket and bit of each different id of a column named id; null has no number.

    Ids are dealt to buckets by hash and numbered within theirs, so nothing is sorted in one task. Ids of a
    bucket beyond its bits go on in further buckets.
    """
    known = ids.where("id is not null").distinct()
    n = max(1, -(-known.count() // per_bucket))
    dealt = known.select("id", F.pmod(F.xxhash64("id"), F.lit(n)).alias("_part"))
    placed = dealt.withColumn("_at", F.row_number().over(Window.partitionBy("_part").orderBy("id")) - 1)
    return placed.select("id", (F.col("_part") + n * F.expr(f"_at div {bits}")).alias("bucket"), (F.col("_at") % bits).cast("long").alias("bit"))


def recording_numbers(t) -> DataFrame:
    ids = t["canonical_tracks"].select("id").union(t["track_genres"].select("canonical_track_id"))
    return numbered(ids).withColumnRenamed("id", "canonical_track_id")


def _by_genre(edges: DataFrame, t) -> DataFrame:
    return edges.select("genre", "canonical_track_id").join(t["recording_numbers"], "canonical_track_id").groupBy("genre", "bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))


def genre_bitmaps(t) -> DataFrame:
    """genre, bucket and bits: the recordings that have the genre."""
    return _by_genre(t["track_genres"], t)


def library_genre_bitmaps(t) -> DataFrame:
    """The same for the library's recordings."""
    return _by_genre(library_edges(t), t)


def size(bits: str = "bits"):
    """How many bits are set in a group's bitmaps."""
    return F.coalesce(F.sum(F.bitmap_count(bits)), F.lit(0))


def both(left: DataFrame, right: DataFrame, *by: str) -> DataFrame:
    """left's bitmaps by some columns and bucket, of which only right's bits stay. right has one bitmap a bucket."""
    met = left.join(right.select("bucket", F.col("bits").alias("_right")), "bucket")
    return met.select(*by, "bucket", F.explode(F.array("bits", "_right")).alias("bits")).groupBy(*by, "bucket").agg(F.bitmap_and_agg("bits").alias("bits"))


def chosen(bitmaps: DataFrame, genres: list[str], match: str = "any") -> DataFrame:
    """bucket and bits of the recordings with any, or all, of the genres; none for an empty list."""
    rows = bitmaps.where(F.col("genre").isin(genres) if genres else F.lit(False))
    if match == "all":
        return rows.groupBy("bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count("*").alias("n")).where(F.col("n") == len(genres)).select("bucket", "bits")
    return rows.groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def members(bitmaps: DataFrame, numbers: DataFrame) -> DataFrame:
    """canonical_track_id of the bits that are set. bitmaps has one bitmap a bucket."""
    byte = F.conv(F.hex(F.expr("substring(bits, cast(bit div 8 as int) + 1, 1)")), 16, 10).cast("int")
    is_set = F.getbit(byte, (F.col("bit") % 8).cast("int")) == 1
    return numbers.join(bitmaps, "bucket").where(is_set).select("canonical_track_id")


def matching(t, genres: list[str], match: str = "any") -> DataFrame:
    return members(chosen(t["genre_bitmaps"], genres, match), t["recording_numbers"])


def selection_totals(t, genres: list[str], match: str = "any") -> DataFrame:
    """genres.selection_stats with the recordings told by bits."""
    return selection_stats(t, genres, match, matching(t, genres, match))


def coverage(t) -> DataFrame:
    described = t["library_genre_bitmaps"].groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits")).agg(size().alias("described"))
    return described.crossJoin(F.broadcast(t["library_canonical"].agg(F.count("*").alias("library"))))  # one row each


def related_genres(t, genre: str, limit: int = 14) -> DataFrame:
    """Genres that share recordings with one, by the Jaccard index of their sets."""
    held = t["library_genre_bitmaps"]
    own, others = held.where(F.col("genre") == genre), held.where(F.col("genre") != genre)
    shared = both(others, own, "genre").groupBy("genre").agg(size().alias("shared"))
    totals = others.groupBy("genre").agg(size().alias("tracks"))
    rows = shared.where("shared > 0").join(totals, "genre").crossJoin(F.broadcast(own.agg(size().alias("seed"))))  # one row
    overlap = F.col("shared").cast("double") / (F.col("seed") + F.col("tracks") - F.col("shared"))
    return rows.where(F.col("shared") >= F.least(F.lit(3), F.col("seed"))).select("genre", "shared", "tracks", overlap.alias("overlap")).orderBy(F.desc("overlap"), F.desc("shared"), "genre").limit(limit)


def collections(t) -> DataFrame:
    """genres.list_collections with the recordings counted by bits, each collection under its own mode."""
    wanted = t["genre_collection_genres"].select("collection_id", "genre").distinct()
    modes = t["genre_collections"].select(F.col("id").alias("collection_id"), "match").join(wanted.groupBy("collection_id").agg(F.count("*").alias("size")), "collection_id")
    found = t["library_genre_bitmaps"].join(wanted, "genre").groupBy("collection_id", "bucket").agg(F.bitmap_or_agg("bits").alias("some"), F.bitmap_and_agg("bits").alias("every"), F.count("*").alias("n"))
    kept = found.join(modes, "collection_id").where((F.col("match") != "all") | (F.col("n") == F.col("size")))
    counted = kept.withColumn("bits", F.when(F.col("match") == "all", F.col("every")).otherwise(F.col("some"))).groupBy(F.col("collection_id").alias("id")).agg(size().alias("track_count"))
    return list_collections(t, counted)

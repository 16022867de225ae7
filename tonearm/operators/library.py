"""The library dashboard. t: tables by name, r: a Range over first_added_at."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.listening import within
from ..functions.numbers import bucket, half_even, share, total
from ..functions.times import day_text, hour, iso, local_day, local_month, local_year, month_text, weekday
from .common import first_artist, month_spine, ranked, real_albums, thumbs, with_credits


def _window(t, r) -> DataFrame:
    return t["library_canonical"].where(within("first_added_at", r))


def _facts(t, *columns: str) -> DataFrame:
    return t["canonical_tracks"].select(F.col("id").alias("canonical_track_id"), *columns)


def totals(t, r) -> DataFrame:
    """One row of headline numbers; a recording that only a compilation carries counts, its album doesn't."""
    albums = real_albums(t).select(F.col("id").alias("primary_album_id"), F.col("id").alias("album_id"))
    return _window(t, r).join(albums, "primary_album_id", "left").agg(
        F.count("*").alias("recordings"), total(F.col("copy_count_in_library")).alias("copies"), total(F.col("duration_ms")).alias("duration_ms"),
        F.countDistinct("primary_artist_id").alias("artists"), F.countDistinct("album_id").alias("albums"),
        F.avg(F.when(F.col("liked"), 1.0).otherwise(0.0)).alias("liked_share"), F.avg(F.when(F.col("explicit"), 1.0).otherwise(0.0)).alias("explicit_share"),
        iso(F.min("first_added_at")).alias("first_added"), iso(F.max("first_added_at")).alias("last_added"),
    )


def additions_by_day(t, r) -> DataFrame:
    return _window(t, r).groupBy(day_text(local_day(F.col("first_added_at"), r.tz)).alias("day")).agg(F.count("*").alias("value"))


def growth(t, r) -> DataFrame:
    """Additions by month without gaps, and the running total with what was there before the window."""
    adds = _window(t, r).groupBy(local_month(F.col("first_added_at"), r.tz).alias("m")).agg(F.count("*").alias("n"))
    base = t["library_canonical"].where(F.col("first_added_at") < F.lit(r.start)).agg(F.count("*").alias("base"))
    spine = month_spine(t["library_canonical"].sparkSession, r.local_day("start"), r.local_day("end"))
    running = F.sum(F.coalesce("n", F.lit(0))).over(Window.orderBy("m").rowsBetween(Window.unboundedPreceding, 0))  # a row for each month
    joined = spine.join(adds, "m", "left").withColumn("running", running).crossJoin(F.broadcast(base))  # one row
    return joined.select(month_text(F.col("m")).alias("period"), F.coalesce("n", F.lit(0)).alias("added"), (F.col("base") + F.col("running")).alias("cumulative"))


def year_ranks(yearly: DataFrame, t, r, top: int) -> DataFrame:
    """Ranks of yr, artist_id, n within each year, and the change against the calendar year before."""
    before = yearly.select((F.col("yr") + 1).alias("yr"), "artist_id", F.col("n").alias("before"))
    placed = yearly.join(before, ["yr", "artist_id"], "left").withColumn("rank", ranked(yearly, ["yr"], F.desc("n"), F.asc("artist_id")))
    shown = placed.where((F.col("rank") <= top) & (F.col("yr") >= r.local_day("start").year))
    names = t["artists"].select(F.col("id").alias("artist_id"), F.col("name").alias("label"))
    return shown.join(names, "artist_id").select(F.col("yr").alias("period"), F.col("artist_id").alias("key"), "label", "rank", F.col("n").alias("value"), (F.col("n") - F.coalesce("before", F.lit(0))).alias("delta"))


def headline_credits(t) -> DataFrame:
    return t["canonical_track_artists"].where("on_representative and position = 0").select("canonical_track_id", "artist_id")


def top_artists_by_year(t, r, top: int = 10) -> DataFrame:
    yearly = _window(t, r.padded()).join(headline_credits(t), "canonical_track_id").groupBy(local_year(F.col("first_added_at"), r.tz).alias("yr"), "artist_id").agg(F.count("*").alias("n"))
    return year_ranks(yearly, t, r, top)


def top_artists(t, r, limit: int = 25) -> DataFrame:
    credited = t["canonical_track_artists"].where("on_representative").select("canonical_track_id", "artist_id")
    names = t["artists"].select(F.col("id").alias("artist_id"), "name")
    albums = real_albums(t).select(F.col("id").alias("primary_album_id"), F.col("id").alias("album_id"))
    joined = _window(t, r).join(credited, "canonical_track_id").join(names, "artist_id").join(albums, "primary_album_id", "left")
    grouped = joined.groupBy(F.col("artist_id").alias("id"), "name").agg(F.countDistinct("canonical_track_id").alias("tracks"), F.countDistinct("album_id").alias("albums"))
    return grouped.orderBy(F.desc("tracks"), "name", "id").limit(limit)


def album_completion(t, r, min_tracks: int = 5, limit: int = 30, strict: bool = False, order_by: str = "pct") -> DataFrame:
    """Albums by the share of them that is held: through any copy, or with strict by the very track."""
    copies = t["tracks"].where("canonical_track_id is not null").select(F.col("id").alias("track_id"), "canonical_track_id", "album_id")
    if strict:
        copies = copies.join(t["library_tracks"].select("track_id"), "track_id", "left_semi")
    albums = real_albums(t).where(~F.col("album_type").eqNullSafe("single") & (F.col("total_tracks") >= min_tracks)).select(F.col("id").alias("album_id"), "name", "total_tracks")
    grouped = _window(t, r).select("canonical_track_id").join(copies, "canonical_track_id").join(albums, "album_id").groupBy("album_id", "name", "total_tracks").agg(F.countDistinct("canonical_track_id").alias("saved"))
    held = grouped.where("saved <= total_tracks").withColumn("pct", share(F.col("saved"), F.col("total_tracks")))
    by = {"pct": [F.col("pct").desc_nulls_last(), F.desc("saved")], "saved": [F.desc("saved"), F.col("pct").desc_nulls_last()]}[order_by]
    top = held.orderBy(*by, "album_id").limit(limit)
    artists = first_artist(t, "album_id").select("album_id", "artist")
    return top.join(artists, "album_id", "left").select(F.col("album_id").alias("id"), "name", "artist", "total_tracks", "saved", "pct")


def top_playlists(t, r, limit: int = 10) -> DataFrame:
    """Playlists by items; a range of all time counts undated items too."""
    items = t["playlist_tracks"] if r.is_all_time else t["playlist_tracks"].where(within("added_at", r))
    lists = t["playlists"].where("removed_at is null").select(F.col("id").alias("playlist_id"), "name", "is_owned")
    held = t["library_tracks"].select("track_id", F.lit(True).alias("held"))
    grouped = items.select("playlist_id", "track_id").join(lists, "playlist_id").join(held, "track_id", "left").groupBy(F.col("playlist_id").alias("id"), "name", "is_owned").agg(F.count("*").alias("tracks"), F.count("held").alias("in_library"))
    return grouped.orderBy(F.desc("tracks"), "name", "id").limit(limit)


def top_labels(t, r, limit: int = 15) -> DataFrame:
    copies = t["tracks"].where("canonical_track_id is not null").select("canonical_track_id", "album_id")
    albums = real_albums(t).where("label is not null").select(F.col("id").alias("album_id"), "label")
    grouped = _window(t, r).select("canonical_track_id").join(copies, "canonical_track_id").join(albums, "album_id").groupBy("label").agg(F.countDistinct("canonical_track_id").alias("tracks"), F.countDistinct("album_id").alias("albums"))
    return grouped.orderBy(F.desc("tracks"), "label").limit(limit)


def recent_additions(t, r, limit: int = 12) -> DataFrame:
    """The newest recordings, cut before credits and covers are joined."""
    newest = _window(t, r).select("canonical_track_id", "first_added_at", "liked").join(_facts(t, "title", "primary_album_id"), "canonical_track_id").orderBy(F.desc("first_added_at"), "title", "canonical_track_id").limit(limit)
    albums = t["albums"].select(F.col("id").alias("primary_album_id"), F.col("name").alias("album_name"))
    joined = newest.join(albums, "primary_album_id", "left").join(thumbs(t["album_images"], "album_id").withColumnRenamed("album_id", "primary_album_id"), "primary_album_id", "left")
    return with_credits(joined, t).select("canonical_track_id", "title", iso(F.col("first_added_at")).alias("added_at"), "liked", F.when(F.col("album_name").isNotNull(), F.col("primary_album_id")).alias("album_id"), "album_name", "cover", "artists")


def release_years(t, r) -> DataFrame:
    dated = _window(t, r).join(_facts(t, "earliest_release_date"), "canonical_track_id").where("earliest_release_date is not null")
    return dated.groupBy(F.year("earliest_release_date").alias("bucket")).agg(F.count("*").alias("count"))


def track_durations(t, r) -> DataFrame:
    """Buckets of 30 seconds up to half an hour."""
    return _window(t, r).where("duration_ms between 1 and 1800000").groupBy((bucket(F.col("duration_ms"), 30_000) / 1_000).cast("long").alias("bucket")).agg(F.count("*").alias("count"))


def add_time_heatmap(t, r) -> DataFrame:
    at = F.col("first_added_at")
    return _window(t, r).groupBy(weekday(at, r.tz).alias("weekday"), hour(at, r.tz).alias("hour")).agg(F.count("*").alias("count"))


def discovery_lag(t, r) -> DataFrame:
    """Exact quartiles of the days from release to addition, by year of addition."""
    joined = _window(t, r).join(_facts(t, "earliest_release_date"), "canonical_track_id").where("earliest_release_date is not null")
    lags = joined.select(local_year(F.col("first_added_at"), r.tz).alias("year"), F.date_diff(local_day(F.col("first_added_at"), r.tz), "earliest_release_date").alias("days")).where("days >= 0")
    q = lags.groupBy("year").agg(F.percentile("days", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.count("*").alias("n"))
    return q.select("year", half_even(F.col("q")[1]).alias("median_days"), half_even(F.col("q")[0]).alias("p25"), half_even(F.col("q")[2]).alias("p75"), "n")


def new_vs_deepening(t, r) -> DataFrame:
    """Additions by month, of artists who came that month and of earlier ones; first contacts over the whole library."""
    whole = t["library_canonical"].where("primary_artist_id is not null")
    firsts = whole.groupBy("primary_artist_id").agg(F.min("first_added_at").alias("first_seen"))
    joined = _window(t, r).join(firsts, "primary_artist_id")
    month, first = local_month(F.col("first_added_at"), r.tz), local_month(F.col("first_seen"), r.tz)
    return joined.groupBy(month_text(month).alias("period")).agg(F.count_if(month == first).alias("new_artists"), F.count_if(month != first).alias("existing"))


def duplicates(t, r, limit: int = 20) -> DataFrame:
    """Recordings with the most copies, and the names of those."""
    many = _facts(t, "title", "primary_artist_id", "copy_count").where("copy_count > 1")
    top = _window(t, r).select("canonical_track_id").join(many, "canonical_track_id").orderBy(F.desc("copy_count"), "title", "canonical_track_id").limit(limit)
    names = t["tracks"].select("canonical_track_id", "name").join(top.select("canonical_track_id"), "canonical_track_id", "left_semi").groupBy("canonical_track_id").agg(F.array_sort(F.collect_set("name")).alias("names"))
    artists = t["artists"].select(F.col("id").alias("primary_artist_id"), F.col("name").alias("artist"))
    return top.join(artists, "primary_artist_id", "left").join(names, "canonical_track_id", "left").select("canonical_track_id", "title", "artist", F.when(F.col("artist").isNotNull(), F.col("primary_artist_id")).alias("artist_id"), F.col("copy_count").alias("copies"), "names")


def day_streaks(days: DataFrame, today: date, busiest: str) -> DataFrame:
    """One row: longest run of consecutive days, its end, the run that lasts until yesterday at least, the busiest day. days: d, n."""
    island = F.date_sub("d", F.row_number().over(Window.orderBy("d")))  # a row for each day
    runs = days.withColumn("island", island).groupBy("island").agg(F.count("*").alias("len"), F.max("d").alias("ended"))
    longest = runs.agg(
        F.coalesce(F.max("len"), F.lit(0)).alias("longest"), day_text(F.max_by("ended", F.struct("len", "ended"))).alias("longest_end"),
        F.coalesce(F.max_by(F.when(F.col("ended") >= F.date_sub(F.lit(today), 1), F.col("len")), F.when(F.col("ended") >= F.date_sub(F.lit(today), 1), F.col("ended"))), F.lit(0)).alias("current"),
    )
    top = days.agg(day_text(F.max_by("d", F.struct("n", "d"))).alias("busiest_day"), F.coalesce(F.max("n"), F.lit(0)).alias(busiest), F.count("*").alias("active_days"))
    return longest.crossJoin(F.broadcast(top))  # one row each


def streaks(t, r, today: date) -> DataFrame:
    days = _window(t, r).groupBy(local_day(F.col("first_added_at"), r.tz).alias("d")).agg(F.count("*").alias("n"))
    return day_streaks(days, today, "busiest_count")


def popularity_distribution(t, r) -> DataFrame:
    known = _window(t, r).join(_facts(t, "max_popularity"), "canonical_track_id").where("max_popularity is not null")
    return known.groupBy(bucket(F.col("max_popularity"), 5).alias("bucket")).agg(F.count("*").alias("count"))

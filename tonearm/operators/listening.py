"""Listening history. t: tables by name, r: a Range over played_at."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.listening import completed, country, device, heard, skipped, within
from ..functions.numbers import per, total
from ..functions.text import any_contains
from ..functions.times import day_text, hour, iso, local_day, local_month, local_year, month_text, weekday
from .common import first_artist, month_spine, paged, thumbs, with_credits
from .library import day_streaks, headline_credits, year_ranks

MINUTE, HOUR, DAY_S = 60_000, 3_600_000, 86_400


def _minutes() -> Column:
    return per(total(heard()), MINUTE)


def _window(t, r) -> DataFrame:
    return t["plays"].where(within("played_at", r))


def _resolved(plays: DataFrame, t, how: str = "inner") -> DataFrame:
    """Plays with their recording."""
    known = t["tracks"].select(F.col("id").alias("track_id"), "canonical_track_id")
    return plays.join(known, "track_id", how)


def _held(t) -> DataFrame:
    return t["library_canonical"].select("canonical_track_id", F.lit(True).alias("held"))


def listening_totals(t, r) -> DataFrame:
    """One row of headline numbers. Artists are counted in a scan of their own, for credits would multiply the plays."""
    facts = t["canonical_tracks"].select(F.col("id").alias("canonical_track_id"), "primary_album_id")
    joined = _resolved(_window(t, r), t, "left").join(facts, "canonical_track_id", "left").join(_held(t), "canonical_track_id", "left")
    span = round((r.end - r.start).total_seconds() / DAY_S)
    numbers = joined.agg(
        F.count("*").alias("plays"), total(heard()).alias("ms_played"), completed().alias("completed"), skipped().alias("skipped"),
        F.countDistinct("canonical_track_id").alias("recordings"), F.countDistinct("primary_album_id").alias("albums"),
        F.countDistinct(local_day(F.col("played_at"), r.tz)).alias("active_days"), F.lit(span).cast("long").alias("span_days"), F.count("held").alias("in_library_plays"),
        iso(F.min("played_at")).alias("first_played"), iso(F.max("played_at")).alias("last_played"),
    )
    credited = t["canonical_track_artists"].where("on_representative").select("canonical_track_id", "artist_id")
    artists = _resolved(_window(t, r).select("track_id"), t).select("canonical_track_id").distinct().join(credited, "canonical_track_id").agg(F.countDistinct("artist_id").alias("artists"))
    return numbers.crossJoin(F.broadcast(artists))  # one row each


def minutes_by_day(t, r) -> DataFrame:
    days = _window(t, r).groupBy(day_text(local_day(F.col("played_at"), r.tz)).alias("day")).agg(total(heard()).alias("ms"))
    return days.where("ms > 0").select("day", per(F.col("ms"), MINUTE).alias("value"))


def listening_by_month(t, r) -> DataFrame:
    """Minutes, plays and minutes of library recordings by month, without gaps."""
    joined = _resolved(_window(t, r), t, "left").join(_held(t), "canonical_track_id", "left")
    played = joined.groupBy(local_month(F.col("played_at"), r.tz).alias("m")).agg(_minutes().alias("minutes"), F.count("*").alias("plays"), per(total(F.when(F.col("held"), heard())), MINUTE).alias("library_minutes"))
    spine = month_spine(t["plays"].sparkSession, r.local_day("start"), r.local_day("end"))
    return spine.join(played, "m", "left").select(month_text(F.col("m")).alias("period"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("minutes", "plays", "library_minutes")))


def listening_clock(t, r) -> DataFrame:
    """Minutes by weekday and hour."""
    at = F.col("played_at")
    return _window(t, r).groupBy(weekday(at, r.tz).alias("weekday"), hour(at, r.tz).alias("hour")).agg(_minutes().alias("minutes"))


def _shares(rows: DataFrame, label) -> DataFrame:
    grouped = rows.groupBy(label.alias("label")).agg(total(heard()).alias("ms")).where("ms > 0")
    return grouped.select("label", per(F.col("ms"), MINUTE).alias("value"))


def device_share(t, r) -> DataFrame:
    return _shares(_window(t, r), device(F.col("platform")))


def country_share(t, r, limit: int = 8) -> DataFrame:
    return _shares(_window(t, r), country(F.col("conn_country"))).orderBy(F.desc("value"), "label").limit(limit)


def end_reasons(t, r, limit: int = 8) -> DataFrame:
    return _window(t, r).where("reason_end is not null").groupBy(F.col("reason_end").alias("label")).agg(F.count("*").alias("value")).orderBy(F.desc("value"), "label").limit(limit)


def completion_buckets(t, r) -> DataFrame:
    """Plays by how far they came, in tenths; what is longer than the recording counts as whole."""
    facts = t["canonical_tracks"].where("duration_ms > 0").select(F.col("id").alias("canonical_track_id"), "duration_ms")
    joined = _resolved(_window(t, r).where(heard().isNotNull()), t).join(facts, "canonical_track_id")
    tenth = F.call_function("div", heard().cast("long") * 10, F.col("duration_ms").cast("long"))
    return joined.groupBy((F.least(F.lit(10), tenth) * 10).cast("long").alias("bucket")).agg(F.count("*").alias("count"))


def top_played_tracks(t, r, limit: int = 20, in_library: bool | None = None) -> DataFrame:
    """Recordings by time heard; in_library keeps those that are in the library, or those that aren't."""
    joined = _resolved(_window(t, r), t)
    if in_library is not None:
        joined = joined.join(t["library_canonical"].select("canonical_track_id"), "canonical_track_id", "left_semi" if in_library else "left_anti")
    played = joined.groupBy("canonical_track_id").agg(F.count("*").alias("plays"), completed().alias("completed"), total(heard()).alias("ms_played"), iso(F.max("played_at")).alias("last_played_at"))
    facts = t["canonical_tracks"].select(F.col("id").alias("canonical_track_id"), "title", "primary_album_id")
    top = played.join(facts, "canonical_track_id").orderBy(F.desc("ms_played"), F.desc("plays"), "title", "canonical_track_id").limit(limit)
    covered = top.join(_held(t), "canonical_track_id", "left").join(thumbs(t["album_images"], "album_id").withColumnRenamed("album_id", "primary_album_id"), "primary_album_id", "left")
    return with_credits(covered, t).select("canonical_track_id", "title", "plays", "completed", "ms_played", "last_played_at", F.col("held").isNotNull().alias("in_library"), "cover", "artists")


def top_played_artists(t, r, limit: int = 20) -> DataFrame:
    """Every credited artist counts. Plays are summed by recording before credits multiply them."""
    by_recording = _resolved(_window(t, r), t).groupBy("canonical_track_id").agg(F.count("*").alias("plays"), total(heard()).alias("ms_played"))
    credited = t["canonical_track_artists"].where("on_representative").select("canonical_track_id", "artist_id")
    grouped = by_recording.join(credited, "canonical_track_id").groupBy("artist_id").agg(F.sum("plays").alias("plays"), F.sum("ms_played").alias("ms_played"), F.count("*").alias("recordings"))
    names = t["artists"].select(F.col("id").alias("artist_id"), "name")
    return grouped.join(names, "artist_id").select(F.col("artist_id").alias("id"), "name", "plays", "ms_played", "recordings").orderBy(F.desc("ms_played"), F.desc("plays"), "name", "id").limit(limit)


def top_played_albums(t, r, limit: int = 15) -> DataFrame:
    by_recording = _resolved(_window(t, r), t).groupBy("canonical_track_id").agg(F.count("*").alias("plays"), total(heard()).alias("ms_played"))
    facts = t["canonical_tracks"].select(F.col("id").alias("canonical_track_id"), F.col("primary_album_id").alias("album_id"))
    albums = t["albums"].where(~F.col("album_type").eqNullSafe("single")).select(F.col("id").alias("album_id"), "name")
    grouped = by_recording.join(facts, "canonical_track_id").groupBy("album_id").agg(F.sum("plays").alias("plays"), F.sum("ms_played").alias("ms_played"), F.count("*").alias("recordings"))
    top = grouped.join(albums, "album_id").orderBy(F.desc("ms_played"), F.desc("plays"), "name", "album_id").limit(limit)
    return top.join(first_artist(t, "album_id").select("album_id", "artist"), "album_id", "left").select(F.col("album_id").alias("id"), "name", "artist", "plays", "ms_played", "recordings")


def top_artists_by_year_played(t, r, top: int = 10) -> DataFrame:
    """Ranks by hours within each year; ranks are given before artists without a full hour are left out."""
    joined = _resolved(_window(t, r.padded()), t).join(headline_credits(t), "canonical_track_id")
    yearly = joined.groupBy(local_year(F.col("played_at"), r.tz).alias("yr"), "artist_id").agg(per(total(heard()), HOUR).alias("n"))
    return year_ranks(yearly, t, r, top).where("value > 0")


def discovery_vs_repeat(t, r) -> DataFrame:
    """Plays by month, of recordings first heard that month and of earlier ones; first plays are those of the statistics over the whole log."""
    firsts = t["canonical_play_stats"].select("canonical_track_id", F.col("first_played_at").alias("first_heard"))
    joined = _resolved(_window(t, r).select("track_id", "played_at"), t).join(firsts, "canonical_track_id")
    month, first = local_month(F.col("played_at"), r.tz), local_month(F.col("first_heard"), r.tz)
    return joined.groupBy(month_text(month).alias("period")).agg(F.count_if(month == first).alias("first_time"), F.count_if(month != first).alias("revisited"))


def listening_streaks(t, r, today: date) -> DataFrame:
    days = _window(t, r).groupBy(local_day(F.col("played_at"), r.tz).alias("d")).agg(_minutes().alias("n"))
    return day_streaks(days, today, "busiest_minutes").drop("active_days")


def _labelled(plays: DataFrame, t) -> DataFrame:
    facts = t["canonical_tracks"].select(F.col("id").alias("canonical_track_id"), F.col("title").alias("known_title"), F.col("primary_album_id").alias("album_id"), F.col("primary_artist_id").alias("artist_id"))
    albums = t["albums"].select(F.col("id").alias("album_id"), F.col("name").alias("known_album"))
    artists = t["artists"].select(F.col("id").alias("artist_id"), F.col("name").alias("known_artist"))
    return _resolved(plays, t, "left").join(facts, "canonical_track_id", "left").join(albums, "album_id", "left").join(artists, "artist_id", "left")


def play_log(t, r, limit: int = 50, offset: int = 0, q: str = "") -> DataFrame:
    """One page of the log, newest first, and how many plays match. Without a search only the page is labelled."""
    window, q = _window(t, r), q.strip()
    newest = [F.desc("played_at"), F.desc("id")]
    if q:
        found = _labelled(window, t).where(any_contains(q, F.coalesce("known_title", "track_name"), F.coalesce("known_artist", "artist_name")))
        page = paged(found, newest, limit, offset)
    else:
        page = _labelled(paged(window, newest, limit, offset), t)
    return page.select(
        "total", "id", iso(F.col("played_at")).alias("played_at"), heard().alias("ms_played"), (F.col("ms_played").isNull() & F.col("estimated_ms").isNotNull()).alias("estimated"), "item_kind",
        F.when(F.col("known_title").isNotNull(), F.col("canonical_track_id")).alias("canonical_track_id"), F.coalesce("known_title", "track_name", "episode_name", F.lit("(unknown)")).alias("title"),
        F.coalesce("known_artist", "artist_name").alias("artist"), F.when(F.col("known_artist").isNotNull(), F.col("artist_id")).alias("artist_id"),
        F.coalesce("known_album", "album_name", "show_name").alias("album"), "platform", "reason_end", "shuffle", "source",
    )


def coverage(t) -> DataFrame:
    """One row: how much of the log is resolved, where it comes from, and how many saved recordings were never played."""
    track, open_ = F.col("item_kind") == "track", F.col("track_id").isNull()
    numbers = t["plays"].agg(
        F.count("*").alias("plays"), F.count("track_id").alias("resolved"), F.count_if(open_ & track & F.col("resolve_attempted_at").isNull()).alias("pending"),
        F.count_if(open_ & track & F.col("resolve_attempted_at").isNotNull()).alias("unresolvable"), F.count_if(~track).alias("non_track"),
        F.count_if(F.col("source") == "extended").alias("from_export"), F.count_if(F.col("source") == "recent").alias("from_api"),
        iso(F.min("played_at")).alias("first_played"), iso(F.max("played_at")).alias("last_played"),
    )
    never = t["library_canonical"].join(t["canonical_play_stats"].select("canonical_track_id"), "canonical_track_id", "left_anti").agg(F.count("*").alias("saved_never_played"))
    return numbers.crossJoin(F.broadcast(never))  # one row each

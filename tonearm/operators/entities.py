"""Lists and pages of tracks, recordings, artists, albums and playlists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.listening import heard
from ..functions.numbers import per, total
from ..functions.text import any_contains
from ..functions.times import iso, local_month, month_text, months
from .common import filtered, first_artist, paged, sort_key, with_credits

MAX_PAGE, MAX_SEARCH = 100_000, 120


def page_params(page: int | str | None, q: str | None, size: int = 50) -> tuple[int, int, str]:
    """limit, offset and search text: pages from 1 to 100 000, searches of at most 120 characters."""
    try:
        n = int(page or 1)
    except ValueError:
        n = 1
    return size, (min(max(n, 1), MAX_PAGE) - 1) * size, (q or "").strip()[:MAX_SEARCH]


def _stats(t, *columns: str) -> DataFrame:
    return t["canonical_play_stats"].select("canonical_track_id", *columns)


def _recordings(t, *columns: str) -> DataFrame:
    return t["canonical_tracks"].select(F.col("id").alias("canonical_track_id"), *columns)


def _albums(t, key: str = "album_id") -> DataFrame:
    return t["albums"].select(F.col("id").alias(key), F.col("name").alias("album_name"))


COPIES = {"dupes": "copies_ > 1", "unique": "copies_ = 1"}
EXPLICIT = {"yes": "explicit", "no": "not explicit"}
LIKED_SORTS = {"added": "added_at", "name": "name", "artist": "artist", "popularity": "popularity", "duration": "duration_ms", "plays": "plays", "listened": "ms_played"}


def liked_tracks(t, sort: str = "added", direction: str = "desc", limit: int = 50, offset: int = 0, q: str = "", filters: dict | None = None) -> DataFrame:
    saved = t["saved_tracks"].where("removed_at is null").select("track_id", "added_at")
    tracks = t["tracks"].select(F.col("id").alias("track_id"), "name", "duration_ms", "popularity", "explicit", "canonical_track_id", "album_id")
    rows = saved.join(tracks, "track_id").join(_recordings(t, "copy_count"), "canonical_track_id", "left").join(_stats(t, "plays", "ms_played"), "canonical_track_id", "left").join(_albums(t), "album_id", "left").join(first_artist(t, "track_id").select("track_id", "artist"), "track_id", "left")
    rows = rows.withColumns({"plays": F.coalesce("plays", F.lit(0)), "ms_played": F.coalesce("ms_played", F.lit(0)), "copies_": F.coalesce("copy_count", F.lit(1))})
    if q:
        rows = rows.where(any_contains(q, F.col("name"), F.col("artist"), F.col("album_name")))
    rows = filtered(rows, filters, {"copies": COPIES, "explicit": EXPLICIT})
    counted = None if q or filters else saved.join(tracks.select("track_id"), "track_id")
    page = with_credits(paged(rows, [sort_key(LIKED_SORTS, sort, direction), F.asc("track_id")], limit, offset, counted), t, "track_id")
    return page.select("total", F.col("track_id").alias("id"), "name", "duration_ms", "popularity", "explicit", iso(F.col("added_at")).alias("added_at"), "canonical_track_id", "copy_count", F.when(F.col("album_name").isNotNull(), F.col("album_id")).alias("album_id"), "album_name", "artists", "plays", "ms_played")


LIBRARY_SORTS = {"added": "first_added_at", "name": "title", "artist": "artist", "popularity": "max_popularity", "duration": "duration_ms", "copies": "copy_count", "plays": "plays", "listened": "ms_played", "lastPlayed": "last_played_at"}
SOURCES = {"liked": "liked", "playlist": "owned_playlist_count > 0", "liked-only": "liked and owned_playlist_count = 0", "playlist-only": "owned_playlist_count > 0 and not liked"}
PLAYED = {"played": "plays > 0", "never": "never"}


def library_rows(t) -> DataFrame:
    """Library recordings with facts, plays, album and artist names."""
    facts = _recordings(t, "representative_track_id", "title", "kind", "max_popularity", "copy_count", "earliest_release_date")
    library = t["library_canonical"]
    artists = t["artists"].select(F.col("id").alias("primary_artist_id"), F.col("name").alias("artist"))
    rows = library.join(facts, "canonical_track_id").join(_stats(t, "plays", "ms_played", "last_played_at"), "canonical_track_id", "left").join(_albums(t, "primary_album_id"), "primary_album_id", "left").join(artists, "primary_artist_id", "left")
    return rows.withColumns({"never": F.col("plays").isNull(), "plays": F.coalesce("plays", F.lit(0)), "ms_played": F.coalesce("ms_played", F.lit(0)), "copies_": F.col("copy_count")})


def library_recordings(t, sort: str = "added", direction: str = "desc", limit: int = 50, offset: int = 0, q: str = "", filters: dict | None = None) -> DataFrame:
    rows = library_rows(t)
    if q:
        rows = rows.where(any_contains(q, F.col("title"), F.col("artist"), F.col("album_name")))
    rows = filtered(rows, filters, {"source": SOURCES, "copies": COPIES, "explicit": EXPLICIT, "played": PLAYED})
    counted = None if q or filters else t["library_canonical"].join(_recordings(t), "canonical_track_id")
    page = with_credits(paged(rows, [sort_key(LIBRARY_SORTS, sort, direction), F.asc("canonical_track_id")], limit, offset, counted), t)
    return page.select(
        "total", "canonical_track_id", "representative_track_id", "title", "kind", "duration_ms", F.col("max_popularity").alias("popularity"), "explicit", "copy_count", "copy_count_in_library", "liked",
        iso(F.col("first_added_at")).alias("first_added_at"), "owned_playlist_count", F.when(F.col("album_name").isNotNull(), F.col("primary_album_id")).alias("album_id"), "album_name", "artists", "plays", "ms_played", iso(F.col("last_played_at")).alias("last_played_at"),
    )


ARTIST_SORTS = {"tracks": "tracks", "name": "name", "albums": "albums", "duration": "duration_ms", "popularity": "popularity", "followers": "followers_total", "plays": "plays", "listened": "ms_played"}
FOLLOWED = {"yes": "followed", "no": "not followed"}


def artist_index(t, sort: str = "tracks", direction: str = "desc", limit: int = 50, offset: int = 0, q: str = "", genre: str = "", filters: dict | None = None) -> DataFrame:
    """Artists of the library; plays are over all recordings that credit them, in the library or not."""
    artists = t["artists"].select(F.col("id").alias("artist_id"), "name", "popularity", "followers_total")
    if q:
        artists = artists.where(any_contains(q, F.col("name")))
    if genre:
        artists = artists.join(t["artist_genres"].where(F.col("genre") == genre).select("artist_id"), "artist_id", "left_semi")
    followed = t["followed_artists"].where("removed_at is null").select("artist_id", F.lit(True).alias("followed"))
    artists = artists.join(followed, "artist_id", "left").withColumn("followed", F.coalesce("followed", F.lit(False)))
    artists = filtered(artists, filters, {"followed": FOLLOWED})
    credits = t["canonical_track_artists"].select("canonical_track_id", "artist_id", "on_representative")  # one row for a recording and an artist
    if q or genre or filters:
        credits = credits.join(artists.select("artist_id"), "artist_id", "left_semi")
    held = credits.join(t["library_canonical"].select("canonical_track_id", "primary_album_id", "duration_ms"), "canonical_track_id")
    # By artist and album first: a count of distinct albums is then one of groups.
    by_album = held.groupBy("artist_id", "primary_album_id").agg(F.count(F.lit(1)).alias("n"), F.sum("duration_ms").alias("ms"))
    counted = by_album.groupBy("artist_id").agg(F.sum("n").alias("tracks"), F.count("primary_album_id").alias("albums"), total(F.col("ms")).alias("duration_ms"))
    played = credits.where("on_representative").join(_stats(t, "plays", "ms_played"), "canonical_track_id").groupBy("artist_id").agg(F.sum("plays").alias("plays"), F.sum("ms_played").alias("ms_played"))
    genres = t["artist_genres"].groupBy("artist_id").agg(F.min("genre").alias("genre"))
    rows = artists.join(counted, "artist_id").join(played, "artist_id", "left").join(genres, "artist_id", "left")
    rows = rows.withColumns({"plays": F.coalesce("plays", F.lit(0)), "ms_played": F.coalesce("ms_played", F.lit(0))})
    counted = artists.join(held.select("artist_id"), "artist_id", "left_semi")
    page = paged(rows, [sort_key(ARTIST_SORTS, sort, direction), F.asc("name"), F.asc("artist_id")], limit, offset, counted)
    return page.select("total", F.col("artist_id").alias("id"), "name", "popularity", "followers_total", "tracks", "albums", "duration_ms", "genre", "followed", "plays", "ms_played")


def library_genres(t, limit: int = 40) -> DataFrame:
    """Artist genres by artists of the library."""
    held = t["canonical_track_artists"].join(t["library_canonical"].select("canonical_track_id"), "canonical_track_id", "left_semi").select("artist_id").distinct()
    known = held.join(t["artists"].select(F.col("id").alias("artist_id")), "artist_id", "left_semi")
    return t["artist_genres"].join(known, "artist_id").groupBy("genre").agg(F.countDistinct("artist_id").alias("artists")).orderBy(F.desc("artists"), "genre").limit(limit)


ALBUM_SORTS = {"tracks": "tracks", "coverage": "coverage", "name": "name", "artist": "artist", "released": "release_date_start", "total": "total_tracks", "popularity": "popularity", "plays": "plays", "listened": "ms_played"}
ALBUM_FILTERS = {
    "type": {k: f"album_type = '{k}'" for k in ("album", "single", "compilation")},
    "saved": {"yes": "saved", "no": "not saved"},
    "coverage": {"full": "tracks >= total_tracks", "partial": "tracks < total_tracks"},
}


def _plays_over(t, members: DataFrame, key: str) -> DataFrame:
    """key, plays, ms_played: sums over the distinct recordings of each key."""
    return members.where("canonical_track_id is not null").select(key, "canonical_track_id").distinct().join(_stats(t, "plays", "ms_played"), "canonical_track_id").groupBy(key).agg(F.sum("plays").alias("plays"), F.sum("ms_played").alias("ms_played"))


def album_index(t, sort: str = "tracks", direction: str = "desc", limit: int = 50, offset: int = 0, q: str = "", filters: dict | None = None) -> DataFrame:
    """Albums with a track in the library."""
    tracks = t["tracks"].select(F.col("id").alias("track_id"), "album_id", "canonical_track_id")
    held = tracks.join(t["library_tracks"].select("track_id"), "track_id", "left_semi").groupBy("album_id").agg(F.countDistinct("canonical_track_id").alias("tracks"))
    saved = t["saved_albums"].where("removed_at is null").select("album_id", F.lit(True).alias("saved"))
    albums = t["albums"].select(F.col("id").alias("album_id"), "name", "album_type", "release_date", "release_date_start", "total_tracks", "popularity")
    rows = albums.join(held, "album_id").join(first_artist(t, "album_id"), "album_id", "left").join(saved, "album_id", "left").join(_plays_over(t, tracks, "album_id"), "album_id", "left")
    rows = rows.withColumns({"plays": F.coalesce("plays", F.lit(0)), "ms_played": F.coalesce("ms_played", F.lit(0)), "saved": F.coalesce("saved", F.lit(False)), "coverage": F.col("tracks") / F.nullif("total_tracks", F.lit(0))})
    if q:
        rows = rows.where(any_contains(q, F.col("name"), F.col("artist")))
    rows = filtered(rows, filters, ALBUM_FILTERS)
    counted = None if q or filters else albums.join(held.select("album_id"), "album_id", "left_semi")
    page = paged(rows, [sort_key(ALBUM_SORTS, sort, direction), F.asc("name"), F.asc("album_id")], limit, offset, counted)
    return page.select("total", F.col("album_id").alias("id"), "name", "album_type", "release_date", "total_tracks", "popularity", "tracks", "saved", "artist", "artist_id", "plays", "ms_played")


PLAYLIST_SORTS = {"tracks": "tracks", "name": "name", "library": "library_tracks", "duration": "duration_ms", "added": "last_added", "owner": "owner", "plays": "plays", "listened": "ms_played"}
PLAYLIST_FILTERS = {"owner": {"mine": "is_owned", "others": "not is_owned"}, "access": {"collab": "collaborative", "public": "public", "private": "not public"}}


def playlist_index(t, sort: str = "tracks", direction: str = "desc", limit: int = 50, offset: int = 0, q: str = "", filters: dict | None = None) -> DataFrame:
    """Playlists; plays are over their distinct recordings, however often an item repeats."""
    lists = t["playlists"].where("removed_at is null").withColumnRenamed("id", "playlist_id").join(t["users"].select(F.col("id").alias("owner_id"), F.col("display_name").alias("owner_name")), "owner_id", "left")
    if q:
        lists = lists.where(any_contains(q, F.col("name"), F.coalesce("description", F.lit(""))))
    lists = filtered(lists, filters, PLAYLIST_FILTERS)
    tracks = t["tracks"].select(F.col("id").alias("track_id"), "duration_ms", "canonical_track_id")
    held = t["library_tracks"].select("track_id", F.col("track_id").alias("held_id"))
    # One pass over the items: by playlist and track, then by recording, so that plays count once for each of a playlist's recordings.
    items = t["playlist_tracks"].join(lists.select("playlist_id"), "playlist_id", "left_semi").groupBy("playlist_id", "track_id").agg(F.count(F.lit(1)).alias("n"), F.max("added_at").alias("added"))
    by_recording = items.join(tracks, "track_id", "left").join(held, "track_id", "left").groupBy("playlist_id", "canonical_track_id").agg(
        F.sum("n").alias("n"), F.count("held_id").alias("held"), F.sum(F.col("n") * F.col("duration_ms")).alias("duration"), F.max("added").alias("added")
    )
    stored = by_recording.join(_stats(t, "plays", "ms_played"), "canonical_track_id", "left").groupBy("playlist_id").agg(
        F.sum("n").alias("tracks"), F.sum("held").alias("library_tracks"), total(F.col("duration")).alias("duration_ms"), F.max("added").alias("last_added"), F.sum("plays").alias("plays"), F.sum("ms_played").alias("ms_played")
    )
    rows = lists.join(stored, "playlist_id", "left")
    rows = rows.withColumns({**{c: F.coalesce(c, F.lit(0)) for c in ("tracks", "library_tracks", "duration_ms", "plays", "ms_played")}, "owner": F.coalesce("owner_name", "owner_id")})
    page = paged(rows, [sort_key(PLAYLIST_SORTS, sort, direction), F.asc("name"), F.asc("playlist_id")], limit, offset, lists)
    return page.select("total", F.col("playlist_id").alias("id"), "name", "description", "owner_id", "owner_name", "is_owned", "collaborative", "public", "tracks", "library_tracks", "duration_ms", iso(F.col("last_added")).alias("last_added_at"), "plays", "ms_played")


# --- plays of one thing


def _summary(stats: DataFrame) -> DataFrame:
    return stats.agg(
        total(F.col("plays")).alias("plays"), total(F.col("completed_plays")).alias("completed"), total(F.col("skips")).alias("skips"), total(F.col("ms_played")).alias("ms_played"),
        iso(F.min("first_played_at")).alias("first_played_at"), iso(F.max("last_played_at")).alias("last_played_at"),
    )


def track_play_summary(t, recording: str) -> DataFrame:
    """One row; zeros where nothing was played."""
    return _summary(t["canonical_play_stats"].where(F.col("canonical_track_id") == recording))


def artist_play_summary(t, artist: str) -> DataFrame:
    mine = t["canonical_track_artists"].where((F.col("artist_id") == artist) & F.col("on_representative")).select("canonical_track_id")
    return _summary(t["canonical_play_stats"].join(mine, "canonical_track_id", "left_semi"))


def album_play_summary(t, album: str) -> DataFrame:
    mine = t["tracks"].where(F.col("album_id") == album).select("canonical_track_id")
    return _summary(t["canonical_play_stats"].join(mine, "canonical_track_id", "left_semi"))


def playlist_play_summary(t, playlist: str) -> DataFrame:
    items = t["playlist_tracks"].where(F.col("playlist_id") == playlist).select("track_id")
    mine = t["tracks"].select(F.col("id").alias("track_id"), "canonical_track_id").join(items, "track_id", "left_semi")
    return _summary(t["canonical_play_stats"].join(mine.select("canonical_track_id"), "canonical_track_id", "left_semi"))


def _plays_of(t, recording: str) -> DataFrame:
    copies = t["tracks"].where(F.col("canonical_track_id") == recording).select(F.col("id").alias("track_id"))
    return t["plays"].join(copies, "track_id", "left_semi")


def track_plays_by_month(t, recording: str, tz: str) -> DataFrame:
    """Plays and minutes by month from the first to the last play, without gaps."""
    month = local_month(F.col("played_at"), tz)
    played = _plays_of(t, recording).groupBy(month.alias("m")).agg(F.count("*").alias("plays"), per(total(heard()), 60_000).alias("minutes"))
    spine = played.agg(F.min("m").alias("lo"), F.max("m").alias("hi")).where("lo is not null").select(F.explode(months(F.col("lo"), F.col("hi"))).alias("m"))
    return spine.join(played, "m", "left").select(month_text(F.col("m")).alias("period"), F.coalesce("plays", F.lit(0)).alias("plays"), F.coalesce("minutes", F.lit(0)).alias("minutes"))


def recent_plays_for(t, recording: str, limit: int = 12) -> DataFrame:
    newest = _plays_of(t, recording).orderBy(F.desc("played_at"), F.desc("id")).limit(limit)
    return newest.select("id", iso(F.col("played_at")).alias("played_at"), heard().alias("ms_played"), (F.col("ms_played").isNull() & F.col("estimated_ms").isNotNull()).alias("estimated"), "platform", "reason_start", "reason_end", "shuffle", "source")


def artist_top_played(t, artist: str, limit: int = 10) -> DataFrame:
    mine = t["canonical_track_artists"].where((F.col("artist_id") == artist) & F.col("on_representative")).select("canonical_track_id")
    top = t["canonical_play_stats"].join(mine, "canonical_track_id", "left_semi").join(_recordings(t, "title", "primary_album_id"), "canonical_track_id").orderBy(F.desc("ms_played"), F.desc("plays"), "title", "canonical_track_id").limit(limit)
    held = t["library_canonical"].select("canonical_track_id", F.lit(True).alias("held"))
    return with_credits(top.join(held, "canonical_track_id", "left"), t).select("canonical_track_id", "title", "plays", "ms_played", iso(F.col("last_played_at")).alias("last_played_at"), F.col("held").isNotNull().alias("in_library"), "artists")


# --- pages


def canonical_track(t, recording: str) -> DataFrame:
    """A recording's page; credits are those of all its copies."""
    one = _recordings(t, *[c for c in t["canonical_tracks"].columns if c != "id"]).where(F.col("canonical_track_id") == recording)
    mine = t["library_canonical"].where(F.col("canonical_track_id") == recording).select("canonical_track_id", "first_added_at", "latest_added_at", "liked", "copy_count_in_library", "owned_playlist_count")
    copies = t["tracks"].where(F.col("canonical_track_id") == recording).select(F.col("id").alias("track_id"), "canonical_track_id")
    liked_at = t["saved_tracks"].where("removed_at is null").join(copies, "track_id").groupBy("canonical_track_id").agg(F.min("added_at").alias("liked_at"))
    named = t["canonical_track_artists"].where(F.col("canonical_track_id") == recording).join(t["artists"].select(F.col("id").alias("artist_id"), "name"), "artist_id")
    listed = named.groupBy("canonical_track_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", F.col("artist_id").alias("id"), "name"))), lambda s: F.struct(s["id"].alias("id"), s["name"].alias("name"))).alias("artists"))
    rows = one.join(_albums(t, "primary_album_id"), "primary_album_id", "left").join(mine, "canonical_track_id", "left").join(liked_at, "canonical_track_id", "left").join(listed, "canonical_track_id", "left")
    return rows.select(
        F.col("canonical_track_id").alias("id"), "kind", "isrc", "title", "duration_ms", "explicit", "representative_track_id", "max_popularity", "copy_count", F.col("earliest_release_date").cast("string").alias("earliest_release_date"),
        "primary_album_id", F.col("album_name").alias("primary_album_name"), F.coalesce("artists", F.array().cast("array<struct<id:string,name:string>>")).alias("artists"), iso(F.col("first_added_at")).alias("first_added_at"), iso(F.col("latest_added_at")).alias("latest_added_at"),
        F.coalesce("liked", F.lit(False)).alias("liked"), iso(F.col("liked_at")).alias("liked_at"), F.coalesce("copy_count_in_library", F.lit(0)).alias("copy_count_in_library"), F.coalesce("owned_playlist_count", F.lit(0)).alias("owned_playlist_count"),
    )


def track_copies(t, recording: str) -> DataFrame:
    """A recording's copies: the representative, then by popularity, release and id; place numbers them."""
    copies = t["tracks"].where(F.col("canonical_track_id") == recording).withColumnRenamed("id", "track_id")
    albums = t["albums"].select(F.col("id").alias("album_id"), F.col("name").alias("album_name"), "album_type", F.col("release_date").alias("album_release_date"), "release_date_start")
    rep = _recordings(t, "representative_track_id")
    held = t["library_tracks"].select("track_id", F.lit(True).alias("held"))
    liked = t["saved_tracks"].where("removed_at is null").select("track_id", F.col("added_at").alias("liked_at"))
    lists = t["playlist_tracks"].join(copies.select("track_id"), "track_id", "left_semi").groupBy("track_id").agg(F.count("*").alias("playlist_count"))
    rows = copies.join(rep, "canonical_track_id").join(albums, "album_id", "left").join(held, "track_id", "left").join(liked, "track_id", "left").join(lists, "track_id", "left")
    rows = with_credits(rows, t, "track_id").withColumn("is_representative", F.col("track_id") == F.col("representative_track_id"))
    return rows.orderBy(F.desc("is_representative"), F.col("popularity").desc_nulls_last(), F.col("release_date_start").asc_nulls_last(), "track_id").select(
        F.col("track_id").alias("id"), "name", "duration_ms", "popularity", "explicit", "disc_number", "track_number", "is_local", "isrc", "linked_from_id", "album_id", "album_name", "album_type", "album_release_date", "artists",
        "is_representative", F.col("held").isNotNull().alias("in_library"), iso(F.col("liked_at")).alias("liked_at"), F.coalesce("playlist_count", F.lit(0)).alias("playlist_count"),
    )


def track_playlists(t, recording: str) -> DataFrame:
    copies = t["tracks"].where(F.col("canonical_track_id") == recording).select(F.col("id").alias("track_id"))
    lists = t["playlists"].where("removed_at is null").select(F.col("id").alias("playlist_id"), "name", "is_owned", "collaborative")
    users = t["users"].select(F.col("id").alias("added_by_id"), "display_name")
    rows = t["playlist_tracks"].join(copies, "track_id", "left_semi").join(lists, "playlist_id").join(users, "added_by_id", "left")
    grouped = rows.groupBy(F.col("playlist_id").alias("id"), "name", "is_owned", "collaborative").agg(F.count("*").alias("occurrences"), F.min("added_at").alias("first"), F.min("added_by_id").alias("added_by_id"), F.min("display_name").alias("added_by_name"), F.array_sort(F.collect_list("position")).alias("positions"))
    return grouped.orderBy(F.desc("is_owned"), F.col("first").asc_nulls_last(), "name").withColumn("added_at", iso(F.col("first"))).drop("first")


def recording_of(t, track: str) -> DataFrame:
    return t["tracks"].where(F.col("id") == track).select("canonical_track_id")


def artist(t, artist_id: str) -> DataFrame:
    one = t["artists"].where(F.col("id") == artist_id)
    genres = t["artist_genres"].where(F.col("artist_id") == artist_id).groupBy(F.col("artist_id").alias("id")).agg(F.array_sort(F.collect_list("genre")).alias("genres"))
    followed = t["followed_artists"].where((F.col("artist_id") == artist_id) & F.col("removed_at").isNull()).select(F.col("artist_id").alias("id"), iso(F.col("first_seen_at")).alias("followed_at"))
    return one.join(genres, "id", "left").join(followed, "id", "left").select("id", "name", "popularity", "followers_total", "detail_level", F.coalesce("genres", F.array().cast("array<string>")).alias("genres"), "followed_at")


def artist_stats(t, artist_id: str) -> DataFrame:
    """One row over all recordings that credit the artist."""
    mine = t["canonical_track_artists"].where(F.col("artist_id") == artist_id).select("canonical_track_id")
    numbers = t["library_canonical"].join(mine, "canonical_track_id", "left_semi").agg(
        F.count("*").alias("library_recordings"), total(F.col("copy_count_in_library")).alias("library_copies"), total(F.col("duration_ms")).alias("duration_ms"), F.countDistinct("primary_album_id").alias("albums_in_library"),
        F.count_if("liked").alias("liked_recordings"), iso(F.min("first_added_at")).alias("first_added_at"), iso(F.max("latest_added_at")).alias("latest_added_at"),
    )
    albums = t["album_artists"].where(F.col("artist_id") == artist_id).agg(F.count("*").alias("catalog_albums"))
    return numbers.crossJoin(F.broadcast(albums))  # one row each


def artist_albums(t, artist_id: str) -> DataFrame:
    mine = t["album_artists"].where(F.col("artist_id") == artist_id).select("album_id")
    held = t["tracks"].select(F.col("id").alias("track_id"), "album_id", "canonical_track_id").join(mine, "album_id", "left_semi").join(t["library_tracks"].select("track_id"), "track_id", "left_semi").groupBy("album_id").agg(F.countDistinct("canonical_track_id").alias("library_tracks"))
    saved = t["saved_albums"].where("removed_at is null").select("album_id", F.lit(True).alias("saved"))
    rows = t["albums"].withColumnRenamed("id", "album_id").join(mine, "album_id").join(held, "album_id", "left").join(saved, "album_id", "left")
    return rows.orderBy(F.col("release_date_start").desc_nulls_last(), "name").select(F.col("album_id").alias("id"), "name", F.coalesce("album_type", F.lit("other")).alias("album_type"), "release_date", "total_tracks", F.coalesce("library_tracks", F.lit(0)).alias("library_tracks"), F.coalesce("saved", F.lit(False)).alias("saved"))


def artist_top_tracks(t, artist_id: str, limit: int = 20) -> DataFrame:
    mine = t["canonical_track_artists"].where(F.col("artist_id") == artist_id).select("canonical_track_id")
    rows = t["library_canonical"].select("canonical_track_id", "liked", "first_added_at").join(mine, "canonical_track_id", "left_semi").join(_recordings(t, "title", "duration_ms", "max_popularity", "explicit", "copy_count", "primary_album_id"), "canonical_track_id")
    top = rows.orderBy(F.col("max_popularity").desc_nulls_last(), "title", "canonical_track_id").limit(limit)
    return top.join(_albums(t, "primary_album_id"), "primary_album_id", "left").select("canonical_track_id", "title", "duration_ms", F.col("max_popularity").alias("popularity"), "explicit", "copy_count", "liked", iso(F.col("first_added_at")).alias("first_added_at"), F.col("primary_album_id").alias("album_id"), "album_name")


def album(t, album_id: str) -> DataFrame:
    one = t["albums"].where(F.col("id") == album_id).withColumnRenamed("id", "album_id")
    saved = t["saved_albums"].where("removed_at is null").select("album_id", iso(F.col("added_at")).alias("saved_at"))
    genres = t["album_genres"].where(F.col("album_id") == album_id).groupBy("album_id").agg(F.array_sort(F.collect_list("genre")).alias("genres"))
    rows = with_credits(one.join(saved, "album_id", "left").join(genres, "album_id", "left"), t, "album_id")
    return rows.select(
        F.col("album_id").alias("id"), "name", "album_type", "release_date", "release_date_precision", "total_tracks", "label", "popularity", "upc", "detail_level", "tracks_complete",
        F.size(F.coalesce("available_markets", F.array().cast("array<string>"))).alias("market_count"), "saved_at", "artists", F.coalesce("genres", F.array().cast("array<string>")).alias("genres"),
    )


def album_editions(t, album_id: str) -> DataFrame:
    """The other albums of the same group."""
    mine = t["albums"].where(F.col("id") == album_id).select("album_group_id")
    groups = t["album_groups"].where("copy_count > 1").select(F.col("id").alias("album_group_id"), "representative_album_id").join(mine, "album_group_id", "left_semi")
    saved = t["saved_albums"].where("removed_at is null").select(F.col("album_id").alias("id"), F.lit(True).alias("saved"))
    rows = t["albums"].where(F.col("id") != album_id).join(groups, "album_group_id").join(saved, "id", "left")
    return rows.orderBy(F.col("release_date_start").asc_nulls_last(), "id").select("id", "name", "album_type", "release_date", F.coalesce("saved", F.lit(False)).alias("saved"), (F.col("id") == F.col("representative_album_id")).alias("representative"))


def album_tracks(t, album_id: str) -> DataFrame:
    rows = t["tracks"].where(F.col("album_id") == album_id).withColumnRenamed("id", "track_id")
    held = t["library_tracks"].select("track_id", F.lit(True).alias("held"))
    other = t["library_canonical"].select("canonical_track_id", F.lit(True).alias("recording_held"))
    liked = t["saved_tracks"].where("removed_at is null").select("track_id", F.lit(True).alias("liked"))
    rows = rows.join(held, "track_id", "left").join(other, "canonical_track_id", "left").join(_stats(t, "plays", "ms_played"), "canonical_track_id", "left").join(liked, "track_id", "left")
    return with_credits(rows, t, "track_id").orderBy("disc_number", "track_number", "name").select(
        F.col("track_id").alias("id"), "name", "disc_number", "track_number", "duration_ms", "explicit", "popularity", "canonical_track_id", "artists", F.col("held").isNotNull().alias("in_library"),
        (F.col("held").isNull() & F.col("recording_held").isNotNull()).alias("via_other_copy"), F.col("liked").isNotNull().alias("liked"), F.coalesce("plays", F.lit(0)).alias("plays"), F.coalesce("ms_played", F.lit(0)).alias("ms_played"),
    )


def playlist(t, playlist_id: str) -> DataFrame:
    tracks = t["tracks"].select(F.col("id").alias("track_id"), "duration_ms", "canonical_track_id")
    held = t["library_tracks"].select("track_id", F.col("track_id").alias("held_id"))
    items = t["playlist_tracks"].where(F.col("playlist_id") == playlist_id).join(tracks, "track_id", "left").join(held, "track_id", "left")
    stored = items.agg(
        F.count("*").alias("stored_tracks"), F.count("track_id").alias("resolved_tracks"), F.count_if("is_local").alias("local_tracks"), total(F.col("duration_ms")).alias("duration_ms"), F.countDistinct("canonical_track_id").alias("distinct_recordings"),
        F.countDistinct("held_id").alias("in_library"), iso(F.min("added_at")).alias("first_added_at"), iso(F.max("added_at")).alias("last_added_at"), F.countDistinct("added_by_id").alias("contributor_count"),
    )
    users = t["users"].select(F.col("id").alias("owner_id"), F.col("display_name").alias("owner_name"))
    one = t["playlists"].where(F.col("id") == playlist_id).join(users, "owner_id", "left").select("id", "name", "description", "owner_id", "owner_name", "is_owned", "collaborative", "public", "snapshot_id", "total_tracks")
    return one.crossJoin(F.broadcast(stored))  # one row each


def playlist_items(t, playlist_id: str) -> DataFrame:
    items = t["playlist_tracks"].where(F.col("playlist_id") == playlist_id)
    tracks = t["tracks"].select(F.col("id").alias("track_id"), "name", "duration_ms", "explicit", "popularity", "canonical_track_id", "album_id")
    held = t["library_tracks"].select("track_id", F.lit(True).alias("held"))
    liked = t["saved_tracks"].where("removed_at is null").select("track_id", F.lit(True).alias("liked"))
    users = t["users"].select(F.col("id").alias("added_by_id"), F.col("display_name").alias("added_by_name"))
    rows = items.join(tracks, "track_id", "left").join(_recordings(t, "copy_count"), "canonical_track_id", "left").join(_albums(t), "album_id", "left").join(users, "added_by_id", "left").join(held, "track_id", "left").join(liked, "track_id", "left")
    return with_credits(rows, t, "track_id").orderBy("position").select(
        "position", "track_id", F.coalesce("name", "local_name", F.lit("(unavailable)")).alias("name"), "duration_ms", F.coalesce("explicit", F.lit(False)).alias("explicit"), "popularity", "canonical_track_id", "copy_count",
        F.when(F.col("album_name").isNotNull(), F.col("album_id")).alias("album_id"), "album_name", "artists", "local_artist", "is_local", iso(F.col("added_at")).alias("added_at"), "added_by_id", "added_by_name", F.col("held").isNotNull().alias("in_library"), F.col("liked").isNotNull().alias("liked"),
    )


def covers(images: DataFrame, key: str) -> DataFrame:
    """key and cover: the widest image."""
    return images.groupBy(key).agg(F.max_by("url", F.coalesce("width", F.lit(0))).alias("cover"))



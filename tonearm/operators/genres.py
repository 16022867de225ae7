"""Genre sets: vocabulary, overlaps, and collections of genres resolved to recordings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import total
from ..functions.text import any_contains, slug
from ..functions.times import iso
from .common import with_credits
from .entities import library_rows

# The most tracks that a collection resolves to, and the genres shown with a track.
MAX_TRACKS, SHOWN_GENRES = 10_000, 8
#: Column or expression, and whether the largest stand first; nulls stand last.
SORTS = {
    "added": ("first_added_at", True), "plays": ("plays", True), "listened": ("ms_played", True), "popularity": ("max_popularity", True), "released": ("earliest_release_date", True),
    "title": ("title", False), "artist": ("artist", False), "random": ("md5(canonical_track_id)", False),
}


def _order(sort: str) -> list[Column]:
    what, descending = SORTS.get(sort, SORTS["added"])
    return [F.expr(what).desc_nulls_last() if descending else F.expr(what).asc_nulls_last(), F.asc("canonical_track_id")]


def library_edges(t) -> DataFrame:
    """genre and canonical_track_id of the library's recordings, each once."""
    return t["track_genres"].join(t["library_canonical"].select("canonical_track_id"), "canonical_track_id", "left_semi").select("genre", "canonical_track_id").distinct()


def _stats(t) -> DataFrame:
    return t["canonical_play_stats"].select("canonical_track_id", "plays", "ms_played", "last_played_at")


def sizes(t) -> DataFrame:
    """genre and tracks of vocabulary(), without plays."""
    return library_edges(t).groupBy("genre").agg(F.count("*").alias("tracks"))


def vocabulary(t) -> DataFrame:
    """Tracks, plays and time heard of each genre of the library."""
    return library_edges(t).join(_stats(t), "canonical_track_id", "left").groupBy("genre").agg(F.count("*").alias("tracks"), total(F.col("plays")).alias("plays"), total(F.col("ms_played")).alias("ms_played"))


def coverage(t) -> DataFrame:
    described = library_edges(t).agg(F.countDistinct("canonical_track_id").alias("described"))
    return described.crossJoin(F.broadcast(t["library_canonical"].agg(F.count("*").alias("library"))))  # one row each


def matching(t, genres: list[str], match: str = "any") -> DataFrame:
    """canonical_track_id of the recordings with any, or all, of the genres; none for an empty list."""
    edges = t["track_genres"].where(F.col("genre").isin(genres) if genres else F.lit(False)).select("canonical_track_id", "genre").distinct()
    if match == "all":
        return edges.groupBy("canonical_track_id").agg(F.count("*").alias("n")).where(F.col("n") == len(genres)).select("canonical_track_id")
    return edges.select("canonical_track_id").distinct()


def _selected(t, genres: list[str], match: str, matched: DataFrame | None = None) -> DataFrame:
    facts = t["canonical_tracks"].select(F.col("id").alias("canonical_track_id"))
    return t["library_canonical"].join(facts, "canonical_track_id").join(matching(t, genres, match) if matched is None else matched, "canonical_track_id", "left_semi").join(_stats(t), "canonical_track_id", "left")


def _sums() -> list[Column]:
    return [
        F.count("*").alias("tracks"), F.count_if("liked").alias("liked"), F.countDistinct("primary_artist_id").alias("artists"), total(F.col("duration_ms")).alias("duration_ms"),
        total(F.col("plays")).alias("plays"), total(F.col("ms_played")).alias("ms_played"),
    ]


def selection_stats(t, genres: list[str], match: str = "any", matched: DataFrame | None = None) -> DataFrame:
    """One row; zeros for an empty selection. matched: the recordings that match, if known otherwise."""
    return _selected(t, genres, match, matched).agg(*_sums())


def genre_summary(t, genre: str) -> DataFrame:
    """One row, or none for a genre that no recording has."""
    numbers = _selected(t, [genre], "any").agg(*_sums(), F.countDistinct("primary_album_id").alias("albums"), iso(F.min("first_added_at")).alias("first_added_at"), iso(F.max("last_played_at")).alias("last_played_at"))
    catalog = t["track_genres"].where(F.col("genre") == genre).agg(F.countDistinct("canonical_track_id").alias("catalog_tracks"), F.coalesce(F.max("votes"), F.lit(0)).alias("top_votes"))
    both = numbers.crossJoin(F.broadcast(catalog))  # one row each
    return both.where("tracks > 0 or catalog_tracks > 0").select(F.lit(genre).alias("genre"), "*")


def related_genres(t, genre: str, limit: int = 14) -> DataFrame:
    """Genres that share recordings with one, by the Jaccard index of their sets."""
    edges = library_edges(t)
    seed = edges.where(F.col("genre") == genre).select("canonical_track_id")
    totals = edges.groupBy("genre").agg(F.count("*").alias("tracks"))
    size = seed.agg(F.count("*").alias("seed"))
    shared = edges.where(F.col("genre") != genre).join(seed, "canonical_track_id", "left_semi").groupBy("genre").agg(F.count("*").alias("shared"))
    rows = shared.join(totals, "genre").crossJoin(F.broadcast(size))  # one row
    overlap = F.col("shared").cast("double") / (F.col("seed") + F.col("tracks") - F.col("shared"))
    return rows.where(F.col("shared") >= F.least(F.lit(3), F.col("seed"))).select("genre", "shared", "tracks", overlap.alias("overlap")).orderBy(F.desc("overlap"), F.desc("shared"), "genre").limit(limit)


def genre_artists(t, genre: str, limit: int = 8) -> DataFrame:
    artists = t["artists"].select(F.col("id").alias("primary_artist_id"), "name")
    grouped = _selected(t, [genre], "any").join(artists, "primary_artist_id").groupBy(F.col("primary_artist_id").alias("id"), "name").agg(F.count("*").alias("tracks"), total(F.col("plays")).alias("plays"), total(F.col("ms_played")).alias("ms_played"))
    return grouped.orderBy(F.desc("tracks"), F.desc("plays"), "name", "id").limit(limit)


def resolve_tracks(t, genres: list[str], match: str = "any", sort: str = "added", limit: int = 50, offset: int = 0, q: str = "") -> DataFrame:
    """One page of a selection: total, rank, and the genres of each track, the picked ones first."""
    rows = library_rows(t).join(matching(t, genres, match), "canonical_track_id", "left_semi")
    if q:
        rows = rows.where(any_contains(q, F.col("title"), F.col("artist"), F.col("album_name")))
    order = _order(sort)
    page = rows.orderBy(*order).offset(offset).limit(limit)  # sorted by ranges; the rows before the page are skipped, not numbered
    page = page.withColumn("rank", F.lit(offset) + F.row_number().over(Window.orderBy(*order)))  # at most limit rows
    page = page.crossJoin(F.broadcast(rows.agg(F.count("*").alias("total"))))  # one row
    votes = t["track_genres"].join(page.select("canonical_track_id"), "canonical_track_id", "left_semi").groupBy("canonical_track_id", "genre").agg(F.max("votes").alias("votes"))
    picked = F.when(F.col("genre").isin(genres), 0).otherwise(1) if genres else F.lit(1)
    listed = F.slice(F.array_sort(F.collect_list(F.struct(picked.alias("a"), (-F.col("votes")).alias("b"), "genre"))), 1, SHOWN_GENRES)
    named = votes.groupBy("canonical_track_id").agg(F.transform(listed, lambda s: s["genre"]).alias("genres"))
    return with_credits(page.join(named, "canonical_track_id", "left"), t).select(
        "total", "rank", "canonical_track_id", F.col("representative_track_id").alias("track_id"), "title", "duration_ms", F.col("max_popularity").alias("popularity"), "explicit", "liked",
        iso(F.col("first_added_at")).alias("first_added_at"), F.when(F.col("album_name").isNotNull(), F.col("primary_album_id")).alias("album_id"), "album_name", "artists", "genres", "plays", "ms_played",
    )


def resolve_track_ids(t, genres: list[str], match: str = "any", sort: str = "added", limit: int = MAX_TRACKS) -> DataFrame:
    """rank and track_id, at most MAX_TRACKS."""
    order = _order(sort)
    top = library_rows(t).join(matching(t, genres, match), "canonical_track_id", "left_semi").orderBy(*order).limit(min(limit, MAX_TRACKS))
    return top.select(F.row_number().over(Window.orderBy(*order)).alias("rank"), F.col("representative_track_id").alias("track_id"))  # at most MAX_TRACKS rows


# --- collections


def _with_genres(t) -> DataFrame:
    genres = t["genre_collection_genres"].groupBy(F.col("collection_id").alias("id")).agg(F.array_sort(F.collect_list("genre")).alias("genres"))
    return t["genre_collections"].join(genres, "id", "left").withColumn("genres", F.coalesce("genres", F.array().cast("array<string>")))


def list_collections(t, counted: DataFrame | None = None) -> DataFrame:
    """Collections with the number of library recordings they resolve to, each under its own mode. counted: id and track_count, if known otherwise."""
    counted = _counted(t) if counted is None else counted
    return _with_genres(t).join(counted, "id", "left").withColumn("track_count", F.coalesce("track_count", F.lit(0)))


def _counted(t) -> DataFrame:
    """id and track_count of the collections that resolve to any, by one join over genres."""
    wanted = t["genre_collection_genres"].select("collection_id", "genre").distinct()
    sizes = wanted.groupBy("collection_id").agg(F.count("*").alias("size"))
    hits = library_edges(t).join(wanted, "genre").groupBy("collection_id", "canonical_track_id").agg(F.count("*").alias("n"))
    modes = t["genre_collections"].select(F.col("id").alias("collection_id"), "match").join(sizes, "collection_id")
    return hits.join(modes, "collection_id").where((F.col("match") != "all") | (F.col("n") == F.col("size"))).groupBy(F.col("collection_id").alias("id")).agg(F.count("*").alias("track_count"))


def collection(t, collection_id: str) -> DataFrame:
    return _with_genres(t).where(F.col("id") == collection_id)


def auto_sync_collections(t) -> DataFrame:
    """Collections to keep in step that have a genre, least recently updated first."""
    some = t["genre_collection_genres"].select(F.col("collection_id").alias("id"))
    return t["genre_collections"].where("auto_sync").join(some, "id", "left_semi").orderBy("updated_at", "id").select("id")


def mint_id(name: str, taken: set[str]) -> str:
    """A free id for a name: its slug, else that with the least free number from 2 on."""
    base, n = slug(name), 2
    found = base
    while found in taken:
        found, n = f"{base}-{n}", n + 1
    return found


def create_collection(t, name: str, now, genres: list[str] = ()) -> tuple[str, dict[str, DataFrame]]:
    """The new id and both tables with it. Looks up only the ids that begin with the slug."""
    base = slug(name)
    taken = {r[0] for r in t["genre_collections"].where((F.col("id") == base) | F.col("id").startswith(base + "-")).select("id").collect()}
    new = mint_id(name, taken)
    defaults = {"id": new, "name": name, "match": "any", "sort": "added", "track_limit": 100, "auto_sync": False, "updated_at": now}
    old = t["genre_collections"]
    row = old.sparkSession.range(1).select(*(F.lit(defaults.get(f.name)).cast(f.dataType).alias(f.name) for f in old.schema.fields))
    return new, add_genres({**t, "genre_collections": old.unionByName(row)}, new, genres, now)


def _touched(collections: DataFrame, collection_id: str, now, patch: dict | None = None) -> DataFrame:
    values = {**(patch or {}), "updated_at": now}
    types = dict(collections.dtypes)
    return collections.withColumns({c: F.when(F.col("id") == collection_id, F.lit(v).cast(types[c])).otherwise(F.col(c)) for c, v in values.items()})


def add_genres(t, collection_id: str, genres: list[str], now) -> dict[str, DataFrame]:
    """Both tables; genres that the collection has stay as they are, none leaves all untouched."""
    collections, old = t["genre_collections"], t["genre_collection_genres"]
    if not genres:
        return {"genre_collections": collections, "genre_collection_genres": old}
    rows = reduce(DataFrame.unionByName, (old.sparkSession.range(1).select(F.lit(collection_id).alias("collection_id"), F.lit(g).alias("genre")) for g in dict.fromkeys(genres)))
    new = rows.join(old, ["collection_id", "genre"], "left_anti")
    return {"genre_collections": _touched(collections, collection_id, now), "genre_collection_genres": old.unionByName(new)}


def remove_genre(t, collection_id: str, genre: str, now) -> dict[str, DataFrame]:
    gone = (F.col("collection_id") == collection_id) & (F.col("genre") == genre)
    return {"genre_collections": _touched(t["genre_collections"], collection_id, now), "genre_collection_genres": t["genre_collection_genres"].where(~gone)}


PATCHABLE = {"name", "description", "match", "sort", "track_limit", "auto_sync", "playlist_public"}


def update_collection(t, collection_id: str, patch: dict, now) -> DataFrame:
    """Collections with some columns of one changed; an empty patch changes nothing."""
    known = {k: v for k, v in patch.items() if k in PATCHABLE}
    return _touched(t["genre_collections"], collection_id, now, known) if known else t["genre_collections"]


def delete_collection(t, collection_id: str) -> dict[str, DataFrame]:
    return {"genre_collections": t["genre_collections"].where(F.col("id") != collection_id), "genre_collection_genres": t["genre_collection_genres"].where(F.col("collection_id") != collection_id)}


def unlink_playlist(t, collection_id: str, now) -> DataFrame:
    """Forgets the playlist that a collection was pushed to."""
    return _touched(t["genre_collections"], collection_id, now, {"linked_playlist_id": None, "synced_fingerprint": None, "synced_snapshot_id": None, "synced_track_count": 0, "last_sync_error": None})


def fingerprint(ids: DataFrame) -> DataFrame:
    """One row: md5 of the ordered track ids joined by commas. ids: rank, track_id, at most MAX_TRACKS rows."""
    return ids.agg(F.md5(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("rank", "track_id"))), lambda s: s["track_id"]))).alias("fingerprint"), F.count("*").alias("tracks"))

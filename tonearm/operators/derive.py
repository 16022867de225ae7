"""Derived tables: recordings, the library, plays and album groups, and read models over enrichment.

Each is a function of whole tables. A choice of one row from a group is min_by over an order written as a
struct, so it is combined before the shuffle and no group is held or sorted in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.listening import BREAK_MS, completed, heard, skipped
from ..functions.numbers import total
from ..functions.text import fallback_key, norm_name, track_id_of_uri
from ..functions.times import epoch_seconds


def nulls_last(c: Column, descending: bool = False) -> Column:
    """A number or date as a part of an ascending order."""
    return F.struct(c.isNull().alias("none"), (-c if descending else c).alias("value"))


def yes_first(c: Column) -> Column:
    """A condition as a part of an ascending order: unknown, then true, then false."""
    return F.when(c.isNull(), 0).when(c, 1).otherwise(2)


# --- recordings (D1, D8)


def coded_recordings(tracks: DataFrame, overrides: DataFrame) -> DataFrame:
    """id and isrc of the recordings that have a code, as canonical_tracks has them. No credits are needed: a fallback key is never a code."""
    fixed = overrides.select("track_id", F.col("canonical_track_id").alias("fixed"))
    told = tracks.where(~F.col("is_local")).select(F.col("id").alias("track_id"), F.when(F.col("isrc") != "", F.concat(F.lit("isrc:"), "isrc")).alias("coded"))
    ids = told.join(fixed, "track_id", "left").select(F.coalesce("fixed", "coded").alias("id")).where(F.col("id").startswith("isrc:")).distinct()
    return ids.withColumn("isrc", F.expr("substr(id, 6)"))


def uncoded(tracks: DataFrame) -> DataFrame:
    """track_id of the tracks without a code: only their keys are told by artists."""
    return tracks.where(~F.col("is_local") & F.coalesce(F.col("isrc") == "", F.lit(True))).select(F.col("id").alias("track_id"))


def recording_keys(tracks: DataFrame, track_artists: DataFrame, overrides: DataFrame) -> DataFrame:
    """track_id and cid of each track that isn't a local file: its override, else its code, else the fallback key."""
    coded = F.when(F.col("isrc") != "", F.concat(F.lit("isrc:"), "isrc"))
    listed = track_artists.join(uncoded(tracks), "track_id", "left_semi").groupBy("track_id").agg(F.array_sort(F.collect_list("artist_id")).alias("ids"))
    fixed = overrides.select("track_id", F.col("canonical_track_id").alias("fixed"))
    joined = tracks.where(~F.col("is_local")).withColumnRenamed("id", "track_id").join(fixed, "track_id", "left").join(listed, "track_id", "left")
    return joined.select("track_id", F.coalesce("fixed", coded, fallback_key(F.col("name"), F.col("duration_ms"), F.col("ids"), F.col("track_id"))).alias("cid"))


def first_credits(credits: DataFrame, key: str) -> DataFrame:
    """The credit of least position, then artist, of each key."""
    return credits.groupBy(key).agg(F.min_by("artist_id", F.struct("position", "artist_id")).alias("primary_artist_id"))


def copies_of(keys: DataFrame, tracks: DataFrame, albums: DataFrame, library_tracks: DataFrame) -> DataFrame:
    """The copies of each recording: cid, track_id, rank (the least one's copy stands for all), copy, popularity and release_date_start."""
    held = library_tracks.select("track_id", F.lit(True).alias("held"))
    released = albums.select(F.col("id").alias("album_id"), "album_type", "release_date_start")
    copies = keys.join(tracks.withColumnRenamed("id", "track_id"), "track_id").join(held, "track_id", "left").join(released, "album_id", "left")
    rank = F.struct(
        F.col("held").isNull().alias("a"), yes_first(F.col("detail_level") == "full").alias("b"), nulls_last(F.col("popularity"), True).alias("c"),
        yes_first(F.col("album_type") == "album").alias("d"), nulls_last(F.col("release_date_start")).alias("e"), F.col("track_id").alias("f"),
    )
    return copies.select("cid", "track_id", rank.alias("rank"), F.struct("track_id", "name", "duration_ms", "explicit", "album_id").alias("copy"), "popularity", "release_date_start")


def canonical_tracks(keys: DataFrame, tracks: DataFrame, track_artists: DataFrame, albums: DataFrame, library_tracks: DataFrame) -> DataFrame:
    """A row for each recording: its representative copy and what its copies sum up to."""
    chosen = copies_of(keys, tracks, albums, library_tracks).groupBy("cid").agg(
        F.min_by("copy", "rank").alias("rep"), F.max("popularity").alias("max_popularity"), F.count(F.lit(1)).alias("copy_count"), F.min("release_date_start").alias("earliest_release_date"),
    )
    return recordings_of(chosen, track_artists)


def recordings_of(chosen: DataFrame, track_artists: DataFrame) -> DataFrame:
    """Recordings from groups of copies: cid, rep (the copy that stands for all), max_popularity, copy_count and earliest_release_date."""
    coded = F.col("cid").startswith("isrc:")
    flat = chosen.select(
        F.col("cid").alias("id"), F.when(coded, "isrc").otherwise("fallback").alias("kind"), F.when(coded, F.expr("substr(cid, 6)")).alias("isrc"),
        F.col("rep.name").alias("title"), "rep.duration_ms", "rep.explicit", F.col("rep.track_id").alias("representative_track_id"), F.col("rep.album_id").alias("primary_album_id"),
        "max_popularity", "copy_count", "earliest_release_date",
    )
    return flat.join(first_credits(track_artists, "track_id").withColumnRenamed("track_id", "representative_track_id"), "representative_track_id", "left")


def canonical_track_artists(keys: DataFrame, recordings: DataFrame, track_artists: DataFrame) -> DataFrame:
    """Credits of all copies of a recording; on_representative tells those of the chosen copy."""
    rep = recordings.select(F.col("id").alias("cid"), "representative_track_id")
    joined = keys.join(track_artists, "track_id").join(rep, "cid")
    return joined.groupBy(F.col("cid").alias("canonical_track_id"), "artist_id").agg(
        F.min("position").alias("position"), F.bool_or(F.col("track_id") == F.col("representative_track_id")).alias("on_representative")
    )


def with_recordings(tracks: DataFrame, keys: DataFrame) -> DataFrame:
    """Tracks with canonical_track_id, null for local files."""
    return tracks.drop("canonical_track_id").join(keys.select(F.col("track_id").alias("id"), F.col("cid").alias("canonical_track_id")), "id", "left")


def checksum(rows: DataFrame, key: str, columns: list[str], groups: int = 4096) -> DataFrame:
    """One row: the number of rows and a digest of them that doesn't depend on their order.

    Rows are hashed, hashes are joined by ranges of the key's digest, and those digests are digested, so
    no task holds more than a range.
    """
    line = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in [key, *columns]))
    hashed = rows.select(F.md5(line).alias("h")).withColumn("g", F.pmod(F.conv(F.substring("h", 1, 8), 16, 10).cast("long"), F.lit(groups)))
    ranges = hashed.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.md5(F.concat_ws("\n", F.array_sort(F.collect_list("h")))).alias("h"))
    return ranges.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.md5(F.concat_ws("\n", F.array_sort(F.collect_list(F.concat_ws(":", "g", "h"))))).alias("checksum"))


#: Characters of a block of lines, at least; a task holds a few blocks.
BLOCK_CHARS = 1 << 20


def _line_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted lines of a range as few large texts: part (of the range), no and text."""
    part, no, held, size = TaskContext.get().partitionId(), 0, [], 0
    block = lambda: pa.RecordBatch.from_pydict({"part": [part], "no": [no], "text": ["\n".join(held)]}, schema=pa.schema([("part", pa.int32()), ("no", pa.int32()), ("text", pa.string())]))
    for batch in batches:
        for line in batch.column("line").to_pylist():
            held.append(line)
            size += len(line)
            if size >= BLOCK_CHARS:
                yield block()
                no, held, size = no + 1, [], 0
    if held:
        yield block()


def _running_md5(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    state, first = hashlib.md5(), True
    for batch in batches:
        for part, text in zip(batch.column("part").to_pylist(), batch.column("text")):
            if part >= 0:
                state.update(b"" if first else b"\n")
                state.update(text.as_py().encode())
                first = False
    yield pa.RecordBatch.from_pydict({"checksum": [state.hexdigest()]})


def text_checksum(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """checksum: md5 of all rows as text in the order of the key.

    Ranges of the key are sorted and joined to blocks in parallel; one task reads the blocks in order, a few at a
    time, through a running md5. That step is sequential by the digest's nature; checksum() has none.
    """
    line = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in [key, *columns]))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = rows.select(F.col(key).alias("k"), line.alias("line")).repartitionByRange(parts, "k", "line").sortWithinPartitions("k", "line")
    blocks = ranges.select("line").mapInArrow(_line_blocks, "part int, no int, text string")
    start = rows.sparkSession.range(1).select(F.lit(-1).alias("part"), F.lit(0).alias("no"), F.lit("").alias("text"))  # so that no rows have a digest too
    return start.union(blocks).repartition(1).sortWithinPartitions("part", "no").mapInArrow(_running_md5, "checksum string")


RECORDING_CHECK = ["kind", "isrc", "title", "duration_ms", "representative_track_id", "primary_artist_id", "primary_album_id", "copy_count"]
GROUP_CHECK = ["kind", "title", "representative_album_id", "primary_artist_id", "track_count", "copy_count"]


# --- the library (D2)


def library_tracks(saved_tracks: DataFrame, playlists: DataFrame, playlist_tracks: DataFrame) -> DataFrame:
    """Tracks that are liked or stand in a playlist of one's own, with the earliest evidence; undated ones are left out."""
    liked = saved_tracks.where("removed_at is null").select("track_id", F.col("added_at").alias("liked_at"), F.lit(True).alias("liked"))
    own = playlists.where("is_owned and removed_at is null").select(F.col("id").alias("playlist_id"))
    held = playlist_tracks.where("track_id is not null and not is_local").join(own, "playlist_id")
    owned = held.groupBy("track_id").agg(F.min("added_at").alias("owned_at"), F.countDistinct("playlist_id").alias("owned_playlist_count"))
    both = liked.join(owned, "track_id", "full").withColumn("first_added_at", F.least("liked_at", "owned_at"))
    return both.where("first_added_at is not null and track_id is not null").select(
        "track_id", F.coalesce("liked", F.lit(False)).alias("via_liked"), F.col("owned_playlist_count").isNotNull().alias("via_owned_playlist"),
        "liked_at", "first_added_at", F.coalesce("owned_playlist_count", F.lit(0)).alias("owned_playlist_count"),
    )


def library_canonical(library: DataFrame, tracks: DataFrame, recordings: DataFrame) -> DataFrame:
    """The library by recordings."""
    known = tracks.where("canonical_track_id is not null").select(F.col("id").alias("track_id"), "canonical_track_id")
    facts = recordings.select(F.col("id").alias("canonical_track_id"), "duration_ms", "primary_artist_id", "primary_album_id", "explicit")
    grouped = library.join(known, "track_id").groupBy("canonical_track_id").agg(
        F.min("first_added_at").alias("first_added_at"), F.max("first_added_at").alias("latest_added_at"), F.bool_or("via_liked").alias("liked"),
        F.count(F.lit(1)).alias("copy_count_in_library"), total(F.col("owned_playlist_count")).alias("owned_playlist_count"),
    )
    return grouped.join(facts, "canonical_track_id")


def library_dates(library: DataFrame, keys: DataFrame) -> DataFrame:
    """canonical_track_id and first_added_at of library_canonical, without the facts of recordings."""
    known = keys.select("track_id", F.col("cid").alias("canonical_track_id"))
    return library.join(known, "track_id").groupBy("canonical_track_id").agg(F.min("first_added_at").alias("first_added_at"))


# --- plays (D5, D6, D7)


def link_plays(plays: DataFrame, tracks: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """Plays with the track that their URI names: by its id, else as the id it was relinked from (the least such track).

    seen: rows with all URIs of plays, where those are cheaper to read.
    """
    open_uris = (plays if seen is None else seen).where("track_id is null and item_kind = 'track'").select("item_uri").distinct().withColumn("raw_id", track_id_of_uri(F.col("item_uri"))).where("raw_id is not null")
    direct = tracks.select(F.col("id").alias("raw_id"), F.col("id").alias("direct_id"))
    relinked = tracks.where("linked_from_id is not null").groupBy(F.col("linked_from_id").alias("raw_id")).agg(F.min("id").alias("relinked_id"))
    found = open_uris.join(direct, "raw_id", "left").join(relinked, "raw_id", "left").select("item_uri", F.coalesce("direct_id", "relinked_id").alias("found_id")).where("found_id is not null")
    joined = plays.join(found, "item_uri", "left")
    return joined.withColumn("track_id", F.coalesce("track_id", F.when(F.col("item_kind") == "track", F.col("found_id")))).select(*plays.columns)


def with_prior(plays: DataFrame, elsewhere: DataFrame | None = None, times: DataFrame | None = None) -> DataFrame:
    """Plays with _prior, played_at of the previous play; plays without a time are left out.

    The previous play of the whole log is found by hours: within an hour by a window, for an hour's first
    play from a small frame of one row for each hour, so that no task sorts the log. elsewhere: where plays are only
    spans of a log, played_at of the last play of each other span; no hour is in two spans. times: rows with played_at of
    all plays, where those are cheaper to read. Plays leave as they met, by hour.
    """
    hour = F.call_function("div", epoch_seconds(F.col("played_at")), F.lit(3600))
    keyed = plays.withColumn("_hour", hour)
    hours = (keyed if times is None else times.select("played_at", hour.alias("_hour"))).groupBy("_hour").agg(F.max("played_at").alias("_last"))
    if elsewhere is not None:
        hours = hours.unionByName(elsewhere.select(hour.alias("_hour"), F.col("played_at").alias("_last")))
    before = hours.select("_hour", F.lag("_last").over(Window.orderBy("_hour")).alias("_earlier"))  # a row for each hour
    inside = F.lag("played_at").over(Window.partitionBy("_hour").orderBy("played_at", "id"))
    prior = keyed.withColumn("_inside", inside).join(F.broadcast(before), "_hour").withColumn("_prior", F.coalesce("_inside", "_earlier"))
    return prior.select(*plays.columns, "_prior")


def polled() -> Column:
    """Whether a play was polled without a time heard, so that it gets an estimate."""
    return F.coalesce((F.col("source") == "recent") & F.col("ms_played").isNull(), F.lit(False))


def _with_durations(plays: DataFrame, tracks: DataFrame) -> DataFrame:
    return plays.join(tracks.select(F.col("id").alias("track_id"), F.col("duration_ms").alias("_duration")), "track_id", "left")


def _estimated(prior: DataFrame) -> DataFrame:
    """Plays with _prior and _duration get estimated_ms and lose both."""
    gap = (epoch_seconds(F.col("played_at")) - epoch_seconds(F.col("_prior"))) * 1000
    guess = F.when((gap > 0) & (gap <= F.col("_duration") + BREAK_MS), F.least(F.col("_duration").cast("long"), gap).cast("int"))
    return prior.withColumn("estimated_ms", F.when(polled(), guess).otherwise(F.col("estimated_ms"))).drop("_prior", "_duration")


def guessed(prior: DataFrame, tracks: DataFrame) -> DataFrame:
    """Plays with _prior get estimated_ms and lose _prior."""
    return _estimated(_with_durations(prior, tracks))


def settled_plays(plays: DataFrame, linked: DataFrame, tracks: DataFrame, elsewhere: DataFrame | None = None) -> DataFrame:
    """What estimate_durations() gives after link_plays() of plays, beside others that are linked; rows leave by hour.

    Only plays that lack a link or get an estimate meet tracks, and the whole rows meet once.
    """
    lacking = polled() | F.coalesce(F.col("track_id").isNull() & (F.col("item_kind") == "track"), F.lit(False))
    near = _with_durations(link_plays(plays.where(lacking), tracks).unionByName(linked.where(polled())), tracks)
    rest = plays.where(~lacking).unionByName(linked.where(~polled())).withColumn("_duration", F.lit(None).cast(tracks.schema["duration_ms"].dataType))
    times = plays.select("played_at").unionByName(linked.select("played_at"))
    return _estimated(with_prior(near.unionByName(rest), elsewhere, times)).select(*plays.columns)


def estimate_durations(plays: DataFrame, tracks: DataFrame, elsewhere: DataFrame | None = None) -> DataFrame:
    """Plays with estimated_ms of polled rows: the gap to the previous play, at most the track's duration. elsewhere: see with_prior()."""
    return guessed(with_prior(plays, elsewhere), tracks).select(*plays.columns)


def heard_plays(plays: DataFrame, tracks: DataFrame) -> DataFrame:
    """What estimate_durations() gives after link_plays(), but for item_uri and track_id: only plays that get an estimate meet tracks."""
    names = [c for c in plays.columns if c not in ("item_uri", "track_id")]
    linked = link_plays(with_prior(plays).where(polled()), tracks, plays.where(polled()))
    return plays.where(F.col("played_at").isNotNull() & ~polled()).select(*names).unionByName(guessed(linked, tracks).select(*names))


def play_stats(plays: DataFrame, tracks: DataFrame) -> DataFrame:
    """Plays by recording."""
    known = tracks.where("canonical_track_id is not null").select(F.col("id").alias("track_id"), "canonical_track_id")
    return plays.join(known, "track_id").groupBy("canonical_track_id").agg(
        F.count(F.lit(1)).alias("plays"), completed().alias("completed_plays"), skipped().alias("skips"), total(heard()).alias("ms_played"),
        F.min("played_at").alias("first_played_at"), F.max("played_at").alias("last_played_at"),
    )


# --- albums (D3, D4)


def album_completeness(albums: DataFrame, tracks: DataFrame) -> DataFrame:
    """Albums with tracks_complete: whether as many tracks are known as the album has; unknown totals are incomplete."""
    have = tracks.groupBy(F.col("album_id").alias("id")).agg(F.count("id").alias("_have"))
    joined = albums.drop("tracks_complete").join(have, "id", "left")
    return joined.withColumn("tracks_complete", F.coalesce(F.coalesce("_have", F.lit(0)) >= F.col("total_tracks"), F.lit(False))).drop("_have")


def album_group_keys(albums: DataFrame, tracks: DataFrame) -> DataFrame:
    """album_id, gid and n_tracks: equal multisets of recordings make a group, of complete albums without ungrouped tracks only."""
    sets = tracks.groupBy("album_id").agg(
        F.count("canonical_track_id").alias("n_tracks"), F.count_if(F.col("canonical_track_id").isNull()).alias("ungrouped"),
        F.concat_ws("\n", F.array_sort(F.collect_list("canonical_track_id"))).alias("members"),
    )
    joined = albums.select(F.col("id").alias("album_id"), "tracks_complete").join(sets, "album_id", "left")
    whole = F.col("tracks_complete") & (F.col("ungrouped") == 0) & (F.col("n_tracks") > 0)
    gid = F.when(whole, F.concat(F.lit("trk:"), F.substring(F.sha2("members", 256), 1, 24))).otherwise(F.concat(F.lit("alb:"), "album_id"))
    return joined.select("album_id", gid.alias("gid"), F.coalesce("n_tracks", F.lit(0)).alias("n_tracks"))


def album_groups(keys: DataFrame, albums: DataFrame, album_artists: DataFrame, saved_albums: DataFrame) -> DataFrame:
    """A row for each group of releases, with its representative."""
    saved = saved_albums.where("removed_at is null").select("album_id", F.lit(True).alias("saved"))
    joined = keys.join(albums.withColumnRenamed("id", "album_id").drop("album_group_id"), "album_id").join(saved, "album_id", "left")
    rank = F.struct(
        F.col("saved").isNull().alias("a"), yes_first(F.col("detail_level") == "full").alias("b"), yes_first(F.col("album_type") == "album").alias("c"),
        nulls_last(F.col("popularity"), True).alias("d"), nulls_last(F.col("release_date_start")).alias("e"), F.col("album_id").alias("f"),
    )
    chosen = joined.groupBy("gid").agg(F.min_by(F.struct("album_id", "name", "n_tracks"), rank).alias("rep"), F.count(F.lit(1)).alias("copy_count"), F.min("release_date_start").alias("earliest_release_date"))
    flat = chosen.select(
        F.col("gid").alias("id"), F.when(F.col("gid").startswith("trk:"), "tracks").otherwise("solo").alias("kind"), F.col("rep.name").alias("title"),
        F.col("rep.album_id").alias("representative_album_id"), F.col("rep.n_tracks").alias("track_count"), "copy_count", "earliest_release_date",
    )
    return flat.join(first_credits(album_artists, "album_id").withColumnRenamed("album_id", "representative_album_id"), "representative_album_id", "left")


def with_groups(albums: DataFrame, keys: DataFrame) -> DataFrame:
    return albums.drop("album_group_id").join(keys.select(F.col("album_id").alias("id"), F.col("gid").alias("album_group_id")), "id", "left")


# --- enrichment (D9 to D14)


def _wanted(t, extra: list[str]) -> DataFrame:
    """Recordings that are played or in the library, with their plays."""
    stats = t["canonical_play_stats"].select(F.col("canonical_track_id").alias("id"), "plays")
    library = t["library_canonical"].select(F.col("canonical_track_id").alias("id"), F.lit(True).alias("held"))
    joined = t["canonical_tracks"].select("id", *extra).join(stats, "id", "left").join(library, "id", "left")
    return joined.withColumn("plays", F.coalesce("plays", F.lit(0))).where("plays > 0 or held").drop("held")


def recording_candidates(t) -> DataFrame:
    return _wanted(t, ["isrc"]).where("isrc is not null").select(F.col("id").alias("canonical_track_id"), "isrc", "plays")


def artist_candidates(t) -> DataFrame:
    credits = t["canonical_track_artists"].select(F.col("canonical_track_id").alias("id"), "artist_id")
    return _wanted(t, []).join(credits, "id").groupBy("artist_id").agg(F.sum("plays").alias("plays"))


def album_candidates(t) -> DataFrame:
    return _wanted(t, ["primary_album_id"]).where("primary_album_id is not null").groupBy(F.col("primary_album_id").alias("album_id")).agg(F.sum("plays").alias("plays"))


def genre_tags(t) -> DataFrame:
    """Tags that are genres: by their own flag or by the vocabulary."""
    known = t["mb_genres"].select(F.col("name").alias("tag"), F.lit(True).alias("known")).distinct()
    return t["mb_tags"].join(known, "tag", "left").where("is_genre or known").drop("known")


def genre_lists(t, entity_type: str) -> DataFrame:
    """entity_mbid and genres, by votes, then name."""
    tags = genre_tags(t).where(F.col("entity_type") == entity_type)
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("minus"), "tag")))
    return tags.groupBy("entity_mbid").agg(F.transform(ordered, lambda s: s["tag"]).alias("genres"))


def track_genres(t) -> DataFrame:
    """canonical_track_id, genre, votes."""
    linked = t["isrc_recordings"].where("recording_mbid is not null").select("isrc", F.col("recording_mbid").alias("entity_mbid"))
    tags = genre_tags(t).where("entity_type = 'recording'").select("entity_mbid", F.col("tag").alias("genre"), F.col("count").alias("votes"))
    return t["canonical_tracks"].select(F.col("id").alias("canonical_track_id"), "isrc").join(linked, "isrc").join(tags, "entity_mbid").select("canonical_track_id", "genre", "votes")


def match_artists_by_credit(t) -> DataFrame:
    """artist_id, mbid, status, source of the links that credits support and that aren't known yet: the most supported, then the least mbid."""
    linked = t["isrc_recordings"].where("recording_mbid is not null").select("isrc", "recording_mbid")
    names = t["artists"].select(F.col("id").alias("artist_id"), norm_name(F.col("name")).alias("own"))
    credited = t["mb_recording_artists"].select("recording_mbid", "artist_mbid", norm_name(F.col("credit_name")).alias("credit"))
    others = t["mb_artists"].select(F.col("mbid").alias("artist_mbid"), norm_name(F.col("name")).alias("other"))
    ours = t["canonical_track_artists"].select(F.col("canonical_track_id").alias("id"), "artist_id").join(t["artist_musicbrainz"].select("artist_id"), "artist_id", "left_anti")
    pairs = t["canonical_tracks"].select("id", "isrc").join(linked, "isrc").join(ours, "id").join(credited, "recording_mbid").join(names, "artist_id").join(others, "artist_mbid")
    support = pairs.where((F.col("own") == F.col("credit")) | (F.col("own") == F.col("other"))).groupBy("artist_id", "artist_mbid").agg(F.count(F.lit(1)).alias("support"))
    best = support.groupBy("artist_id").agg(F.min_by("artist_mbid", F.struct(-F.col("support"), "artist_mbid")).alias("mbid"))
    return best.select("artist_id", "mbid", F.lit("matched").alias("status"), F.lit("credit").alias("source"))


AUDIO = ["bpm", "key_key", "key_scale", "happy"]


def track_enrichment(t) -> DataFrame:
    """What is known of each recording from outside; null is unknown."""
    found = t["isrc_recordings"].select("isrc", "recording_mbid", F.col("status").alias("lookup_status"))
    facts = t["mb_recordings"].select(F.col("mbid").alias("recording_mbid"), F.col("title").alias("mb_title"), F.col("length_ms").alias("mb_length_ms"), F.col("first_release_date_start").alias("mb_first_release_date"))
    sound = t["audio_features"].where("status = 'ok'").select("recording_mbid", *[c for c in t["audio_features"].columns if c not in ("recording_mbid", "status")])
    genres = genre_lists(t, "recording").withColumnRenamed("entity_mbid", "recording_mbid")
    base = t["canonical_tracks"].select(F.col("id").alias("canonical_track_id"), "isrc").join(found, "isrc", "left")
    return base.join(facts, "recording_mbid", "left").join(genres, "recording_mbid", "left").join(sound, "recording_mbid", "left")


def artist_enrichment(t) -> DataFrame:
    links = t["artist_musicbrainz"].select("artist_id", "mbid", F.col("status").alias("lookup_status"), F.col("source").alias("match_source"))
    facts = t["mb_artists"].withColumnRenamed("name", "mb_name").drop("detail_level")
    return t["artists"].select(F.col("id").alias("artist_id")).join(links, "artist_id").join(facts, "mbid").join(genre_lists(t, "artist").withColumnRenamed("entity_mbid", "mbid"), "mbid", "left")


def album_enrichment(t) -> DataFrame:
    """Releases and their groups; genres are the group's, else the release's."""
    links = t["album_musicbrainz"].select("album_id", "release_mbid", F.col("status").alias("lookup_status"))
    releases = t["mb_releases"].select(F.col("mbid").alias("release_mbid"), F.col("title").alias("mb_title"), "country", "label_name", "release_group_mbid")
    groups = t["mb_release_groups"].select(F.col("mbid").alias("release_group_mbid"), F.col("title").alias("release_group_title"), "primary_type")
    of_group = genre_lists(t, "release_group").select(F.col("entity_mbid").alias("release_group_mbid"), F.col("genres").alias("group_genres"))
    of_release = genre_lists(t, "release").select(F.col("entity_mbid").alias("release_mbid"), F.col("genres").alias("release_genres"))
    base = t["albums"].select(F.col("id").alias("album_id")).join(links, "album_id").join(releases, "release_mbid").join(groups, "release_group_mbid", "left")
    joined = base.join(of_group, "release_group_mbid", "left").join(of_release, "release_mbid", "left")
    return joined.withColumn("genres", F.coalesce("group_genres", "release_genres")).drop("group_genres", "release_genres")


def enrichment_coverage(t) -> DataFrame:
    """stage, candidates, matched, missed."""
    found = t["isrc_recordings"].select("isrc", "recording_mbid", "status")
    rec = recording_candidates(t).join(found, "isrc", "left")
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    recordings = rec.agg(F.count(F.lit(1)).alias("candidates"), F.count("recording_mbid").alias("matched"), count(F.col("status") == "not_found").alias("missed"))
    sound = t["audio_features"].select("recording_mbid", F.col("status").alias("sound"))
    heard_of = rec.where("recording_mbid is not null").select("recording_mbid").distinct().join(sound, "recording_mbid", "left")
    audio = heard_of.agg(F.countDistinct("recording_mbid").alias("candidates"), F.countDistinct(F.when(F.col("sound") == "ok", F.col("recording_mbid"))).alias("matched"), F.countDistinct(F.when(F.col("sound") == "missing", F.col("recording_mbid"))).alias("missed"))
    links = t["artist_musicbrainz"].select("artist_id", "mbid", "status")
    details = t["mb_artists"].select("mbid", "detail_level")
    artists = artist_candidates(t).join(links, "artist_id", "left").join(details, "mbid", "left").agg(F.count(F.lit(1)).alias("candidates"), count(F.col("detail_level") == "full").alias("matched"), count(F.col("status") == "not_found").alias("missed"))
    releases = t["album_musicbrainz"].select("album_id", "release_mbid", "status")
    albums = album_candidates(t).join(releases, "album_id", "left").agg(F.count(F.lit(1)).alias("candidates"), F.count("release_mbid").alias("matched"), count(F.col("status") == "not_found").alias("missed"))
    stages = [f.select(F.lit(s).alias("stage"), "candidates", "matched", "missed") for s, f in (("recordings", recordings), ("audio", audio), ("artists", artists), ("albums", albums))]
    return stages[0].unionByName(stages[1]).unionByName(stages[2]).unionByName(stages[3])

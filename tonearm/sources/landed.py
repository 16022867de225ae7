"""Objects of web interfaces, landed as JSON files, with their schemas spelled out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ARTIST = "struct<id:string,name:string,popularity:int,followers:struct<total:int>,genres:array<string>,images:array<struct<url:string,width:int,height:int>>>"
ALBUM = (
    "struct<id:string,name:string,album_type:string,release_date:string,release_date_precision:string,total_tracks:int,label:string,popularity:int,external_ids:struct<upc:string>,"
    f"available_markets:array<string>,artists:array<{ARTIST}>>"
)
TRACK = (
    "struct<id:string,name:string,type:string,duration_ms:int,disc_number:int,track_number:int,explicit:boolean,popularity:int,external_ids:struct<isrc:string>,is_local:boolean,is_playable:boolean,"
    f"linked_from:struct<id:string>,uri:string,artists:array<{ARTIST}>,album:{ALBUM}>"
)
SCHEMAS = {
    "saved_tracks": f"added_at timestamp_ntz, track {TRACK}",
    "saved_albums": f"added_at timestamp_ntz, album {ALBUM}",
    "recently_played": f"played_at timestamp_ntz, track {TRACK}",
    "playlist_items": f"playlist_id string, position int, added_at timestamp_ntz, added_by struct<id:string>, is_local boolean, track {TRACK}",
    "tracks": f"track {TRACK}",
    "albums": f"album {ALBUM}",
    "artists": f"artist {ARTIST}",
    "recordings": "isrc string, recordings array<struct<id:string,title:string,length:int,`first-release-date`:string>>",
    "audio": "mbid string, low string, high string",
}


def landed(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """JSON lines of one kind under its schema; a broken line fails the read."""
    return spark.read.schema(SCHEMAS[kind]).option("mode", "FAILFAST").json(folder)


def flat_tracks(rows: DataFrame, level: str = "full", column: str = "track") -> DataFrame:
    """Tracks as rows; objects without an id are left out, missing flags are false."""
    t = F.col(column)
    return rows.where(t["id"].isNotNull()).select(
        t["id"].alias("id"), t["name"].alias("name"), t["album"]["id"].alias("album_id"), t["duration_ms"].alias("duration_ms"), t["disc_number"].alias("disc_number"), t["track_number"].alias("track_number"),
        F.coalesce(t["explicit"], F.lit(False)).alias("explicit"), t["popularity"].alias("popularity"), t["external_ids"]["isrc"].alias("isrc"), F.coalesce(t["is_local"], F.lit(False)).alias("is_local"),
        t["linked_from"]["id"].alias("linked_from_id"), t["uri"].alias("uri"), F.lit(level).alias("detail_level"),
    )


def flat_credits(rows: DataFrame, column: str = "track", key: str = "track_id") -> DataFrame:
    """Credits of tracks or albums with their place; an artist that an object names twice keeps the first place."""
    t = F.col(column)
    each = rows.where(t["id"].isNotNull()).select(t["id"].alias(key), F.posexplode(t["artists"]).alias("position", "artist")).where("artist.id is not null")
    return each.groupBy(key, F.col("artist.id").alias("artist_id")).agg(F.min("position").alias("position"))


def flat_albums(rows: DataFrame, level: str = "full", column: str = "album") -> DataFrame:
    a = F.col(column)
    return rows.where(a["id"].isNotNull()).select(
        a["id"].alias("id"), a["name"].alias("name"), a["album_type"].alias("album_type"), a["release_date"].alias("release_date"), a["release_date_precision"].alias("release_date_precision"), a["total_tracks"].alias("total_tracks"),
        a["label"].alias("label"), a["popularity"].alias("popularity"), a["external_ids"]["upc"].alias("upc"), a["available_markets"].alias("available_markets"), F.lit(level).alias("detail_level"),
    )


def flat_artists(rows: DataFrame, column: str = "artist") -> DataFrame:
    a = F.col(column)
    return rows.where(a["id"].isNotNull()).select(a["id"].alias("id"), a["name"].alias("name"), a["popularity"].alias("popularity"), a["followers"]["total"].alias("followers_total"), a["genres"].alias("genres"))


def polled_plays(rows: DataFrame) -> DataFrame:
    """Recently played items as plays: whole seconds, no duration."""
    at = F.col("played_at")
    second = F.date_trunc("second", at).cast("timestamp_ntz")
    t = F.col("track")
    return rows.select(
        second.alias("played_at"), F.lit(None).cast("int").alias("ms_played"), F.lit("track").alias("item_kind"), t["uri"].alias("item_uri"), t["name"].alias("track_name"),
        F.get(t["artists"], F.lit(0))["name"].alias("artist_name"), t["album"]["name"].alias("album_name"), F.lit("recent").alias("source"),
    )


def flat_recordings(rows: DataFrame) -> DataFrame:
    """isrc, mbid, title, length_ms and first_release_date of looked-up codes."""
    each = rows.select("isrc", F.explode("recordings").alias("r"))
    return each.select("isrc", F.col("r.id").alias("mbid"), F.col("r.title").alias("title"), F.col("r.length").alias("length_ms"), F.col("r.`first-release-date`").alias("first_release_date"))


# Where each audio feature stands in the two documents of an analysis.
LOW = {
    "bpm": "$.rhythm.bpm", "beats_count": "$.rhythm.beats_count", "onset_rate": "$.rhythm.onset_rate", "danceability_raw": "$.rhythm.danceability", "key_key": "$.tonal.key_key", "key_scale": "$.tonal.key_scale",
    "key_strength": "$.tonal.key_strength", "chords_key": "$.tonal.chords_key", "chords_scale": "$.tonal.chords_scale", "chords_changes_rate": "$.tonal.chords_changes_rate", "tuning_frequency": "$.tonal.tuning_frequency",
    "average_loudness": "$.lowlevel.average_loudness", "dynamic_complexity": "$.lowlevel.dynamic_complexity", "spectral_centroid": "$.lowlevel.spectral_centroid.mean", "replay_gain": "$.metadata.audio_properties.replay_gain",
    "length_seconds": "$.metadata.audio_properties.length",
}
HIGH = {
    "danceable": ("danceability", "danceable"), "aggressive": ("mood_aggressive", "aggressive"), "electronic": ("mood_electronic", "electronic"), "acoustic": ("mood_acoustic", "acoustic"), "happy": ("mood_happy", "happy"),
    "sad": ("mood_sad", "sad"), "party": ("mood_party", "party"), "relaxed": ("mood_relaxed", "relaxed"), "bright": ("timbre", "bright"), "tonal": ("tonal_atonal", "tonal"), "instrumental": ("voice_instrumental", "instrumental"), "female": ("gender", "female"),
}
NAMED = {"mood_mirex": "moods_mirex", "genre_dortmund": "genre_dortmund", "genre_electronic": "genre_electronic", "genre_rosamerica": "genre_rosamerica", "genre_tzanetakis": "genre_tzanetakis"}
TEXTS = {"key_key", "key_scale", "chords_key", "chords_scale"}


def audio_features(requested: DataFrame, rows: DataFrame) -> DataFrame:
    """A row for each requested id (recording_mbid): the features of its analysis, or status 'missing'."""
    mbid = "recording_mbid"

    def low(name: str, path: str) -> Column:
        found = F.get_json_object("low", path)
        return (found if name in TEXTS else found.try_cast("double")).alias(name)

    numbers = [low(n, p) for n, p in LOW.items()]
    likely = [F.get_json_object("high", f"$.{model}.all.{label}").try_cast("double").alias(n) for n, (model, label) in HIGH.items()]
    words = [F.get_json_object("high", f"$.{model}.value").alias(n) for n, model in NAMED.items()]
    known = F.when(F.col("low").isNull() & F.col("high").isNull(), "missing").otherwise("ok")
    return requested.select(mbid).distinct().join(rows.withColumnRenamed("mbid", mbid), mbid, "left").select(mbid, known.alias("status"), *numbers, *likely, *words)

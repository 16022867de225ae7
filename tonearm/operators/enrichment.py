"""Enrichment pages and totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import total
from .derive import album_enrichment, artist_enrichment, enrichment_coverage, track_enrichment

STAGES = ("recordings", "audio", "artists", "albums")


def stage_coverage(t) -> DataFrame:
    """Stages in their order with what their runs left behind."""
    stages = t["enrich_stages"].select(F.col("key").alias("stage"), "status", "requests", "last_error")
    place = F.coalesce(*(F.when(F.col("stage") == s, k + 1) for k, s in enumerate(STAGES)), F.lit(len(STAGES) + 1))
    return enrichment_coverage(t).join(stages, "stage", "left").withColumns({"requests": F.coalesce("requests", F.lit(0)), "place": place}).orderBy("place", "stage")


def totals(t) -> DataFrame:
    """One row of seven counts."""
    used = t["mb_tags"].join(t["mb_genres"].select(F.col("name").alias("tag")), "tag", "left_semi")
    parts = [
        t["mb_recordings"].agg(F.count("*").alias("recordings")), t["audio_features"].agg(F.count_if(F.col("status") == "ok").alias("analysed")), t["mb_artists"].agg(F.count_if(F.col("detail_level") == "full").alias("artists")),
        t["mb_releases"].agg(F.count("*").alias("releases")), t["mb_tags"].agg(F.count("*").alias("genre_tags")), t["mb_genres"].agg(F.count("*").alias("vocabulary")), used.agg(F.countDistinct("tag").alias("genres_in_use")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(F.broadcast(p))  # one row each
    return out


def top_genres(t, limit: int = 24) -> DataFrame:
    """Vocabulary genres by plays of all recordings, in the library or not."""
    linked = t["isrc_recordings"].where("recording_mbid is not null").select("isrc", F.col("recording_mbid").alias("entity_mbid"))
    tags = t["mb_tags"].where("entity_type = 'recording'").join(t["mb_genres"].select(F.col("name").alias("tag")), "tag", "left_semi").select("entity_mbid", F.col("tag").alias("genre"))
    stats = t["canonical_play_stats"].select(F.col("canonical_track_id").alias("id"), "plays")
    rows = t["canonical_tracks"].select("id", "isrc").join(linked, "isrc").join(tags, "entity_mbid").join(stats, "id", "left")
    return rows.groupBy("genre").agg(F.countDistinct("id").alias("recordings"), total(F.col("plays")).alias("plays")).orderBy(F.desc("plays"), F.desc("recordings"), "genre").limit(limit)


def of_track(t, recording: str) -> DataFrame:
    return track_enrichment({**_held(t), "canonical_tracks": t["canonical_tracks"].where(F.col("id") == recording)})


def of_artist(t, artist: str) -> DataFrame:
    return artist_enrichment({**_held(t), "artists": t["artists"].where(F.col("id") == artist)})


def of_album(t, album: str) -> DataFrame:
    return album_enrichment({**_held(t), "albums": t["albums"].where(F.col("id") == album)})


def _held(t) -> dict[str, DataFrame]:
    names = ("isrc_recordings", "mb_recordings", "audio_features", "mb_tags", "mb_genres", "artist_musicbrainz", "mb_artists", "album_musicbrainz", "mb_releases", "mb_release_groups", "canonical_tracks", "artists", "albums")
    return {n: t[n] for n in names}

"""Queries whose tables are kept up to date by changes; each is held against the statement of the table built anew."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import deltas, derive
from ..sources.shared import kept as stored
from ..sources.shared import shared_dir
from ..streaming import plays as streams
from .warehouse import Warehouse, first_credits


def _folder(w: Warehouse, name: str) -> str:
    return f"{shared_dir(w.spark)}/{name}-{uuid.uuid4().hex}"


def followed(w: Warehouse, name: str, rows: DataFrame, row: str, fold: deltas.Fold, altered: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Groups of rows that were first known in part and in part otherwise: a third comes late, some were other than they are, some shouldn't be there."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    rows = stored(rows, f"{name}-rows")  # read many times below; the joins behind them run once
    h = F.pmod(F.xxhash64(row), F.lit(30))
    odd = altered(rows.where(h.between(10, 14)))
    extra = rows.where(h.between(15, 17)).withColumn(row, F.concat(F.lit("-"), F.col(row).cast("string")).cast(rows.schema[row].dataType))
    kept = deltas.Maintained(w.spark, _folder(w, name), schema, row, fold, buckets=8)
    kept.rebuild(rows.where(h >= 15).unionByName(odd).unionByName(extra), "start")
    kept.apply(odd.unionByName(extra), rows.where(h.between(5, 14)), "one")
    kept.apply(rows.where("false"), rows.where(h < 5), "two")
    return kept.read()


def play_stats(w: Warehouse) -> DataFrame:
    rows = deltas.play_rows(w["plays"], w["tracks"])
    other = lambda df: df.withColumns({"ms": F.col("ms") + 40_000, "played_at": F.col("played_at") - F.expr("interval 40 days")})
    return deltas.play_stats(followed(w, "stats", rows, "id", deltas.PLAY_STATS, other))


def recordings(w: Warehouse) -> DataFrame:
    rows = derive.copies_of(w["recording_keys"], w["tracks_landed"], w["albums_dated"], w["library_tracks"])
    rank = F.col("rank").withField("c", F.struct(F.lit(False).alias("none"), F.lit(-1_000).alias("value")))  # so that it stands for its recording
    other = lambda df: df.withColumns({"rank": rank.cast(df.schema["rank"].dataType), "popularity": F.lit(1_000).cast(df.schema["popularity"].dataType), "release_date_start": F.lit("1900-01-01").cast("date")})
    groups = followed(w, "recordings", rows, "track_id", deltas.RECORDINGS, other)
    return deltas.recordings(groups, first_credits(w, groups.select(F.col("best.copy.track_id").alias("track_id"))))


def library_canonical(w: Warehouse) -> DataFrame:
    rows = deltas.library_rows(w["library_tracks"], w["tracks"])
    other = lambda df: df.withColumns({"via_liked": ~F.col("via_liked"), "first_added_at": F.col("first_added_at") - F.expr("interval 900 days")})
    return deltas.library_canonical(followed(w, "library", rows, "track_id", deltas.LIBRARY, other), w["canonical_tracks"])


def track_genres(w: Warehouse) -> DataFrame:
    """Genres after tags, codes and vocabulary have changed, by changes of the rows that they bear on."""
    tags, words, codes = w["mb_tags"], w["mb_genres"], w["isrc_recordings"]
    old = {
        "mb_tags": tags.where(F.pmod(F.xxhash64("tag", "entity_mbid"), F.lit(9)) > 0).withColumn("count", F.when(F.pmod(F.xxhash64("entity_mbid"), F.lit(20)) == 3, F.col("count") + 1).otherwise(F.col("count"))),
        "mb_genres": words.where(F.pmod(F.xxhash64("name"), F.lit(10)) > 0), "isrc_recordings": codes.where(F.pmod(F.xxhash64("isrc"), F.lit(12)) > 0), "canonical_tracks": w["canonical_tracks"],
    }
    gone, come = deltas.track_genre_changes(old, w)
    return derive.track_genres(old).exceptAll(gone).unionByName(come)


def log_by_slices(w: Warehouse) -> DataFrame:
    """The landed plays, merged into a sliced log in three parts that overlap in time."""
    log = streams.PlayLog(w.spark, _folder(w, "log"))
    plays = w["plays_landed"].select(*(f.split()[0] for f in streams.PLAYS.split(", ")))
    for k in (2, 0, 1):
        log.merge(plays.where(F.pmod(F.xxhash64("id"), F.lit(3)) == k), w["tracks"], f"part-{k}")
    return log.read()


QUERIES = {
    "d01_recordings_by_changes": (recordings, "d01_canonical_tracks"), "d02_library_by_changes": (library_canonical, "d02_library_canonical"), "d07_play_stats_by_changes": (play_stats, "d07_play_stats"), "d14_track_genres_by_changes": (track_genres, "d14_track_genres"),
    "d06_durations_by_slices": (lambda w: log_by_slices(w).select("id", "ms_played", "estimated_ms"), "d06_estimated_durations"),
}

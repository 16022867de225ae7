"""What to fetch next, and the state of runs."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.times import iso
from .derive import album_candidates, artist_candidates, recording_candidates

# How long a vocabulary, an entity, finished runs and events are kept or trusted; slices of a stage.
FRESH_DAYS, RUN_DAYS, EVENT_DAYS = 30, 90, 30
SLICES = {"recordings": 25, "audio": 100, "artist_details": 15, "artist_urls": 15, "albums": 10}


def albums_to_fetch(t) -> DataFrame:
    """Albums of library tracks that are unknown, known in brief, or incomplete."""
    held = t["tracks"].where("album_id is not null").select(F.col("id").alias("track_id"), "album_id").join(t["library_tracks"].select("track_id"), "track_id", "left_semi").select("album_id").distinct()
    known = t["albums"].select(F.col("id").alias("album_id"), "detail_level", "tracks_complete")
    return held.join(known, "album_id", "left").where("detail_level is null or detail_level = 'simplified' or not tracks_complete").select("album_id")


def brief_entities(rows: DataFrame) -> DataFrame:
    """Ids of entities known in brief; local files are left out."""
    brief = rows.where("detail_level = 'simplified'")
    return (brief.where("not is_local") if "is_local" in rows.columns else brief).select("id")


def changed_playlists(t) -> DataFrame:
    """Playlists whose snapshot isn't the one that their items were read at."""
    return t["playlists"].where(F.col("removed_at").isNull() & ~F.col("snapshot_id").eqNullSafe(F.col("items_synced_snapshot_id"))).select("id")


def codes_to_look_up(t, limit: int = SLICES["recordings"]) -> DataFrame:
    return recording_candidates(t).join(t["isrc_recordings"].select("isrc"), "isrc", "left_anti").orderBy(F.desc("plays"), "isrc").select("isrc", "plays").limit(limit)


def recordings_to_analyse(t, limit: int = SLICES["audio"]) -> DataFrame:
    linked = t["isrc_recordings"].where("recording_mbid is not null").select("isrc", F.col("recording_mbid").alias("mbid"))
    done = t["audio_features"].select(F.col("recording_mbid").alias("mbid"))
    return recording_candidates(t).join(linked, "isrc").join(done, "mbid", "left_anti").groupBy("mbid").agg(F.max("plays").alias("plays")).orderBy(F.desc("plays"), "mbid").limit(limit)


def artists_to_detail(t, limit: int = SLICES["artist_details"]) -> DataFrame:
    stubs = t["mb_artists"].where("detail_level = 'stub'").select("mbid")
    linked = t["artist_musicbrainz"].select("artist_id", "mbid").join(stubs, "mbid", "left_semi")
    return artist_candidates(t).join(linked, "artist_id").groupBy("mbid").agg(F.sum("plays").alias("plays")).orderBy(F.desc("plays"), "mbid").limit(limit)


def artists_to_match(t, limit: int = SLICES["artist_urls"]) -> DataFrame:
    return artist_candidates(t).join(t["artist_musicbrainz"].select("artist_id"), "artist_id", "left_anti").orderBy(F.desc("plays"), "artist_id").limit(limit)


def albums_to_match(t, limit: int = SLICES["albums"]) -> DataFrame:
    return album_candidates(t).join(t["album_musicbrainz"].select("album_id"), "album_id", "left_anti").orderBy(F.desc("plays"), "album_id").limit(limit)


def is_stale(rows: DataFrame, now: datetime, days: int = FRESH_DAYS) -> DataFrame:
    """One row: whether the newest fetched_at is older than so many days; an empty table is stale."""
    return rows.agg(F.coalesce(F.max("fetched_at") < F.lit(now - timedelta(days=days)), F.lit(True)).alias("stale"))


def fresh_entities(rows: DataFrame, now: datetime, days: int = FRESH_DAYS) -> DataFrame:
    """Ids that are known in full and were fetched lately."""
    return rows.where((F.col("detail_level") == "full") & (F.col("fetched_at") > F.lit(now - timedelta(days=days)))).select("id")


def stalled_runs(runs: DataFrame, phases: DataFrame, now: datetime) -> DataFrame:
    """Running runs with the number of open phases and the seconds since anything of them changed."""
    open_ = ~F.col("status").isin("completed", "skipped")
    by_run = phases.groupBy("run_id").agg(F.count_if(open_).alias("open_phases"), F.max("updated_at").alias("touched"))
    running = runs.where("status = 'running'").select(F.col("id").alias("run_id"), "started_at").join(by_run, "run_id", "left")
    idle = F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds(F.greatest("started_at", F.coalesce("touched", "started_at")).cast("timestamp"))
    return running.select("run_id", F.coalesce("open_phases", F.lit(0)).alias("open_phases"), idle.alias("idle_seconds"))


def table_counts(t) -> DataFrame:
    """name and rows of the tables that a finished run reports."""
    named = {
        "tracks": t["tracks"], "recordings": t["canonical_tracks"], "library": t["library_canonical"], "albums": t["albums"], "artists": t["artists"],
        "playlists": t["playlists"].where("removed_at is null"), "liked": t["saved_tracks"].where("removed_at is null"),
    }
    parts = [df.agg(F.count("*").alias("rows")).select(F.lit(n).alias("name"), "rows") for n, df in named.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def phase_rates(phases: DataFrame, now: datetime) -> DataFrame:
    """rate (done a second) and eta_seconds of each phase; null where nothing was done or nothing is left."""
    seconds = lambda until: F.greatest(F.unix_seconds(until.cast("timestamp")) - F.unix_seconds(F.col("started_at").cast("timestamp")), F.lit(1))
    begun = F.col("started_at").isNotNull() & (F.col("done") > 0)
    rate = F.when(begun, F.col("done") / seconds(F.coalesce("finished_at", F.lit(now).cast("timestamp_ntz"))))
    left = F.when(begun & (F.col("total") > F.col("done")), (F.col("total") - F.col("done")) / F.nullif(F.col("done") / seconds(F.lit(now)), F.lit(0.0)))
    return phases.withColumns({"rate": rate, "eta_seconds": left})


def run_eta(minutes: DataFrame, phases: DataFrame) -> DataFrame:
    """One row: seconds that the open phases take at the rate of the last three minutes counted; null where there is none."""
    rate = minutes.orderBy(F.desc("bucket")).limit(3).agg((F.sum("requests") / (F.count("*") * 60)).alias("rate"))
    left = phases.where(~F.col("status").isin("completed", "skipped")).agg(F.sum(F.greatest(F.lit(0), F.col("total") - F.col("done"))).alias("left"))
    return rate.crossJoin(F.broadcast(left)).select(F.when((F.col("rate") > 0) & (F.col("left") > 0), F.col("left") / F.col("rate")).alias("eta_seconds"))  # one row each


def list_runs(runs: DataFrame, limit: int = 20) -> DataFrame:
    return runs.orderBy(F.desc("id")).limit(limit)


def list_imports(imports: DataFrame, plays: DataFrame, limit: int = 20) -> DataFrame:
    """The newest imports with the plays that are still there of each."""
    live = plays.where("import_id is not null").groupBy(F.col("import_id").alias("id")).agg(F.count("*").alias("live_plays"))
    newest = imports.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)
    return newest.join(live, "id", "left").withColumns({"live_plays": F.coalesce("live_plays", F.lit(0)), "created_at": iso(F.col("created_at"))})


def data_version(runs: DataFrame, library: DataFrame) -> DataFrame:
    """One row: a key that changes when a run completes or the library's size does."""
    last = runs.where("status = 'completed'").agg(F.coalesce(F.max("finished_at").cast("string"), F.lit("none")).alias("last"))
    return last.crossJoin(F.broadcast(library.agg(F.count("*").alias("n")))).select(F.concat_ws(":", "last", "n").alias("version"))  # one row each

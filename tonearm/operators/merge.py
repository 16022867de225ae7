"""Merge rules. Stored rows and a batch in, the new state out; a caller writes it beside the old one and swaps.

No rule reads a table through the driver, and each is one join on the key.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PLAY_KEY = ("played_at", "item_uri", "ms_played")


def _matches(a: DataFrame, b: DataFrame, keys: tuple[str, ...] | list[str]) -> Column:
    on = F.lit(True)
    for k in keys:
        on = on & a[k].eqNullSafe(b[k])
    return on


def new_plays(stored: DataFrame, batch: DataFrame, keys: tuple[str, ...] = PLAY_KEY) -> DataFrame:
    """The batch's plays that aren't stored, each key once; nulls in a key are equal. Of equal keys the least id stays."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy("id"))
    once = batch.withColumn("_n", first).where("_n = 1").drop("_n")
    have = stored.select(*(F.col(k).alias(f"s_{k}") for k in keys))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"s_{k}"))
    return once.join(have, on, "left_anti")


def superseded_polls_removed(plays: DataFrame, low: datetime, high: datetime) -> DataFrame:
    """Plays without the polled ones in an import's span, ends included."""
    return plays.where(~((F.col("source") == "recent") & F.col("played_at").between(F.lit(low), F.lit(high))))


def last_wins(batch: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The last row of each key, in the given order."""
    latest = F.row_number().over(Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order)))
    return batch.withColumn("_n", latest).where("_n = 1").drop("_n")


def _nothing(c: str, kind: str) -> Column:
    """A new value that says nothing: null, or an empty array or map."""
    return (F.col(c).isNull() | (F.size(c) == 0)) if kind.startswith(("array", "map")) else F.col(c).isNull()


def upsert(stored: DataFrame, batch: DataFrame, keys: list[str], overwrite: tuple[str, ...] = (), sticky: tuple[str, ...] = (), add: tuple[str, ...] = ()) -> DataFrame:
    """Stored rows under a batch, whose keys are distinct.

    A new value replaces the old one unless it is null or empty. overwrite: columns whose new value
    counts in any case. sticky: booleans that stay true. add: numbers that are added. Columns that the
    batch lacks keep their old value, or null in a new row. Keys aren't null.
    """
    kinds, fresh = dict(stored.dtypes), [c for c in batch.columns if c not in keys]
    new = batch.select(*keys, *(F.col(c).alias(f"n_{c}") for c in fresh), F.lit(True).alias("_in"))
    joined = stored.withColumn("_old", F.lit(True)).join(new, keys, "full")

    def value(c: str) -> Column:
        if c in keys or c not in fresh:
            return F.col(c)
        old, got = F.col(c), F.col(f"n_{c}")
        if c in overwrite:
            merged = F.when(F.col("_in"), got).otherwise(old)
        elif c in sticky:
            merged = F.coalesce(old, F.lit(False)) | F.coalesce(got, F.lit(False))
        elif c in add:
            merged = F.coalesce(old, F.lit(0)) + F.coalesce(got, F.lit(0))
        else:
            merged = F.when(_nothing(f"n_{c}", kinds[c]), F.coalesce(old, got)).otherwise(got)
        return merged.cast(stored.schema[c].dataType).alias(c)

    return joined.select(*(value(c) for c in stored.columns))


#: What a simplified object doesn't know of an entity.
FULL_ONLY = ("popularity", "isrc", "label", "upc", "followers_total")


def upsert_detail(stored: DataFrame, batch: DataFrame, keys: list[str], level: str) -> DataFrame:
    """upsert for objects of one level of detail; a full row isn't made a simplified one again, and full-only columns wait for full objects."""
    known = batch if level == "full" else batch.drop(*(c for c in FULL_ONLY if c in batch.columns))
    merged = upsert(stored, known.drop("detail_level"), keys)
    touched = batch.select(*keys, F.lit(level).alias("_level"))
    best = F.when((F.col("detail_level") == "full") | F.col("_level").isNull(), F.col("detail_level")).otherwise(F.col("_level"))
    return merged.join(touched, keys, "left").withColumn("detail_level", best).drop("_level")


def replace_children(stored: DataFrame, children: DataFrame, parent: str) -> DataFrame:
    """Children of the parents that the batch has children of are replaced; a parent without any isn't touched."""
    return stored.join(children.select(parent).distinct(), parent, "left_anti").select(*stored.columns).unionByName(children.select(*stored.columns))


def replace_playlists(stored: DataFrame, items: DataFrame, read: DataFrame) -> DataFrame:
    """Items of the playlists that were read are replaced by position; repeats stay, and a playlist read as empty has none. read: playlist_id."""
    return stored.join(read.select("playlist_id").distinct(), "playlist_id", "left_anti").select(*stored.columns).unionByName(items.select(*stored.columns))


def playlist_rows(landed: DataFrame) -> DataFrame:
    """Landed items as rows: local files, episodes and missing tracks keep a label but no track.

    landed: playlist_id, position, added_at, added_by_id, is_local, and track (id, type, name, artist) or null.
    """
    track, local = F.col("track"), F.coalesce("is_local", F.lit(False))
    real = track.isNotNull() & ~local & (F.coalesce(track["type"], F.lit("track")) == "track")
    return landed.select(
        "playlist_id", "position", F.when(real, track["id"]).alias("track_id"), "added_at", "added_by_id", local.alias("is_local"),
        F.when(~real, track["name"]).alias("local_name"), F.when(~real, track["artist"]).alias("local_artist"),
    )


def reconcile(stored: DataFrame, listing: DataFrame, key: str, now: datetime) -> DataFrame:
    """Soft deletion against a full listing: what is absent is removed now, what is there again comes back."""
    here = listing.select(key).distinct().withColumn("_here", F.lit(True))
    kind = stored.schema["removed_at"].dataType
    joined = stored.join(here, key, "left")
    removed = F.when(F.col("_here").isNull(), F.coalesce("removed_at", F.lit(now).cast(kind)))
    return joined.withColumn("removed_at", removed).select(*stored.columns)


def insert_missing(stored: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows and those of the batch whose key is new, each once."""
    new = batch.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti")
    return stored.unionByName(new.select(*stored.columns))


def record_misses(requested: DataFrame, found: DataFrame, key: str, status: str) -> DataFrame:
    """Found rows, and for each other requested key a row that says so."""
    missing = requested.select(key).distinct().join(found, key, "left_anti").withColumn("status", F.lit(status))
    return found.unionByName(missing, allowMissingColumns=True)


def reset_misses(rows: DataFrame, status: str) -> DataFrame:
    """Rows without the misses, so that they are asked for again."""
    return rows.where(~F.col("status").eqNullSafe(status))


def latest_payloads(payloads: DataFrame) -> DataFrame:
    """The newest payload of each entity from an append-only store."""
    return last_wins(payloads, ["entity_type", "entity_id"], "fetched_at", "payload")


def chosen_recordings(candidates: DataFrame) -> DataFrame:
    """The recording of each code: the earliest release, then the longest, then the least id. candidates: isrc, mbid, first_release_date, length_ms."""
    order = F.struct(F.coalesce("first_release_date", F.lit("9999")), -F.coalesce("length_ms", F.lit(0)), F.col("mbid"))
    return candidates.groupBy("isrc").agg(F.min_by("mbid", order).alias("recording_mbid"), F.count(F.lit(1)).alias("candidates"))


def undo_import(plays: DataFrame, import_id: int) -> DataFrame:
    return plays.where(~F.col("import_id").eqNullSafe(import_id))


def expired_removed(rows: DataFrame, column: str, before: datetime) -> DataFrame:
    """Rows that aren't older than a moment; those without a time stay."""
    return rows.where(F.col(column).isNull() | (F.col(column) >= F.lit(before)))


def push_decisions(rows: DataFrame) -> DataFrame:
    """rows with decision, as push_decision() has it. rows: fingerprint, tracks, synced_fingerprint, synced_snapshot_id, snapshot_id."""
    equal = F.col("fingerprint").eqNullSafe(F.col("synced_fingerprint")) & F.col("snapshot_id").eqNullSafe(F.col("synced_snapshot_id"))
    return rows.withColumn("decision", F.when(F.coalesce("tracks", F.lit(0)) == 0, "refuse").when(equal, "skip").otherwise("write"))


def push_decision(fingerprint: str, tracks: int, stored_fingerprint: str | None, stored_snapshot: str | None, snapshot: str | None) -> str:
    """What a collection's playlist needs: 'refuse' an empty push, 'skip' an equal one, else 'write'; a snapshot that moved is always written."""
    if not tracks:
        return "refuse"
    return "skip" if fingerprint == stored_fingerprint and snapshot == stored_snapshot else "write"

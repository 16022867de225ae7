"""Aggregates that follow their rows: signed changes are folded into grouped values, and only touched groups are looked at.

A change is rows that went and rows that came; an update is both. Counts and sums add up with the sign. A least or
greatest value stands unless a row that went had it; then the group is repaired, which means computed again from the
rows it has now. A representative is the least of a struct that begins with its rank, so it follows
the same rule. Rows and groups lie in buckets by the hash of the group's key, so a change opens the
buckets of its keys, and of a repair's rows the groups in need only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.listening import COMPLETION_MS, heard
from ..streaming.slices import Slices
from . import derive


@dataclass(frozen=True)
class Fold:
    """What is kept of each group: names and columns over its rows. sums ignore nulls, and so do least and most."""

    key: str
    sums: dict[str, Callable[[], Column]] = field(default_factory=dict)
    least: dict[str, Callable[[], Column]] = field(default_factory=dict)
    most: dict[str, Callable[[], Column]] = field(default_factory=dict)


def folded(rows: DataFrame, fold: Fold) -> DataFrame:
    """All groups anew: key, n (rows), and the fold's columns."""
    aggs = [F.count(F.lit(1)).alias("n"), *(F.coalesce(F.sum(c()), F.lit(0)).alias(k) for k, c in fold.sums.items())]
    aggs += [F.min(c()).alias(k) for k, c in fold.least.items()] + [F.max(c()).alias(k) for k, c in fold.most.items()]
    return rows.groupBy(fold.key).agg(*aggs)


def signed(gone: DataFrame, come: DataFrame, fold: Fold) -> DataFrame:
    """Changes by group: what counts and sums grow by, and the extremes of the rows that went (g_) and that came (c_)."""
    both = gone.withColumn("_sign", F.lit(-1)).unionByName(come.withColumn("_sign", F.lit(1)))
    aggs = [F.sum("_sign").alias("d_n"), *(F.coalesce(F.sum(c() * F.col("_sign")), F.lit(0)).alias(f"d_{k}") for k, c in fold.sums.items())]
    for names, pick in ((fold.least, F.min), (fold.most, F.max)):
        for k, c in names.items():
            aggs += [pick(F.when(F.col("_sign") < 0, c())).alias(f"g_{k}"), pick(F.when(F.col("_sign") > 0, c())).alias(f"c_{k}")]
    return both.groupBy(fold.key).agg(*aggs)


def broken(fold: Fold) -> Column:
    """Whether a group's extreme went with a row, and no row that came is as extreme. Over groups joined with their changes."""
    lost = [(F.col(f"g_{k}") <= F.col(k)) & ~F.coalesce(F.col(f"c_{k}") <= F.col(f"g_{k}"), F.lit(False)) for k in fold.least]
    lost += [(F.col(f"g_{k}") >= F.col(k)) & ~F.coalesce(F.col(f"c_{k}") >= F.col(f"g_{k}"), F.lit(False)) for k in fold.most]
    return F.coalesce(reduce(lambda a, b: F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False)), lost), F.lit(False)) if lost else F.lit(False)


def joined(groups: DataFrame, changes: DataFrame, fold: Fold) -> DataFrame:
    """Touched and untouched groups with their changes and what they become; broken tells those whose extremes must be computed again."""
    both = groups.join(changes, fold.key, "full").withColumn("broken", broken(fold))
    out = {k: F.coalesce(k, F.lit(0)) + F.coalesce(f"d_{k}", F.lit(0)) for k in ("n", *fold.sums)}
    out |= {k: F.least(k, f"c_{k}") for k in fold.least} | {k: F.greatest(k, f"c_{k}") for k in fold.most}
    return both.select(fold.key, "broken", *(c.alias(k) for k, c in out.items())).where("n > 0")


class Maintained:
    """Rows and their groups in buckets of a folder, kept up to date by changes.

    schema: columns of the rows, of which row is a key of its own and fold.key may be null (such rows are in no group).
    Changes name rows as they were: a row that went must be one that is there.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, row: str, fold: Fold, buckets: int = 64) -> None:
        self.spark, self.fold, self.row, self.buckets = spark, fold, row, buckets
        self.rows = Slices(spark, f"{folder}/rows", schema, [fold.key, row])
        shape = folded(spark.createDataFrame([], schema), fold).schema
        self.groups = Slices(spark, f"{folder}/groups", ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in shape.fields), [fold.key])

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.fold.key), F.lit(self.buckets).cast("long"))

    def _touched(self, *frames: DataFrame) -> set[int]:
        """Buckets of some frames' keys: fewer than there are buckets."""
        return {r[0] for df in frames for r in df.where(F.col(self.fold.key).isNotNull()).select(self._bucket()).distinct().collect()}

    def rebuild(self, rows: DataFrame, tag: str) -> None:
        """Everything anew from all rows."""
        known = rows.where(F.col(self.fold.key).isNotNull())
        every = range(self.buckets)
        self.rows.commit(known.withColumn("slice", self._bucket()), every, tag)
        self.groups.commit(folded(self.rows.read(), self.fold).withColumn("slice", self._bucket()), every, tag)

    def apply(self, gone: DataFrame, come: DataFrame, tag: str) -> None:
        """Folds a change in. One that was folded in before (by its tag) does nothing; one that was stopped half-way is finished."""
        if self.groups.has(tag):
            return
        gone, come = (df.where(F.col(self.fold.key).isNotNull()) for df in (gone, come))
        touched = self._touched(gone, come)
        if not self.rows.has(tag):
            rest = self.rows.read(touched).join(gone.select(self.fold.key, self.row), [self.fold.key, self.row], "left_anti")
            self.rows.commit(rest.unionByName(come.select(*rest.columns)).withColumn("slice", self._bucket()), touched, tag)
        now = joined(self.groups.read(touched), signed(gone, come, self.fold), self.fold)
        repaired = self.rows.read(touched).join(now.where("broken").select(self.fold.key), self.fold.key, "left_semi")
        whole = now.where("not broken").drop("broken").unionByName(folded(repaired, self.fold))
        self.groups.commit(whole.withColumn("slice", self._bucket()), touched, tag)

    def rekey(self, moves: DataFrame, member: str, tag: str) -> None:
        """Rows whose member (track, say) has another key now go to its group. moves: member, was and now; a member that was in no group has a null there."""
        old = self.rows.read(self._touched(moves.select(F.col("was").alias(self.fold.key))))
        gone = old.join(moves.select(member, F.col("was").alias(self.fold.key), F.col("now").alias("_now")), [self.fold.key, member])
        self.apply(gone.drop("_now"), gone.withColumn(self.fold.key, F.col("_now")).drop("_now"), tag)

    def read(self, keys: Iterable | None = None) -> DataFrame:
        """The groups; of some keys without opening other buckets."""
        if keys is None:
            return self.groups.read()
        wanted = self.spark.createDataFrame([(k,) for k in keys], self.spark.createDataFrame([], self.groups.schema).select(self.fold.key).schema)
        return self.groups.read(self._touched(wanted)).join(F.broadcast(wanted), self.fold.key, "left_semi")


# --- plays by recording (D7)

PLAY_ROWS = "canonical_track_id string, track_id string, id long, played_at timestamp_ntz, ms long"
PLAY_STATS = Fold(
    "canonical_track_id",
    sums={
        "completed_plays": lambda: F.when(F.col("ms") >= COMPLETION_MS, 1).otherwise(0).cast("long"), "skips": lambda: F.when(F.col("ms") < COMPLETION_MS, 1).otherwise(0).cast("long"), "ms_played": lambda: F.coalesce("ms", F.lit(0)).cast("long"),
    },
    least={"first_played_at": lambda: F.col("played_at")}, most={"last_played_at": lambda: F.col("played_at")},
)


def play_rows(plays: DataFrame, tracks: DataFrame) -> DataFrame:
    known = tracks.where("canonical_track_id is not null").select(F.col("id").alias("track_id"), "canonical_track_id")
    return plays.join(known, "track_id").select("canonical_track_id", "track_id", "id", "played_at", heard().cast("long").alias("ms"))


def play_stats(groups: DataFrame) -> DataFrame:
    """Groups in the shape of derive.play_stats."""
    return groups.select("canonical_track_id", F.col("n").alias("plays"), "completed_plays", "skips", "ms_played", "first_played_at", "last_played_at")


# --- recordings (D1)

RECORDINGS = Fold("cid", least={"best": lambda: F.struct("rank", "copy"), "earliest_release_date": lambda: F.col("release_date_start")}, most={"max_popularity": lambda: F.col("popularity")})


def recordings(groups: DataFrame, track_artists: DataFrame) -> DataFrame:
    """Groups in the shape of derive.canonical_tracks."""
    return derive.recordings_of(groups.select("cid", F.col("best.copy").alias("rep"), "max_popularity", F.col("n").alias("copy_count"), "earliest_release_date"), track_artists)


# --- the library by recording (D2)

LIBRARY_ROWS = "canonical_track_id string, track_id string, first_added_at timestamp_ntz, via_liked boolean, owned_playlist_count long"
LIBRARY = Fold(
    "canonical_track_id", sums={"likes": lambda: F.col("via_liked").cast("int").cast("long"), "owned_playlist_count": lambda: F.col("owned_playlist_count")},
    least={"first_added_at": lambda: F.col("first_added_at")}, most={"latest_added_at": lambda: F.col("first_added_at")},
)


def library_rows(library: DataFrame, tracks: DataFrame) -> DataFrame:
    known = tracks.where("canonical_track_id is not null").select(F.col("id").alias("track_id"), "canonical_track_id")
    return library.join(known, "track_id").select("canonical_track_id", "track_id", F.col("first_added_at").cast("timestamp_ntz").alias("first_added_at"), "via_liked", F.col("owned_playlist_count").cast("long").alias("owned_playlist_count"))


def library_canonical(groups: DataFrame, recordings: DataFrame) -> DataFrame:
    """Groups in the shape of derive.library_canonical."""
    facts = recordings.select(F.col("id").alias("canonical_track_id"), "duration_ms", "primary_artist_id", "primary_album_id", "explicit")
    told = groups.select("canonical_track_id", "first_added_at", "latest_added_at", (F.col("likes") > 0).alias("liked"), F.col("n").alias("copy_count_in_library"), "owned_playlist_count")
    return told.join(facts, "canonical_track_id")


# --- genres of recordings (D14)


def track_genre_changes(t_old, t_new) -> tuple[DataFrame, DataFrame]:
    """Rows of track_genres that went and that came between two states of its tables.

    Only recordings and tags of the codes, tags and vocabulary words that differ are joined again, on both sides.
    """

    def differing(name: str, *columns: str) -> DataFrame:
        was, now = t_old[name].select(*columns), t_new[name].select(*columns)
        return was.exceptAll(now).unionByName(now.exceptAll(was))

    words = differing("mb_genres", "name").select(F.col("name").alias("tag")).distinct()
    by_word = t_new["mb_tags"].where("entity_type = 'recording'").join(words, "tag", "left_semi").select("entity_mbid").unionByName(t_old["mb_tags"].where("entity_type = 'recording'").join(words, "tag", "left_semi").select("entity_mbid"))
    mbids = differing("mb_tags", "entity_type", "entity_mbid", "tag", "count", "is_genre").where("entity_type = 'recording'").select("entity_mbid").unionByName(by_word)
    codes = differing("isrc_recordings", "isrc", "recording_mbid").select("isrc").unionByName(differing("canonical_tracks", "id", "isrc").select("isrc"))
    linked = t_old["isrc_recordings"].select("isrc", "recording_mbid").unionByName(t_new["isrc_recordings"].select("isrc", "recording_mbid"))
    codes = codes.unionByName(linked.join(mbids.distinct().withColumnRenamed("entity_mbid", "recording_mbid"), "recording_mbid", "left_semi").select("isrc")).where("isrc is not null").distinct()

    def of(t) -> DataFrame:
        class Near(dict):
            def __missing__(self, name):
                return t[name].join(codes, "isrc", "left_semi") if name in ("canonical_tracks", "isrc_recordings") else t[name]

        return derive.track_genres(Near())

    was, now = of(t_old), of(t_new)
    return was.exceptAll(now), now.exceptAll(was)

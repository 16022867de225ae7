"""Landed tables and all that is derived from them, each built once and kept as Parquet.

A table is built when it is first asked for, out of other tables, by a pure function, and written under a
path of its own; queries then scan only the columns and row groups they need. Build order follows from
what each function asks for: recordings, library, plays, statistics, albums.
"""

from __future__ import annotations

from collections import ChainMap
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.times import ragged_date
from ..operators import bitmaps, derive
from ..sources.driver import PLANS, STAR, TABLES, credits_of, first_credits_of, playlist_items
from ..sources.shared import kept

Builder = Callable[[Mapping[str, DataFrame]], DataFrame]



def _planned(t, name: str) -> bool:
    """Whether a table isn't built yet and would be built from the star tables, so that a part of it can be had without it."""
    return isinstance(t, Warehouse) and name not in t.built and t.texts.get(name) == TABLES[name]


def own_items(t: Mapping[str, DataFrame]) -> DataFrame:
    """playlist_tracks of one's own playlists at least."""
    if not _planned(t, "playlist_tracks"):
        return t["playlist_tracks"]
    return playlist_items(t, t["playlists"].where("is_owned and removed_at is null").select(F.col("id").alias("playlist_id")))


def some_credits(t: Mapping[str, DataFrame], wanted: DataFrame) -> DataFrame:
    """track_artists of some tracks at least. wanted: track_id."""
    return credits_of(t, wanted) if _planned(t, "track_artists") else t["track_artists"]


def first_credits(t: Mapping[str, DataFrame], wanted: DataFrame) -> DataFrame:
    """Rows of track_artists, the first ones of some tracks at least. wanted: track_id."""
    return first_credits_of(t, wanted) if _planned(t, "track_artists") else t["track_artists"]


def library_dates(t: Mapping[str, DataFrame]) -> DataFrame:
    """canonical_track_id and first_added_at of library_canonical, without the facts of recordings where those aren't built yet."""
    if isinstance(t, Warehouse) and "library_canonical" not in t.built:
        return derive.library_dates(t["library_tracks"], t["recording_keys"])
    return t["library_canonical"]


def raw_plays(t: Mapping[str, DataFrame]) -> DataFrame:
    """Plays, for queries that need neither tracks nor estimates."""
    if isinstance(t, Warehouse) and "plays" not in t.built:
        return t.scan("plays_landed")
    return t["plays"]


def heard_plays(t: Mapping[str, DataFrame]) -> DataFrame:
    """Plays without item_uri and track_id, for queries that need estimates but not tracks; the columns a query leaves out aren't computed."""
    if isinstance(t, Warehouse) and "plays" not in t.built:
        return derive.heard_plays(t.scan("plays_landed"), t["tracks_landed"])
    return t["plays"]


#: Derived tables. A table named x_landed is what a source gave, x is what queries read.
DERIVED: dict[str, Builder] = {
    "albums_dated": lambda t: t["albums_landed"].withColumns({"release_date_start": ragged_date(F.col("release_date")), "available_markets": F.split("markets", ",")}).drop("markets"),
    "library_tracks": lambda t: derive.library_tracks(t["saved_tracks"], t["playlists"], own_items(t)),
    "recording_keys": lambda t: derive.recording_keys(t["tracks_landed"], some_credits(t, derive.uncoded(t["tracks_landed"])), t["canonical_overrides"]),
    "canonical_tracks": lambda t: derive.canonical_tracks(t["recording_keys"], t["tracks_landed"], t["track_artists"], t["albums_dated"], t["library_tracks"]),
    "canonical_track_artists": lambda t: derive.canonical_track_artists(t["recording_keys"], t["canonical_tracks"], t["track_artists"]),
    "tracks": lambda t: derive.with_recordings(t["tracks_landed"], t["recording_keys"]),
    "library_canonical": lambda t: derive.library_canonical(t["library_tracks"], t["tracks"], t["canonical_tracks"]),
    # Each file holds a span of time, so a window reads the files and row groups of that time.
    "plays": lambda t: laid_by_time(derive.estimate_durations(derive.link_plays(t["plays_landed"], t["tracks"]), t["tracks"]), t["plays_landed"]),
    "canonical_play_stats": lambda t: derive.play_stats(t["plays"], t["tracks"]),
    "albums_complete": lambda t: derive.album_completeness(t["albums_dated"], t["tracks"]),
    "album_group_keys": lambda t: derive.album_group_keys(t["albums_complete"], t["tracks"]),
    "albums": lambda t: derive.with_groups(t["albums_complete"], t["album_group_keys"]),
    "album_groups": lambda t: derive.album_groups(t["album_group_keys"], t["albums_complete"], t["album_artists"], t["saved_albums"]),
    # Only recordings with codes have genres; they are told from tracks, without credits and the library.
    "track_genres": lambda t: derive.track_genres(ChainMap({"canonical_tracks": derive.coded_recordings(t["tracks_landed"], t["canonical_overrides"])}, t)),
}

#: Built when a query first asks for them; a refresh leaves them out.
INDEXES: dict[str, Builder] = {
    "recording_numbers": bitmaps.recording_numbers,
    "genre_bitmaps": bitmaps.genre_bitmaps,
    "library_genre_bitmaps": bitmaps.library_genre_bitmaps,
}


#: Plays of a file of the log, at least.
FILE_PLAYS = 250_000


def laid_by_time(plays: DataFrame, landed: DataFrame) -> DataFrame:
    """plays in files of days that follow each other, about equally many plays each.

    Which days go to which file is told from the counts of landed's days, so plays are computed once and
    not sampled first.
    """
    day = F.col("played_at").cast("date")
    counts = landed.groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("n"))
    total = landed.count()
    files = max(int(plays.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // FILE_PLAYS))
    before = F.coalesce(F.sum("n").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each day
    placed = counts.select(F.col("day").alias("_day"), F.floor(before * files / max(1, total)).cast("int").alias("_file"))
    told = plays.join(F.broadcast(placed), day.eqNullSafe(F.col("_day")), "left")  # a row for each day of a log
    return told.repartitionById(files, F.coalesce("_file", F.lit(0))).sortWithinPartitions("played_at").drop("_day", "_file")


class Warehouse(Mapping):
    """Tables by name over a folder of star-schema Parquet files."""

    def __init__(self, spark: SparkSession, folder: str, tables: Mapping[str, str] = TABLES, derived: Mapping[str, Builder] = DERIVED) -> None:
        self.spark, self.folder, self.texts, self.derived = spark, folder, tables, derived
        self.built: dict[str, DataFrame] = {}
        #: What the files of the star tables that were read looked like, and which of them each built table comes from.
        self.files: dict[str, tuple] = {}
        self.sources: dict[str, set[str]] = {}
        self._building: list[str] = []

    def __getitem__(self, name: str) -> DataFrame:
        if name in STAR:
            if name not in self.files:
                self.files[name] = self._listing(name)
            self._comes_from({name})
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        if name not in self.built:
            builder = self.derived.get(name) or INDEXES.get(name)
            if builder is None and name in PLANS and self.texts.get(name) == TABLES[name]:
                builder = PLANS[name]
            if builder is None and name not in self.texts:
                if f"{name}_landed" in self.texts:
                    return self[f"{name}_landed"]
                raise KeyError(name)
            self._building.append(name)
            self.sources[name] = set()
            try:
                rows = builder(self) if builder else self.spark.sql(self.texts[name], **{n: self[n] for n in used(self.texts[name])})
                self.built[name] = kept(rows, name)
            finally:
                self._building.pop()
        self._comes_from(self.sources[name])
        return self.built[name]

    def scan(self, name: str) -> DataFrame:
        """A landed table as its text gives it, not kept unless it is already."""
        if name in self.built or name not in self.texts:
            return self[name]
        return self.spark.sql(self.texts[name], **{n: self[n] for n in used(self.texts[name])})

    def _comes_from(self, stars: set[str]) -> None:
        if self._building:
            self.sources[self._building[-1]] |= stars

    def _listing(self, star: str) -> tuple:
        """Name, size and time of each file of a star table."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{star}.parquet")
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(path)))

    def renew(self) -> list[str]:
        """Forgets the built tables that come from files which have changed since, and names them; the others stay."""
        changed = {star for star, seen in self.files.items() if self._listing(star) != seen}
        gone = [name for name in self.built if self.sources[name] & changed]
        for name in gone:
            del self.built[name]
        for star in changed:
            del self.files[star]
        return gone

    def __iter__(self):
        return iter([*STAR, *self.texts, *self.derived])

    def __len__(self) -> int:
        return len(STAR) + len(self.texts) + len(self.derived)


def used(text: str) -> list[str]:
    """The tables in braces."""
    import string

    return sorted({name for _, name, _, _ in string.Formatter().parse(text) if name})


_OPEN: dict[tuple[str, str], Warehouse] = {}


def warehouse(spark: SparkSession, folder: str) -> Warehouse:
    """The session's warehouse over a folder: tables that one query built serve the next, as long as their files are the same."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _OPEN:
        _OPEN[key] = Warehouse(spark, folder)
    _OPEN[key].renew()
    return _OPEN[key]


def refresh(spark: SparkSession, folder: str) -> Warehouse:
    """Builds all derived tables anew."""
    _OPEN[spark.sparkContext.applicationId, folder] = w = Warehouse(spark, folder)
    for name in w.derived:
        w[name]
    return w

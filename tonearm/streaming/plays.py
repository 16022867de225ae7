"""The poll as a stream: landed items are merged into the log as they come.

A file-source stream takes the place of the poll's high-water mark. The log is kept in slices of time: a micro-batch is
merged by key and linked in the slices that it falls into, and polled rows are estimated anew there, for an
answer may change when a play lands in front of one. What an estimate needs from outside is the last play of
the slices before; it stands in the manifest. A batch's tag makes it count once, however often it is run.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.times import epoch_seconds
from ..operators import derive, merge
from ..sources.landed import SCHEMAS, polled_plays
from ..sources.shared import shared_dir
from .slices import Slices

PLAYS = (
    "id long, played_at timestamp_ntz, ms_played int, estimated_ms int, item_kind string, item_uri string, track_id string, resolve_attempted_at timestamp_ntz, track_name string, artist_name string, "
    "album_name string, source string, import_id long"
)


#: Seconds of a slice of the log; whole hours, for the estimate looks back by hours.
SPAN = 86_400


def slice_of(at: Column) -> Column:
    return F.call_function("div", epoch_seconds(at), F.lit(SPAN).cast("long"))


class PlayLog(Slices):
    """A log of plays in slices of time. A change reads and writes the slices that its plays fall into, and the next one where that begins with an estimate."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        open_row = F.col("ms_played").isNull() & (F.col("source") == "recent")
        facts = {
            "last": F.max("played_at"), "open_head": F.min_by(open_row, F.struct("played_at", "id")), "polled": F.count_if(F.col("source") == "recent"),
            "unlinked": F.count_if(F.col("track_id").isNull() & (F.col("item_kind") == "track")),
        }
        super().__init__(spark, folder, PLAYS, ["played_at", "id"], facts)

    def window(self, low: datetime, high: datetime) -> DataFrame:
        """The plays of a half-open window, from the slices that it meets."""
        first, last = ((t - datetime(1970, 1, 1)) // timedelta(seconds=SPAN) for t in (low, high))
        return self.read([r["slice"] for r in self.manifest() if first <= r["slice"] <= last]).where((F.col("played_at") >= F.lit(low)) & (F.col("played_at") < F.lit(high)))

    def merge(self, batch: DataFrame, tracks: DataFrame, tag: str, span: tuple[datetime, datetime] | None = None) -> int | None:
        """The version with a batch of plays: each key once, links resolved, estimates as over the whole log.

        span: of an import, in which polled plays give way. None if the batch has been merged before or changes nothing.
        """
        if self.has(tag):
            return None
        manifest = self.manifest()
        path = f"{shared_dir(self.spark)}/tonearm-batch-{uuid.uuid4().hex}"
        near = [r["slice"] for r in batch.select(slice_of(F.col("played_at")).alias("slice")).distinct().collect()]
        fresh = merge.new_plays(self.read(near), batch)
        kinds = {f.name: f.dataType for f in self.spark.createDataFrame([], PLAYS).schema.fields}
        fresh.select(*((F.col(c) if c in fresh.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items())).write.parquet(path)
        new = self.spark.read.schema(PLAYS).parquet(path)
        changed = {r["slice"] for r in new.select(slice_of(F.col("played_at")).alias("slice")).distinct().collect()}
        if span:
            low, high = ((t - datetime(1970, 1, 1)) // timedelta(seconds=SPAN) for t in span)
            changed |= {r["slice"] for r in manifest if r["polled"] and low <= r["slice"] <= high}
        version = None
        if changed:
            old = self.read(changed)
            rows = (merge.superseded_polls_removed(old.unionByName(new), *span) if span else old.unionByName(new))
            version = self._settled(rows, changed, tracks, tag, manifest)
        fs, at = self._fs()
        fs.delete(at(path), True)
        return version

    def relink(self, tracks: DataFrame, tag: str) -> int | None:
        """The version in which plays are linked that the catalog has come to know; slices with unlinked plays are read, those with a find written."""
        manifest = self.manifest()
        open_slices = [r["slice"] for r in manifest if r["unlinked"]]
        rows = self.read(open_slices).where("track_id is null and item_kind = 'track'")
        found = {r["slice"] for r in derive.link_plays(rows, tracks).where("track_id is not null").select(slice_of(F.col("played_at")).alias("slice")).distinct().collect()}
        return self._settled(self.read(found), found, tracks, tag, manifest) if found and not self.has(tag) else None

    def _settled(self, rows: DataFrame, changed: set[int], tracks: DataFrame, tag: str, manifest: list) -> int:
        """Commits the changed slices, and each next one whose first play takes its estimate from the play before it."""
        others = [r for r in manifest if r["slice"] not in changed]
        order = sorted(changed | {r["slice"] for r in others})
        heads = {r["slice"] for r in others if r["open_head"]}
        follow = {b for a, b in zip(order, order[1:]) if a in changed and b in heads}
        lasts = self.spark.createDataFrame([(r["last"],) for r in others if r["slice"] not in follow], "played_at timestamp_ntz")  # a row for each slice
        settled = derive.settled_plays(rows, self.read(follow) if follow else rows.limit(0), tracks, lasts)
        return self.commit(settled.withColumn("slice", slice_of(F.col("played_at"))), changed | follow, tag, laid=True)


def merged(stored: DataFrame, polled: DataFrame, tracks: DataFrame) -> DataFrame:
    """A whole log with a batch of polled plays: what PlayLog.merge gives slice by slice."""
    new = merge.new_plays(stored, with_ids(polled))
    kinds = {f.name: f.dataType for f in stored.schema.fields}
    shaped = new.select(*((F.col(c) if c in new.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in stored.columns))
    return derive.estimate_durations(derive.link_plays(stored.unionByName(shaped), tracks), tracks)


def with_ids(polled: DataFrame) -> DataFrame:
    """Polled plays with a hash of their key as id."""
    return polled.withColumn("id", F.xxhash64("played_at", "item_uri", F.lit("recent")))


def poll_stream(spark: SparkSession, landing: str, log: PlayLog, tracks: DataFrame, checkpoint: str, after: Callable[[int | None], None] | None = None) -> StreamingQuery:
    """Runs all landed files through the log once and stops. after: called with each batch's version of the log, to refresh what hangs on it."""
    items = spark.readStream.schema(SCHEMAS["recently_played"]).option("maxFilesPerTrigger", 100).json(landing)

    def batch(rows: DataFrame, number: int) -> None:
        version = log.merge(with_ids(polled_plays(rows)), tracks, f"poll-{number}")
        if after:
            after(version)

    return items.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def minute_counters(calls: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Requests, errors and rate-limited answers by minute, from batch or stream. calls: at (timestamp_ntz), status.

    A stream drops calls that come later than the given time behind the newest.
    """
    timed = calls.withColumn("at", F.col("at").cast("timestamp"))
    timed = timed.withWatermark("at", late) if calls.isStreaming else timed
    counted = timed.groupBy(F.window("at", "1 minute").alias("w")).agg(F.count(F.lit(1)).alias("requests"), F.count_if(F.col("status") >= 400).alias("errors"), F.count_if(F.col("status") == 429).alias("rate_limited"))
    return counted.select(F.col("w.start").cast("timestamp_ntz").alias("bucket"), "requests", "errors", "rate_limited")


def recent_rate(minutes: DataFrame, now, hours: int = 2, last: int = 3) -> DataFrame:
    """One row: requests a second over the last minutes counted within the trailing hours."""
    trailing = minutes.where(F.col("bucket") > F.lit(now) - F.expr(f"interval {hours} hours")).orderBy(F.desc("bucket")).limit(last)
    return trailing.agg((F.sum("requests") / (F.count(F.lit(1)) * 60)).alias("rate"))


def listening_sessions(plays: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Runs of plays without a longer gap: start, end (with the gap) and plays, from batch or stream."""
    timed = plays.withColumn("at", F.col("played_at").cast("timestamp"))
    timed = timed.withWatermark("at", late) if plays.isStreaming else timed
    runs = timed.groupBy(F.session_window("at", gap).alias("w")).agg(F.count(F.lit(1)).alias("plays"))
    return runs.select(F.col("w.start").cast("timestamp_ntz").alias("started_at"), F.col("w.end").cast("timestamp_ntz").alias("ended_at"), "plays")


def unseen(items: DataFrame, late: str = "1 day") -> DataFrame:
    """A stream of plays with each key once within the watermark; merged() does so without a bound."""
    timed = items.withColumn("at", F.col("played_at").cast("timestamp")).withWatermark("at", late)
    return timed.dropDuplicatesWithinWatermark(["played_at", "item_uri"]).drop("at")


def new_since(items: DataFrame, newest) -> DataFrame:
    """Items added after the newest one that is stored; a listing in order of addition can stop there."""
    return items.where(F.col("added_at") > F.lit(newest)) if newest else items


def default_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}"

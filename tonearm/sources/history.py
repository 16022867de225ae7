"""Listening-history exports: zip archives and folders of JSON files."""

from __future__ import annotations

import codecs
import json
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime
from itertools import islice

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import derive, merge

# Names of the files that hold plays, and of those of the short export, which can't be used.
LONG_FORM, SHORT_FORM = r"Streaming_History_Audio_[^/]*\.json$", r"StreamingHistory[^/]*\.json$"
MAX_ENTRY_BYTES = 512 * 2**20
BLANK = re.compile("[ \t\r\n]*")

PLAY = (
    "played_at timestamp_ntz, ms_played int, item_kind string, item_uri string, track_name string, artist_name string, album_name string, episode_name string, show_name string, "
    "platform string, conn_country string, reason_start string, reason_end string, shuffle boolean, skipped boolean, offline boolean, incognito boolean"
)


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column("archive").to_pylist():
            fs, at = pafs.FileSystem.from_uri(path)
            with fs.open_input_file(at) as raw, zipfile.ZipFile(raw) as z:
                found = [e for e in z.infolist() if not e.is_dir()]
            yield pa.RecordBatch.from_pydict({"archive": pa.array([path] * len(found), pa.string()), "entry": pa.array([e.filename for e in found], pa.string()), "size": pa.array([e.file_size for e in found], pa.int64())})


def archive_entries(spark: SparkSession, archives: list[str]) -> DataFrame:
    """archive, entry and size (unpacked) of all files in zip archives, from their directories alone. archives: URIs."""
    tasks = min(len(archives), int(spark.conf.get("spark.sql.shuffle.partitions")))
    paths = spark.createDataFrame([(a,) for a in archives], "archive string").repartition(max(1, tasks))
    return paths.mapInArrow(_entries, "archive string, entry string, size long")


def array_items(stream, size: int = 1 << 20) -> Iterator[object]:
    """The items of a JSON array, one at a time, from a stream of UTF-8 bytes; only a piece of the text and one item are held.

    Any white space may stand between marks and items. What is no array, or ends within it, raises ValueError.
    """
    decoder, text = json.JSONDecoder(), codecs.getincrementaldecoder("utf-8-sig")()
    held, at, ended = "", 0, False
    expected = "["  # then "first" (an item or the end), "mark" (, or the end) and "item" in turn

    def more() -> None:
        nonlocal held, at, ended
        piece = stream.read(size)
        ended = not piece
        held, at = held[at:] + text.decode(piece, final=ended), 0

    def mark() -> str:
        """The next character that isn't white space, at which at stands then; empty at the end."""
        nonlocal at
        while True:
            at = BLANK.match(held, at).end()
            if at < len(held) or ended:
                return held[at : at + 1]
            more()

    while now := mark():
        if expected == "[":
            if now != "[":
                raise ValueError("a history file holds a JSON array")
            expected, at = "first", at + 1
        elif expected == "mark" and now == ",":
            expected, at = "item", at + 1
        elif expected in ("first", "mark") and now == "]":
            at += 1
            if mark():
                raise ValueError("something follows the array of a history file")
            return
        elif expected == "mark":
            raise ValueError("items of a history file aren't parted by commas")
        else:
            try:
                item, end = decoder.raw_decode(held, at)
            except json.JSONDecodeError:
                if ended:
                    raise
                more()
                continue
            if not ended and now not in '{["' and held[end : end + 1] in ".eE+-0123456789":  # a number that is cut off may go on
                more()
                continue
            yield item
            expected, at = "mark", end
    raise ValueError("a history file ends within its array")


def _records(most: int):
    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, entry, size in zip(*(batch.column(n).to_pylist() for n in ("archive", "entry", "size"))):
                if size > most:
                    raise ValueError(f"{entry} of {path} has {size} bytes, more than {most}")
                fs, at = pafs.FileSystem.from_uri(path)
                with fs.open_input_file(at) as raw, zipfile.ZipFile(raw) as z:
                    with z.open(entry) as stream:
                        items = array_items(stream)
                        while part := [json.dumps(r) for r in islice(items, 20_000)]:
                            yield pa.RecordBatch.from_pydict({"archive": pa.array([path] * len(part), pa.string()), "entry": pa.array([entry] * len(part), pa.string()), "record": pa.array(part, pa.string())})

    return records


def archive_plays(entries: DataFrame, most: int = MAX_ENTRY_BYTES) -> DataFrame:
    """archive, entry and the plays of the history files among the entries; a file is read by one task, and tasks have about equally many.

    An entry over the byte limit fails the read, as an upload over its ceiling does.
    """
    files = entries.where(F.col("entry").rlike(LONG_FORM))
    spread = files.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parsed = spread.mapInArrow(_records(most), "archive string, entry string, record string")
    return parsed.select("archive", "entry", F.from_json("record", PLAY).alias("play")).select("archive", "entry", "play.*")


def folder_plays(spark: SparkSession, folder: str) -> DataFrame:
    """The plays of a folder's history files, with the file in entry. Files are JSON arrays, one task each."""
    rows = spark.read.schema(PLAY).option("multiLine", True).option("pathGlobFilter", "Streaming_History_Audio_*.json").json(folder)
    return rows.withColumn("entry", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1))


def why_empty(entries: DataFrame) -> str | None:
    """What is wrong with an archive that has no history file, or None."""
    seen = entries.agg(F.count_if(F.col("entry").rlike(LONG_FORM)).alias("long"), F.min(F.when(F.col("entry").rlike(SHORT_FORM), F.col("entry"))).alias("short")).first()
    if seen["long"]:
        return None
    return f"{seen['short']} belongs to the short export, which has no track ids; ask for the extended history" if seen["short"] else "no Streaming_History_Audio_*.json in this archive"


def import_counts(landed: DataFrame, inserted: DataFrame) -> DataFrame:
    """Rows read, inserted and repeated, and the span, of each file."""
    read = landed.groupBy("entry").agg(F.count(F.lit(1)).alias("rows_read"), F.min("played_at").alias("first_played_at"), F.max("played_at").alias("last_played_at"))
    new = inserted.groupBy("entry").agg(F.count(F.lit(1)).alias("plays_inserted"))
    return read.join(new, "entry", "left").withColumn("plays_inserted", F.coalesce("plays_inserted", F.lit(0))).withColumn("duplicates", F.col("rows_read") - F.col("plays_inserted"))


def import_plays(stored: DataFrame, landed: DataFrame, tracks: DataFrame, import_id: int) -> tuple[DataFrame, DataFrame]:
    """The log after an import, and the rows it adds.

    New plays are added, polled plays in the import's span give way to it, then URIs are linked and all
    polled plays are estimated anew, for an imported one may now stand between two of them. An id is a hash of
    the play's key, so it is the same however often the frames are evaluated.
    """
    span = span_of(landed)
    numbered = imported_rows(landed, import_id)
    new = merge.new_plays(stored, numbered)
    kinds = {f.name: f.dataType for f in stored.schema.fields}
    shaped = new.select(*((F.col(c) if c in new.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in stored.columns))
    whole = stored.unionByName(shaped)
    if span[0] is not None:
        whole = merge.superseded_polls_removed(whole, span[0], span[1])
    return derive.estimate_durations(derive.link_plays(whole, tracks), tracks), new


def imported_rows(landed: DataFrame, import_id: int) -> DataFrame:
    """Landed plays as rows of the log."""
    return landed.withColumns({"id": F.xxhash64("played_at", "item_uri", "ms_played", "entry"), "source": F.lit("extended"), "import_id": F.lit(import_id).cast("long")})


def import_into(log, landed: DataFrame, tracks: DataFrame, import_id: int) -> int | None:
    """Merges an import into a log that is kept in slices (streaming.plays.PlayLog); gives its version. Only the slices of the import's span are read."""
    span = span_of(landed)
    return log.merge(imported_rows(landed, import_id), tracks, f"import-{import_id}", span) if span[0] is not None else None


def span_of(landed: DataFrame) -> tuple[datetime | None, datetime | None]:
    row = landed.agg(F.min("played_at"), F.max("played_at")).first()
    return row[0], row[1]

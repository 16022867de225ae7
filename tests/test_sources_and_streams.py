"""Archives, folders, streams and guarded SQL."""

import json
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tonearm.plans import adhoc
from tonearm.sources import history
from tonearm.streaming import plays as streams


def record(second, ms=40_000, uri="spotify:track:a"):
    return {"played_at": f"2024-01-01T10:00:{second:02d}", "ms_played": ms, "item_kind": "track", "item_uri": uri, "track_name": "n"}


@pytest.fixture
def tracks(spark):
    return spark.createDataFrame([("a", 180_000, None, "c")], "id string, duration_ms int, linked_from_id string, canonical_track_id string")


def test_archives(spark, tmp_path, tracks):
    path = tmp_path / "export.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("x/Streaming_History_Audio_2024_0.json", json.dumps([record(1), record(2), record(1)]))
        z.writestr("x/Streaming_History_Audio_2024_1.json", json.dumps([record(2), record(9)]), zipfile.ZIP_STORED)
        z.writestr("x/ReadMe.pdf", "x")
    entries = history.archive_entries(spark, [path.as_uri()])
    assert entries.count() == 3 and history.why_empty(entries) is None
    landed = history.archive_plays(entries)
    assert sorted((r["entry"][-6], r["played_at"].second) for r in landed.collect()) == [("0", 1), ("0", 1), ("0", 2), ("1", 2), ("1", 9)]
    stored = spark.createDataFrame([(1, datetime(2024, 1, 1, 10, 0, 5), None, None, "track", "spotify:track:a", None, None, None, None, None, "recent", None), (2, datetime(2024, 1, 1, 10, 1), None, None, "track", "spotify:track:a", None, None, None, None, None, "recent", None)], streams.PLAYS)
    after, new = history.import_plays(stored, landed, tracks, 7)
    got = sorted((r["played_at"].second + 60 * r["played_at"].minute, r["source"], r["import_id"], r["track_id"], r["estimated_ms"]) for r in after.collect())
    assert got == [(1, "extended", 7, "a", None), (2, "extended", 7, "a", None), (9, "extended", 7, "a", None), (60, "recent", None, "a", 51_000)]
    counts = history.import_counts(landed, new).agg(F.sum("rows_read"), F.sum("plays_inserted"), F.sum("duplicates")).first()
    assert tuple(counts) == (5, 3, 2)


def test_short_exports_are_explained(spark, tmp_path):
    path = tmp_path / "short.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("StreamingHistory_music_0.json", "[]")
    assert "short export" in history.why_empty(history.archive_entries(spark, [path.as_uri()]))


def test_folders(spark, tmp_path):
    (tmp_path / "Streaming_History_Audio_1.json").write_text(json.dumps([record(1), record(2)]))
    (tmp_path / "other.json").write_text("[1]")
    got = history.folder_plays(spark, str(tmp_path)).collect()
    assert sorted(r["played_at"].second for r in got) == [1, 2] and {r["entry"] for r in got} == {"Streaming_History_Audio_1.json"}


def item(at, uri="spotify:track:a"):
    return json.dumps({"played_at": at, "track": {"id": "a", "uri": uri, "name": "n"}})


def test_polls_stream_into_the_log(spark, tmp_path, tracks):
    landing, log = tmp_path / "in", streams.PlayLog(spark, (tmp_path / "log").as_uri())
    landing.mkdir()
    (landing / "1.json").write_text(item("2024-01-01T10:00:00.500") + "\n" + item("2024-01-01T10:02:00"))
    run = lambda: streams.poll_stream(spark, str(landing), log, tracks, str(tmp_path / "checkpoint")).awaitTermination(120)
    run()
    assert {r["played_at"]: r["estimated_ms"] for r in log.read().collect()} == {datetime(2024, 1, 1, 10): None, datetime(2024, 1, 1, 10, 2): 120_000}
    # The same play again, and one that lands between two that were estimated.
    (landing / "2.json").write_text(item("2024-01-01T10:00:00.100") + "\n" + item("2024-01-01T10:01:00"))
    run()
    assert {r["played_at"]: (r["estimated_ms"], r["track_id"]) for r in log.read().collect()} == {datetime(2024, 1, 1, 10): (None, "a"), datetime(2024, 1, 1, 10, 1): (60_000, "a"), datetime(2024, 1, 1, 10, 2): (60_000, "a")}
    assert log.versions() == [0, 1]


def test_counters_agree_in_batch_and_stream(spark, tmp_path):
    calls = spark.createDataFrame([(datetime(2024, 1, 1, 10, m, s), code) for m, s, code in ((0, 1, 200), (0, 59, 429), (1, 0, 500), (3, 0, 200))], "at timestamp_ntz, status int")
    calls.coalesce(1).write.parquet(str(tmp_path / "calls"))
    batch = sorted(map(tuple, streams.minute_counters(calls).collect()))
    assert [r[1:] for r in batch] == [(2, 1, 1), (1, 1, 0), (1, 0, 0)]
    stream = streams.minute_counters(spark.readStream.schema(calls.schema).parquet(str(tmp_path / "calls")))
    q = stream.writeStream.format("memory").queryName("counters").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("counters").collect())) == batch
    minutes = streams.minute_counters(calls)
    assert streams.recent_rate(minutes, datetime(2024, 1, 1, 10, 5)).first()[0] == 4 / 180


def test_sessions(spark, tmp_path):
    plays = spark.createDataFrame([(datetime(2024, 1, 1, 10, m),) for m in (0, 10, 39)] + [(datetime(2024, 1, 1, 12),)], "played_at timestamp_ntz")
    assert sorted(r["plays"] for r in streams.listening_sessions(plays).collect()) == [1, 3]
    assert streams.unseen(spark.readStream.schema("played_at timestamp_ntz, item_uri string").parquet(str(tmp_path))).isStreaming


@pytest.fixture
def tables(spark):
    return {"t": spark.range(300).withColumn("v", F.col("id") % 3), "u": spark.range(2)}


def test_reads_run(spark, tables):
    got = adhoc.run(spark, tables, tables, "select v, count(*) n from t group by v order by v -- a; b\n;")
    assert got.columns == [("v", "bigint"), ("n", "bigint")] and [json.loads(r)["n"] for r in got.rows] == [100, 100, 100] and not got.more
    assert [n for n, _ in adhoc.run(spark, tables, tables, "select a.id, b.id from u a join u b on a.id = b.id").columns] == ["id", "id_2"]
    assert len(adhoc.run(spark, tables, tables, "select * from t").rows) == adhoc.DEFAULT_ROWS and adhoc.run(spark, tables, tables, "select * from t").more
    assert adhoc.run(spark, tables, tables, "select 1 x; select 2 y").columns == [("y", "int")]
    assert adhoc.as_text(adhoc.run(spark, tables, tables, "select 'ä;' x")).endswith('{"x": "ä;"}')
    assert adhoc.describe(tables, ["u"]) == [{"table": "u", "columns": [{"name": "id", "type": "bigint"}], "rows": 2}]
    assert adhoc.run(spark, tables, tables, "(select id from u) except (select id from t where id > 0)").rows == ['{"id":0}']


@pytest.mark.parametrize(
    "statement",
    [
        "drop view t", "create table x as select 1", "insert into t select 1, 2", "set spark.sql.ansi.enabled = false", "from t insert into u select id insert into u select v", "select * from parquet.`/etc`", "cache table t", "truncate table t",
        "select 1; drop view t", "select java_method('java.lang.System', 'exit', 1)", "select reflect('java.util.UUID', 'randomUUID')", "with a as (select 1) insert into t select * from a, a", "add jar 'x'", "describe t", "",
    ],
)
def test_anything_else_is_refused(spark, tables, statement):
    with pytest.raises(adhoc.Refused):
        adhoc.run(spark, tables, tables, statement)


def test_slow_statements_are_cancelled(spark, tables):
    with pytest.raises(TimeoutError):
        adhoc.run(spark, tables, tables, "select max(sha2(cast(a.id * b.id * c.id as string), 512)) from t a, t b, t c", seconds=2)

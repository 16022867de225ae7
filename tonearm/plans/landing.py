"""Queries over what sources land: exports, objects of web interfaces, changes and guarded statements, with DuckDB SQL beside them."""

from __future__ import annotations

import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import groupby

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import charts, common, genres, listening, merge
from ..sources import history, landed
from ..sources.shared import shared_dir
from ..streaming import plays as streams
from . import adhoc, oracle
from .warehouse import Warehouse

ADHOC = "select n_name as name, r_name as name, n_nationkey, case when n_nationkey > 3 then upper(n_name) end as note from nation join region on r_regionkey = n_regionkey order by n_nationkey"


def _folder(w: Warehouse, name: str) -> str:
    return f"{shared_dir(w.spark)}/{name}-{uuid.uuid4().hex}"


#: Plays of an export file, about; a day with more is exported in several.
FILE_PLAYS = 50_000


def _export(folder: str, zipped: bool):
    """Writes each file's records as a JSON array, in an archive of its own or as a plain file, from rows sorted by file; gives the files' URIs."""

    @contextmanager
    def opened(fs, root: str, file: str) -> Iterator[Callable[[bytes], object]]:
        """What writes into the file."""
        entry = f"Streaming_History_Audio_{file}.json"
        with fs.open_output_stream(f"{root}/export_{file}.zip" if zipped else f"{root}/{entry}") as out:
            if not zipped:
                yield out.write
                return
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr("ReadMe.txt", "x")
                with z.open(f"My Data/{entry}", "w") as inner:
                    yield inner.write

    def export(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root)
        rows = ((file, record) for b in batches for file, record in zip(b.column("file").to_pylist(), b.column("record").to_pylist()))
        for file, held in groupby(rows, lambda r: r[0]):
            with opened(fs, root, file) as write:
                for k, (_, record) in enumerate(held):
                    write((b",\n" if k else b"[") + record.encode())
                write(b"]")
            yield pa.RecordBatch.from_pydict({"uri": [f"{folder}/export_{file}.zip"]})

    return export


def exported(w: Warehouse, zipped: bool, whole: bool = False) -> tuple[str, list[str]]:
    """The imported plays of the log as export files, written as they stream by: one for each day, or several where a day has more than FILE_PLAYS. whole: one in any case."""
    folder = _folder(w, "export")
    names = ["ms_played", "item_kind", "item_uri", "track_name", "artist_name", "platform", "conn_country", "reason_end", "shuffle"]
    plays, at = w["plays_landed"].where("source = 'extended'"), F.col("played_at").cast("string")
    file = F.substring(at, 1, 10)
    if not whole:
        days = plays.groupBy(file.alias("_day")).agg(F.ceil(F.count(F.lit(1)) / FILE_PLAYS).alias("_files"))
        plays = plays.join(F.broadcast(days), file.eqNullSafe(F.col("_day")))  # a row for each day
        file = F.when(F.col("_files") == 1, file).otherwise(F.concat_ws("_", file, F.pmod(F.xxhash64("id"), "_files")))
    records = plays.select(file.alias("file"), "played_at", F.to_json(F.struct(at.alias("played_at"), *names)).alias("record"))
    n = int(w.spark.conf.get("spark.sql.shuffle.partitions"))
    laid = records.repartition(n, "file").sortWithinPartitions("file", "played_at").select("file", "record")
    return folder, sorted(r["uri"] for r in laid.mapInArrow(_export(folder, zipped), "uri string").collect())  # a row for each file


def _archived(w: Warehouse) -> DataFrame:
    return history.archive_plays(history.archive_entries(w.spark, exported(w, True)[1]))


def _imported(w: Warehouse) -> DataFrame:
    plays = w["plays_landed"].where("source = 'recent'").select(*(f.split()[0] for f in streams.PLAYS.split(", ")))
    return history.import_plays(plays, _archived(w), w["tracks"], 9)[0]


def _objects(w: Warehouse, kind: str, rows: DataFrame) -> DataFrame:
    """Rows landed as JSON lines and read again under the kind's schema."""
    folder = _folder(w, kind)
    rows.write.option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss").json(folder)
    return landed.landed(w.spark, folder, kind)


def _tracks(w: Warehouse) -> DataFrame:
    credits = w["track_artists"].join(w["artists"].select(F.col("id").alias("artist_id"), "name"), "artist_id").groupBy("track_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", F.col("artist_id").alias("id"), "name"))), lambda x: F.struct(x["id"].alias("id"), x["name"].alias("name"))).alias("artists"))
    t = w["tracks_landed"].join(credits, F.col("id") == F.col("track_id"), "left")
    named = lambda inner, name: F.struct(F.col(inner).alias(name))
    plain = ["id", "name", "duration_ms", "disc_number", "track_number", "popularity", "is_local"]
    track = F.struct(*plain, F.when(F.col("explicit"), F.lit(True)).alias("explicit"), named("isrc", "isrc").alias("external_ids"), named("linked_from_id", "id").alias("linked_from"), named("album_id", "id").alias("album"), "artists", F.concat(F.lit("spotify:track:"), "id").alias("uri"))
    return _objects(w, "saved_tracks", t.select(F.lit("2024-01-01T00:00:00").alias("added_at"), track.alias("track")))


def _albums(w: Warehouse) -> DataFrame:
    a = w["albums_landed"]
    album = F.struct("id", "name", "album_type", "release_date", "release_date_precision", "total_tracks", "label", "popularity", F.split("markets", ",").alias("available_markets"))
    return landed.flat_albums(_objects(w, "albums", a.select(album.alias("album"))))


def _recordings(w: Warehouse) -> DataFrame:
    one = F.struct(F.col("mbid").alias("id"), "title", F.col("length_ms").alias("length"), F.col("first_release_date").alias("first-release-date"))
    codes = w["isrc_recordings"].select("isrc", F.col("recording_mbid").alias("mbid")).join(w["mb_recordings"], "mbid")
    return landed.flat_recordings(_objects(w, "recordings", codes.groupBy("isrc").agg(F.collect_list(one).alias("recordings"))))


def _audio(w: Warehouse) -> DataFrame:
    a = w["audio_features"]
    low = F.to_json(F.struct(F.struct("bpm").alias("rhythm"), F.struct("key_key", "key_scale").alias("tonal")))
    high = F.to_json(F.struct(F.struct(F.struct(F.struct("happy").alias("all"), F.lit("happy").alias("value")).alias("mood_happy")).alias("models")))
    known = a.where("status = 'ok'").select(F.col("recording_mbid").alias("mbid"), low.alias("low"), F.get_json_object(high, "$.models").alias("high"))
    return landed.audio_features(a, _objects(w, "audio", known)).select("recording_mbid", "status", "bpm", "key_key", "key_scale", "happy")


def _once(w: Warehouse) -> DataFrame:
    """Polled items that are delivered twice, as a stream that lets each through once."""
    folder = _folder(w, "deliveries")
    items = w["plays_landed"].where("source = 'recent'").select(F.date_trunc("second", F.col("played_at")).cast("timestamp_ntz").alias("played_at"), "item_uri")
    items.union(items).write.parquet(f"{folder}/landing")
    stream = streams.unseen(w.spark.readStream.schema(items.schema).parquet(f"{folder}/landing"))
    stream.writeStream.format("parquet").option("path", f"{folder}/seen").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return w.spark.read.schema(items.schema).parquet(f"{folder}/seen")


def _collections(w: Warehouse, now) -> DataFrame:
    """Collections after one is made, one is changed, one loses a genre and one goes."""
    names = ("genre_collections", "genre_collection_genres")
    t = {n: w[n] for n in names}
    _, made = genres.create_collection(t, "Some", now, ["blue", "red", "blue"])
    t |= made
    t |= genres.remove_genre(t, "some", "widget", now)
    t |= {names[0]: genres.update_collection(t, "both", {"name": "All of them", "match": "any", "id": "ignored"}, now)}
    t |= genres.delete_collection(t, "odd")
    held = t[names[1]].groupBy(F.col("collection_id").alias("id")).agg(F.array_sort(F.collect_list("genre")).alias("genres"))
    return t[names[0]].join(held, "id", "left").select("id", "name", "match", (F.col("updated_at") == F.lit(now)).alias("touched"), "genres")


def _pushes(w: Warehouse) -> DataFrame:
    number = F.col("id").cast("long")
    print_, stored = F.md5("name"), F.when(number % 2 == 0, F.md5("name")).when(number % 3 == 0, F.md5("id"))
    rows = w["playlists"].select("id", F.col("total_tracks").alias("tracks"), print_.alias("fingerprint"), stored.alias("synced_fingerprint"), F.col("items_synced_snapshot_id").alias("synced_snapshot_id"), "snapshot_id")
    return merge.push_decisions(rows).select("id", "decision")


def _lines(w: Warehouse) -> DataFrame:
    answer = adhoc.run(w.spark, w, ["nation", "region"], ADHOC, limit=20)
    head = ", ".join(f"{n} {t}" for n, t in answer.columns)
    return w.spark.createDataFrame([(k, line, head, answer.more) for k, line in enumerate(answer.rows)], "place long, line string, head string, more boolean")


#: Statements that call the functions which statements have besides Spark's own: tables, statement, columns, DuckDB's SQL.
STATEMENTS = {
    "adhoc_norm_title": (["tracks_landed"], "select id, norm_title(name) as plain from tracks_landed", "id plain", f"SELECT id, {oracle.title('name')} AS plain FROM {{tracks_landed}}"),
    "adhoc_norm_name": (["artists"], "select id, norm_name(name) as plain from artists where norm_name(name) <> ''", "id plain", f"SELECT id, {oracle.name('name')} AS plain FROM {{artists}} WHERE {oracle.name('name')} <> ''"),
    "adhoc_fallback_key": (
        ["tracks_landed", "track_artists"],
        "with listed as (select track_id, array_sort(collect_list(artist_id)) as ids from track_artists group by track_id) select id, fallback_key(name, duration_ms, ids, id) as key from tracks_landed left join listed on track_id = id", "id key",
        f"""SELECT id, 'fb:' || substr(sha256(CASE WHEN {oracle.title('name')} = '' THEN 'id:' || id ELSE {oracle.title('name')} || '|' || (coalesce(duration_ms, 0) // 5000) || '|' || coalesce(ids, '') END), 1, 24) AS key
            FROM {{tracks_landed}} LEFT JOIN (SELECT track_id, string_agg(artist_id, ',' ORDER BY artist_id) AS ids FROM {{track_artists}} GROUP BY 1) ON track_id = id""",
    ),
    "adhoc_release_date": (["albums_landed"], "select year(parse_release_date(release_date)) as released, count(*) as n from albums_landed group by 1", "released# n#", f"SELECT year({oracle.ragged('release_date')}) AS released, count(*) AS n FROM {{albums_landed}} GROUP BY 1"),
    "adhoc_completion": (["plays_landed"], "select item_uri, count_if(ms_played >= play_completion_ms()) as completed from plays_landed group by item_uri", "item_uri completed#", "SELECT item_uri, count(*) FILTER (ms_played >= 30000) AS completed FROM {plays_landed} GROUP BY 1"),
    "adhoc_genre_list": (
        ["mb_recordings", "mb_tags", "mb_genres"], "select mbid, array_join(mb_genre_list('recording', mbid), ',') as genres from mb_recordings", "mbid genres",
        """SELECT mbid, genres FROM {mb_recordings} LEFT JOIN (SELECT entity_mbid, string_agg(tag, ',' ORDER BY count DESC, tag) AS genres FROM {mb_tags} WHERE entity_type = 'recording' AND (is_genre OR tag IN (SELECT name FROM {mb_genres})) GROUP BY 1) ON entity_mbid = mbid""",
    ),
}


def _catalog(w: Warehouse) -> DataFrame:
    told = adhoc.describe(w, ["nation", "customer", "albums_landed"])
    return w.spark.createDataFrame([(x["table"], len(x["columns"]), x["columns"][0]["name"], x["rows"]) for x in told], "name string, columns long, first string, rows long")


def register(add: Callable, window: Callable, HIST, NOW) -> None:
    linked = """coalesce(d.id, r.id) AS track_id FROM (SELECT *, CASE WHEN item_kind = 'track' THEN nullif(regexp_extract(item_uri, 'spotify:track:(.+)$', 1), '') END AS raw_id FROM {0}) p
          LEFT JOIN {{tracks}} d ON d.id = raw_id LEFT JOIN (SELECT linked_from_id, min(id) AS id FROM {{tracks}} WHERE linked_from_id IS NOT NULL GROUP BY 1) r ON r.linked_from_id = raw_id"""
    add("s1_archive_entries", lambda w: history.archive_entries(w.spark, exported(w, True, whole=True)[1]).groupBy("entry").agg(F.count("*").alias("n"), F.min("size").cast("boolean").alias("filled")), "entry n# filled", """
        SELECT 'ReadMe.txt' AS entry, count(DISTINCT CAST(played_at AS DATE)) AS n, TRUE AS filled FROM {plays_landed} WHERE source = 'extended'
        UNION ALL SELECT DISTINCT 'My Data/Streaming_History_Audio_' || CAST(CAST(played_at AS DATE) AS VARCHAR) || '.json', 1, TRUE FROM {plays_landed} WHERE source = 'extended'""")
    shown = "CAST(played_at AS VARCHAR) AS played_at, ms_played, item_kind, item_uri, track_name, platform, shuffle"
    for name, rows in (("s2_archive_plays", _archived), ("s3_folder_plays", lambda w: history.folder_plays(w.spark, exported(w, False)[0]))):
        add(name, lambda w, rows=rows: rows(w).select("played_at", "ms_played", "item_kind", "item_uri", "track_name", "platform", "shuffle"), "played_at ms_played# item_kind item_uri track_name platform shuffle", f"SELECT {shown} FROM {{plays_landed}} WHERE source = 'extended'")
    add("r3_imported_log", lambda w: _imported(w).select("played_at", "ms_played", "item_uri", "source", "track_id"), "played_at ms_played# item_uri source track_id", f"""
        SELECT CAST(played_at AS VARCHAR) AS played_at, ms_played, item_uri, source, {linked.format("(SELECT DISTINCT played_at, ms_played, item_uri, item_kind, source FROM {plays_landed} WHERE source = 'extended')")}
        UNION ALL SELECT CAST(played_at AS VARCHAR), ms_played, item_uri, source, {linked.format("(SELECT * RENAME (track_id AS told_id) FROM {plays_landed} WHERE source = 'recent' AND NOT played_at BETWEEN (SELECT min(played_at) FROM {plays_landed} WHERE source = 'extended') AND (SELECT max(played_at) FROM {plays_landed} WHERE source = 'extended'))").replace("coalesce(d.id", "coalesce(told_id, d.id")}""")
    add("s5_landed_tracks", lambda w: landed.flat_tracks(_tracks(w)), "id name album_id duration_ms# disc_number# track_number# explicit popularity# isrc is_local linked_from_id uri detail_level", "SELECT id, name, album_id, duration_ms, disc_number, track_number, coalesce(explicit, FALSE) AS explicit, popularity, isrc, is_local, linked_from_id, 'spotify:track:' || id AS uri, 'full' AS detail_level FROM {tracks_landed}")
    add("s5_landed_credits", lambda w: landed.flat_credits(_tracks(w)), "track_id artist_id position#", "SELECT track_id, artist_id, row_number() OVER (PARTITION BY track_id ORDER BY position) - 1 AS position FROM {track_artists} WHERE artist_id IN (SELECT id FROM {artists}) AND track_id IN (SELECT id FROM {tracks_landed})")
    add("s5_landed_albums", _albums, "id name album_type release_date release_date_precision total_tracks# label popularity# upc available_markets detail_level", "SELECT id, name, album_type, release_date, release_date_precision, total_tracks, label, popularity, upc, markets AS available_markets, 'full' AS detail_level FROM {albums_landed}")
    add("s6_landed_recordings", _recordings, "isrc mbid title length_ms# first_release_date", "SELECT isrc, mbid, title, length_ms, first_release_date FROM {isrc_recordings} JOIN {mb_recordings} ON mbid = recording_mbid")
    add("s7_landed_audio", _audio, "recording_mbid status bpm~ key_key key_scale happy~", "SELECT recording_mbid, status, CASE WHEN status = 'ok' THEN bpm END AS bpm, CASE WHEN status = 'ok' THEN key_key END AS key_key, CASE WHEN status = 'ok' THEN key_scale END AS key_scale, CASE WHEN status = 'ok' THEN happy END AS happy FROM {audio_features}")
    add("s11_parallel_arrays", lambda w: common.parallel_rows(w["part"].select("p_partkey", F.split("p_name", " ").alias("word"), F.split("p_brand", "#").alias("piece")), "word", "piece"), "p_partkey# word piece", "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word, unnest(string_split(p_brand, '#')) AS piece FROM {part}")
    add("s12_catalog", _catalog, "name columns# first rows#", "SELECT 'nation' AS name, 3 AS columns, 'n_nationkey' AS first, count(*) AS rows FROM {nation} UNION ALL SELECT 'customer', 5, 'c_custkey', count(*) FROM {customer} UNION ALL SELECT 'albums_landed', 12, 'id', count(*) FROM {albums_landed}")
    add("k14_push_decisions", _pushes, "id decision", """
        SELECT id, CASE WHEN total_tracks = 0 THEN 'refuse' WHEN CAST(id AS BIGINT) % 2 = 0 AND items_synced_snapshot_id IS NOT DISTINCT FROM snapshot_id THEN 'skip' ELSE 'write' END AS decision FROM {playlists}""")
    add("k16_json_lines", _lines, "place# line head more", """
        SELECT n_nationkey AS place, '{{"name":"' || n_name || '","name_2":"' || r_name || '","n_nationkey":' || n_nationkey || CASE WHEN n_nationkey > 3 THEN ',"note":"' || upper(n_name) || '"' ELSE '' END || '}}' AS line,
          'name string, name_2 string, n_nationkey ' || CASE typeof(n_nationkey) WHEN 'BIGINT' THEN 'bigint' ELSE 'int' END || ', note string' AS head, TRUE AS more
        FROM {nation} JOIN {region} ON r_regionkey = n_regionkey WHERE n_nationkey < 20""")
    for name, (tables, asked, columns, sql) in STATEMENTS.items():
        add(name, lambda w, tables=tables, asked=asked: adhoc.frame(w.spark, w, tables, asked), columns, sql)
    add("g12_collection_changes", lambda w: _collections(w, NOW), "id name match touched genres", "SELECT * FROM (VALUES ('some', 'Some', 'any', TRUE, 'red'), ('both', 'All of them', 'any', TRUE, 'red,widget'), ('none', 'None', 'any', FALSE, NULL), ('some-2', 'Some', 'any', TRUE, 'blue,red')) AS v(id, name, match, touched, genres)")
    add("r2_unseen_once", _once, "played_at item_uri", "SELECT DISTINCT CAST(date_trunc('second', played_at) AS VARCHAR) AS played_at, item_uri FROM {plays_landed} WHERE source = 'recent'")
    add("r8_new_since", lambda w: streams.new_since(w["saved_tracks"], HIST.start.replace(year=1998)).select("track_id"), "track_id", f"SELECT track_id FROM {{saved_tracks}} WHERE added_at > TIMESTAMP '{HIST.start.replace(year=1998)}'")
    add("c12_figures", lambda w: charts.history_figures(listening.listening_by_month(w, HIST), listening.listening_totals(w, HIST))[1].crossJoin(F.broadcast(charts.resolved_share(listening.coverage(w)))), "hours_a_day~ resolved_share~", f"""
        SELECT (SELECT coalesce(sum(coalesce(ms_played, estimated_ms)), 0) / 3600000.0::DOUBLE / count(DISTINCT CAST(timezone('Europe/Stockholm', played_at AT TIME ZONE 'UTC') AS DATE)) FROM {{plays}} WHERE {window("played_at", HIST)}) AS hours_a_day, (SELECT count(track_id) / count(*)::DOUBLE FROM {{plays}}) AS resolved_share""")
    add("c14_added_genres", lambda w: charts.added_genres(_two_lists(w), "own", "other").select("id", "added"), "id added", """
        SELECT s_suppkey::VARCHAR AS id, array_to_string(list_sort(list_filter(list_distinct([lower(r_name), 'jazz', lower(n_name)]), lambda x: x <> lower(r_name))), ',') AS added FROM {supplier} JOIN {nation} ON n_nationkey = s_nationkey JOIN {region} ON r_regionkey = n_regionkey""")
    forms = "CASE CAST(id AS BIGINT) % 5 WHEN 0 THEN 'spotify:track:' || id WHEN 1 THEN 'https://open.spotify.com/intl-de/album/' || id || '?si=1' WHEN 2 THEN 'http://open.spotify.com/playlist/' || id WHEN 3 THEN 'spotify:show:' || id ELSE id END"
    add("f_link_target_forms", lambda w: w["tracks_landed"].select("id", text.link_target(F.expr(forms)).alias("target")).select(F.col("id").alias("of"), F.col("target.kind").alias("kind"), F.col("target.id").alias("id")), "of kind id", "SELECT id AS of, CASE CAST(id AS BIGINT) % 5 WHEN 0 THEN 'track' WHEN 1 THEN 'album' WHEN 2 THEN 'playlist' END AS kind, CASE WHEN CAST(id AS BIGINT) % 5 < 3 THEN id END AS id FROM {tracks_landed}")


def _two_lists(w: Warehouse) -> DataFrame:
    s = w["supplier"].join(w["nation"], F.col("n_nationkey") == F.col("s_nationkey")).join(w["region"], F.col("r_regionkey") == F.col("n_regionkey"))
    return s.select(F.col("s_suppkey").cast("string").alias("id"), F.array(F.lower("r_name")).alias("own"), F.array(F.upper("r_name"), F.lit("Jazz"), "n_name", F.lit("jazz")).alias("other"))

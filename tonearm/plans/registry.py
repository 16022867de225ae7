"""The named queries over the driver's tables, each with the DuckDB statement it is held against."""

from __future__ import annotations

import uuid
from collections import ChainMap
from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import music, text
from ..operators import bitmaps, charts, derive, enrichment, entities, genres, library, listening, merge, work
from ..sources.shared import shared_dir
from ..streaming import plays as streams
from . import landing, upkeep
from .adhoc import distinct_names
from .oracle import DEVICE, HEARD, ZONE, iso, name, ragged, statement, title, wall, whole
from .range import EARLIEST, Range, midnight
from .warehouse import Warehouse, heard_plays, library_dates, raw_plays, warehouse

LIB = Range(midnight("1996-03-15", ZONE), midnight("2000-06-30", ZONE, 1), ZONE)
HIST = Range(midnight("2024-01-03", ZONE), midnight("2024-01-27", ZONE, 1), ZONE)
TODAY, NOW = date(2000, 7, 1), datetime(2001, 1, 1)
GENRE, PICKED = "red", ["red", "widget"]
RECORDING, ARTIST, ALBUM, PLAYLIST, EDITION, RELEASED = "isrc:Brand#9-50", "8", "Brand#1/1", "11", "solo/1444", "solo/291"

Query = Callable[[Warehouse], DataFrame]
_ENTRIES: dict[str, tuple[Query, str | None]] = {}


def flat(df: DataFrame) -> DataFrame:
    """Lists as text, whole numbers as longs, days and instants as text: what two engines can be compared by."""

    def shown(f: T.StructField):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.ArrayType):
            item = f.dataType.elementType
            one = (lambda s: F.concat_ws(":", *(s[n] for n in item.names))) if isinstance(item, T.StructType) else (lambda s: s.cast("string"))
            return F.array_join(F.transform(c, one), ",").alias(f.name)
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            return c.cast("long").alias(f.name)
        if isinstance(f.dataType, T.DecimalType):
            return c.cast("double").alias(f.name)
        if isinstance(f.dataType, (T.DateType, T.TimestampNTZType, T.TimestampType)):
            return c.cast("string").alias(f.name)
        return c

    return df.select(*map(shown, df.schema.fields))


def add(key: str, query: Query, columns: str = "", sql: str | None = None) -> None:
    _ENTRIES[key] = (query, statement(sql, columns) if sql else None)


def again(key: str, other: str, query: Query) -> None:
    """A query that gives the rows of another by other means, held against the same statement."""
    _ENTRIES[key] = (query, _ENTRIES[other][1])


def _since(w: Warehouse) -> ChainMap:
    """The warehouse for queries that ask of the library only which recordings it has, and since when."""
    return ChainMap({"library_canonical": library_dates(w)}, w)


def window(column: str, r: Range) -> str:
    return f"{column} >= TIMESTAMP '{r.start}' AND {column} < TIMESTAMP '{r.end}'"


L = window("first_added_at", LIB)
P = window("played_at", HIST)
ADDED, PLAYED = wall("first_added_at"), wall("played_at")
PLAYS_R = "{plays} p JOIN {tracks} t ON t.id = p.track_id"
BACK = Range(datetime(LIB.start.year - 1, LIB.start.month, LIB.start.day, LIB.start.hour), LIB.end, ZONE)
MONTHS = "SELECT unnest(generate_series(date_trunc('month', {lo}), date_trunc('month', {hi}), INTERVAL 1 MONTH)) AS m"


def spine(r: Range) -> str:
    return MONTHS.format(lo=f"DATE '{r.local_day('start')}'", hi=f"DATE '{r.local_day('end')}'")


def ranks(yearly: str, r: Range, extra: str = "") -> str:
    return f"""
        SELECT y.yr AS period, y.artist_id AS key, name AS label, place AS rank, y.n AS value, y.n - coalesce(b.n, 0) AS delta
        FROM (SELECT *, row_number() OVER (PARTITION BY yr ORDER BY n DESC, artist_id) AS place FROM ({yearly})) y LEFT JOIN ({yearly}) b ON b.artist_id = y.artist_id AND b.yr = y.yr - 1 JOIN {{artists}} a ON a.id = y.artist_id
        WHERE place <= 10 AND y.yr >= {r.local_day("start").year} {extra}"""


def streak(days: str, busiest: str, active: str = "") -> str:
    return f"""
        SELECT coalesce(max(run), 0) AS longest, CAST(arg_max(ended, run * 100000 + (ended - DATE '1970-01-01')) AS VARCHAR) AS longest_end, coalesce(arg_max(run, ended) FILTER (ended >= DATE '{TODAY}' - 1), 0) AS current,
          any_value(busiest_day) AS busiest_day, coalesce(any_value(most), 0) AS {busiest} {active}
        FROM (SELECT count(*) AS run, max(d) AS ended, any_value(busiest_day) AS busiest_day, any_value(most) AS most, any_value(days) AS days
          FROM (SELECT d, d - CAST(row_number() OVER (ORDER BY d) AS INT) AS island, CAST(arg_max(d, n * 100000 + (d - DATE '1970-01-01')) OVER () AS VARCHAR) AS busiest_day, max(n) OVER () AS most, count(*) OVER () AS days FROM ({days})) GROUP BY island)"""


def register() -> None:
    # --- the library dashboard
    add("q01_totals", lambda w: library.totals(w, LIB), "recordings# copies# duration_ms# artists# albums# liked_share~ explicit_share~ first_added last_added", f"""
        SELECT count(*) AS recordings, sum(copy_count_in_library) AS copies, sum(duration_ms) AS duration_ms, count(DISTINCT primary_artist_id) AS artists,
          count(DISTINCT primary_album_id) FILTER (primary_album_id IN (SELECT id FROM {{albums}} WHERE album_type IS DISTINCT FROM 'compilation')) AS albums,
          avg(CASE WHEN liked THEN 1.0::DOUBLE ELSE 0 END) AS liked_share, avg(CASE WHEN explicit THEN 1.0::DOUBLE ELSE 0 END) AS explicit_share, {iso('min(first_added_at)')} AS first_added, {iso('max(first_added_at)')} AS last_added
        FROM {{library_canonical}} WHERE {L}""")
    add("q02_additions_by_day", lambda w: library.additions_by_day(_since(w), LIB), "day value#", f"SELECT CAST(CAST({ADDED} AS DATE) AS VARCHAR) AS day, count(*) AS value FROM {{library_canonical}} WHERE {L} GROUP BY 1")
    add("q03_growth", lambda w: library.growth(_since(w), LIB), "period added# cumulative#", f"""
        SELECT strftime(m, '%Y-%m') AS period, coalesce(n, 0) AS added, sum(coalesce(n, 0)) OVER (ORDER BY m) + (SELECT count(*) FROM {{library_canonical}} WHERE first_added_at < TIMESTAMP '{LIB.start}') AS cumulative
        FROM ({spine(LIB)}) s LEFT JOIN (SELECT date_trunc('month', {ADDED}) AS m, count(*) AS n FROM {{library_canonical}} WHERE {L} GROUP BY 1) a USING (m)""")
    yearly = f"SELECT year({ADDED}) AS yr, artist_id, count(*) AS n FROM {{library_canonical}} JOIN {{canonical_track_artists}} USING (canonical_track_id) WHERE on_representative AND position = 0 AND {window('first_added_at', BACK)} GROUP BY 1, 2"
    add("q04_top_artists_by_year", lambda w: library.top_artists_by_year(w, LIB), "period# key label rank# value# delta#", ranks(yearly, LIB))
    add("q05_top_artists", lambda w: library.top_artists(w, LIB), "id name tracks# albums#", f"""
        SELECT a.id, name, count(DISTINCT canonical_track_id) AS tracks, count(DISTINCT al.id) AS albums FROM {{library_canonical}} l JOIN {{canonical_track_artists}} c USING (canonical_track_id) JOIN {{artists}} a ON a.id = c.artist_id
          LEFT JOIN (SELECT id FROM {{albums}} WHERE album_type IS DISTINCT FROM 'compilation') al ON al.id = primary_album_id WHERE on_representative AND {L} GROUP BY 1, 2 ORDER BY tracks DESC, name, a.id LIMIT 25""")
    for strict in (False, True):
        by = "saved" if strict else "pct"
        add(f"q06_album_completion{'_strict' if strict else ''}", lambda w, s=strict, b=by: library.album_completion(w, LIB, strict=s, order_by=b), "id name artist total_tracks# saved# pct~", f"""
            SELECT g.*, artist FROM (SELECT al.id, al.name, total_tracks, count(DISTINCT canonical_track_id) AS saved, round(count(DISTINCT canonical_track_id)::DOUBLE / total_tracks, 4) AS pct
              FROM {{library_canonical}} l JOIN {{tracks}} t USING (canonical_track_id) JOIN {{albums}} al ON al.id = t.album_id WHERE album_type IS DISTINCT FROM 'compilation' AND album_type IS DISTINCT FROM 'single' AND {L}
                {"AND t.id IN (SELECT track_id FROM {library_tracks})" if strict else ""} GROUP BY 1, 2, 3 HAVING total_tracks >= 5 AND count(DISTINCT canonical_track_id) <= total_tracks) g
            LEFT JOIN {{album_credit_names}} n ON n.album_id = g.id ORDER BY {"saved DESC, pct DESC" if strict else "pct DESC, saved DESC"}, g.id LIMIT 30""")
    add("q07_top_playlists", lambda w: library.top_playlists(w, LIB), "id name is_owned tracks# in_library#", f"""
        SELECT p.id, name, is_owned, count(*) AS tracks, count(l.track_id) AS in_library FROM {{playlists}} p JOIN {{playlist_tracks}} i ON i.playlist_id = p.id LEFT JOIN {{library_tracks}} l ON l.track_id = i.track_id
        WHERE removed_at IS NULL AND {window('added_at', LIB)} GROUP BY 1, 2, 3 ORDER BY tracks DESC, name, p.id LIMIT 10""")
    whole_time = Range(LIB.start, LIB.end, ZONE, "all", True)
    add("q07_top_playlists_all_time", lambda w: library.top_playlists(w, whole_time), "id name is_owned tracks# in_library#", """
        SELECT p.id, name, is_owned, count(*) AS tracks, count(l.track_id) AS in_library FROM {playlists} p JOIN {playlist_tracks} i ON i.playlist_id = p.id LEFT JOIN {library_tracks} l ON l.track_id = i.track_id
        WHERE removed_at IS NULL GROUP BY 1, 2, 3 ORDER BY tracks DESC, name, p.id LIMIT 10""")
    add("q08_top_labels", lambda w: library.top_labels(w, LIB), "label tracks# albums#", f"""
        SELECT label, count(DISTINCT canonical_track_id) AS tracks, count(DISTINCT al.id) AS albums FROM {{library_canonical}} JOIN {{tracks}} t USING (canonical_track_id) JOIN {{albums}} al ON al.id = t.album_id
        WHERE label IS NOT NULL AND album_type IS DISTINCT FROM 'compilation' AND {L} GROUP BY 1 ORDER BY tracks DESC, label LIMIT 15""")
    add("q09_recent_additions", lambda w: library.recent_additions(w, LIB), "canonical_track_id title added_at liked album_id album_name cover artists", f"""
        SELECT canonical_track_id, title, {iso('first_added_at')} AS added_at, liked, r.album_id, album_name, cover, artists FROM {{library_rows}} r LEFT JOIN {{covers}} c ON c.album_id = r.primary_album_id WHERE {L} ORDER BY first_added_at DESC, title, canonical_track_id LIMIT 12""")
    add("q10_release_years", lambda w: library.release_years(w, LIB), "bucket# count#", f"SELECT year(earliest_release_date) AS bucket, count(*) AS count FROM {{library_rows}} WHERE earliest_release_date IS NOT NULL AND {L} GROUP BY 1")
    add("q11_track_durations", lambda w: library.track_durations(w, LIB), "bucket# count#", f"SELECT duration_ms // 30000 * 30 AS bucket, count(*) AS count FROM {{library_canonical}} WHERE duration_ms BETWEEN 1 AND 1800000 AND {L} GROUP BY 1")
    add("q12_add_time_heatmap", lambda w: library.add_time_heatmap(_since(w), LIB), "weekday# hour# count#", f"SELECT isodow({ADDED}) AS weekday, hour({ADDED}) AS hour, count(*) AS count FROM {{library_canonical}} WHERE {L} GROUP BY 1, 2")
    add("q13_discovery_lag", lambda w: library.discovery_lag(w, LIB), "year# median_days# p25# p75# n#", f"""
        SELECT year, round_even(quantile_cont(days, 0.5), 0) AS median_days, round_even(quantile_cont(days, 0.25), 0) AS p25, round_even(quantile_cont(days, 0.75), 0) AS p75, count(*) AS n
        FROM (SELECT year({ADDED}) AS year, CAST({ADDED} AS DATE) - earliest_release_date AS days FROM {{library_rows}} WHERE earliest_release_date IS NOT NULL AND {L}) WHERE days >= 0 GROUP BY 1""")
    add("q14_new_vs_deepening", lambda w: library.new_vs_deepening(w, LIB), "period new_artists# existing#", f"""
        SELECT strftime({ADDED}, '%Y-%m') AS period, count(*) FILTER (date_trunc('month', {ADDED}) = date_trunc('month', {wall('first_seen')})) AS new_artists, count(*) FILTER (date_trunc('month', {ADDED}) <> date_trunc('month', {wall('first_seen')})) AS existing
        FROM (SELECT *, min(first_added_at) OVER (PARTITION BY primary_artist_id) AS first_seen FROM {{library_canonical}} WHERE primary_artist_id IS NOT NULL) WHERE {L} GROUP BY 1""")
    add("q15_duplicates", lambda w: library.duplicates(w, LIB), "canonical_track_id title artist artist_id copies# names", f"""
        SELECT r.canonical_track_id, r.title, artist, CASE WHEN artist IS NOT NULL THEN primary_artist_id END AS artist_id, copy_count AS copies, names FROM {{library_rows}} r
          JOIN (SELECT canonical_track_id, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM {{tracks}} GROUP BY 1) n USING (canonical_track_id) WHERE copy_count > 1 AND {L} ORDER BY copies DESC, title, canonical_track_id LIMIT 20""")
    add("q16_streaks", lambda w: library.streaks(_since(w), LIB, TODAY), "longest# longest_end current# busiest_day busiest_count# active_days#", streak(f"SELECT CAST({ADDED} AS DATE) AS d, count(*) AS n FROM {{library_canonical}} WHERE {L} GROUP BY 1", "busiest_count", ", coalesce(any_value(days), 0) AS active_days"))
    add("q17_popularity_distribution", lambda w: library.popularity_distribution(w, LIB), "bucket# count#", f"SELECT max_popularity // 5 * 5 AS bucket, count(*) AS count FROM {{library_rows}} WHERE max_popularity IS NOT NULL AND {L} GROUP BY 1")

    # --- listening
    add("p1_listening_totals", lambda w: listening.listening_totals(w, HIST), "plays# ms_played# completed# skipped# recordings# albums# active_days# span_days# in_library_plays# first_played last_played artists#", f"""
        SELECT count(*) AS plays, sum({HEARD}) AS ms_played, count(*) FILTER ({HEARD} >= 30000) AS completed, count(*) FILTER ({HEARD} < 30000) AS skipped, count(DISTINCT t.canonical_track_id) AS recordings, count(DISTINCT c.primary_album_id) AS albums,
          count(DISTINCT CAST({PLAYED} AS DATE)) AS active_days, {(HIST.end - HIST.start).days} AS span_days, count(l.canonical_track_id) AS in_library_plays, {iso('min(played_at)')} AS first_played, {iso('max(played_at)')} AS last_played,
          (SELECT count(DISTINCT artist_id) FROM {PLAYS_R} JOIN {{canonical_track_artists}} x ON x.canonical_track_id = t.canonical_track_id WHERE on_representative AND {P}) AS artists
        FROM {{plays}} p LEFT JOIN {{tracks}} t ON t.id = p.track_id LEFT JOIN {{canonical_tracks}} c ON c.id = t.canonical_track_id LEFT JOIN {{library_canonical}} l ON l.canonical_track_id = c.id WHERE {P}""")
    add("p2_minutes_by_day", lambda w: listening.minutes_by_day(w, HIST), "day value#", f"SELECT CAST(CAST({PLAYED} AS DATE) AS VARCHAR) AS day, {whole(HEARD)} AS value FROM {{plays}} WHERE {P} GROUP BY 1 HAVING sum({HEARD}) > 0")
    add("p3_listening_by_month", lambda w: listening.listening_by_month(w, HIST), "period minutes# plays# library_minutes#", f"""
        SELECT strftime(m, '%Y-%m') AS period, coalesce(minutes, 0) AS minutes, coalesce(plays, 0) AS plays, coalesce(library_minutes, 0) AS library_minutes FROM ({spine(HIST)}) s LEFT JOIN
          (SELECT date_trunc('month', {PLAYED}) AS m, {whole(HEARD)} AS minutes, count(*) AS plays, {whole(f'CASE WHEN l.canonical_track_id IS NOT NULL THEN {HEARD} END')} AS library_minutes
           FROM {{plays}} p LEFT JOIN {{tracks}} t ON t.id = p.track_id LEFT JOIN {{library_canonical}} l ON l.canonical_track_id = t.canonical_track_id WHERE {P} GROUP BY 1) USING (m)""")
    add("p4_listening_clock", lambda w: listening.listening_clock(w, HIST), "weekday# hour# minutes#", f"SELECT isodow({PLAYED}) AS weekday, hour({PLAYED}) AS hour, {whole(HEARD)} AS minutes FROM {{plays}} WHERE {P} GROUP BY 1, 2")
    add("p5_device_share", lambda w: listening.device_share({"plays": heard_plays(w)}, HIST), "label value#", f"SELECT {DEVICE} AS label, {whole(HEARD)} AS value FROM {{plays}} WHERE {P} GROUP BY 1 HAVING sum({HEARD}) > 0")
    add("p6_country_share", lambda w: listening.country_share({"plays": heard_plays(w)}, HIST), "label value#", f"SELECT coalesce(nullif(conn_country, 'ZZ'), 'Unknown') AS label, {whole(HEARD)} AS value FROM {{plays}} WHERE {P} GROUP BY 1 HAVING sum({HEARD}) > 0 ORDER BY value DESC, label LIMIT 8")
    add("p7_end_reasons", lambda w: listening.end_reasons({"plays": raw_plays(w)}, HIST), "label value#", f"SELECT reason_end AS label, count(*) AS value FROM {{plays}} WHERE reason_end IS NOT NULL AND {P} GROUP BY 1 ORDER BY value DESC, label LIMIT 8")
    add("p8_completion_buckets", lambda w: listening.completion_buckets(w, HIST), "bucket# count#", f"SELECT least(10, {HEARD} * 10 // c.duration_ms) * 10 AS bucket, count(*) AS count FROM {PLAYS_R} JOIN {{canonical_tracks}} c ON c.id = t.canonical_track_id WHERE {HEARD} IS NOT NULL AND c.duration_ms > 0 AND {P} GROUP BY 1")
    for key, flag in (("", None), ("_in_library", True), ("_elsewhere", False)):
        side = {None: "", True: "AND l.canonical_track_id IS NOT NULL", False: "AND l.canonical_track_id IS NULL"}[flag]
        add(f"p9_top_played_tracks{key}", lambda w, f=flag: listening.top_played_tracks(w, HIST, in_library=f), "canonical_track_id title plays# completed# ms_played# last_played_at in_library cover artists", f"""
            SELECT g.*, cover, coalesce(artists, '') AS artists FROM (SELECT c.id AS canonical_track_id, c.title, c.primary_album_id, count(*) AS plays, count(*) FILTER ({HEARD} >= 30000) AS completed, coalesce(sum({HEARD}), 0) AS ms_played, {iso('max(played_at)')} AS last_played_at, bool_or(l.canonical_track_id IS NOT NULL) AS in_library
              FROM {PLAYS_R} JOIN {{canonical_tracks}} c ON c.id = t.canonical_track_id LEFT JOIN {{library_canonical}} l ON l.canonical_track_id = c.id WHERE {P} {side} GROUP BY 1, 2, 3) g
            LEFT JOIN {{covers}} v ON v.album_id = g.primary_album_id LEFT JOIN {{artist_names}} n ON n.canonical_track_id = g.canonical_track_id ORDER BY ms_played DESC, plays DESC, title, g.canonical_track_id LIMIT 20""")
    add("p10_top_played_artists", lambda w: listening.top_played_artists(w, HIST), "id name plays# ms_played# recordings#", f"""
        SELECT a.id, a.name, count(*) AS plays, coalesce(sum({HEARD}), 0) AS ms_played, count(DISTINCT t.canonical_track_id) AS recordings FROM {PLAYS_R} JOIN {{canonical_track_artists}} c ON c.canonical_track_id = t.canonical_track_id JOIN {{artists}} a ON a.id = c.artist_id
        WHERE on_representative AND {P} GROUP BY 1, 2 ORDER BY ms_played DESC, plays DESC, a.name, a.id LIMIT 20""")
    add("p11_top_played_albums", lambda w: listening.top_played_albums(w, HIST), "id name artist plays# ms_played# recordings#", f"""
        SELECT g.*, artist FROM (SELECT al.id, al.name, count(*) AS plays, coalesce(sum({HEARD}), 0) AS ms_played, count(DISTINCT c.id) AS recordings FROM {PLAYS_R} JOIN {{canonical_tracks}} c ON c.id = t.canonical_track_id JOIN {{albums}} al ON al.id = c.primary_album_id
          WHERE album_type IS DISTINCT FROM 'single' AND {P} GROUP BY 1, 2) g LEFT JOIN {{album_credit_names}} n ON n.album_id = g.id ORDER BY ms_played DESC, plays DESC, name, g.id LIMIT 15""")
    back = Range(datetime(2023, 1, 2, 23), HIST.end, ZONE)
    hours = f"SELECT year({PLAYED}) AS yr, artist_id, {whole(HEARD, '3600000.0')} AS n FROM {PLAYS_R} JOIN {{canonical_track_artists}} c ON c.canonical_track_id = t.canonical_track_id WHERE on_representative AND c.position = 0 AND {window('played_at', back)} GROUP BY 1, 2"
    add("p12_top_artists_by_year_played", lambda w: listening.top_artists_by_year_played(w, HIST), "period# key label rank# value# delta#", ranks(hours, HIST, "AND y.n > 0"))
    add("p13_discovery_vs_repeat", lambda w: listening.discovery_vs_repeat(w, HIST), "period first_time# revisited#", f"""
        SELECT strftime({PLAYED}, '%Y-%m') AS period, count(*) FILTER (date_trunc('month', {PLAYED}) = date_trunc('month', {wall('first')})) AS first_time, count(*) FILTER (date_trunc('month', {PLAYED}) <> date_trunc('month', {wall('first')})) AS revisited
        FROM (SELECT played_at, min(played_at) OVER (PARTITION BY t.canonical_track_id) AS first FROM {PLAYS_R} WHERE t.canonical_track_id IS NOT NULL) WHERE {P} GROUP BY 1""")
    add("p14_listening_streaks", lambda w: listening.listening_streaks(w, HIST, date(2024, 1, 28)), "longest# longest_end current# busiest_day busiest_minutes#", streak(f"SELECT CAST({PLAYED} AS DATE) AS d, {whole(HEARD)} AS n FROM {{plays}} WHERE {P} GROUP BY 1", "busiest_minutes").replace(str(TODAY), "2024-01-28"))
    for key, q in (("", ""), ("_search", "%")):
        found = "AND (coalesce(c.title, track_name, '') ILIKE '%WIDGET%' OR coalesce(a.name, artist_name) ILIKE '%widget%')" if q else ""
        add(f"p15_play_log{key}", lambda w, s="WIDGET" if q else "": listening.play_log(w, HIST, 50, 25, s), "total# id# played_at ms_played# estimated item_kind canonical_track_id title artist artist_id album platform reason_end shuffle source", f"""
            SELECT count(*) OVER () AS total, p.id, {iso('played_at')} AS played_at, {HEARD} AS ms_played, ms_played IS NULL AND estimated_ms IS NOT NULL AS estimated, item_kind, c.id AS canonical_track_id, coalesce(c.title, track_name, episode_name, '(unknown)') AS title,
              coalesce(a.name, artist_name) AS artist, a.id AS artist_id, coalesce(al.name, album_name, show_name) AS album, platform, reason_end, shuffle, source
            FROM {{plays}} p LEFT JOIN {{tracks}} t ON t.id = p.track_id LEFT JOIN {{canonical_tracks}} c ON c.id = t.canonical_track_id LEFT JOIN {{albums}} al ON al.id = c.primary_album_id LEFT JOIN {{artists}} a ON a.id = c.primary_artist_id
            WHERE {P} {found} ORDER BY p.played_at DESC, p.id DESC LIMIT 50 OFFSET 25""")
    add("p16_coverage", listening.coverage, "plays# resolved# pending# unresolvable# non_track# from_export# from_api# first_played last_played saved_never_played#", f"""
        SELECT count(*) AS plays, count(track_id) AS resolved, count(*) FILTER (track_id IS NULL AND item_kind = 'track' AND resolve_attempted_at IS NULL) AS pending, count(*) FILTER (track_id IS NULL AND item_kind = 'track' AND resolve_attempted_at IS NOT NULL) AS unresolvable,
          count(*) FILTER (item_kind <> 'track') AS non_track, count(*) FILTER (source = 'extended') AS from_export, count(*) FILTER (source = 'recent') AS from_api, {iso('min(played_at)')} AS first_played, {iso('max(played_at)')} AS last_played,
          (SELECT count(*) FROM {{library_canonical}} WHERE canonical_track_id NOT IN (SELECT canonical_track_id FROM {{canonical_play_stats}})) AS saved_never_played FROM {{plays}}""")

    # --- lists and pages
    add("e01_liked_tracks", lambda w: entities.liked_tracks(w, "plays", limit=40, offset=10, filters={"explicit": "no"}), "total# id name duration_ms# popularity# explicit added_at canonical_track_id copy_count# album_id album_name artists plays# ms_played#", f"""
        SELECT count(*) OVER () AS total, t.id, t.name, t.duration_ms, t.popularity, t.explicit, {iso('added_at')} AS added_at, t.canonical_track_id, copy_count, al.id AS album_id, al.name AS album_name, coalesce(artists, '') AS artists, coalesce(s.plays, 0) AS plays, coalesce(s.ms_played, 0) AS ms_played
        FROM {{saved_tracks}} v JOIN {{tracks}} t ON t.id = v.track_id LEFT JOIN {{canonical_tracks}} c ON c.id = t.canonical_track_id LEFT JOIN {{canonical_play_stats}} s ON s.canonical_track_id = c.id LEFT JOIN {{albums}} al ON al.id = t.album_id LEFT JOIN {{track_credit_names}} n ON n.track_id = t.id
        WHERE removed_at IS NULL AND NOT t.explicit ORDER BY plays DESC, t.id LIMIT 40 OFFSET 10""")
    # Pages and searches as a caller may send them: below the first page, beyond the last, no numbers, blank, far too long.
    sql = _ENTRIES["e01_liked_tracks"][1]
    for key, page, q, found in (("below", "-3", " " * 500, "LIMIT 50 OFFSET 0"), ("no_number", "two", None, "LIMIT 50 OFFSET 0"), ("third", 3, "  ", "LIMIT 50 OFFSET 100"), ("beyond", 10**12, "", "LIMIT 50 OFFSET 4999950"), ("long", 1, "x" * 500, "LIMIT 0")):
        _ENTRIES[f"f12_page_{key}"] = (lambda w, page=page, q=q: _liked_page(w, page, q), sql.replace("LIMIT 40 OFFSET 10", found))
    shown = f"canonical_track_id, representative_track_id, title, kind, duration_ms, max_popularity AS popularity, explicit, copy_count, copy_count_in_library, liked, {iso('first_added_at')} AS first_added_at, owned_playlist_count, album_id, album_name, artists, plays, ms_played, {iso('last_played_at')} AS last_played_at"
    add("e02_library_recordings", lambda w: entities.library_recordings(w, "lastPlayed", limit=30, q="widget", filters={"source": "playlist", "copies": "dupes", "played": "played"}), "total# canonical_track_id representative_track_id title kind duration_ms# popularity# explicit copy_count# copy_count_in_library# liked first_added_at owned_playlist_count# album_id album_name artists plays# ms_played# last_played_at", f"""
        SELECT count(*) OVER () AS total, {shown} FROM {{library_rows}} r WHERE (title ILIKE '%widget%' OR artist ILIKE '%widget%' OR album_name ILIKE '%widget%') AND owned_playlist_count > 0 AND copy_count > 1 AND plays > 0 ORDER BY r.last_played_at DESC NULLS LAST, canonical_track_id LIMIT 30""")
    add("e03_artist_index", lambda w: entities.artist_index(w, "plays", genre="asia", filters={"followed": "no"}), "total# id name popularity# followers_total# tracks# albums# duration_ms# genre followed plays# ms_played#", """
        SELECT count(*) OVER () AS total, g.*, coalesce(p.plays, 0) AS plays, coalesce(p.ms_played, 0) AS ms_played, (SELECT min(genre) FROM {artist_genres} x WHERE x.artist_id = g.id) AS genre
        FROM (SELECT a.id, a.name, a.popularity, a.followers_total, count(DISTINCT l.canonical_track_id) AS tracks, count(DISTINCT l.primary_album_id) AS albums, sum(l.duration_ms) AS duration_ms, bool_or(f.artist_id IS NOT NULL) AS followed
          FROM {artists} a JOIN {canonical_track_artists} c ON c.artist_id = a.id JOIN {library_canonical} l ON l.canonical_track_id = c.canonical_track_id LEFT JOIN {followed_artists} f ON f.artist_id = a.id AND f.removed_at IS NULL
          WHERE a.id IN (SELECT artist_id FROM {artist_genres} WHERE genre = 'asia') GROUP BY 1, 2, 3, 4 HAVING NOT bool_or(f.artist_id IS NOT NULL)) g
        LEFT JOIN (SELECT artist_id, sum(plays) AS plays, sum(ms_played) AS ms_played FROM {canonical_play_stats} s JOIN {canonical_track_artists} c USING (canonical_track_id) WHERE on_representative GROUP BY 1) p ON p.artist_id = g.id
        ORDER BY coalesce(p.plays, 0) DESC, name, id LIMIT 50""")
    add("e04_library_genres", entities.library_genres, "genre artists#", "SELECT genre, count(DISTINCT g.artist_id) AS artists FROM {artist_genres} g JOIN {canonical_track_artists} c ON c.artist_id = g.artist_id JOIN {library_canonical} l USING (canonical_track_id) GROUP BY 1 ORDER BY artists DESC, genre LIMIT 40")
    of_albums = "(SELECT album_id, sum(plays) AS plays, sum(ms_played) AS ms_played FROM (SELECT DISTINCT album_id, canonical_track_id FROM {tracks}) JOIN {canonical_play_stats} USING (canonical_track_id) GROUP BY 1)"
    add("e05_album_index", lambda w: entities.album_index(w, "coverage", filters={"saved": "no", "coverage": "partial"}), "total# id name album_type release_date total_tracks# popularity# tracks# saved artist artist_id plays# ms_played#", f"""
        SELECT count(*) OVER () AS total, g.*, artist, artist_id, coalesce(plays, 0) AS plays, coalesce(ms_played, 0) AS ms_played FROM (SELECT al.id, al.name, al.album_type, al.release_date, al.total_tracks, al.popularity, count(DISTINCT t.canonical_track_id) AS tracks, bool_or(v.album_id IS NOT NULL) AS saved
          FROM {{albums}} al JOIN {{tracks}} t ON t.album_id = al.id JOIN {{library_tracks}} l ON l.track_id = t.id LEFT JOIN {{saved_albums}} v ON v.album_id = al.id AND v.removed_at IS NULL GROUP BY 1, 2, 3, 4, 5, 6
          HAVING NOT bool_or(v.album_id IS NOT NULL) AND count(DISTINCT t.canonical_track_id) < al.total_tracks) g LEFT JOIN {{album_credit_names}} n ON n.album_id = g.id LEFT JOIN {of_albums} p ON p.album_id = g.id
        ORDER BY tracks / total_tracks::DOUBLE DESC NULLS LAST, name, id LIMIT 50""")
    add("e06_playlist_index", lambda w: entities.playlist_index(w, "listened", q="THE", filters={"access": "private"}), "total# id name description owner_id owner_name is_owned collaborative public tracks# library_tracks# duration_ms# last_added_at plays# ms_played#", f"""
        SELECT count(*) OVER () AS total, p.id, p.name, description, owner_id, display_name AS owner_name, is_owned, collaborative, public, coalesce(tracks, 0) AS tracks, coalesce(library_tracks, 0) AS library_tracks, coalesce(s.duration_ms, 0) AS duration_ms, {iso('last_added')} AS last_added_at, coalesce(plays, 0) AS plays, coalesce(ms_played, 0) AS ms_played
        FROM {{playlists}} p LEFT JOIN {{users}} u ON u.id = owner_id
          LEFT JOIN (SELECT playlist_id, count(*) AS tracks, count(DISTINCT l.track_id) AS library_tracks, sum(t.duration_ms) AS duration_ms, max(added_at) AS last_added FROM {{playlist_tracks}} i LEFT JOIN {{tracks}} t ON t.id = i.track_id LEFT JOIN {{library_tracks}} l ON l.track_id = i.track_id GROUP BY 1) s ON s.playlist_id = p.id
          LEFT JOIN (SELECT playlist_id, sum(plays) AS plays, sum(ms_played) AS ms_played FROM (SELECT DISTINCT playlist_id, canonical_track_id FROM {{playlist_tracks}} i JOIN {{tracks}} t ON t.id = i.track_id) JOIN {{canonical_play_stats}} USING (canonical_track_id) GROUP BY 1) x ON x.playlist_id = p.id
        WHERE removed_at IS NULL AND (name ILIKE '%the%' OR description ILIKE '%the%') AND NOT public ORDER BY coalesce(ms_played, 0) DESC, name, p.id LIMIT 50""")
    sums = f"coalesce(sum(plays), 0) AS plays, coalesce(sum(completed_plays), 0) AS completed, coalesce(sum(skips), 0) AS skips, coalesce(sum(ms_played), 0) AS ms_played, {iso('min(first_played_at)')} AS first_played_at, {iso('max(last_played_at)')} AS last_played_at"
    for key, call, of in (
        ("e07_track_play_summary", lambda w: entities.track_play_summary(w, RECORDING), f"canonical_track_id = '{RECORDING}'"),
        ("e10_artist_play_summary", lambda w: entities.artist_play_summary(w, ARTIST), f"canonical_track_id IN (SELECT canonical_track_id FROM {{canonical_track_artists}} WHERE artist_id = '{ARTIST}' AND on_representative)"),
        ("e12_album_play_summary", lambda w: entities.album_play_summary(w, ALBUM), f"canonical_track_id IN (SELECT canonical_track_id FROM {{tracks}} WHERE album_id = '{ALBUM}')"),
        ("e13_playlist_play_summary", lambda w: entities.playlist_play_summary(w, PLAYLIST), f"canonical_track_id IN (SELECT canonical_track_id FROM {{playlist_tracks}} JOIN {{tracks}} t ON t.id = track_id WHERE playlist_id = '{PLAYLIST}')"),
    ):
        add(key, call, "plays# completed# skips# ms_played# first_played_at last_played_at", f"SELECT {sums} FROM {{canonical_play_stats}} WHERE {of}")
    add("e08_track_plays_by_month", lambda w: entities.track_plays_by_month(w, RECORDING, ZONE), "period plays# minutes#", f"""
        SELECT strftime(m, '%Y-%m') AS period, coalesce(plays, 0) AS plays, coalesce(minutes, 0) AS minutes FROM (SELECT unnest(generate_series(date_trunc('month', min({PLAYED})), date_trunc('month', max({PLAYED})), INTERVAL 1 MONTH)) AS m FROM {PLAYS_R} WHERE canonical_track_id = '{RECORDING}') s
          LEFT JOIN (SELECT date_trunc('month', {PLAYED}) AS m, count(*) AS plays, {whole(HEARD)} AS minutes FROM {PLAYS_R} WHERE canonical_track_id = '{RECORDING}' GROUP BY 1) USING (m)""")
    add("e09_recent_plays_for", lambda w: entities.recent_plays_for(w, RECORDING), "id# played_at ms_played# estimated platform reason_start reason_end shuffle source", f"""
        SELECT p.id, {iso('p.played_at')} AS played_at, {HEARD} AS ms_played, ms_played IS NULL AND estimated_ms IS NOT NULL AS estimated, platform, reason_start, reason_end, shuffle, source FROM {PLAYS_R} WHERE canonical_track_id = '{RECORDING}' ORDER BY p.played_at DESC, p.id DESC LIMIT 12""")
    add("e11_artist_top_played", lambda w: entities.artist_top_played(w, ARTIST), "canonical_track_id title plays# ms_played# last_played_at in_library artists", f"""
        SELECT c.id AS canonical_track_id, title, plays, ms_played, {iso('s.last_played_at')} AS last_played_at, l.canonical_track_id IS NOT NULL AS in_library, artists FROM {{canonical_play_stats}} s JOIN {{canonical_tracks}} c ON c.id = s.canonical_track_id
          JOIN {{canonical_track_artists}} x ON x.canonical_track_id = c.id AND on_representative AND artist_id = '{ARTIST}' LEFT JOIN {{library_canonical}} l ON l.canonical_track_id = c.id LEFT JOIN {{artist_names}} n ON n.canonical_track_id = c.id ORDER BY ms_played DESC, plays DESC, title, c.id LIMIT 10""")
    add("e14_canonical_track", lambda w: entities.canonical_track(w, RECORDING), "id kind isrc title duration_ms# explicit representative_track_id max_popularity# copy_count# earliest_release_date primary_album_id primary_album_name artists first_added_at latest_added_at liked liked_at copy_count_in_library# owned_playlist_count#", f"""
        SELECT c.id, c.kind, c.isrc, c.title, c.duration_ms, c.explicit, representative_track_id, max_popularity, copy_count, CAST(earliest_release_date AS VARCHAR) AS earliest_release_date, c.primary_album_id, al.name AS primary_album_name,
          (SELECT string_agg(artist_id || ':' || name, ',' ORDER BY position, artist_id) FROM {{canonical_track_artists}} x JOIN {{artists}} a ON a.id = x.artist_id WHERE x.canonical_track_id = c.id) AS artists, {iso('first_added_at')} AS first_added_at, {iso('latest_added_at')} AS latest_added_at,
          coalesce(liked, FALSE) AS liked, {iso("(SELECT min(added_at) FROM {saved_tracks} v JOIN {tracks} t ON t.id = v.track_id WHERE t.canonical_track_id = c.id AND removed_at IS NULL)")} AS liked_at, coalesce(copy_count_in_library, 0) AS copy_count_in_library, coalesce(owned_playlist_count, 0) AS owned_playlist_count
        FROM {{canonical_tracks}} c LEFT JOIN {{albums}} al ON al.id = c.primary_album_id LEFT JOIN {{library_canonical}} l ON l.canonical_track_id = c.id WHERE c.id = '{RECORDING}'""")
    add("e15_track_copies", lambda w: entities.track_copies(w, RECORDING), "id name duration_ms# popularity# explicit disc_number# track_number# is_local isrc linked_from_id album_id album_name album_type album_release_date artists is_representative in_library liked_at playlist_count#", f"""
        SELECT t.id, t.name, t.duration_ms, t.popularity, t.explicit, disc_number, track_number, is_local, t.isrc, linked_from_id, t.album_id, al.name AS album_name, album_type, release_date AS album_release_date, coalesce(artists, '') AS artists, t.id = representative_track_id AS is_representative, l.track_id IS NOT NULL AS in_library,
          {iso('v.added_at')} AS liked_at, (SELECT count(*) FROM {{playlist_tracks}} i WHERE i.track_id = t.id) AS playlist_count
        FROM {{tracks}} t JOIN {{canonical_tracks}} c ON c.id = t.canonical_track_id LEFT JOIN {{albums}} al ON al.id = t.album_id LEFT JOIN {{library_tracks}} l ON l.track_id = t.id LEFT JOIN (SELECT * FROM {{saved_tracks}} WHERE removed_at IS NULL) v ON v.track_id = t.id LEFT JOIN {{track_credit_names}} n ON n.track_id = t.id
        WHERE c.id = '{RECORDING}'""")
    add("e16_track_playlists", lambda w: entities.track_playlists(w, RECORDING), "id name is_owned collaborative occurrences# added_at added_by_id added_by_name positions", f"""
        SELECT p.id, p.name, is_owned, collaborative, count(*) AS occurrences, {iso('min(added_at)')} AS added_at, min(added_by_id) AS added_by_id, min(display_name) AS added_by_name, string_agg(CAST(position AS VARCHAR), ',' ORDER BY position) AS positions
        FROM {{playlist_tracks}} i JOIN {{tracks}} t ON t.id = i.track_id JOIN {{playlists}} p ON p.id = i.playlist_id LEFT JOIN {{users}} u ON u.id = added_by_id WHERE canonical_track_id = '{RECORDING}' AND removed_at IS NULL GROUP BY 1, 2, 3, 4""")
    add("e17_recording_of", lambda w: entities.recording_of(w, "7"), "canonical_track_id", "SELECT canonical_track_id FROM {tracks} WHERE id = '7'")
    add("e18_artist", lambda w: entities.artist(w, ARTIST), "id name popularity# followers_total# detail_level genres followed_at", f"""
        SELECT a.id, name, popularity, followers_total, detail_level, (SELECT string_agg(genre, ',' ORDER BY genre) FROM {{artist_genres}} WHERE artist_id = a.id) AS genres, {iso('f.first_seen_at')} AS followed_at FROM {{artists}} a LEFT JOIN (SELECT * FROM {{followed_artists}} WHERE removed_at IS NULL) f ON f.artist_id = a.id WHERE a.id = '{ARTIST}'""")
    mine = f"(SELECT canonical_track_id FROM {{canonical_track_artists}} WHERE artist_id = '{ARTIST}')"
    add("e19_artist_stats", lambda w: entities.artist_stats(w, ARTIST), "library_recordings# library_copies# duration_ms# albums_in_library# liked_recordings# first_added_at latest_added_at catalog_albums#", f"""
        SELECT count(*) AS library_recordings, coalesce(sum(copy_count_in_library), 0) AS library_copies, coalesce(sum(duration_ms), 0) AS duration_ms, count(DISTINCT primary_album_id) AS albums_in_library, count(*) FILTER (liked) AS liked_recordings, {iso('min(first_added_at)')} AS first_added_at,
          {iso('max(latest_added_at)')} AS latest_added_at, (SELECT count(*) FROM {{album_artists}} WHERE artist_id = '{ARTIST}') AS catalog_albums FROM {{library_canonical}} WHERE canonical_track_id IN {mine}""")
    add("e20_artist_albums", lambda w: entities.artist_albums(w, ARTIST), "id name album_type release_date total_tracks# library_tracks# saved", f"""
        SELECT al.id, al.name, coalesce(album_type, 'other') AS album_type, release_date, total_tracks, (SELECT count(DISTINCT canonical_track_id) FROM {{tracks}} t JOIN {{library_tracks}} l ON l.track_id = t.id WHERE t.album_id = al.id) AS library_tracks, v.album_id IS NOT NULL AS saved
        FROM {{albums}} al JOIN {{album_artists}} x ON x.album_id = al.id LEFT JOIN (SELECT * FROM {{saved_albums}} WHERE removed_at IS NULL) v ON v.album_id = al.id WHERE x.artist_id = '{ARTIST}'""")
    add("e21_artist_top_tracks", lambda w: entities.artist_top_tracks(w, ARTIST), "canonical_track_id title duration_ms# popularity# explicit copy_count# liked first_added_at album_id album_name", f"""
        SELECT canonical_track_id, title, duration_ms, max_popularity AS popularity, explicit, copy_count, liked, {iso('r.first_added_at')} AS first_added_at, primary_album_id AS album_id, album_name FROM {{library_rows}} r WHERE canonical_track_id IN {mine} ORDER BY max_popularity DESC NULLS LAST, title, canonical_track_id LIMIT 20""")
    add("e22_album", lambda w: entities.album(w, ALBUM), "id name album_type release_date release_date_precision total_tracks# label popularity# upc detail_level tracks_complete market_count# saved_at artists genres", f"""
        SELECT al.id, name, album_type, release_date, release_date_precision, total_tracks, label, popularity, upc, detail_level, tracks_complete, CASE WHEN markets IS NULL THEN 0 ELSE len(string_split(markets, ',')) END AS market_count, {iso('v.added_at')} AS saved_at, coalesce(artists, '') AS artists,
          (SELECT string_agg(genre, ',' ORDER BY genre) FROM {{album_genres}} g WHERE g.album_id = al.id) AS genres FROM {{albums}} al LEFT JOIN (SELECT * FROM {{saved_albums}} WHERE removed_at IS NULL) v ON v.album_id = al.id LEFT JOIN {{album_credit_names}} n ON n.album_id = al.id WHERE al.id = '{ALBUM}'""")
    add("e23_album_editions", lambda w: entities.album_editions(w, EDITION), "id name album_type release_date saved representative", f"""
        SELECT al.id, al.name, al.album_type, al.release_date, v.album_id IS NOT NULL AS saved, al.id = representative_album_id AS representative FROM {{albums}} me JOIN {{album_groups}} g ON g.id = me.album_group_id AND g.copy_count > 1 JOIN {{albums}} al ON al.album_group_id = g.id AND al.id <> me.id
          LEFT JOIN (SELECT * FROM {{saved_albums}} WHERE removed_at IS NULL) v ON v.album_id = al.id WHERE me.id = '{EDITION}'""")
    add("e24_album_tracks", lambda w: entities.album_tracks(w, ALBUM), "id name disc_number# track_number# duration_ms# explicit popularity# canonical_track_id artists in_library via_other_copy liked plays# ms_played#", f"""
        SELECT t.id, t.name, disc_number, track_number, t.duration_ms, t.explicit, t.popularity, t.canonical_track_id, coalesce(artists, '') AS artists, l.track_id IS NOT NULL AS in_library, l.track_id IS NULL AND c.canonical_track_id IS NOT NULL AS via_other_copy, v.track_id IS NOT NULL AS liked, coalesce(plays, 0) AS plays, coalesce(ms_played, 0) AS ms_played
        FROM {{tracks}} t LEFT JOIN {{library_tracks}} l ON l.track_id = t.id LEFT JOIN {{library_canonical}} c ON c.canonical_track_id = t.canonical_track_id LEFT JOIN {{canonical_play_stats}} s ON s.canonical_track_id = t.canonical_track_id LEFT JOIN (SELECT * FROM {{saved_tracks}} WHERE removed_at IS NULL) v ON v.track_id = t.id
          LEFT JOIN {{track_credit_names}} n ON n.track_id = t.id WHERE t.album_id = '{ALBUM}'""")
    add("e25_playlist", lambda w: entities.playlist(w, PLAYLIST), "id name description owner_id owner_name is_owned collaborative public snapshot_id total_tracks# stored_tracks# resolved_tracks# local_tracks# duration_ms# distinct_recordings# in_library# first_added_at last_added_at contributor_count#", f"""
        SELECT p.id, p.name, description, owner_id, display_name AS owner_name, is_owned, collaborative, public, snapshot_id, total_tracks, s.* FROM {{playlists}} p LEFT JOIN {{users}} u ON u.id = owner_id CROSS JOIN
          (SELECT count(*) AS stored_tracks, count(i.track_id) AS resolved_tracks, count(*) FILTER (i.is_local) AS local_tracks, coalesce(sum(t.duration_ms), 0) AS duration_ms, count(DISTINCT t.canonical_track_id) AS distinct_recordings, count(DISTINCT l.track_id) AS in_library, {iso('min(added_at)')} AS first_added_at,
             {iso('max(added_at)')} AS last_added_at, count(DISTINCT added_by_id) AS contributor_count FROM {{playlist_tracks}} i LEFT JOIN {{tracks}} t ON t.id = i.track_id LEFT JOIN {{library_tracks}} l ON l.track_id = i.track_id WHERE playlist_id = '{PLAYLIST}') s WHERE p.id = '{PLAYLIST}'""")
    add("e26_playlist_items", lambda w: entities.playlist_items(w, PLAYLIST), "position# track_id name duration_ms# explicit popularity# canonical_track_id copy_count# album_id album_name artists local_artist is_local added_at added_by_id added_by_name in_library liked", f"""
        SELECT i.position, i.track_id, coalesce(t.name, local_name, '(unavailable)') AS name, t.duration_ms, coalesce(t.explicit, FALSE) AS explicit, t.popularity, t.canonical_track_id, copy_count, al.id AS album_id, al.name AS album_name, coalesce(artists, '') AS artists, local_artist, i.is_local, {iso('i.added_at')} AS added_at, added_by_id,
          display_name AS added_by_name, l.track_id IS NOT NULL AS in_library, v.track_id IS NOT NULL AS liked
        FROM (SELECT * FROM {{playlist_tracks}} WHERE playlist_id = '{PLAYLIST}') i LEFT JOIN {{tracks}} t ON t.id = i.track_id LEFT JOIN {{canonical_tracks}} c ON c.id = t.canonical_track_id LEFT JOIN {{albums}} al ON al.id = t.album_id LEFT JOIN {{users}} u ON u.id = added_by_id LEFT JOIN {{library_tracks}} l ON l.track_id = i.track_id
          LEFT JOIN (SELECT * FROM {{saved_tracks}} WHERE removed_at IS NULL) v ON v.track_id = i.track_id LEFT JOIN {{track_credit_names}} n ON n.track_id = i.track_id""")

    # --- genres
    edges = "{library_edges} e LEFT JOIN {canonical_play_stats} s USING (canonical_track_id)"
    add("g01_vocabulary", genres.vocabulary, "genre tracks# plays# ms_played#", f"SELECT genre, count(*) AS tracks, coalesce(sum(plays), 0) AS plays, coalesce(sum(ms_played), 0) AS ms_played FROM {edges} GROUP BY 1")
    add("g02_genre_coverage", genres.coverage, "described# library#", "SELECT (SELECT count(DISTINCT canonical_track_id) FROM {library_edges}) AS described, (SELECT count(*) FROM {library_canonical}) AS library")
    chosen = "{library_canonical} l LEFT JOIN {canonical_play_stats} s USING (canonical_track_id)"
    sums = "count(*) AS tracks, count(*) FILTER (liked) AS liked, count(DISTINCT primary_artist_id) AS artists, coalesce(sum(duration_ms), 0) AS duration_ms, coalesce(sum(plays), 0) AS plays, coalesce(sum(ms_played), 0) AS ms_played"
    listed = ", ".join(f"'{g}'" for g in PICKED)
    any_of = f"canonical_track_id IN (SELECT canonical_track_id FROM {{track_genres}} WHERE genre IN ({listed}))"
    all_of = f"canonical_track_id IN (SELECT canonical_track_id FROM {{track_genres}} WHERE genre IN ({listed}) GROUP BY 1 HAVING count(DISTINCT genre) = {len(PICKED)})"
    has = f"canonical_track_id IN (SELECT canonical_track_id FROM {{track_genres}} WHERE genre = '{GENRE}')"
    for mode, cond in (("any", any_of), ("all", all_of)):
        add(f"g03_selection_stats_{mode}", lambda w, m=mode: genres.selection_stats(w, PICKED, m), "tracks# liked# artists# duration_ms# plays# ms_played#", f"SELECT {sums} FROM {chosen} WHERE {cond}")
        add(f"g09_matches_{mode}", lambda w, m=mode: genres.matching(w, PICKED, m), "canonical_track_id", f"SELECT id AS canonical_track_id FROM (SELECT id, id AS canonical_track_id FROM {{canonical_tracks}}) WHERE {cond}")
        again(f"g03_bitmap_stats_{mode}", f"g03_selection_stats_{mode}", lambda w, m=mode: bitmaps.selection_totals(w, PICKED, m))
        again(f"g09_bitmap_matches_{mode}", f"g09_matches_{mode}", lambda w, m=mode: bitmaps.matching(w, PICKED, m))
    add("g04_genre_summary", lambda w: genres.genre_summary(w, GENRE), "genre tracks# liked# artists# duration_ms# plays# ms_played# albums# first_added_at last_played_at catalog_tracks# top_votes#", f"""
        SELECT '{GENRE}' AS genre, {sums}, count(DISTINCT primary_album_id) AS albums, {iso('min(first_added_at)')} AS first_added_at, {iso('max(last_played_at)')} AS last_played_at, (SELECT count(DISTINCT canonical_track_id) FROM {{track_genres}} WHERE genre = '{GENRE}') AS catalog_tracks,
          (SELECT max(votes) FROM {{track_genres}} WHERE genre = '{GENRE}') AS top_votes FROM {chosen} WHERE {has}""")
    add("g05_related_genres", lambda w: genres.related_genres(w, GENRE), "genre shared# tracks# overlap~", f"""
        SELECT *, shared::DOUBLE / (seed + tracks - shared) AS overlap FROM (SELECT genre, count(*) FILTER (canonical_track_id IN (SELECT canonical_track_id FROM {{library_edges}} WHERE genre = '{GENRE}')) AS shared, count(*) AS tracks, (SELECT count(*) FROM {{library_edges}} WHERE genre = '{GENRE}') AS seed FROM {{library_edges}} WHERE genre <> '{GENRE}' GROUP BY 1)
        WHERE shared > 0 AND shared >= least(3, seed) ORDER BY overlap DESC, shared DESC, genre LIMIT 14""")
    add("g06_genre_artists", lambda w: genres.genre_artists(w, GENRE), "id name tracks# plays# ms_played#", f"SELECT a.id, a.name, count(*) AS tracks, coalesce(sum(plays), 0) AS plays, coalesce(sum(ms_played), 0) AS ms_played FROM {chosen} JOIN {{artists}} a ON a.id = primary_artist_id WHERE {has} GROUP BY 1, 2 ORDER BY tracks DESC, plays DESC, a.name, a.id LIMIT 8")
    own = "(SELECT string_agg(genre, ',' ORDER BY genre) FROM {genre_collection_genres} g WHERE g.collection_id = c.id)"
    add("g07_list_collections", lambda w: genres.list_collections(w).select("id", "name", "match", "genres", "track_count"), "id name match genres track_count#", f"""
        SELECT c.id, c.name, c.match, coalesce({own}, '') AS genres, coalesce(n, 0) AS track_count FROM {{genre_collections}} c LEFT JOIN (SELECT collection_id, count(*) FILTER (match <> 'all' OR hits = size) AS n FROM
          (SELECT collection_id, match, canonical_track_id, count(DISTINCT e.genre) AS hits, (SELECT count(*) FROM {{genre_collection_genres}} y WHERE y.collection_id = x.collection_id) AS size FROM {{genre_collection_genres}} x JOIN {{genre_collections}} k ON k.id = x.collection_id JOIN {{library_edges}} e ON e.genre = x.genre GROUP BY 1, 2, 3) GROUP BY 1) z ON z.collection_id = c.id""")
    again("g02_bitmap_coverage", "g02_genre_coverage", bitmaps.coverage)
    again("g05_bitmap_related_genres", "g05_related_genres", lambda w: bitmaps.related_genres(w, GENRE))
    again("g07_bitmap_collections", "g07_list_collections", lambda w: bitmaps.collections(w).select("id", "name", "match", "genres", "track_count"))
    add("g08_collection", lambda w: genres.collection(w, "some").select("id", "name", "match", "sort", "track_limit", "genres"), "id name match sort track_limit# genres", f"SELECT c.id, name, match, sort, track_limit, {own} AS genres FROM {{genre_collections}} c WHERE id = 'some'")
    add("g10_resolve_tracks", lambda w: genres.resolve_tracks(w, PICKED, "any", "popularity", 25, 10), "total# rank# canonical_track_id track_id title duration_ms# popularity# explicit liked first_added_at album_id album_name artists genres plays# ms_played#", f"""
        SELECT total, place AS rank, canonical_track_id, representative_track_id AS track_id, title, duration_ms, max_popularity AS popularity, explicit, liked, {iso('first_added_at')} AS first_added_at, album_id, album_name, artists, genres, plays, ms_played
        FROM (SELECT *, count(*) OVER () AS total, row_number() OVER (ORDER BY max_popularity DESC NULLS LAST, canonical_track_id) AS place FROM {{library_rows}} WHERE {any_of}) r
          LEFT JOIN (SELECT canonical_track_id, string_agg(genre, ',' ORDER BY k) AS genres FROM (SELECT canonical_track_id, genre, row_number() OVER (PARTITION BY canonical_track_id ORDER BY genre IN ({listed}) DESC, max(votes) DESC, genre) AS k FROM {{track_genres}} GROUP BY 1, 2) WHERE k <= 8 GROUP BY 1) g USING (canonical_track_id)
        WHERE place > 10 AND place <= 35""")
    add("g11_resolve_track_ids", lambda w: genres.resolve_track_ids(w, PICKED, "any", "random", 500), "rank# track_id", f"SELECT row_number() OVER (ORDER BY md5(canonical_track_id), canonical_track_id) AS rank, representative_track_id AS track_id FROM {{library_rows}} WHERE {any_of} ORDER BY 1 LIMIT 500")
    add("k14_collection_fingerprint", lambda w: genres.fingerprint(genres.resolve_track_ids(w, PICKED, "any", "title")), "fingerprint tracks#", f"SELECT md5(string_agg(representative_track_id, ',' ORDER BY title, canonical_track_id)) AS fingerprint, count(*) AS tracks FROM {{library_rows}} WHERE {any_of}")

    # --- derived tables
    add("d01_canonical_tracks", lambda w: w["canonical_tracks"], "id kind isrc title duration_ms# explicit representative_track_id max_popularity# copy_count# earliest_release_date primary_album_id primary_artist_id", "SELECT * REPLACE (CAST(earliest_release_date AS VARCHAR) AS earliest_release_date) FROM {canonical_tracks}")
    add("d01_canonical_track_artists", lambda w: w["canonical_track_artists"], "canonical_track_id artist_id position# on_representative", "SELECT * FROM {canonical_track_artists}")
    add("d02_library_tracks", lambda w: w["library_tracks"].withColumns({c: F.col(c).cast("string") for c in ("liked_at", "first_added_at")}), "track_id via_liked via_owned_playlist liked_at first_added_at owned_playlist_count#", "SELECT * REPLACE (CAST(liked_at AS VARCHAR) AS liked_at, CAST(first_added_at AS VARCHAR) AS first_added_at) FROM {library_tracks}")
    add("d02_library_canonical", lambda w: w["library_canonical"], "canonical_track_id first_added_at latest_added_at liked copy_count_in_library# owned_playlist_count# duration_ms# primary_artist_id primary_album_id explicit", "SELECT * REPLACE (CAST(first_added_at AS VARCHAR) AS first_added_at, CAST(latest_added_at AS VARCHAR) AS latest_added_at) FROM {library_canonical}")
    add("d03_album_completeness", lambda w: w["albums_complete"].select("id", "total_tracks", "tracks_complete"), "id total_tracks# tracks_complete", "SELECT id, total_tracks, tracks_complete FROM {albums_complete}")
    add("d04_album_groups", lambda w: w["album_groups"], "id kind title representative_album_id track_count# copy_count# earliest_release_date primary_artist_id", "SELECT * REPLACE (CAST(earliest_release_date AS VARCHAR) AS earliest_release_date) FROM {album_groups}")
    add("d05_linked_plays", lambda w: derive.link_plays(w["plays_landed"], w["tracks"]).select("id", "item_uri", "track_id"), "id# item_uri track_id", "SELECT id, item_uri, track_id FROM {plays_linked}")
    add("d06_estimated_durations", lambda w: w["plays"].select("id", "ms_played", "estimated_ms"), "id# ms_played# estimated_ms#", "SELECT id, ms_played, estimated_ms FROM {plays}")
    add("d07_play_stats", lambda w: w["canonical_play_stats"].withColumns({c: F.col(c).cast("string") for c in ("first_played_at", "last_played_at")}), "canonical_track_id plays# completed_plays# skips# ms_played# first_played_at last_played_at", "SELECT * REPLACE (CAST(first_played_at AS VARCHAR) AS first_played_at, CAST(last_played_at AS VARCHAR) AS last_played_at) FROM {canonical_play_stats}")
    lines = "coalesce(isrc, '') || '|' || title || '|' || duration_ms || '|' || representative_track_id || '|' || coalesce(primary_artist_id, '') || '|' || coalesce(primary_album_id, '') || '|' || copy_count"
    add("d08_canonical_checksum", lambda w: derive.text_checksum(w["canonical_tracks"], "id", derive.RECORDING_CHECK), "checksum", f"SELECT md5(string_agg(id || '|' || kind || '|' || {lines}, chr(10) ORDER BY id)) AS checksum FROM {{canonical_tracks}}")
    add("d08_album_group_checksum", lambda w: derive.text_checksum(w["album_groups"], "id", derive.GROUP_CHECK), "checksum", "SELECT md5(string_agg(id || '|' || kind || '|' || title || '|' || representative_album_id || '|' || coalesce(primary_artist_id, '') || '|' || track_count || '|' || copy_count, chr(10) ORDER BY id)) AS checksum FROM {album_groups}")
    add("d08_ranged_checksum", lambda w: derive.checksum(w["canonical_tracks"], "id", derive.RECORDING_CHECK), "rows# checksum", f"""
        WITH hashed AS (SELECT md5(id || '|' || kind || '|' || {lines}) AS h FROM {{canonical_tracks}}), ranged AS (SELECT CAST('0x' || substr(h, 1, 8) AS BIGINT) % 4096 AS g, count(*) AS n, md5(string_agg(h, chr(10) ORDER BY h)) AS r FROM hashed GROUP BY 1)
        SELECT sum(n) AS rows, md5(string_agg(g || ':' || r, chr(10) ORDER BY g || ':' || r)) AS checksum FROM ranged""")
    add("d09_match_artists_by_credit", derive.match_artists_by_credit, "artist_id mbid status source", f"""
        SELECT artist_id, artist_mbid AS mbid, 'matched' AS status, 'credit' AS source FROM (SELECT x.artist_id, m.artist_mbid, row_number() OVER (PARTITION BY x.artist_id ORDER BY count(*) DESC, m.artist_mbid) AS k
          FROM {{canonical_tracks}} c JOIN {{isrc_recordings}} i ON i.isrc = c.isrc JOIN {{mb_recording_artists}} m ON m.recording_mbid = i.recording_mbid JOIN {{canonical_track_artists}} x ON x.canonical_track_id = c.id JOIN {{artists}} a ON a.id = x.artist_id JOIN {{mb_artists}} o ON o.mbid = m.artist_mbid
          WHERE x.artist_id NOT IN (SELECT artist_id FROM {{artist_musicbrainz}}) AND ({name('a.name')} = {name('credit_name')} OR {name('a.name')} = {name('o.name')}) GROUP BY 1, 2) WHERE k = 1""")
    add("d10_recording_candidates", derive.recording_candidates, "canonical_track_id isrc plays#", "SELECT * FROM {wanted_codes}")
    add("d10_artist_candidates", derive.artist_candidates, "artist_id plays#", "SELECT * FROM {wanted_artists}")
    add("d10_album_candidates", derive.album_candidates, "album_id plays#", "SELECT * FROM {wanted_albums}")
    add("d11_genre_lists", lambda w: derive.genre_lists(w, "recording"), "entity_mbid genres", "SELECT entity_mbid, genres FROM {genre_lists} WHERE entity_type = 'recording'")
    dated = ragged("first_release_date")
    facts = f"""SELECT c.id AS canonical_track_id, c.isrc, i.recording_mbid, i.status AS lookup_status, r.title AS mb_title, length_ms AS mb_length_ms, CAST({dated} AS VARCHAR) AS mb_first_release_date, genres, bpm, key_key, key_scale, happy
        FROM {{canonical_tracks}} c LEFT JOIN {{isrc_recordings}} i ON i.isrc = c.isrc LEFT JOIN {{mb_recordings}} r ON r.mbid = i.recording_mbid LEFT JOIN (SELECT * FROM {{genre_lists}} WHERE entity_type = 'recording') g ON g.entity_mbid = i.recording_mbid LEFT JOIN (SELECT * FROM {{audio_features}} WHERE status = 'ok') f ON f.recording_mbid = i.recording_mbid"""
    spec = "canonical_track_id isrc recording_mbid lookup_status mb_title mb_length_ms# mb_first_release_date genres bpm~ key_key key_scale happy~"
    add("d12_track_enrichment", lambda w: derive.track_enrichment(_dated(w)), spec, facts)
    add("n04_track_enrichment", lambda w: enrichment.of_track(_dated(w), RECORDING), spec, facts + f" WHERE c.id = '{RECORDING}'")
    of_artist = "SELECT a.id AS artist_id, x.mbid, x.status AS lookup_status, x.source AS match_source, m.name AS mb_name, m.country, m.type, genres FROM {artists} a JOIN {artist_musicbrainz} x ON x.artist_id = a.id JOIN {mb_artists} m ON m.mbid = x.mbid LEFT JOIN (SELECT * FROM {genre_lists} WHERE entity_type = 'artist') g ON g.entity_mbid = m.mbid"
    add("d12_artist_enrichment", derive.artist_enrichment, "artist_id mbid lookup_status match_source mb_name country type genres", of_artist)
    add("n04_artist_enrichment", lambda w: enrichment.of_artist(w, ARTIST), "artist_id mbid lookup_status match_source mb_name country type genres", of_artist + f" WHERE a.id = '{ARTIST}'")
    of_album = """SELECT a.id AS album_id, x.release_mbid, x.status AS lookup_status, r.title AS mb_title, r.country, label_name, release_group_mbid, q.title AS release_group_title, primary_type, coalesce(g.genres, h.genres) AS genres
        FROM {albums} a JOIN {album_musicbrainz} x ON x.album_id = a.id JOIN {mb_releases} r ON r.mbid = x.release_mbid LEFT JOIN {mb_release_groups} q ON q.mbid = release_group_mbid
          LEFT JOIN (SELECT * FROM {genre_lists} WHERE entity_type = 'release_group') g ON g.entity_mbid = release_group_mbid LEFT JOIN (SELECT * FROM {genre_lists} WHERE entity_type = 'release') h ON h.entity_mbid = x.release_mbid"""
    spec = "album_id release_mbid lookup_status mb_title country label_name release_group_mbid release_group_title primary_type genres"
    add("d12_album_enrichment", derive.album_enrichment, spec, of_album)
    add("n04_album_enrichment", lambda w: enrichment.of_album(w, RELEASED), spec, of_album + f" WHERE a.id = '{RELEASED}'")
    rec, art, alb = "{wanted_codes} c JOIN {isrc_recordings} i ON i.isrc = c.isrc", "{wanted_artists} c JOIN {artist_musicbrainz} x ON x.artist_id = c.artist_id", "{wanted_albums} c JOIN {album_musicbrainz} x ON x.album_id = c.album_id"
    stages = f"""SELECT 'recordings' AS stage, (SELECT count(*) FROM {{wanted_codes}}) AS candidates, (SELECT count(*) FROM {rec} WHERE recording_mbid IS NOT NULL) AS matched, (SELECT count(*) FROM {rec} WHERE status = 'not_found') AS missed
        UNION ALL SELECT 'audio', (SELECT count(DISTINCT recording_mbid) FROM {rec}), (SELECT count(DISTINCT i.recording_mbid) FROM {rec} JOIN {{audio_features}} f ON f.recording_mbid = i.recording_mbid WHERE f.status = 'ok'), (SELECT count(DISTINCT i.recording_mbid) FROM {rec} JOIN {{audio_features}} f ON f.recording_mbid = i.recording_mbid WHERE f.status = 'missing')
        UNION ALL SELECT 'artists', (SELECT count(*) FROM {{wanted_artists}}), (SELECT count(*) FROM {art} JOIN {{mb_artists}} m ON m.mbid = x.mbid WHERE detail_level = 'full'), (SELECT count(*) FROM {art} WHERE status = 'not_found')
        UNION ALL SELECT 'albums', (SELECT count(*) FROM {{wanted_albums}}), (SELECT count(*) FROM {alb} WHERE release_mbid IS NOT NULL), (SELECT count(*) FROM {alb} WHERE status = 'not_found')"""
    add("d13_enrichment_coverage", derive.enrichment_coverage, "stage candidates# matched# missed#", stages)
    add("d14_track_genres", lambda w: w["track_genres"], "canonical_track_id genre votes#", "SELECT * FROM {track_genres}")
    add("n01_stage_coverage", lambda w: enrichment.stage_coverage({n: w[n] for n in (*NAMES, "enrich_stages")} | {"enrich_stages": w["enrich_stages"].withColumn("last_error", F.lit(None).cast("string"))}).drop("last_error"), "stage candidates# matched# missed# status requests# place#", f"""
        SELECT c.*, s.status, coalesce(requests, 0) AS requests, CASE stage WHEN 'recordings' THEN 1 WHEN 'audio' THEN 2 WHEN 'artists' THEN 3 ELSE 4 END AS place FROM ({stages}) c LEFT JOIN {{enrich_stages}} s ON s.key = c.stage""")
    add("n02_totals", enrichment.totals, "recordings# analysed# artists# releases# genre_tags# vocabulary# genres_in_use#", """
        SELECT (SELECT count(*) FROM {mb_recordings}) AS recordings, (SELECT count(*) FROM {audio_features} WHERE status = 'ok') AS analysed, (SELECT count(*) FROM {mb_artists} WHERE detail_level = 'full') AS artists, (SELECT count(*) FROM {mb_releases}) AS releases, (SELECT count(*) FROM {mb_tags}) AS genre_tags,
          (SELECT count(*) FROM {mb_genres}) AS vocabulary, (SELECT count(DISTINCT tag) FROM {mb_tags} WHERE tag IN (SELECT name FROM {mb_genres})) AS genres_in_use""")
    add("n03_top_genres", enrichment.top_genres, "genre recordings# plays#", """
        SELECT tag AS genre, count(DISTINCT c.id) AS recordings, coalesce(sum(plays), 0) AS plays FROM {canonical_tracks} c JOIN {isrc_recordings} i ON i.isrc = c.isrc JOIN {mb_tags} m ON entity_type = 'recording' AND entity_mbid = recording_mbid LEFT JOIN {canonical_play_stats} s ON s.canonical_track_id = c.id
        WHERE tag IN (SELECT name FROM {mb_genres}) GROUP BY 1 ORDER BY plays DESC, recordings DESC, genre LIMIT 24""")

    # --- work selection and state
    add("x01_albums_to_fetch", work.albums_to_fetch, "album_id", "SELECT DISTINCT album_id FROM {library_tracks} l JOIN {tracks} t ON t.id = l.track_id LEFT JOIN {albums} a ON a.id = t.album_id WHERE album_id IS NOT NULL AND (a.id IS NULL OR a.detail_level = 'simplified' OR NOT tracks_complete)")
    add("x02_brief_tracks", lambda w: work.brief_entities(w["tracks"]), "id", "SELECT id FROM {tracks} WHERE detail_level = 'simplified' AND NOT is_local")
    add("x02_brief_artists", lambda w: work.brief_entities(w["artists"]), "id", "SELECT id FROM {artists} WHERE detail_level = 'simplified'")
    add("x03_changed_playlists", work.changed_playlists, "id", "SELECT id FROM {playlists} WHERE removed_at IS NULL AND snapshot_id IS DISTINCT FROM items_synced_snapshot_id")
    add("x04_codes_to_look_up", work.codes_to_look_up, "isrc plays#", "SELECT isrc, plays FROM {wanted_codes} WHERE isrc NOT IN (SELECT isrc FROM {isrc_recordings}) ORDER BY plays DESC, isrc LIMIT 25")
    add("x05_recordings_to_analyse", work.recordings_to_analyse, "mbid plays#", f"SELECT recording_mbid AS mbid, max(plays) AS plays FROM {rec} WHERE recording_mbid IS NOT NULL AND recording_mbid NOT IN (SELECT recording_mbid FROM {{audio_features}}) GROUP BY 1 ORDER BY plays DESC, mbid LIMIT 100")
    add("x06_artists_to_detail", work.artists_to_detail, "mbid plays#", f"SELECT x.mbid, sum(plays) AS plays FROM {art} WHERE x.mbid IN (SELECT mbid FROM {{mb_artists}} WHERE detail_level = 'stub') GROUP BY 1 ORDER BY plays DESC, x.mbid LIMIT 15")
    add("x06_artists_to_match", work.artists_to_match, "artist_id plays#", "SELECT * FROM {wanted_artists} WHERE artist_id NOT IN (SELECT artist_id FROM {artist_musicbrainz}) ORDER BY plays DESC, artist_id LIMIT 15")
    add("x07_albums_to_match", work.albums_to_match, "album_id plays#", "SELECT * FROM {wanted_albums} WHERE album_id NOT IN (SELECT album_id FROM {album_musicbrainz}) ORDER BY plays DESC, album_id LIMIT 10")
    add("x08_vocabulary_stale", lambda w: work.is_stale(w["mb_genres"], NOW), "stale", f"SELECT coalesce(max(fetched_at) < TIMESTAMP '{NOW}' - INTERVAL 30 DAY, TRUE) AS stale FROM {{mb_genres}}")
    add("x10_auto_sync_collections", genres.auto_sync_collections, "id", "SELECT id FROM {genre_collections} WHERE auto_sync AND id IN (SELECT collection_id FROM {genre_collection_genres})")
    add("x11_stalled_runs", lambda w: work.stalled_runs(w["sync_runs"], w["sync_phases"], NOW), "run_id# open_phases# idle_seconds#", f"""
        SELECT r.id AS run_id, count(*) FILTER (p.status NOT IN ('completed', 'skipped')) AS open_phases, CAST(epoch(TIMESTAMP '{NOW}') - epoch(greatest(any_value(r.started_at), max(p.updated_at))) AS BIGINT) AS idle_seconds FROM {{sync_runs}} r LEFT JOIN {{sync_phases}} p ON p.run_id = r.id WHERE r.status = 'running' GROUP BY 1""")
    add("x12_table_counts", work.table_counts, "name rows#", """
        SELECT 'tracks' AS name, count(*) AS rows FROM {tracks} UNION ALL SELECT 'recordings', count(*) FROM {canonical_tracks} UNION ALL SELECT 'library', count(*) FROM {library_canonical} UNION ALL SELECT 'albums', count(*) FROM {albums} UNION ALL SELECT 'artists', count(*) FROM {artists}
        UNION ALL SELECT 'playlists', count(*) FROM {playlists} WHERE removed_at IS NULL UNION ALL SELECT 'liked', count(*) FROM {saved_tracks} WHERE removed_at IS NULL""")
    add("m2_list_runs", lambda w: work.list_runs(w["sync_runs"].select("id", "status")), "id# status", "SELECT id, status FROM {sync_runs} ORDER BY id DESC LIMIT 20")
    add("m3_list_imports", lambda w: work.list_imports(w["play_imports"], w["plays"]), "id# label kind status created_at live_plays#", f"SELECT i.id, label, kind, status, {iso('created_at')} AS created_at, (SELECT count(*) FROM {{plays}} p WHERE p.import_id = i.id) AS live_plays FROM {{play_imports}} i ORDER BY created_at DESC, id DESC LIMIT 20")
    add("m4_data_version", lambda w: work.data_version(w["sync_runs"], w["library_canonical"]), "version", "SELECT coalesce(CAST(max(finished_at) AS VARCHAR), 'none') || ':' || (SELECT count(*) FROM {library_canonical}) AS version FROM {sync_runs} WHERE status = 'completed'")

    # --- merge rules, over the landed log
    halves = "SELECT * FROM {plays_landed} WHERE id % 2 = 0", "SELECT id + CASE WHEN id % 3 = 0 THEN 10000000 ELSE 0 END AS id, played_at, item_uri, ms_played FROM {plays_landed}"
    add("k01_new_plays", lambda w: merge.new_plays(w["plays_landed"].where("id % 2 = 0"), _batch(w)), "id# played_at item_uri ms_played#", f"""
        SELECT min(id) AS id, CAST(played_at AS VARCHAR) AS played_at, item_uri, ms_played FROM ({halves[1]} UNION ALL {halves[1].replace('id + CASE', '20000000 + id + CASE')}) b
        WHERE NOT EXISTS (SELECT 1 FROM ({halves[0]}) s WHERE s.played_at = b.played_at AND s.item_uri = b.item_uri AND s.ms_played IS NOT DISTINCT FROM b.ms_played) GROUP BY b.played_at, item_uri, ms_played""")
    add("k02_superseded_polls", lambda w: merge.superseded_polls_removed(w["plays_landed"], HIST.start, HIST.end).select("id", "source"), "id# source", f"SELECT id, source FROM {{plays_landed}} WHERE NOT (source = 'recent' AND played_at BETWEEN TIMESTAMP '{HIST.start}' AND TIMESTAMP '{HIST.end}')")
    add("k03_last_wins", lambda w: merge.last_wins(w["plays_landed"].select("item_uri", "id", "ms_played"), ["item_uri"], "id"), "item_uri id# ms_played#", "SELECT item_uri, max(id) AS id, CAST(arg_max(coalesce(ms_played, -1), id) AS INT) AS m, nullif(CAST(arg_max(coalesce(ms_played, -1), id) AS INT), -1) AS ms_played FROM {plays_landed} GROUP BY 1")
    add("k04_upsert", lambda w: merge.upsert(*_track_halves(w)), "id name isrc popularity# explicit", """
        SELECT coalesce(s.id, b.id) AS id, coalesce(b.name, s.name) AS name, coalesce(b.isrc, s.isrc) AS isrc, coalesce(b.popularity, s.popularity) AS popularity, coalesce(b.explicit, s.explicit) AS explicit
        FROM (SELECT * FROM {tracks_landed} WHERE CAST(id AS BIGINT) % 3 > 0) s FULL JOIN (SELECT id, upper(name) AS name, CASE WHEN CAST(id AS BIGINT) % 5 = 0 THEN isrc END AS isrc, popularity, CASE WHEN CAST(id AS BIGINT) % 7 = 1 THEN TRUE END AS explicit FROM {tracks_landed} WHERE CAST(id AS BIGINT) % 3 < 2) b USING (id)""")
    add("k06_replace_children", lambda w: merge.replace_children(w["track_artists"], _new_credits(w), "track_id"), "track_id artist_id position#", """
        SELECT * FROM {track_artists} WHERE CAST(track_id AS BIGINT) % 4 <> 1 UNION ALL SELECT track_id, artist_id, position + 1 FROM {track_artists} WHERE CAST(track_id AS BIGINT) % 4 = 1 AND position < 3""")
    add("k08_reconcile", lambda w: merge.reconcile(w["saved_tracks"], w["saved_tracks"].where("cast(track_id as bigint) % 3 > 0").select("track_id"), "track_id", NOW).select("track_id", F.col("removed_at").cast("string").alias("removed_at")), "track_id removed_at", f"SELECT track_id, CASE WHEN CAST(track_id AS BIGINT) % 3 = 0 THEN coalesce(CAST(removed_at AS VARCHAR), '{NOW}') END AS removed_at FROM {{saved_tracks}}")
    add("k11_insert_missing", lambda w: merge.insert_missing(w["mb_genres"].select("name"), w["artist_genres"].select(F.col("genre").alias("name")), ["name"]), "name", "SELECT name FROM {mb_genres} UNION SELECT genre FROM {artist_genres}")
    add("k12_record_misses", lambda w: merge.record_misses(w["tracks_landed"].where("isrc is not null").select("isrc"), w["isrc_recordings"], "isrc", "missing").select("isrc", "recording_mbid", "status"), "isrc recording_mbid status", "SELECT isrc, recording_mbid, status FROM {isrc_recordings} UNION ALL SELECT DISTINCT isrc, NULL, 'missing' FROM {tracks_landed} WHERE isrc IS NOT NULL AND isrc NOT IN (SELECT isrc FROM {isrc_recordings})")
    add("k15_undo_import", lambda w: merge.undo_import(w["plays_landed"], 3).select("id", "import_id"), "id# import_id#", "SELECT id, import_id FROM {plays_landed} WHERE import_id IS DISTINCT FROM 3")
    add("k17_chosen_recordings", lambda w: merge.chosen_recordings(_takes(w)), "isrc recording_mbid candidates#", """
        SELECT isrc, mbid AS recording_mbid, n AS candidates FROM (SELECT isrc, mbid, count(*) OVER (PARTITION BY isrc) AS n, row_number() OVER (PARTITION BY isrc ORDER BY coalesce(d, '9999'), coalesce(m, 0) DESC, mbid) AS k
          FROM (SELECT isrc, id AS mbid, CASE WHEN CAST(id AS BIGINT) % 3 > 0 THEN CAST(1990 + CAST(id AS BIGINT) % 4 AS VARCHAR) END AS d, popularity AS m FROM {tracks_landed} WHERE isrc IS NOT NULL)) WHERE k = 1""")

    # --- streams, and what they agree with in batch
    polled = "SELECT DISTINCT date_trunc('second', played_at) AS played_at, item_uri FROM {plays_landed} WHERE source = 'recent'"
    add("r1_polled_log", _polled_log, "played_at item_uri track_id", f"""
        SELECT CAST(played_at AS VARCHAR) AS played_at, item_uri, coalesce(d.id, r.id) AS track_id FROM (SELECT *, nullif(regexp_extract(item_uri, 'spotify:track:(.+)$', 1), '') AS raw_id FROM ({polled})) p
          LEFT JOIN {{tracks}} d ON d.id = raw_id LEFT JOIN (SELECT linked_from_id, min(id) AS id FROM {{tracks}} WHERE linked_from_id IS NOT NULL GROUP BY 1) r ON r.linked_from_id = raw_id""")
    add("r4_minute_counters", lambda w: streams.minute_counters(_calls(w)), "bucket requests# errors# rate_limited#", "SELECT CAST(date_trunc('minute', ts) AS VARCHAR) AS bucket, count(*) AS requests, count(*) FILTER (event_type IN ('error', 'click')) AS errors, count(*) FILTER (event_type = 'click') AS rate_limited FROM {events} GROUP BY 1")
    add("r5_recent_rate", lambda w: streams.recent_rate(streams.minute_counters(_calls(w)), datetime(2024, 1, 15, 12)).select(F.round("rate", 9).alias("rate")), "rate~", """
        SELECT round(sum(n) / (count(*) * 60.0::DOUBLE), 9) AS rate FROM (SELECT date_trunc('minute', ts) AS m, count(*) AS n FROM {events} WHERE ts >= TIMESTAMP '2024-01-15 10:01:00' GROUP BY 1 ORDER BY 1 DESC LIMIT 3)""")
    add("r7_listening_sessions", lambda w: streams.listening_sessions(raw_plays(w)), "started_at ended_at plays#", """
        SELECT CAST(min(played_at) AS VARCHAR) AS started_at, CAST(max(played_at) + INTERVAL 30 MINUTE AS VARCHAR) AS ended_at, count(*) AS plays FROM
          (SELECT played_at, sum(CASE WHEN gap < INTERVAL 30 MINUTE THEN 0 ELSE 1 END) OVER (ORDER BY played_at, id) AS run FROM (SELECT id, played_at, played_at - lag(played_at) OVER (ORDER BY played_at, id) AS gap FROM {plays})) GROUP BY run""")

    # --- the other merge rules
    number = "CAST(id AS BIGINT)"
    add("k05_upsert_detail", lambda w: merge.upsert_detail(_brief(w), w["tracks_landed"].where("cast(id as bigint) % 2 = 0").select("id", F.upper("name").alias("name"), F.lit(99).alias("popularity"), "detail_level"), ["id"], "simplified"), "id name popularity# detail_level", f"""
        SELECT id, CASE WHEN {number} % 2 = 0 THEN upper(name) ELSE name END AS name, CASE WHEN {number} % 5 > 0 THEN popularity END AS popularity, CASE WHEN {number} % 5 > 0 AND detail_level = 'full' THEN 'full' WHEN {number} % 5 > 0 OR {number} % 2 = 0 THEN 'simplified' END AS detail_level
        FROM {{tracks_landed}} WHERE {number} % 5 > 0 OR {number} % 2 = 0""")
    add("k07_playlist_replace", lambda w: merge.replace_playlists(_items(w), _items(w).where("playlist_id % 3 = 1 and position < 2"), w["playlists"].where("cast(id as int) % 3 = 1").select(F.col("id").cast("int").alias("playlist_id"))), "playlist_id# position# track_id", "SELECT CAST(playlist_id AS INT) AS playlist_id, position, track_id FROM {playlist_tracks} WHERE CAST(playlist_id AS INT) % 3 <> 1 OR position < 2")
    add("k09_sticky_flags", lambda w: merge.upsert(_tags(w), _tags(w).withColumn("is_genre", F.col("tag").startswith("s")), ["entity_mbid", "tag"], sticky=("is_genre",)), "entity_mbid tag is_genre", "SELECT entity_mbid, tag, is_genre OR tag LIKE 's%' AS is_genre FROM {mb_tags} WHERE entity_type = 'recording'")
    add("k10_overwrite", lambda w: merge.upsert(_audio(w), _audio(w).where("bpm > 130").withColumn("bpm", F.lit(None).cast("double")), ["recording_mbid"], overwrite=("bpm",)), "recording_mbid bpm~", "SELECT recording_mbid, CASE WHEN bpm <= 130 THEN bpm END AS bpm FROM {audio_features}")
    add("k13_latest_payloads", lambda w: merge.latest_payloads(w["events"].select(F.col("event_type").alias("entity_type"), F.col("user_id").alias("entity_id"), F.col("ts").alias("fetched_at"), F.col("props").alias("payload"))).drop("fetched_at"), "entity_type entity_id# payload", "SELECT event_type AS entity_type, user_id AS entity_id, arg_max(props, ts) AS payload FROM {events} GROUP BY 1, 2")
    add("k16_distinct_names", lambda w: w["nation"].join(w["region"], F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name").toDF(*distinct_names(["name", "name"])), "name name_2", "SELECT n_name AS name, r_name AS name_2 FROM {nation} JOIN {region} ON r_regionkey = n_regionkey")
    add("k18_retention", lambda w: merge.expired_removed(w["events"].select("event_id", "ts"), "ts", HIST.start).select("event_id"), "event_id#", f"SELECT event_id FROM {{events}} WHERE ts >= TIMESTAMP '{HIST.start}'")
    add("x09_fresh_entities", lambda w: work.fresh_entities(_fetched(w), NOW), "id", f"SELECT c_name AS id FROM (SELECT c_name, c_custkey, max(o_orderdate) AS newest FROM {{customer}} JOIN {{orders}} ON o_custkey = c_custkey GROUP BY 1, 2) WHERE c_custkey % 2 = 0 AND newest > TIMESTAMP '{NOW}' - INTERVAL 30 DAY")
    add("x13_reset_misses", lambda w: merge.reset_misses(w["isrc_recordings"], "not_found").select("isrc"), "isrc", "SELECT isrc FROM {isrc_recordings} WHERE status <> 'not_found'")
    add("x14_stage_counters", lambda w: merge.upsert(w["enrich_stages"].select("key", "requests"), w["enrich_stages"].select(F.when(F.col("key") == "artists", "audio").otherwise(F.col("key")).alias("key"), F.lit(5).alias("requests")), ["key"], add=("requests",)), "key requests#", "SELECT key, sum(n) AS requests FROM (SELECT key, requests AS n FROM {enrich_stages} UNION ALL SELECT CASE WHEN key = 'artists' THEN 'audio' ELSE key END, 5 FROM {enrich_stages}) GROUP BY 1")
    add("m1_phase_rates", lambda w: work.phase_rates(w["sync_phases"], NOW).select("key", F.round("rate", 12).alias("rate"), F.round("eta_seconds", 3).alias("eta_seconds")), "key rate~ eta_seconds~", f"""
        SELECT key, round(CASE WHEN done > 0 THEN done / greatest(epoch(coalesce(finished_at, TIMESTAMP '{NOW}')) - epoch(started_at), 1) END, 12) AS rate,
          round(CASE WHEN done > 0 AND total > done THEN (total - done) / (done / greatest(epoch(TIMESTAMP '{NOW}') - epoch(started_at), 1)) END, 3) AS eta_seconds FROM {{sync_phases}}""")
    add("m5_scope_start", lambda w: w["library_canonical"].agg(F.coalesce(F.min("first_added_at"), F.lit(EARLIEST)).alias("start")), "start", "SELECT CAST(min(first_added_at) AS VARCHAR) AS start FROM {library_canonical}")
    add("f_similarity", lambda w: w["part"].select("p_partkey", F.round(text.similarity(F.col("p_name"), F.lit("red widget")), 9).alias("similarity")), "p_partkey# similarity~", """
        WITH grams AS (SELECT n, list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower(n), '[^a-z0-9]+'), lambda x: x <> ''), lambda x: list_transform(range(1, len(x) + 2), lambda i: substr('  ' || x || ' ', i, 3))))) AS g FROM (SELECT p_name AS n FROM {part} UNION SELECT 'red widget'))
        SELECT p_partkey, round(len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g)))::DOUBLE, 9) AS similarity FROM {part} JOIN grams a ON a.n = p_name CROSS JOIN (SELECT g FROM grams WHERE n = 'red widget') b""")

    # --- text functions over whole texts
    add("f_norm_title", lambda w: w["documents"].select("doc_id", F.md5(text.norm_title(F.col("text"))).alias("digest")), "doc_id# digest", f"SELECT doc_id, md5({title('text')}) AS digest FROM {{documents}}")
    add("f_norm_name", lambda w: w["documents"].select("doc_id", F.md5(text.norm_name(F.col("text"))).alias("digest")), "doc_id# digest", f"SELECT doc_id, md5({name('text')}) AS digest FROM {{documents}}")
    add("f_plain_text", lambda w: w["pages"].select("page_id", F.md5(text.plain_text(F.col("html"), False)).alias("digest")), "page_id# digest", r"""
        SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]*>', '', 'g'), '&lt;', '<', 'gi'), '&gt;', '>', 'gi'), '&quot;', '"', 'gi'), '&apos;', '''', 'gi'), '&nbsp;', ' ', 'gi'), '&amp;', '&', 'gi'), '\s+', ' ', 'g'))) AS digest FROM {pages}""")
    # Numeric entities: each distinct one of a text is replaced in turn.
    decoded = r"""
        SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(list_reduce(list_prepend(bare, list_distinct(regexp_extract_all(bare, '&#(?:x[0-9a-fA-F]+|[0-9]+);'))),
            lambda t, e: CASE WHEN t = e THEN t ELSE replace(t, e, chr(CAST(CASE WHEN e LIKE '&#x%' THEN '0x' || e[4:-2] ELSE e[3:-2] END AS INT))) END), '&lt;', '<', 'gi'), '&gt;', '>', 'gi'), '&quot;', '"', 'gi'), '&apos;', '''', 'gi'), '&nbsp;', ' ', 'gi'), '&amp;', '&', 'gi'), '\s+', ' ', 'g'))) AS digest
        FROM (SELECT page_id, regexp_replace(MARKUP, '<[^>]*>', '', 'g') AS bare FROM {pages})"""
    add("f_plain_text_numeric", lambda w: w["pages"].select("page_id", F.md5(text.plain_text(F.col("html"))).alias("digest")), "page_id# digest", decoded.replace("MARKUP", "html"))
    add("f_plain_text_coded", lambda w: w["pages"].select("page_id", F.md5(text.plain_text(_coded())).alias("digest")), "page_id# digest", decoded.replace("MARKUP", "html || '&#' || (page_id % 50 + 8364) || '; &amp;&#x' || printf('%X', page_id % 50 + 945) || ';&#38;lt;'"))
    add("f_link_target", lambda w: w["pages"].select("page_id", text.link_target(F.col("url")).alias("target")).select("page_id", F.col("target.kind").alias("kind"), F.col("target.id").alias("id")), "page_id# kind id", r"""
        SELECT page_id, CASE WHEN regexp_matches(url, u) THEN regexp_extract(url, u, 1) WHEN regexp_matches(url, w) THEN regexp_extract(url, w, 1) END AS kind, CASE WHEN regexp_matches(url, u) THEN regexp_extract(url, u, 2) WHEN regexp_matches(url, w) THEN regexp_extract(url, w, 2) END AS id
        FROM (SELECT *, '^spotify:(track|album|artist|playlist|user):([A-Za-z0-9]+)$' AS u, 'open\.spotify\.com/(?:intl-[a-z][a-z]/)?(track|album|artist|playlist|user)/([A-Za-z0-9]+)' AS w FROM {pages})""")
    add("f_music_labels", lambda w: w["audio_features"].select("recording_mbid", music.musical_key(F.col("key_key"), F.col("key_scale")).alias("key"), music.camelot(F.col("key_key"), F.col("key_scale")).alias("camelot"), music.tempo_label(F.col("bpm")).alias("tempo")), "recording_mbid key camelot tempo", """
        SELECT recording_mbid, replace(key_key, '#', '♯') || ' ' || key_scale AS key, CASE key_key || ' ' || key_scale WHEN 'C# minor' THEN '12A' WHEN 'C# major' THEN '3B' WHEN 'A minor' THEN '8A' WHEN 'A major' THEN '11B' END AS camelot,
          CASE WHEN bpm < 70 THEN 'slow' WHEN bpm < 100 THEN 'mid-tempo' WHEN bpm < 125 THEN 'upbeat' WHEN bpm < 145 THEN 'fast' ELSE 'very fast' END AS tempo FROM {audio_features}""")

    # --- chart statistics
    days = f"SELECT CAST({PLAYED} AS DATE) AS d, {whole(HEARD)} AS n FROM {{plays}} WHERE {P} GROUP BY 1"
    per_day = lambda w: listening.minutes_by_day(w, HIST)
    add("c1_summary", lambda w: charts.summary(w["canonical_tracks"], "duration_ms"), "n# low# high# mean~ median~", "SELECT count(*) AS n, min(duration_ms) AS low, max(duration_ms) AS high, avg(duration_ms) AS mean, median(duration_ms) AS median FROM {canonical_tracks}")
    add("c1_histogram", lambda w: charts.histogram(w["canonical_tracks"], "duration_ms", 0.0, 20000.0), "bin~ count#", "SELECT duration_ms // 20000 * 20000 AS bin, count(*) AS count FROM {canonical_tracks} GROUP BY 1")
    add("c2_weighted_summary", lambda w: charts.summary(library.track_durations(w, LIB), "bucket", "count"), "n# low# high# mean~ median~", f"SELECT count(*) AS n, min(b) AS low, max(b) AS high, avg(b) AS mean, median(b) AS median FROM (SELECT duration_ms // 30000 * 30 AS b FROM {{library_canonical}} WHERE duration_ms BETWEEN 1 AND 1800000 AND {L})")
    add("c3_donut", lambda w: charts.donut(genres.sizes(_since(w)), "genre", "tracks", 5), "label value# place# share~", """
        WITH v AS (SELECT genre, count(*) AS tracks FROM {library_edges} GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY tracks DESC, genre) AS k FROM v)
        SELECT CASE WHEN k > 5 THEN 'Other (' || (SELECT count(*) - 5 FROM v) || ')' ELSE genre END AS label, sum(tracks) AS value, least(6, min(k)) AS place, sum(tracks) / (SELECT sum(tracks) FROM v)::DOUBLE AS share FROM r GROUP BY 1""")
    add("c4_bar_shares", lambda w: charts.bar_shares(listening.device_share({"plays": heard_plays(w)}, HIST), "label", "value"), "label value# share~", f"SELECT label, value, value / (sum(value) OVER ())::DOUBLE AS share FROM (SELECT {DEVICE} AS label, {whole(HEARD)} AS value FROM {{plays}} WHERE {P} GROUP BY 1 HAVING sum({HEARD}) > 0)")
    add("c5_heat_thresholds", lambda w: charts.heat_thresholds(per_day(w), "value").select(F.size("thresholds").alias("steps"), F.round(F.col("thresholds")[3], 6).alias("top")), "steps# top~", f"SELECT 4 AS steps, round(quantile_cont(n, pow(0.8, 0.45)), 6) AS top FROM ({days}) WHERE n > 0")
    add("c6_calendar", lambda w: charts.calendar(per_day(w), "day", "value", "2024-01-01", "2024-02-04"), "day value# week# weekday#", f"""
        SELECT CAST(s.d AS VARCHAR) AS day, coalesce(n, 0) AS value, (s.d - DATE '2024-01-01') // 7 AS week, isodow(s.d) - 1 AS weekday FROM (SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-02-04', INTERVAL 1 DAY)) AS DATE) AS d) s LEFT JOIN ({days}) x ON x.d = s.d""")
    add("c7_cumulative", lambda w: charts.cumulative(library.year_ranks(_yearly(w), w, LIB, 10).select("period", "key", "value"), ["key"], "period", "value"), "period# key value# running#", f"SELECT *, sum(value) OVER (PARTITION BY key ORDER BY period) AS running FROM (SELECT period, key, value FROM ({ranks(yearly, LIB)}))")
    add("c8_median_gap", lambda w: charts.median_gap(library.release_years(w, LIB), "bucket"), "median_gap~", f"SELECT median(gap) AS median_gap FROM (SELECT b - lag(b) OVER (ORDER BY b) AS gap FROM (SELECT DISTINCT year(earliest_release_date) AS b FROM {{library_rows}} WHERE earliest_release_date IS NOT NULL AND {L}))")
    add("c9_bump_series", lambda w: charts.bump_series(library.top_artists_by_year(w, LIB), 5).select("period", "key", "rank", "place"), "period# key rank# place#", f"""
        WITH s AS (SELECT * FROM ({ranks(yearly, LIB)}) WHERE rank <= 5), f AS (SELECT key, min(period * 1000 + rank) AS first FROM s GROUP BY 1) SELECT period, key, rank, place FROM s JOIN (SELECT key, row_number() OVER (ORDER BY first, key) AS place FROM f) USING (key)""")
    add("c10_sparkline", lambda w: charts.sparkline(library.growth(_since(w), LIB), "period", "cumulative"), "first# last# points# change~", f"""
        SELECT arg_min(c, period) AS first, arg_max(c, period) AS last, count(*) AS points, (arg_max(c, period) - arg_min(c, period)) * 100.0::DOUBLE / arg_min(c, period) AS change FROM (SELECT strftime(m, '%Y-%m') AS period, (SELECT count(*) FROM {{library_canonical}} WHERE first_added_at < least(TIMESTAMP '{LIB.end}', (m + INTERVAL 1 MONTH)::TIMESTAMP AT TIME ZONE '{ZONE}' AT TIME ZONE 'UTC')) AS c FROM ({spine(LIB)}) ORDER BY m DESC LIMIT 24)""")
    add("c11_chip_sizes", lambda w: charts.chip_sizes(genres.vocabulary(w), "genre", "tracks"), "label size~", "SELECT genre AS label, sqrt(n / (max(n) OVER ())::DOUBLE) AS size FROM (SELECT genre, count(*) AS n FROM {library_edges} GROUP BY 1)")
    add("c12_outside_minutes", lambda w: charts.history_figures(listening.listening_by_month(w, HIST), listening.listening_totals(w, HIST))[0], "period outside_minutes#", f"""
        SELECT strftime(m, '%Y-%m') AS period, greatest(0, a - b) AS outside_minutes FROM (SELECT date_trunc('month', {PLAYED}) AS m, {whole(HEARD)} AS a, {whole(f'CASE WHEN l.canonical_track_id IS NOT NULL THEN {HEARD} END')} AS b
           FROM {{plays}} p LEFT JOIN {{tracks}} t ON t.id = p.track_id LEFT JOIN {{library_canonical}} l ON l.canonical_track_id = t.canonical_track_id WHERE {P} GROUP BY 1)""")
    landing.register(add, window, HIST, NOW)
    for key, (query, same) in upkeep.QUERIES.items():
        shown = ("first_added_at", "latest_added_at", "first_played_at", "last_played_at", "earliest_release_date")
        _ENTRIES[key] = (lambda w, query=query: (df := query(w)).withColumns({c: F.col(c).cast("string") for c in shown if c in df.columns}), _ENTRIES[same][1])
    add("c13_trailing_mean", lambda w: charts.trailing_mean(per_day(w), "day", "value"), "day value# trailing_mean~", f"SELECT CAST(d AS VARCHAR) AS day, n AS value, avg(n) OVER (ORDER BY d ROWS 2 PRECEDING) AS trailing_mean FROM ({days})")


NAMES = ("canonical_tracks", "canonical_play_stats", "library_canonical", "isrc_recordings", "audio_features", "artist_musicbrainz", "mb_artists", "album_musicbrainz", "canonical_track_artists")


def _dated(w: Warehouse) -> dict[str, DataFrame]:
    from ..functions.times import ragged_date

    names = ("canonical_tracks", "isrc_recordings", "audio_features", "mb_tags", "mb_genres", "artist_musicbrainz", "mb_artists", "album_musicbrainz", "mb_releases", "mb_release_groups", "artists", "albums")
    return {n: w[n] for n in names} | {"mb_recordings": w["mb_recordings"].withColumn("first_release_date_start", ragged_date(F.col("first_release_date")))}


def _batch(w: Warehouse) -> DataFrame:
    one = w["plays_landed"].select((F.col("id") + F.when(F.col("id") % 3 == 0, 10_000_000).otherwise(0)).alias("id"), "played_at", "item_uri", "ms_played")
    return one.unionByName(one.withColumn("id", F.col("id") + 20_000_000))


def _track_halves(w: Warehouse) -> tuple[DataFrame, DataFrame, list[str]]:
    rows, number = w["tracks_landed"].select("id", "name", "isrc", "popularity", "explicit"), F.col("id").cast("long")
    new = rows.where(number % 3 < 2).withColumns({"name": F.upper("name"), "isrc": F.when(number % 5 == 0, F.col("isrc")), "explicit": F.when(number % 7 == 1, F.lit(True))})
    return rows.where(number % 3 > 0), new, ["id"]


def _new_credits(w: Warehouse) -> DataFrame:
    return w["track_artists"].where((F.col("track_id").cast("long") % 4 == 1) & (F.col("position") < 3)).withColumn("position", F.col("position") + 1)


def _liked_page(w: Warehouse, page, q) -> DataFrame:
    limit, offset, wanted = entities.page_params(page, q)
    return entities.liked_tracks(w, "plays", limit=limit, offset=offset, q=wanted, filters={"explicit": "no"})


def _coded():
    """The pages' markup with numeric entities behind it, one of which spells another entity's first character."""
    return F.concat("html", F.lit("&#"), (F.col("page_id") % 50 + 8_364).cast("string"), F.lit("; &amp;&#x"), F.hex(F.col("page_id") % 50 + 945), F.lit(";&#38;lt;"))


def _takes(w: Warehouse) -> DataFrame:
    number = F.col("id").cast("long")
    return w["tracks_landed"].where("isrc is not null").select("isrc", F.col("id").alias("mbid"), F.when(number % 3 > 0, (1990 + number % 4).cast("string")).alias("first_release_date"), F.col("popularity").alias("length_ms"))


def _yearly(w: Warehouse) -> DataFrame:
    from ..functions.listening import within
    from ..functions.times import local_year

    rows = w["library_canonical"].where(within("first_added_at", LIB.padded())).join(library.headline_credits(w), "canonical_track_id")
    return rows.groupBy(local_year(F.col("first_added_at"), ZONE).alias("yr"), "artist_id").agg(F.count(F.lit(1)).alias("n"))


def _calls(w: Warehouse) -> DataFrame:
    status = F.when(F.col("event_type") == "error", 500).when(F.col("event_type") == "click", 429).otherwise(200)
    return w["events"].select(F.col("ts").alias("at"), status.alias("status"))


def _polled_log(w: Warehouse) -> DataFrame:
    """Lands the polled plays as JSON, runs the stream over them and reads the log it leaves."""
    folder = f"{shared_dir(w.spark)}/polls-{uuid.uuid4().hex}"
    track = F.struct(F.col("track_id").alias("id"), F.col("item_uri").alias("uri"), F.col("track_name").alias("name"))
    items = w["plays_landed"].where("source = 'recent'").select("played_at", track.alias("track"))
    items.write.option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(f"{folder}/landing")
    log = streams.PlayLog(w.spark, f"{folder}/log")
    streams.poll_stream(w.spark, f"{folder}/landing", log, w["tracks"], f"{folder}/checkpoint").awaitTermination()
    return log.read().select("played_at", "item_uri", "track_id")


def _brief(w: Warehouse) -> DataFrame:
    return w["tracks_landed"].where("cast(id as bigint) % 5 > 0").select("id", "name", "popularity", "detail_level")


def _items(w: Warehouse) -> DataFrame:
    return w["playlist_tracks"].select(F.col("playlist_id").cast("int").alias("playlist_id"), "position", "track_id")


def _tags(w: Warehouse) -> DataFrame:
    return w["mb_tags"].where("entity_type = 'recording'").select("entity_mbid", "tag", "is_genre")


def _audio(w: Warehouse) -> DataFrame:
    return w["audio_features"].select("recording_mbid", "bpm")


def _fetched(w: Warehouse) -> DataFrame:
    at = w["customer"].join(w["orders"], F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_name").alias("id"), "c_custkey").agg(F.max("o_orderdate").alias("fetched_at"))
    return at.select("id", "fetched_at", F.when(F.col("c_custkey") % 2 == 0, "full").otherwise("simplified").alias("detail_level"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    if not _ENTRIES:
        register()
    return {k: (lambda spark, folder, f=f: flat(f(warehouse(spark, folder)))) for k, (f, _) in _ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    if not _ENTRIES:
        register()
    return {k: sql for k, (_, sql) in _ENTRIES.items() if sql}

"""Star-schema test tables in the shape of a media library.

Each text is one SELECT over the tables in braces, in SQL that Spark and DuckDB both read, so that a query
and the SQL it is held against begin at the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STAR = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
DATED = "CROSS JOIN (SELECT min(o_orderdate) AS first_day, max(o_orderdate) AS last_day FROM {orders}) AS dated"
ALBUM_OF = "CASE WHEN p_size = 50 THEN 'solo/' || CAST(p_partkey AS STRING) ELSE p_brand || '/' || CAST(p_partkey % 8 AS STRING) END"
CODE = "CASE WHEN p_partkey % 20 <> 0 THEN p_brand || '-' || CAST(p_size AS STRING) END"
K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)"

TABLES = {
    "plays_landed": f"""
        SELECT event_id AS id, ts AS played_at, CASE WHEN event_type <> 'error' THEN CAST(floor(value * 1000) AS INT) END AS ms_played, CAST(NULL AS INT) AS estimated_ms,
          CASE WHEN event_id % 50 = 0 THEN 'episode' ELSE 'track' END AS item_kind,
          CASE WHEN event_id % 50 = 0 THEN 'spotify:episode:' ELSE 'spotify:track:' END || CAST(user_id + CASE WHEN event_id % 60 = 7 THEN 1000000 WHEN event_id % 60 = 8 THEN 5000000 ELSE 0 END AS STRING) AS item_uri,
          CASE WHEN event_id % 50 = 0 OR event_id % 4 = 3 OR event_id % 60 IN (7, 8) THEN NULL ELSE CAST(user_id AS STRING) END AS track_id,
          CASE WHEN event_id % 60 = 8 THEN ts END AS resolve_attempted_at,
          CASE WHEN event_id % 50 <> 0 THEN 'Title ' || CAST(user_id AS STRING) END AS track_name, 'Singer ' || CAST(user_id % 9 AS STRING) AS artist_name, CAST(NULL AS STRING) AS album_name,
          CASE WHEN event_id % 100 = 0 THEN 'Episode 100%' END AS episode_name, CASE WHEN event_id % 50 = 0 THEN 'Show' END AS show_name,
          CASE {K} % 9 WHEN 0 THEN 'iOS 17.2 (iPhone14)' WHEN 1 THEN 'Partner web_player' WHEN 2 THEN 'web_player windows' WHEN 3 THEN 'Windows 10' WHEN 4 THEN 'OS X 12' WHEN 5 THEN 'linux' WHEN 6 THEN 'Android 13' WHEN 7 THEN 'BeOS' END AS platform,
          CASE {K} % 5 WHEN 0 THEN 'SE' WHEN 1 THEN 'DE' WHEN 2 THEN 'ZZ' WHEN 3 THEN 'US' END AS conn_country,
          'clickrow' AS reason_start, CASE WHEN {K} % 10 <> 0 THEN event_type END AS reason_end, event_id % 2 = 0 AS shuffle,
          CASE WHEN event_type = 'error' THEN 'recent' ELSE 'extended' END AS source, event_id % 5 AS import_id
        FROM {{events}}""",
    "tracks_landed": f"""
        SELECT CAST(p_partkey AS STRING) AS id, CASE p_partkey % 6 WHEN 0 THEN p_name || ' - Remastered 2011' WHEN 1 THEN upper(p_name) || ' (feat. X)' ELSE p_name END AS name,
          {ALBUM_OF} AS album_id, 5000 * p_size AS duration_ms, CAST(1 + p_partkey % 2 AS INT) AS disc_number, CAST(p_partkey AS INT) AS track_number, p_partkey % 7 = 0 AS explicit,
          CASE WHEN p_partkey % 19 <> 0 THEN p_size END AS popularity, {CODE} AS isrc, p_partkey % 97 = 5 AS is_local,
          CASE WHEN p_partkey % 3 = 0 THEN CAST(p_partkey + 1000000 AS STRING) END AS linked_from_id, CASE WHEN p_partkey % 3 = 1 THEN 'simplified' ELSE 'full' END AS detail_level
        FROM {{part}}""",
    "albums_landed": f"""
        SELECT id, 'Album ' || title AS name, CASE n % 5 WHEN 0 THEN 'compilation' WHEN 1 THEN 'single' WHEN 2 THEN NULL ELSE 'album' END AS album_type,
          CASE n % 7 WHEN 0 THEN '1995' WHEN 1 THEN '1996-03' WHEN 2 THEN '1994-02-14' WHEN 3 THEN '1997-02-30' WHEN 4 THEN NULL WHEN 5 THEN '0000' ELSE '1998-13' END AS release_date, 'day' AS release_date_precision,
          CAST(size + n % 3 - 1 AS INT) AS total_tracks, CASE WHEN n % 7 <> 3 THEN 'Label ' || CAST(n % 6 AS STRING) END AS label, CAST(n % 100 AS INT) AS popularity, CAST(NULL AS STRING) AS upc,
          CASE WHEN n % 2 = 0 THEN 'full' ELSE 'simplified' END AS detail_level, CASE WHEN n % 4 > 0 THEN 'SE,DE' END AS markets, CAST(n AS BIGINT) AS number
        FROM (SELECT {ALBUM_OF} AS id, min(p_name) AS title, min(p_partkey) AS n, count(*) AS size FROM {{part}} GROUP BY 1) AS grouped""",
    "track_artists": """
        SELECT CAST(l_partkey AS STRING) AS track_id, CAST(l_suppkey AS STRING) AS artist_id, CAST(row_number() OVER (PARTITION BY l_partkey ORDER BY l_suppkey) - 1 AS INT) AS position
        FROM (SELECT DISTINCT l_partkey, l_suppkey FROM {lineitem}) AS pairs""",
    "artists": """
        SELECT CAST(s_suppkey AS STRING) AS id, s_name AS name, CASE WHEN s_suppkey % 9 <> 0 THEN CAST(s_suppkey % 100 AS INT) END AS popularity, CAST(s_suppkey * 37 % 1000 AS INT) AS followers_total, n_name AS country,
          CASE WHEN s_suppkey % 2 = 0 THEN 'full' ELSE 'simplified' END AS detail_level
        FROM {supplier} JOIN {nation} ON n_nationkey = s_nationkey""",
    "artist_genres": """
        SELECT CAST(s_suppkey AS STRING) AS artist_id, lower(r_name) AS genre FROM {supplier} JOIN {nation} ON n_nationkey = s_nationkey JOIN {region} ON r_regionkey = n_regionkey
        UNION ALL SELECT CAST(s_suppkey AS STRING), lower(n_name) FROM {supplier} JOIN {nation} ON n_nationkey = s_nationkey""",
    "album_artists": """
        SELECT album_id, artist_id, CAST(row_number() OVER (PARTITION BY album_id ORDER BY artist_id DESC) - 1 AS INT) AS position
        FROM (SELECT DISTINCT t.album_id, c.artist_id FROM {track_artists} AS c JOIN {tracks_landed} AS t ON t.id = c.track_id WHERE c.position = 0) AS pairs""",
    "album_images": """
        SELECT id AS album_id, position, 'img/' || id || '/' || CAST(width AS STRING) AS url, width FROM {albums_landed} CROSS JOIN (VALUES (0, 640), (1, 300), (2, 64)) AS sizes(position, width)
        WHERE number % 6 <> 0 OR width < 100""",
    "album_genres": "SELECT id AS album_id, 'style ' || CAST(number % 4 AS STRING) AS genre FROM {albums_landed}",
    "canonical_overrides": "SELECT CAST(p_partkey AS STRING) AS track_id, 'fix:' || CAST(p_partkey % 3 AS STRING) AS canonical_track_id, 'by hand' AS reason FROM {part} WHERE p_partkey % 101 = 3",
    "saved_tracks": """
        SELECT CAST(l_partkey AS STRING) AS track_id, CASE WHEN l_partkey % 2 = 0 THEN first_day + INTERVAL '23' HOUR ELSE first_day END AS added_at, CASE WHEN l_partkey % 13 = 0 THEN last_day END AS removed_at
        FROM (SELECT l_partkey, min(l_shipdate) AS first_day, max(l_shipdate) AS last_day FROM {lineitem} WHERE l_returnflag = 'R' AND l_quantity > 45 GROUP BY l_partkey) AS liked""",
    "playlists": """
        SELECT CAST(c_custkey AS STRING) AS id, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN 'for the ' || lower(c_mktsegment) END AS description, CASE WHEN c_mktsegment = 'BUILDING' THEN 'me' ELSE CAST(c_nationkey AS STRING) END AS owner_id,
          c_mktsegment = 'BUILDING' AS is_owned, c_custkey % 5 = 0 AS collaborative, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey % 4 = 1 END AS public, 's' || CAST(c_custkey % 7 AS STRING) AS snapshot_id,
          CASE WHEN c_custkey % 3 <> 0 THEN 's' || CAST(c_custkey % 5 AS STRING) END AS items_synced_snapshot_id, CAST(c_custkey % 50 AS INT) AS total_tracks, CASE WHEN c_custkey % 17 = 0 THEN last_day END AS removed_at
        FROM {customer} """ + DATED,
    "playlist_tracks": """
        SELECT CAST(o_custkey AS STRING) AS playlist_id,
          CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) - 1 AS INT) AS position,
          CASE WHEN l_orderkey % 41 <> 0 THEN CAST(l_partkey AS STRING) END AS track_id, CASE WHEN l_linenumber <> 7 THEN o_orderdate END AS added_at, CAST(l_suppkey % 25 AS STRING) AS added_by_id, l_orderkey % 43 = 0 AS is_local,
          CASE WHEN l_orderkey % 82 = 0 THEN 'Local ' || CAST(l_partkey AS STRING) END AS local_name, CASE WHEN l_orderkey % 82 = 0 THEN 'Somebody' END AS local_artist
        FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey""",
    "users": "SELECT 'me' AS id, 'Me' AS display_name UNION ALL SELECT CAST(n_nationkey AS STRING), n_name FROM {nation} WHERE n_nationkey < 20",
    "saved_albums": "SELECT id AS album_id, first_day AS added_at, CASE WHEN number % 8 = 1 THEN last_day END AS removed_at FROM {albums_landed} " + DATED + " WHERE number % 4 = 1",
    "followed_artists": "SELECT CAST(s_suppkey AS STRING) AS artist_id, first_day AS first_seen_at, CASE WHEN s_suppkey % 10 = 0 THEN last_day END AS removed_at FROM {supplier} " + DATED + " WHERE s_suppkey % 5 = 0",
    "isrc_recordings": """
        SELECT isrc, CASE WHEN size % 4 <> 0 THEN 'rec-' || isrc END AS recording_mbid, CASE WHEN size % 4 <> 0 THEN 'found' ELSE 'not_found' END AS status
        FROM (SELECT isrc, CAST(max(duration_ms) / 5000 AS BIGINT) AS size FROM {tracks_landed} WHERE isrc IS NOT NULL GROUP BY isrc) AS codes WHERE size % 10 <> 9""",
    "mb_tags": f"""
        SELECT 'recording' AS entity_type, 'rec-' || code AS entity_mbid, tag, CAST(count(*) AS INT) AS count, max(p_size) % 2 = 0 AS is_genre
        FROM (SELECT {CODE} AS code, p_size, regexp_extract(p_name, '^([a-z]+)', 1) AS tag FROM {{part}} UNION ALL SELECT {CODE}, p_size, regexp_extract(p_name, '([a-z]+)$', 1) FROM {{part}}) AS words
        WHERE code IS NOT NULL GROUP BY 2, 3
        UNION ALL SELECT 'artist', 'art-' || artist_id, genre, 3, TRUE FROM {{artist_genres}}
        UNION ALL SELECT 'release_group', 'rg-' || CAST(r_regionkey AS STRING), lower(r_name), 2, TRUE FROM {{region}}
        UNION ALL SELECT 'release', 'rel-' || id, 'style ' || CAST(number % 4 AS STRING), 1, number % 3 = 0 FROM {{albums_landed}}""",
    "mb_genres": "SELECT DISTINCT regexp_extract(p_name, '^([a-z]+)', 1) AS name, first_day AS fetched_at FROM {part} " + DATED,
    "mb_recordings": "SELECT recording_mbid AS mbid, 'Work ' || isrc AS title, CASE WHEN length(isrc) % 2 = 0 THEN 180000 END AS length_ms, CASE WHEN isrc LIKE '%1' THEN '1991-05' ELSE '1993' END AS first_release_date FROM {isrc_recordings} WHERE recording_mbid IS NOT NULL",
    "mb_recording_artists": """
        SELECT 'rec-' || t.isrc AS recording_mbid, 'art-' || c.artist_id AS artist_mbid, CASE WHEN CAST(c.artist_id AS INT) % 3 = 0 THEN upper(a.name) ELSE 'Unknown' END AS credit_name, CAST(c.position AS INT) AS position
        FROM (SELECT isrc, min(id) AS id FROM {tracks_landed} WHERE isrc IS NOT NULL GROUP BY isrc) AS t JOIN {track_artists} AS c ON c.track_id = t.id JOIN {artists} AS a ON a.id = c.artist_id""",
    "mb_artists": "SELECT 'art-' || id AS mbid, CASE WHEN CAST(id AS INT) % 5 = 1 THEN lower(name) ELSE 'Someone' END AS name, country, 'Group' AS type, CASE WHEN CAST(id AS INT) % 4 = 0 THEN 'full' ELSE 'stub' END AS detail_level FROM {artists}",
    "artist_musicbrainz": """
        SELECT id AS artist_id, CASE WHEN CAST(id AS INT) % 4 <> 1 THEN 'art-' || id END AS mbid, CASE WHEN CAST(id AS INT) % 4 <> 1 THEN 'matched' ELSE 'not_found' END AS status, 'url' AS source
        FROM {artists} WHERE CAST(id AS INT) % 4 < 3""",
    "album_musicbrainz": "SELECT id AS album_id, CASE WHEN number % 3 = 0 THEN 'rel-' || id END AS release_mbid, CASE WHEN number % 3 = 0 THEN 'matched' ELSE 'not_found' END AS status FROM {albums_landed} WHERE number % 3 <> 2",
    "mb_releases": "SELECT 'rel-' || id AS mbid, name AS title, 'SE' AS country, label AS label_name, CASE WHEN number % 2 = 0 THEN 'rg-' || CAST(number % 7 AS STRING) END AS release_group_mbid FROM {albums_landed}",
    "mb_release_groups": "SELECT 'rg-' || CAST(r_regionkey AS STRING) AS mbid, r_name AS title, 'Album' AS primary_type FROM {region}",
    "audio_features": """
        SELECT recording_mbid, CASE WHEN isrc LIKE '%3' THEN 'missing' ELSE 'ok' END AS status, CAST(60 + length(isrc) * 8 AS DOUBLE) AS bpm, CASE WHEN isrc LIKE '%1' THEN 'C#' ELSE 'A' END AS key_key,
          CASE WHEN isrc LIKE '%2' THEN 'minor' ELSE 'major' END AS key_scale, CAST(length(isrc) AS DOUBLE) / 16 AS happy
        FROM {isrc_recordings} WHERE recording_mbid IS NOT NULL AND isrc NOT LIKE '%7'""",
    "genre_collections": """
        SELECT id, name, match, 'added' AS sort, 100 AS track_limit, auto AS auto_sync, CASE WHEN id = 'both' THEN first_day ELSE last_day END AS updated_at
        FROM (SELECT 'some' AS id, 'Some' AS name, 'any' AS match, TRUE AS auto UNION ALL SELECT 'both', 'Both', 'all', TRUE UNION ALL SELECT 'none', 'None', 'any', TRUE UNION ALL SELECT 'odd', 'Odd', 'all', FALSE) AS given """ + DATED,
    "genre_collection_genres": "SELECT * FROM (VALUES ('some', 'red'), ('some', 'widget'), ('both', 'red'), ('both', 'widget'), ('odd', 'red'), ('odd', 'no such genre')) AS given(collection_id, genre)",
    "enrich_stages": "SELECT * FROM (VALUES ('recordings', 'ok', 12), ('artists', 'failed', 3)) AS given(key, status, requests)",
    "play_imports": "SELECT CAST(r_regionkey AS BIGINT) AS id, r_name AS label, 'zip' AS kind, 'completed' AS status, CASE WHEN r_regionkey % 2 = 0 THEN first_day ELSE last_day END AS created_at FROM {region} " + DATED,
    "sync_runs": "SELECT CAST(r_regionkey AS BIGINT) AS id, CASE WHEN r_regionkey = 4 THEN 'running' ELSE 'completed' END AS status, first_day AS started_at, CASE WHEN r_regionkey < 4 THEN last_day END AS finished_at FROM {region} " + DATED,
    "sync_phases": """
        SELECT CAST(n_regionkey AS BIGINT) AS run_id, n_name AS key, CASE n_nationkey % 3 WHEN 0 THEN 'completed' WHEN 1 THEN 'running' ELSE 'skipped' END AS status, n_nationkey AS done, n_nationkey * 2 AS total, first_day AS started_at,
          CASE WHEN n_nationkey % 3 = 0 THEN last_day END AS finished_at, last_day AS updated_at FROM {nation} """ + DATED,
}


def track_artists(t) -> DataFrame:
    """The rows of TABLES["track_artists"] from one shuffle: lines meet by part, and are made distinct and numbered there."""
    pairs = t["lineitem"].select("l_partkey", "l_suppkey").repartition("l_partkey").distinct()
    place = F.row_number().over(Window.partitionBy("l_partkey").orderBy("l_suppkey")) - 1
    return pairs.select(F.col("l_partkey").cast("string").alias("track_id"), F.col("l_suppkey").cast("string").alias("artist_id"), place.cast("int").alias("position"))


def playlist_tracks(t) -> DataFrame:
    """The rows of TABLES["playlist_tracks"], with lines shuffled by order only.

    A line's place is that in its order, after all lines of its customer's earlier orders; those are summed over
    narrow rows of orders, so no line is sorted among all of a customer's.
    """
    sizes = t["lineitem"].groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    order = ["o_custkey", "o_orderdate", "o_orderkey"]
    upto = F.sum("n").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    own = F.sum("n").over(Window.partitionBy(*order))  # orders of one key, date and customer, if there are several
    begun = t["orders"].select(*order).join(sizes, "o_orderkey").select(*order, (upto - own).alias("before"))
    inside = F.row_number().over(Window.partitionBy(*order).orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"))
    lines = t["lineitem"].join(begun, F.col("l_orderkey") == F.col("o_orderkey")).withColumn("position", (F.col("before") + inside - 1).cast("int"))
    part, local = F.col("l_partkey").cast("string"), F.col("l_orderkey") % 82 == 0
    return lines.select(
        F.col("o_custkey").cast("string").alias("playlist_id"), "position", F.when(F.col("l_orderkey") % 41 != 0, part).alias("track_id"), F.when(F.col("l_linenumber") != 7, F.col("o_orderdate")).alias("added_at"),
        (F.col("l_suppkey") % 25).cast("string").alias("added_by_id"), (F.col("l_orderkey") % 43 == 0).alias("is_local"), F.when(local, F.concat(F.lit("Local "), part)).alias("local_name"), F.when(local, F.lit("Somebody")).alias("local_artist"),
    )


def credits_of(t, wanted: DataFrame) -> DataFrame:
    """track_id and artist_id of TABLES["track_artists"] for some tracks only, unnumbered. wanted: track_id."""
    pairs = t["lineitem"].select(F.col("l_partkey").cast("string").alias("track_id"), F.col("l_suppkey").cast("string").alias("artist_id"))
    return pairs.join(wanted, "track_id", "left_semi").distinct()


def first_credits_of(t, wanted: DataFrame) -> DataFrame:
    """The rows of TABLES["track_artists"] with position 0 for some tracks: their least artists, so no line is made distinct or numbered. wanted: track_id."""
    lines = t["lineitem"].select(F.col("l_partkey").cast("string").alias("track_id"), "l_suppkey").join(wanted, "track_id", "left_semi")
    least = lines.groupBy("track_id").agg(F.min(F.struct("l_suppkey")).alias("least"))  # a null is least, as in the text's order
    return least.select("track_id", F.col("least.l_suppkey").cast("string").alias("artist_id"), F.lit(0).alias("position"))


def playlist_items(t, playlists: DataFrame) -> DataFrame:
    """Items of TABLES["playlist_tracks"] in some playlists only, unnumbered, so that lines needn't be sorted. playlists: playlist_id."""
    some = t["orders"].select("o_orderkey", "o_orderdate", F.col("o_custkey").cast("string").alias("playlist_id")).join(playlists, "playlist_id", "left_semi")
    lines = t["lineitem"].select("l_orderkey", "l_linenumber", "l_partkey").join(some, F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.select(
        "playlist_id", F.when(F.col("l_orderkey") % 41 != 0, F.col("l_partkey").cast("string")).alias("track_id"),
        F.when(F.col("l_linenumber") != 7, F.col("o_orderdate")).alias("added_at"), (F.col("l_orderkey") % 43 == 0).alias("is_local"),
    )


#: The same rows as the texts of these names give, by plans that shuffle less.
PLANS = {"track_artists": track_artists, "playlist_tracks": playlist_tracks}

"""The derived tables in DuckDB SQL, written apart from the Spark code, to hold queries against."""

from __future__ import annotations

import re

from ..sources.driver import TABLES
from .warehouse import used

ZONE = "Europe/Stockholm"


def wall(ts: str) -> str:
    return f"timezone('{ZONE}', {ts} AT TIME ZONE 'UTC')"


def iso(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%dT%H:%M:%SZ')"


def whole(x: str, unit: str = "60000.0") -> str:
    return f"CAST(round(coalesce(sum({x}), 0) / {unit}) AS BIGINT)"


HEARD = "coalesce(ms_played, estimated_ms)"
# Fixed values, written out here once more so that a slip in the code isn't in both: letters that are spelled
# out, marks of versions in titles, and device families.
SPELLED = {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "þ": "th", "Þ": "TH", "ð": "d", "Ð": "D", "ı": "i"}
MARKS = r"\s*[\(\[][^\)\]]*[\)\]]\s*|\s+-\s+(remaster|remastered|mono|stereo|live|radio edit|single version|album version).*$"
DEVICE = """CASE WHEN platform IS NULL THEN 'Unknown' WHEN platform ILIKE 'ios%' OR platform ILIKE '%iphone%' OR platform ILIKE '%ipad%' THEN 'iOS' WHEN platform ILIKE 'android%' THEN 'Android'
  WHEN platform ILIKE 'partner%' OR platform ILIKE '%cast%' OR platform ILIKE '%sonos%' OR platform ILIKE '%speaker%' THEN 'Speaker & partner' WHEN platform ILIKE '%web_player%' OR platform ILIKE 'web player%' THEN 'Web player'
  WHEN platform ILIKE 'windows%' THEN 'Windows' WHEN platform ILIKE 'osx%' OR platform ILIKE 'os x%' OR platform ILIKE 'macos%' THEN 'macOS' WHEN platform ILIKE 'linux%' THEN 'Linux' ELSE 'Other' END"""
PLAIN = "lower(strip_accents(" + "replace(" * len(SPELLED) + "coalesce({}, '')" + "".join(f", '{a}', '{b}')" for a, b in SPELLED.items()) + "))"


def title(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace({PLAIN.format(x)}, '{MARKS}', ' ', 'gs'), '[^a-z0-9]+', ' ', 'g'))"


def name(x: str) -> str:
    return f"trim(regexp_replace({PLAIN.format(x)}, '[^a-z0-9]+', ' ', 'g'))"


def ragged(x: str) -> str:
    month = f"CASE WHEN length({x}) >= 7 AND regexp_matches(substr({x}, 6, 2), '^[0-9][0-9]$') AND substr({x}, 6, 2) BETWEEN '01' AND '12' THEN substr({x}, 6, 2) ELSE '01' END"
    day = f"CASE WHEN length({x}) >= 10 AND regexp_matches(substr({x}, 9, 2), '^[0-9][0-9]$') AND substr({x}, 9, 2) BETWEEN '01' AND '31' THEN substr({x}, 9, 2) ELSE '01' END"
    year = f"substr({x}, 1, 4)"
    return f"CASE WHEN regexp_matches({x}, '^[0-9][0-9][0-9][0-9]') AND {year} > '0000' THEN coalesce(try_cast({year} || '-' || {month} || '-' || {day} AS DATE), try_cast({year} || '-' || {month} || '-01' AS DATE)) END"


VIEWS = {
    "albums_dated": f"SELECT *, {ragged('release_date')} AS release_date_start FROM {{albums_landed}}",
    "library_tracks": """
        SELECT track_id, l.track_id IS NOT NULL AS via_liked, o.track_id IS NOT NULL AS via_owned_playlist, l.added_at AS liked_at, least(l.added_at, o.added_at) AS first_added_at, coalesce(n, 0) AS owned_playlist_count
        FROM (SELECT * FROM {saved_tracks} WHERE removed_at IS NULL) l FULL JOIN
          (SELECT track_id, min(added_at) AS added_at, count(DISTINCT playlist_id) AS n FROM {playlist_tracks} i JOIN {playlists} p ON p.id = i.playlist_id WHERE is_owned AND removed_at IS NULL AND track_id IS NOT NULL AND NOT is_local GROUP BY 1) o USING (track_id)
        WHERE least(l.added_at, o.added_at) IS NOT NULL""",
    "recording_keys": f"""
        SELECT t.id AS track_id, coalesce(canonical_track_id, CASE WHEN isrc <> '' THEN 'isrc:' || isrc END,
          'fb:' || substr(sha256(CASE WHEN {title('t.name')} = '' THEN 'id:' || t.id ELSE {title('t.name')} || '|' || (coalesce(duration_ms, 0) // 5000) || '|' || coalesce(ids, '') END), 1, 24)) AS cid
        FROM {{tracks_landed}} t LEFT JOIN {{canonical_overrides}} v ON v.track_id = t.id
          LEFT JOIN (SELECT track_id, string_agg(artist_id, ',' ORDER BY artist_id) AS ids FROM {{track_artists}} GROUP BY 1) a ON a.track_id = t.id
        WHERE NOT is_local""",
    "canonical_tracks": """
        SELECT cid AS id, CASE WHEN cid LIKE 'isrc:%' THEN 'isrc' ELSE 'fallback' END AS kind, CASE WHEN cid LIKE 'isrc:%' THEN substr(cid, 6) END AS isrc, name AS title, duration_ms, explicit, rep.id AS representative_track_id, album_id AS primary_album_id,
          max_popularity, copy_count, earliest_release_date, artist_id AS primary_artist_id
        FROM (SELECT k.cid, t.*, row_number() OVER (PARTITION BY k.cid ORDER BY l.track_id IS NOT NULL DESC, detail_level = 'full' DESC NULLS FIRST, t.popularity DESC NULLS LAST, album_type = 'album' DESC NULLS FIRST, release_date_start NULLS LAST, t.id) AS place,
            max(t.popularity) OVER w AS max_popularity, count(*) OVER w AS copy_count, min(release_date_start) OVER w AS earliest_release_date
          FROM {recording_keys} k JOIN {tracks_landed} t ON t.id = k.track_id LEFT JOIN {library_tracks} l ON l.track_id = t.id LEFT JOIN (SELECT id AS aid, album_type, release_date_start FROM {albums_dated}) a ON aid = t.album_id
          WINDOW w AS (PARTITION BY k.cid)) rep
          LEFT JOIN (SELECT track_id, artist_id FROM {track_artists} WHERE position = 0) c ON c.track_id = rep.id
        WHERE place = 1""",
    "canonical_track_artists": """
        SELECT cid AS canonical_track_id, artist_id, min(position) AS position, bool_or(a.track_id = representative_track_id) AS on_representative
        FROM {recording_keys} k JOIN {track_artists} a ON a.track_id = k.track_id JOIN {canonical_tracks} c ON c.id = k.cid GROUP BY 1, 2""",
    "tracks": "SELECT t.*, cid AS canonical_track_id FROM {tracks_landed} t LEFT JOIN {recording_keys} k ON k.track_id = t.id",
    "library_canonical": """
        SELECT t.canonical_track_id, min(first_added_at) AS first_added_at, max(first_added_at) AS latest_added_at, bool_or(via_liked) AS liked, count(*) AS copy_count_in_library, sum(owned_playlist_count) AS owned_playlist_count,
          max(c.duration_ms) AS duration_ms, max(primary_artist_id) AS primary_artist_id, max(primary_album_id) AS primary_album_id, bool_or(c.explicit) AS explicit
        FROM {library_tracks} l JOIN {tracks} t ON t.id = l.track_id JOIN {canonical_tracks} c ON c.id = t.canonical_track_id GROUP BY 1""",
    "plays_linked": """
        SELECT p.* REPLACE (coalesce(p.track_id, CASE WHEN item_kind = 'track' THEN coalesce(d.id, r.id) END) AS track_id)
        FROM (SELECT *, nullif(regexp_extract(item_uri, 'spotify:track:(.+)$', 1), '') AS raw_id FROM {plays_landed}) p LEFT JOIN {tracks} d ON d.id = raw_id
          LEFT JOIN (SELECT linked_from_id, min(id) AS id FROM {tracks} WHERE linked_from_id IS NOT NULL GROUP BY 1) r ON r.linked_from_id = raw_id""",
    "plays": """
        SELECT o.* REPLACE (CASE WHEN source = 'recent' AND ms_played IS NULL THEN CASE WHEN gap > 0 AND gap <= duration_ms + 60000 THEN least(duration_ms, gap) END ELSE estimated_ms END AS estimated_ms)
        FROM (SELECT p.*, t.duration_ms, 1000 * (CAST(floor(epoch(played_at)) AS BIGINT) - CAST(floor(epoch(lag(played_at) OVER (ORDER BY played_at, p.id))) AS BIGINT)) AS gap FROM {plays_linked} p LEFT JOIN {tracks} t ON t.id = p.track_id) o""",
    "canonical_play_stats": f"""
        SELECT canonical_track_id, count(*) AS plays, count(*) FILTER ({HEARD} >= 30000) AS completed_plays, count(*) FILTER ({HEARD} < 30000) AS skips, coalesce(sum({HEARD}), 0) AS ms_played, min(played_at) AS first_played_at, max(played_at) AS last_played_at
        FROM {{plays}} p JOIN {{tracks}} t ON t.id = p.track_id WHERE canonical_track_id IS NOT NULL GROUP BY 1""",
    "albums_complete": "SELECT a.*, coalesce(coalesce(have, 0) >= total_tracks, FALSE) AS tracks_complete FROM {albums_dated} a LEFT JOIN (SELECT album_id, count(*) AS have FROM {tracks} GROUP BY 1) h ON h.album_id = a.id",
    "album_group_keys": """
        SELECT a.id AS album_id, CASE WHEN tracks_complete AND ungrouped = 0 AND n_tracks > 0 THEN 'trk:' || substr(sha256(members), 1, 24) ELSE 'alb:' || a.id END AS gid, coalesce(n_tracks, 0) AS n_tracks
        FROM {albums_complete} a LEFT JOIN (SELECT album_id, count(canonical_track_id) AS n_tracks, count(*) FILTER (canonical_track_id IS NULL) AS ungrouped, string_agg(canonical_track_id, chr(10) ORDER BY canonical_track_id) AS members FROM {tracks} GROUP BY 1) s ON s.album_id = a.id""",
    "albums": "SELECT a.*, gid AS album_group_id FROM {albums_complete} a JOIN {album_group_keys} k ON k.album_id = a.id",
    "album_groups": """
        SELECT gid AS id, CASE WHEN gid LIKE 'trk:%' THEN 'tracks' ELSE 'solo' END AS kind, name AS title, rep.id AS representative_album_id, n_tracks AS track_count, copy_count, earliest_release_date, artist_id AS primary_artist_id
        FROM (SELECT gid, n_tracks, a.*, row_number() OVER (PARTITION BY gid ORDER BY s.album_id IS NOT NULL DESC, detail_level = 'full' DESC NULLS FIRST, album_type = 'album' DESC NULLS FIRST, popularity DESC NULLS LAST, release_date_start NULLS LAST, a.id) AS place,
            count(*) OVER (PARTITION BY gid) AS copy_count, min(release_date_start) OVER (PARTITION BY gid) AS earliest_release_date
          FROM {album_group_keys} k JOIN {albums_complete} a ON a.id = k.album_id LEFT JOIN (SELECT album_id FROM {saved_albums} WHERE removed_at IS NULL) s ON s.album_id = a.id) rep
          LEFT JOIN (SELECT album_id, artist_id FROM {album_artists} WHERE position = 0) c ON c.album_id = rep.id
        WHERE place = 1""",
    "genre_tags": "SELECT * FROM {mb_tags} WHERE is_genre OR tag IN (SELECT name FROM {mb_genres})",
    "track_genres": "SELECT c.id AS canonical_track_id, tag AS genre, g.count AS votes FROM {canonical_tracks} c JOIN {isrc_recordings} i ON i.isrc = c.isrc JOIN {genre_tags} g ON g.entity_type = 'recording' AND g.entity_mbid = i.recording_mbid",
    "library_edges": "SELECT DISTINCT genre, canonical_track_id FROM {track_genres} WHERE canonical_track_id IN (SELECT canonical_track_id FROM {library_canonical})",
    "genre_lists": "SELECT entity_type, entity_mbid, string_agg(tag, ',' ORDER BY g.count DESC, tag) AS genres FROM {genre_tags} g GROUP BY 1, 2",
    "wanted": """
        SELECT c.*, coalesce(s.plays, 0) AS plays FROM {canonical_tracks} c LEFT JOIN {canonical_play_stats} s ON s.canonical_track_id = c.id
        WHERE coalesce(s.plays, 0) > 0 OR c.id IN (SELECT canonical_track_id FROM {library_canonical})""",
    "wanted_codes": "SELECT id AS canonical_track_id, isrc, plays FROM {wanted} WHERE isrc IS NOT NULL",
    "wanted_artists": "SELECT artist_id, sum(plays) AS plays FROM {wanted} w JOIN {canonical_track_artists} a ON a.canonical_track_id = w.id GROUP BY 1",
    "wanted_albums": "SELECT primary_album_id AS album_id, sum(plays) AS plays FROM {wanted} WHERE primary_album_id IS NOT NULL GROUP BY 1",
    "artist_names": "SELECT canonical_track_id, string_agg(artist_id || ':' || name, ',' ORDER BY position, artist_id) AS artists FROM {canonical_track_artists} c JOIN {artists} a ON a.id = c.artist_id WHERE on_representative GROUP BY 1",
    "track_credit_names": "SELECT track_id, string_agg(artist_id || ':' || name, ',' ORDER BY position, artist_id) AS artists, min_by(name, position) AS artist FROM {track_artists} c JOIN {artists} a ON a.id = c.artist_id GROUP BY 1",
    "album_credit_names": "SELECT album_id, string_agg(artist_id || ':' || name, ',' ORDER BY position, artist_id) AS artists, min_by(name, position) AS artist, min_by(artist_id, position) AS artist_id FROM {album_artists} c JOIN {artists} a ON a.id = c.artist_id GROUP BY 1",
    "covers": "SELECT album_id, arg_min(url, (CASE WHEN coalesce(width, 0) < 200 THEN 1000000 ELSE 0 END) + coalesce(width, 0)) AS cover FROM {album_images} GROUP BY 1",
    "library_rows": """
        SELECT l.*, c.title, c.kind, c.max_popularity, c.copy_count, c.representative_track_id, c.earliest_release_date, coalesce(s.plays, 0) AS plays, s.plays IS NULL AS never, coalesce(s.ms_played, 0) AS ms_played, s.last_played_at,
          al.name AS album_name, al.id AS album_id, ar.name AS artist, coalesce(artists, '') AS artists
        FROM {library_canonical} l JOIN {canonical_tracks} c ON c.id = l.canonical_track_id LEFT JOIN {canonical_play_stats} s ON s.canonical_track_id = c.id LEFT JOIN {albums} al ON al.id = c.primary_album_id LEFT JOIN {artists} ar ON ar.id = c.primary_artist_id
          LEFT JOIN {artist_names} n ON n.canonical_track_id = c.id""",
}


def _needed(text: str, seen: dict[str, str]) -> None:
    for n in used(text):
        found = VIEWS.get(n) or TABLES.get(n) or TABLES.get(f"{n}_landed")
        if found and n not in seen:
            _needed(found, seen)
            seen[n] = found


def statement(text: str, columns: str) -> str:
    """A query over names in braces as one statement. columns: names, # behind long and ~ behind double ones."""
    seen: dict[str, str] = {}
    _needed(text, seen)
    plain = lambda s: re.sub(r"\{(\w+)\}", r"\1", s).replace("{{", "{").replace("}}", "}").replace("AS STRING)", "AS VARCHAR)")
    kinds = {"#": "BIGINT", "~": "DOUBLE"}
    shown = ", ".join(f"CAST({c[:-1]} AS {kinds[c[-1]]}) AS {c[:-1]}" if c[-1] in kinds else c for c in columns.split())
    views = ", ".join(f"{n} AS MATERIALIZED ({plain(s)})" for n, s in seen.items())
    return f"WITH {views} SELECT {shown} FROM ({plain(text)}) AS result" if views else f"SELECT {shown} FROM ({plain(text)}) AS result"

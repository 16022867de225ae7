"""DuckDB statements of clustering and conversation repair, written out round by round and state by state."""

from __future__ import annotations


def clustering_sql(k: int = 8, rounds: int = 10, size: int = 64, seed: int = 3) -> str:
    steps = []
    for r in range(rounds + 1):
        steps.append(
            f"a{r} AS MATERIALIZED (SELECT n, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT n, c, list_sum(list_transform(list_zip(w, o), lambda z: CAST((z[1] - z[2]) * (z[1] - z[2]) AS HUGEINT))) AS d FROM v CROSS JOIN c{r}) GROUP BY n)"
        )
        if r < rounds:
            steps.append(
                f"m{r} AS MATERIALIZED (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS o FROM (SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(w) AS x, unnest(range({size})) AS i FROM a{r} JOIN v USING (n)) GROUP BY c, i) GROUP BY c)"
            )
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c, coalesce(list_transform(m{r}.o, lambda x: CAST(x AS BIGINT)), c{r}.o) AS o FROM c{r} LEFT JOIN m{r} USING (c))")
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS w FROM embeddings
  WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {size}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, w) - 1 AS c, w AS o FROM (SELECT w, sha256('{seed}:' || CAST(vec_id AS VARCHAR)) AS h FROM v WHERE vec_id IS NOT NULL ORDER BY h, w LIMIT {k})),
{", ".join(steps)}
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(o, ',')) AS centroid_sha256
FROM a{rounds} JOIN v USING (n) JOIN c{rounds} USING (c)
"""


def repair_sql() -> str:
    """Ways are text: a cost of nine digits, then the audit, so that the least text is the cheapest way with the least audit."""

    def then(way: str, cost: str, letters: str) -> str:
        return f"printf('%09d', CAST({way}[1:9] AS BIGINT) + {cost}) || {way}[10:] || {letters}"

    opened = f"e AS oe, s AS os, least(u, {then('e', '3', chr(39) + 'I' + chr(39))}, {then('s', '3', chr(39) + 'I' + chr(39))}, {then('a', '3', chr(39) + 'I' + chr(39))}) AS ou, least(a, {then('u', '3', chr(39) + 'I' + chr(39))}, {then('e', '6', chr(39) + 'II' + chr(39))}, {then('s', '6', chr(39) + 'II' + chr(39))}) AS oa"
    gone = {x: then(f"o{x}", "4", "'D'") for x in "esua"}
    kept = {
        "s": f"CASE WHEN NOT gone AND initial = 's' THEN {then('oe', 'extra', chr(39) + 'K' + chr(39))} END",
        "u": f"CASE WHEN NOT gone THEN {then('least(oe, os, oa)', '(extra + CASE WHEN initial = ' + chr(39) + 'u' + chr(39) + ' THEN 0 ELSE 3 END)', 'CASE WHEN initial = ' + chr(39) + 'u' + chr(39) + ' THEN ' + chr(39) + 'K' + chr(39) + ' ELSE ' + chr(39) + 'R' + chr(39) + ' END')} END",
        "a": f"CASE WHEN NOT gone THEN {then('ou', '(extra + CASE WHEN initial = ' + chr(39) + 'a' + chr(39) + ' THEN 0 ELSE 3 END)', 'CASE WHEN initial = ' + chr(39) + 'a' + chr(39) + ' THEN ' + chr(39) + 'K' + chr(39) + ' ELSE ' + chr(39) + 'R' + chr(39) + ' END')} END",
    }
    return rf"""
WITH RECURSIVE said AS (SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text FROM conversations),
tab AS MATERIALIZED (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, CAST(range(8) AS BIGINT[])), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
hit AS MATERIALIZED (SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT))),
       lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS h FROM said CROSS JOIN tab),
dam AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE WHEN h = 1 THEN '' WHEN h = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN h = 3 THEN [0, 1] ELSE [0] END) AS copy FROM hit WHERE h <> 0),
laid AS MATERIALIZED (SELECT *, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS g, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS p FROM dam),
flag AS (SELECT *, role[1:1] AS initial, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS bare, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY p) > 1 AS again, lag(role[1:1]) OVER (PARTITION BY conv_id ORDER BY p) AS prior FROM laid),
mark AS MATERIALIZED (SELECT *, bare = '' AS blank, bare <> '' AND again AS dup, bare <> '' AND NOT again AND right(bare, 1) NOT IN ('.', '!', '?') AS cut FROM flag),
turns AS MATERIALIZED (SELECT g, p, initial, blank OR dup AS gone, CASE WHEN cut THEN 3 ELSE 0 END AS extra FROM mark),
fold AS (
  SELECT DISTINCT g, CAST(0 AS BIGINT) AS p, '000000000' AS e, NULL::VARCHAR AS s, NULL::VARCHAR AS u, NULL::VARCHAR AS a FROM turns
  UNION ALL
  SELECT g, p, {gone["e"]}, least({gone["s"]}, {kept["s"]}), least({gone["u"]}, {kept["u"]}), least({gone["a"]}, {kept["a"]})
  FROM (SELECT fold.g, turns.p, initial, gone, extra, {opened} FROM fold JOIN turns ON turns.g = fold.g AND turns.p = fold.p + 1)),
best AS MATERIALIZED (SELECT g, least(e, a, {then("u", "3", "'I'")}, {then("s", "6", "'II'")}) AS w FROM (SELECT *, p = max(p) OVER (PARTITION BY g) AS final FROM fold) WHERE final),
letter AS (SELECT g, w, unnest(range(1, len(w) - 8)) AS i FROM best),
edit AS (SELECT g, i, w[9 + i:9 + i] AS x, len(replace(w[10:9 + i], 'I', '')) AS p FROM letter),
spoken AS (SELECT edit.*, initial, role, text, count(*) FILTER (x <> 'D' AND NOT (x = 'K' AND initial = 's')) OVER (PARTITION BY edit.g ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) % 2 AS odd
           FROM edit LEFT JOIN mark ON mark.g = edit.g AND mark.p = edit.p AND x <> 'I'),
lines AS (SELECT g, sha256(string_agg(CASE WHEN x = 'K' THEN role WHEN odd = 1 THEN 'assistant' ELSE 'user' END || ':' || coalesce(text, ''), chr(10) ORDER BY i)) AS digest FROM spoken WHERE x <> 'D' GROUP BY g),
tally AS (SELECT g, conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate, count(*) FILTER (cut) AS truncated,
                 count(*) FILTER (prior IS NOT NULL AND prior || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM mark GROUP BY g, conv_id)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
       CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(CAST(w[1:9] AS BIGINT), 0) AS BIGINT) AS cost, coalesce(w[10:], '') AS audit, coalesce(digest, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM said) o LEFT JOIN tally ON tally.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN best ON best.g = tally.g LEFT JOIN lines ON lines.g = tally.g
"""

"""Functions for statements, and a guard that looks at expressions and not at text."""

import pytest
from pyspark.sql import functions as F

from tonearm.functions import text, times
from tonearm.plans import adhoc

WIDE = ", ".join(map(str, range(40)))
CALL = "java_method('java.lang.System', 'getProperty', 'java.version')"


@pytest.fixture(scope="module")
def tables(spark):
    return {"t": spark.range(20).selectExpr("id", "id % 3 as v", "cast(id as string) s"), "u": spark.range(2)}


@pytest.mark.parametrize(
    "statement",
    [
        f"select {WIDE}, {CALL}", f"select id from t where s in ({', '.join(repr(str(k)) for k in range(60))}, {CALL})", f"select id from t where s in (select {CALL} from u)", f"with a as (select {WIDE}, {CALL} as x) select x from a",
        f"select * from (values {', '.join(f'({k})' for k in range(60))}, ({CALL})) as x(y)", f"select sum(id) over w from t window w as (partition by {CALL})", f"select * from range(length({CALL}))", f"select id from t limit length({CALL})", f"select * from u, lateral (select {CALL})",
        f"select transform(array(1), x -> concat(x, {CALL})) from u", f"select case when id > 1 then {CALL} end from t", f"select v from t group by v having max({CALL}) > ''", f"select * from t order by {CALL}", f"select * from t pivot (max({CALL}) for v in (0, 1))", f"select 1 union all select {CALL}",
        f"select * from t join u on t.s = {CALL}", f"select * from t lateral view explode(array({CALL})) e as x", "select * from sql_keywords()", "select * from collations()", "select sql_keywords()", "select input_file_name() from t", "select current_user()", "select version()",
        "select * from python_worker_logs()", "select `reflect`('java.util.UUID', 'randomUUID')", "select raise_error('x')", "select session_user", "select user", f"select count(*) filter (where {CALL} = '') from t", f"select if(true, 1, length({CALL}))", "select nothing_like_this(1)", "select xpath_string('<a/>', 'a')",
    ],
)
def test_calls_that_are_not_allowed_are_refused_wherever_they_stand(spark, tables, statement):
    with pytest.raises(Exception) as caught:
        adhoc.run(spark, tables, tables, statement)
    assert isinstance(caught.value, adhoc.Refused), caught.value


@pytest.mark.parametrize(
    "statement",
    [
        "select date_trunc('month', timestamp '2024-01-02') + interval 1 day, extract(year from date '2024-01-02'), date '2024-01-02' - date '2024-01-01', trim(both 'x' from 'xax'), position('a' in 'ba'), cast('1' as int) between 0 and 2",
        "select id, sum(id) over (partition by v order by id rows between 1 preceding and current row) s, lag(id) over (order by id) p, percentile_cont(0.5) within group (order by id) over () from t",
        "select v, collect_list(id), max_by(s, id), approx_count_distinct(s), listagg(s, ',') within group (order by s), mode(v), any_value(s), count(s) filter (where id > 2) from t group by v", "select count(distinct s) filter (where id > 2), sum(distinct v) from t", "select grouping_id(v), v, count(*) from t group by cube (v)",
        "select regexp_replace(s, '1', 'x'), s like '1%', s rlike '1', s ilike all ('%1%', '%'), split(s, ',')[0], size(array(1)), struct(1 as a).a, map('a', 1)['a'], try_divide(1, 0), nvl(null, 1), 1 <=> null, json_tuple('{\"a\":1}', 'a') from t",
        "select get_json_object('{}', '$.a'), to_json(struct(1)), sha2('a', 256), md5('a'), crc32('a'), parse_url('http://a/b', 'HOST'), typeof(1), exists(array(1), x -> x > 0), aggregate(array(1, 2), 0, (a, x) -> a + x), date_format(date '2024-01-02', 'yyyy')",
        "select timestampadd(hour, 1, timestamp '2024-01-01'), timestampdiff(day, timestamp '2024-01-01', timestamp '2024-02-01'), make_interval(1), -id, id % 2, id div 2, ~id, id & 1, not (id > 1), to_timestamp('2024-01-01'), convert_timezone('UTC', 'Europe/Paris', timestamp_ntz '2024-01-01') from t",
        "select (select max(id) from u), id in (select id from u), exists (select 1 from u where u.id = t.id) from t", "select * from stack(2, 1, 2, 3, 4)", "select a.x from (select explode(sequence(1, 3)) as x) a", "select window.start, count(*) from (select timestamp '2024-01-01' as at) group by window(at, '1 hour')",
    ],
)
def test_plain_functions_pass(spark, tables, statement):
    assert adhoc.run(spark, tables, tables, statement).rows


TITLES = [None, "", "Ænima (Live) [x]", "Señor - Remastered 2011", "  STRASSE ß\nœuvre - live\nend", "a - b", "Ｆｕｌｌ", "Łódź'd"]
DATES = [None, "", "1995", "1996-03", "1994-02-14", "1997-02-30", "0000", "1998-13", "1998-1", "19x8", "1998-12-99"]


def test_functions_say_what_the_columns_say(spark):
    rows = [(k, t, d, 1000 * k if k % 3 else None, [str(k), "b"] if k % 2 else None) for k, (t, d) in enumerate(zip(TITLES * 2, DATES * 2))]
    t = spark.createDataFrame(rows, "k int, title string, written string, ms int, artists array<string>")
    got = adhoc.frame(spark, {"t": t}, ["t"], "select k, norm_title(title) a, norm_name(title) b, fallback_key(title, ms, artists, cast(k as string)) c, fallback_key(title, ms, artists, null) d, parse_release_date(written) e, play_completion_ms() f from t")
    want = t.select("k", text.norm_title(F.col("title")), text.norm_name(F.col("title")), text.fallback_key(F.col("title"), F.col("ms"), F.col("artists"), F.col("k").cast("string")),
                    text.fallback_key(F.col("title"), F.col("ms"), F.col("artists"), F.lit(None).cast("string")), times.ragged_date(F.col("written")), F.lit(30_000))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_genre_lists_are_there_where_their_tables_are(spark):
    tags = spark.createDataFrame([("artist", "a", "rock", 2, True), ("artist", "a", "jazz", 5, False), ("artist", "a", "alt", 2, True), ("artist", "a", "no", 9, False), ("release", "a", "x", 1, True)], "entity_type string, entity_mbid string, tag string, count int, is_genre boolean")
    tables = {"mb_tags": tags, "mb_genres": spark.createDataFrame([("jazz",)], "name string"), "who": spark.createDataFrame([("a",), ("b",)], "id string")}
    got = adhoc.frame(spark, tables, tables, "select id, mb_genre_list('artist', id) g from who order by id").collect()
    assert [tuple(r) for r in got] == [("a", ["jazz", "alt", "rock"]), ("b", None)]
    with pytest.raises(adhoc.Refused):
        adhoc.run(spark, tables, ["who"], "select mb_genre_list('artist', id) from who")


def test_functions_cannot_be_made_by_a_statement(spark, tables):
    for s in ("create temporary function f() returns int return 1", "create function f as 'x.Y'", "drop temporary function norm_title", "select 1; create temporary function f() returns int return 1; select f()"):
        with pytest.raises(Exception):
            adhoc.run(spark, tables, tables, s)


def test_counts_are_kept_for_a_while(spark, tmp_path):
    folder = str(tmp_path / "t")
    spark.range(5).write.parquet(folder)
    first = spark.read.parquet(folder)
    assert adhoc.counted(first) == 5 and adhoc.counted(spark.range(7)) == 7 and adhoc.counted(spark.range(8)) == 8
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    before = jobs()
    assert adhoc.counted(first) == 5 and jobs() == before
    assert adhoc.counted(first, seconds=-1) == 5 and jobs() > before

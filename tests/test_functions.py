"""Column functions on edge rows."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tonearm.functions import listening, music, numbers, text, times
from tonearm.plans import range as ranges
from tonearm.plans.range import Range, midnight, resolve


def values(spark, rows, kind, f):
    return [r[0] for r in spark.createDataFrame([(k, x) for k, x in enumerate(rows)], f"k int, x {kind}").orderBy("k").select(f(F.col("x"))).collect()]


def test_ragged_dates(spark):
    given = ["1998", "1998-03", "1998-03-14", "0000", "2023-02-30", "1998-13", None, "", "98", "1998-03-99", "1998-xx-05"]
    want = [date(1998, 1, 1), date(1998, 3, 1), date(1998, 3, 14), None, date(2023, 2, 1), date(1998, 1, 1), None, None, None, date(1998, 3, 1), date(1998, 1, 5)]
    assert values(spark, given, "string", times.ragged_date) == want


def test_roundings(spark):
    assert values(spark, [0.5, 1.5, 2.5, -0.5], "double", numbers.half_even) == [0, 2, 2, 0]
    assert values(spark, [30_000, 89_999, 90_000, 29_999], "long", lambda c: numbers.per(c, 60_000)) == [1, 1, 2, 0]
    assert values(spark, [0, 4, 5, 99], "int", lambda c: numbers.bucket(c, 5)) == [0, 0, 5, 95]


def test_local_time(spark):
    given = [datetime(2023, 12, 31, 23, 30), datetime(2024, 3, 31, 0, 59), datetime(2024, 3, 31, 1, 0)]
    zone = "Europe/Stockholm"
    assert values(spark, given, "timestamp_ntz", lambda c: times.local_day(c, zone)) == [date(2024, 1, 1), date(2024, 3, 31), date(2024, 3, 31)]
    assert values(spark, given, "timestamp_ntz", lambda c: times.hour(c, zone)) == [0, 1, 3]
    assert values(spark, given, "timestamp_ntz", lambda c: times.weekday(c, zone)) == [1, 7, 7]
    assert values(spark, given[:1], "timestamp_ntz", times.iso) == ["2023-12-31T23:30:00Z"]
    assert values(spark, [datetime(1970, 1, 2, 0, 0, 1, 999_999)], "timestamp_ntz", times.epoch_seconds) == [86_401]


def test_titles(spark):
    given = ["Söng (feat. X) [Live]", "Song - Remastered 2011", "A (feat. X) - Remastered 2011", None, "???", "Straße", "Ænima"]
    assert values(spark, given, "string", text.norm_title) == ["song", "song", "a remastered 2011", "", "", "strasse", "aenima"]


def test_fallback_keys(spark):
    rows = [("Song", 4_999, ["a"], "1"), ("Song", 5_000, ["a"], "2"), ("song!", 4_000, ["a"], "3"), ("", 1, None, "4"), ("", 1, None, "5"), ("Song", None, None, "6")]
    df = spark.createDataFrame(rows, "name string, ms int, artists array<string>, id string")
    a, b, c, d, e, f = [r[0] for r in df.orderBy("id").select(text.fallback_key(*map(F.col, ("name", "ms", "artists", "id")))).collect()]
    assert a == c != b and d != e and len({a, b, d, e, f}) == 5 and all(len(k) == 27 and k.startswith("fb:") for k in (a, b, d, f))


def test_search_is_literal(spark):
    assert values(spark, ["100%", "100", "a_b", "aXb", "c\\d"], "string", lambda c: text.contains(c, "%")) == [True, False, False, False, False]
    assert values(spark, ["A_B", "aXb"], "string", lambda c: text.contains(c, "a_b")) == [True, False]
    assert values(spark, ["c\\d", "cd"], "string", lambda c: text.contains(c, "\\")) == [True, False]


def test_plain_text(spark):
    given = ["<b>a</b> &amp; &#98;&#x63;  &lt;d&gt;&nbsp;e", None, "&amp;lt; &bogus;"]
    assert values(spark, given, "string", text.plain_text) == ["a & bc <d> e", "", "&lt; &bogus;"]


def test_links(spark):
    given = ["spotify:track:abc1", "https://open.spotify.com/intl-de/album/XyZ?si=1", "nothing", None]
    got = values(spark, given, "string", text.link_target)
    assert [g and (g["kind"], g["id"]) for g in got] == [("track", "abc1"), ("album", "XyZ"), None, None]


def test_slugs():
    assert text.slug("Ça va!") == "c-a-va" and text.slug("!!!") == "collection" and len(text.slug("x" * 99)) == 48


def test_similarity(spark):
    df = spark.createDataFrame([("word", "word"), ("word", "two words"), ("", "x")], "a string, b string")
    got = [r[0] for r in df.select(text.similarity(F.col("a"), F.col("b"))).collect()]
    assert got[0] == 1.0 and 0.3 < got[1] < 0.5 and got[2] == 0.0


def test_devices_and_countries(spark):
    assert values(spark, [None, "Partner spotify web_player", "web_player chrome", "iOS 17", "Android 13 cast", "osx", "BeOS"], "string", listening.device) == ["Unknown", "Speaker & partner", "Web player", "iOS", "Android", "macOS", "Other"]
    assert values(spark, ["ZZ", None, "SE"], "string", listening.country) == ["Unknown", "Unknown", "SE"]


def test_music(spark):
    df = spark.createDataFrame([("C#", "minor", 124.9, 0.6, 0.9), ("A", None, 145.0, None, 0.5), (None, "major", None, 0.7, 0.7)], "k string, s string, bpm double, happy double, party double")
    for t in music.TRAITS:
        if t not in df.columns:
            df = df.withColumn(t, F.lit(None).cast("double"))
    got = df.select(music.musical_key(F.col("k"), F.col("s")), music.camelot(F.col("k"), F.col("s")), music.tempo_label(F.col("bpm")), music.traits()).collect()
    assert [tuple(r) for r in got] == [("C♯ minor", "12A", "upbeat", ["party", "happy"]), ("A", None, "very fast", []), (None, None, None, ["happy", "party"])]


START, NOW = datetime(2010, 1, 1), datetime(2024, 3, 31, 12)


@pytest.mark.parametrize(
    "given, want",
    [
        ({}, Range(START, NOW, preset="all", is_all_time=True)),
        ({"preset": "1y"}, Range(datetime(2023, 3, 31, 12), NOW, preset="1y")),
        ({"preset": "6m"}, Range(datetime(2023, 10, 1, 12), NOW, preset="6m")),  # 31 September runs over
        ({"preset": "ytd"}, Range(datetime(2024, 1, 1), NOW, preset="ytd")),
        ({"preset": "odd"}, Range(START, NOW, preset="odd")),
        ({"first": "2024-03-31", "last": "2024-03-31"}, Range(datetime(2024, 3, 30, 23), datetime(2024, 3, 31, 22))),
        ({"first": "2024-02-02", "last": "2024-01-01"}, Range(datetime(2023, 12, 31, 23), datetime(2024, 2, 2, 23))),
        ({"first": "2025-01-01"}, Range(NOW, NOW)),
        ({"last": "nonsense"}, Range(START, NOW)),
    ],
)
def test_ranges(given, want):
    assert resolve(START, NOW, **given) == want


def test_midnights():
    assert midnight("2024-03-31", "Europe/Stockholm", 1) == datetime(2024, 3, 31, 22)
    assert midnight("2024-01-01", "America/New_York") == datetime(2024, 1, 1, 5)


def test_scope_start(spark):
    df = spark.createDataFrame([(datetime(2020, 1, 1),)], "t timestamp_ntz")
    assert ranges.scope_start(df, "t") == datetime(2020, 1, 1) and ranges.scope_start(df.limit(0), "t") == ranges.EARLIEST

"""Exports come in files of a bounded number of plays, and reading one takes time in proportion to its length."""

import io
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tonearm.plans import landing
from tonearm.plans.warehouse import Warehouse
from tonearm.sources import history

STAR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("zipped", [True, False])
def test_a_day_with_many_plays_is_exported_in_several_files(spark, monkeypatch, zipped):
    w = Warehouse(spark, STAR)
    rows = lambda df: Counter(tuple(r) for r in df.select("played_at", "item_uri", "ms_played").collect())
    want = rows(w["plays_landed"].where("source = 'extended'"))
    days = {str(r[0]) for r in w["plays_landed"].where("source = 'extended'").select(F.col("played_at").cast("date")).distinct().collect()}
    most = sum(want.values()) // len(days) // 2
    monkeypatch.setattr(landing, "FILE_PLAYS", most)
    folder, uris = landing.exported(w, zipped)
    found = history.archive_plays(history.archive_entries(spark, uris)) if zipped else history.folder_plays(spark, folder)
    sizes = {r[0]: r[1] for r in found.groupBy("entry").count().collect()}
    assert rows(found) == want and len(sizes) > 1.5 * len(days)
    assert {re.search(r"Audio_(\d{4}-\d\d-\d\d)", e)[1] for e in sizes} == days
    # Whole days are still to be had.
    assert len(landing.exported(w, zipped, whole=True)[1]) == len(days)


def test_items_are_not_searched_from_copies_of_the_rest():
    body, took = ("[" + "1 , " * 200_000 + "1]").encode(), {}
    for size in (1 << 13, 1 << 20):
        began = time.perf_counter()
        assert sum(history.array_items(io.BytesIO(body), size)) == 200_001
        took[size] = time.perf_counter() - began
    assert took[1 << 20] < 6 * took[1 << 13]

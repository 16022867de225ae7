"""Small sources beside a large one reach their targets in the pipeline."""

from collections import Counter

import corpus_pipeline
from tests.llm.test_operators import DOCS, brute_targets, words_of
from tonearm.llm import mixing


def test_each_source_gets_its_target(spark, monkeypatch):
    monkeypatch.setattr(mixing, "LEAST_SLOTS", 16)  # blocks of 1362 words, as on a corpus of 22 M words
    rows = [(k, f"w{k} " * 200, "en", "large", 0) for k in range(100)]
    rows += [(1000 + 3 * k + j, f"s{k}x{j} " * 10, "en", f"small{k:02d}", 0) for k in range(60) for j in range(3)]
    sizes = Counter()
    for _, text, _, source, _ in rows:
        sizes[source] += len(words_of(text))
    got = Counter()
    for r in corpus_pipeline.mix_sources(spark, spark.createDataFrame(rows, DOCS), "").collect():
        got[r["source"]] += len(words_of(r["text"]))
    assert got == {s: round(t) for s, t in brute_targets(sizes).items()}


def test_each_block_has_a_slot(spark):
    rows = [(k, k, "large" if k else "tail", 5_000 if k else 3, k) for k in range(40)]
    sized = spark.createDataFrame(rows, "row long, doc_id long, source string, size long, text_hash long")
    _, pieces = mixing.mix_plan(sized)
    slots = [r["slot"] for r in pieces.collect()]
    assert slots and None not in slots and min(slots) >= 0


def test_taken_is_the_rounded_target(spark):
    rows = [(k, f"w{k} " * 400, "en", "large", 0) for k in range(60)] + [(100 + k, "x y z", "en", f"host{k % 9}", 0) for k in range(30)] + [(900, None, "en", None, 0)]
    got, want = Counter(), {}
    for r in mixing.mix_documents(spark.createDataFrame(rows, DOCS)).collect():
        got[r["source"]] += r["taken"]
        want[r["source"]] = round(r["target"])
        assert r["taken"] <= 3 * r["size"]
    assert got == want


def test_many_sources_beside_a_large_one(spark):
    """Sources of 30 words beside eight million get their 90; there are as many sources as there are."""
    rows = [(k, k, "large", 100_000, k) for k in range(80)] + [(1000 + k, 1000 + k, f"host{k:05d}", 30, k) for k in range(3_000)]
    sized = spark.createDataFrame(rows, "row long, doc_id long, source string, size long, text_hash long")
    docs, pieces = mixing.mix_plan(sized)
    got = {r["source"]: r["n"] for r in docs.join(pieces, "row").groupBy("source").agg({"words": "sum"}).withColumnRenamed("sum(words)", "n").collect()}
    sizes = {"large": 8_000_000} | {f"host{k:05d}": 30 for k in range(3_000)}
    assert got == {s: round(t) for s, t in brute_targets(sizes).items()} and got["host00007"] == 90


def test_rows_without_ids(spark):
    rows = [(None, "same words here", "en", None, 0)] * 300 + [(5, "a b", "en", "x", 0)] * 50 + [(None, None, None, None, None), (7, "", "en", "x", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    got = mixing.mix_documents(docs).collect()
    assert len(got) == len(rows) and all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    taken = Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
    assert taken == {s: round(t) for s, t in brute_targets({None: 900, "x": 100}).items()}
    held = Counter()
    for r in mixing.mixed_texts(docs.repartition(5)).collect():
        held[r["source"]] += len(words_of(r["text"]))
    assert held == taken

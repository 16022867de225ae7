"""The pipeline, and queries over their whole tables."""

import hashlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tonearm.llm import bpe, common, queries
from tests.llm.test_near_copies import brute_groups
from tests.llm.test_operators import DOCS, brute_stats, sample, words_of

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.createDataFrame(sample(9, 120), DOCS)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    kept = corpus_pipeline.quality_rules(spark, docs, SF)
    assert kept.columns == list(corpus_pipeline.COLUMNS)
    whole = Counter((r["doc_id"], r["text"]) for r in docs.collect())
    held = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    fine = Counter({k: n for k, n in whole.items() if (s := brute_stats(k[1]))[0] >= 50 and 2 * s[4] <= s[0]})
    assert not held - fine and held.total() >= 0.95 * fine.total()
    lines = corpus_pipeline.line_dedup_stage(spark, kept, SF)
    assert {r["doc_id"] for r in lines.collect()} <= {k for k, _ in held}
    near = corpus_pipeline.near_dedup(spark, lines, SF).collect()
    held = sorted(lines.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    leads = {held[k]["doc_id"] for k, g in enumerate(brute_groups([r["text"] or "" for r in held])) if g == k}
    assert {r["doc_id"] for r in near if r["doc_id"] is not None} == leads - {None} and len(near) <= len(held)
    table = spark.createDataFrame(near, DOCS)
    mixed = corpus_pipeline.mix_sources(spark, table, SF)
    assert mixed.columns == list(corpus_pipeline.COLUMNS)
    texts = Counter(w for r in near for w in words_of(r["text"]))
    assert set(w for r in mixed.collect() for w in words_of(r["text"])) <= set(texts)
    coded = corpus_pipeline.encode(spark, mixed, SF)
    path = queries.tokenizer(queries.BYTE_BPE)
    back = Counter((r["doc_id"], r["decoded"]) for r in bpe.decode_ids(coded, path).collect())
    assert back == Counter((r["doc_id"], r["text"]) for r in mixed.collect())


def test_stages_on_no_rows(spark):
    docs = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_run(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "lang", "source", "n_tokens", "ids"]
    assert got.where(F.col("n_tokens") != F.size("ids")).count() == 0 and got.count() > 100


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, db, name):
    got = queries.queries()[name](spark, SF)
    columns = sorted(got.columns)
    want = db.execute(f"select {', '.join(columns)} from ({queries.oracle_sql()[name]})").fetchall()
    show = lambda row: tuple(round(x, 6) if isinstance(x, float) else x for x in row)
    assert Counter(show(tuple(r[c] for c in columns)) for r in got.collect()) == Counter(map(show, want))


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql()) - {"pipeline"}))
def test_a_row_for_each_document(spark, name):
    got = queries.queries()[name](spark, SF)
    want = spark.read.parquet(f"{SF}/documents.parquet")
    rows = got.select("doc_id").distinct() if name == "op11_packing" else got.select("doc_id")  # a row for each piece
    assert Counter(r["doc_id"] for r in rows.collect()) == Counter(r["doc_id"] for r in want.select("doc_id").collect())


def test_kept_digest(spark):
    got = {r["doc_id"]: r for r in queries.op1_substring_dedup(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        if got[r["doc_id"]]["n_removed"] == 0:
            assert got[r["doc_id"]]["kept_sha256"] == hashlib.sha256(" ".join(words_of(r["text"])).encode()).hexdigest()


def test_only_the_last_stages_files_stay(spark):
    """Two runs whose frames are read after both were made: neither removes what the other reads."""
    before = set(common.made())
    one, two = corpus_pipeline.run(spark, SF), corpus_pipeline.run(spark, SF)
    assert one.count() == two.count() > 100
    left = [p for p in common.made() if p not in before]
    assert len(left) < 8 and sum("-stage-" in p for p in left) == 2


def test_a_stage_leaves_the_files_of_another_call(spark):
    docs = spark.createDataFrame(sample(3, 60), DOCS)
    one = corpus_pipeline.near_dedup(spark, docs.limit(30), "x")
    two = corpus_pipeline.near_dedup(spark, docs, "x")
    assert 0 < one.count() <= two.count()
    mixed = corpus_pipeline.mix_sources(spark, docs, "y")  # another chain
    assert one.count() > 0 and mixed.count() > 0

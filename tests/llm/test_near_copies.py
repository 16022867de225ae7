"""Near copies against brute force over all pairs."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import DOCS
from tonearm.llm import near_copies

SF = "/root/testdata/sf0.001"


def brute_groups(texts):
    """The least place of each text's group."""
    sets, root = [], list(range(len(texts)))
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(k) for k in range(len(texts))]


def planted(seed, groups, copies):
    """Texts with copies that have a few words replaced: their similarities lie on both sides of 0.8."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(4))
    texts = []
    for _ in range(groups):
        base = [word() for _ in range(r.randint(60, 300))]
        texts.append(" ".join(base))
        for _ in range(copies):
            w = list(base)
            for k in r.sample(range(len(w)), r.randint(1, len(w) // 30)):
                w[k] = word()
            texts.append(" ".join(w))
    r.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed, groups, copies", [(1, 60, 3), (2, 3, 70)])
def test_stage_drops_what_brute_force_drops(spark, seed, groups, copies):
    texts = planted(seed, groups, copies)
    want = set(brute_groups(texts))
    assert groups <= len(want) < len(texts)
    docs = spark.createDataFrame([(k, t, "en", "web", len(t)) for k, t in enumerate(texts)], DOCS)
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()} == want


def test_dense_cells_without_links_stay_apart(spark):
    """A shared passage of half of each text puts many texts into one cell, and none of them is a near copy."""
    r = random.Random(4)
    shared = " ".join(f"s{k}" for k in range(150))
    texts = [shared + " " + " ".join(f"w{r.random()}" for _ in range(60)) for _ in range(60)]
    got = near_copies.grouped(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string"))
    assert got.select(F.count_distinct("group")).first()[0] == 60


def test_texts_without_words_are_one_group(spark):
    rows = [(1, ""), (2, None), (3, " \n"), (4, "one"), (5, "ONE"), (6, "two words")]
    groups = defaultdict(set)
    for x in near_copies.grouped(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        groups[x["group"]].add(x["doc_id"])
    assert sorted(map(sorted, groups.values())) == [[1, 2, 3], [4, 5], [6]]


def test_one_row_of_each_group_stays(spark):
    a, b, c = planted(7, 3, 0)
    rows = [(None, a), (5, a), (5, a), (4, b), (4, c), (None, b), (6, c), (None, c)]
    docs = spark.createDataFrame([(k, t, "en", "web", len(t)) for k, t in rows], DOCS)
    kept = corpus_pipeline.near_dedup(spark, docs, SF)
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == sorted([(5, a), (4, b), (4, c)])
    nameless = docs.where("doc_id is null").union(docs.where("doc_id is null"))
    assert sorted((r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, nameless, SF).collect()) == sorted([(None, a), (None, b), (None, c)])


@pytest.mark.parametrize("n", [300, 1_500])
def test_pages_of_one_template_are_not_all_compared(spark, monkeypatch, n):
    """100 words of a template and 25 words of one's own: a similarity of two thirds, so no pair is linked; a few planted ones are."""
    r = random.Random(n)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    template = [word() for _ in range(100)]
    texts = [" ".join(template + [word() for _ in range(25)]) for _ in range(n)]
    texts += [f"{t} {word()}" for t in texts[:20]]
    seen, verified = [], near_copies._verified

    def counted(pairs, *more):
        seen.append(pairs.distinct().count())
        return verified(pairs, *more)

    monkeypatch.setattr(near_copies, "_verified", counted)
    docs = spark.createDataFrame([(k, t, "en", "web", len(t)) for k, t in enumerate(texts)], DOCS)
    kept = {x["doc_id"] for x in near_copies.one_of_each(docs).select("doc_id").collect()}
    assert kept == set(range(n)) and sum(seen) < 20 * n


def test_fingerprints_link_near_copies(spark):
    """The grid over fingerprints gives candidates of its own: texts that differ in a word at the end, of one fingerprint or within two bits."""
    texts = [" ".join(f"w{k}x{n}" for k in range(400)) for n in range(20)]
    texts += [f"{t} more" for t in texts]
    marks = near_copies.packed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).marks.select("uid", "fp")
    prints = {r["uid"]: r["fp"] % 2**64 for r in marks.collect()}
    want = {(u, v) for u in prints for v in prints if u < v and (prints[u] ^ prints[v]).bit_count() <= 2}
    got = {(r["u"], r["v"]) for r in near_copies.by_fingerprint(marks).collect()}
    assert got == want and len(want) > 10

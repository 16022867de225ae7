"""Sharding of groups whose sizes are far apart."""

import random
from collections import Counter, defaultdict

import pytest

from tests.llm.test_operators import DOCS, least_capacity, sample
from tonearm.llm import sharding


@pytest.mark.parametrize("n, shards, most", [(8000, 16, 256), (8000, 16, 8), (2000, 400, 256), (40, 16, 256)])
def test_heavy_tailed_groups(spark, monkeypatch, n, shards, most):
    monkeypatch.setattr(sharding, "MOST_SPLIT", most)
    r = random.Random(n)
    groups = sorted((r.getrandbits(64) - 2**63, int(r.paretovariate(0.7))) for _ in range(n))
    alone, lasts = sharding.cut_points(spark.createDataFrame(groups, "g long, size long"), shards)
    rest = [(g, s) for g, s in groups if g not in set(alone)]
    sums = defaultdict(int)
    for g, s in rest:
        sums[sum(g > last for last in lasts)] += s
    assert len(sums) <= shards - len(alone)
    assert max(sums.values()) == least_capacity([s for _, s in rest], shards - len(alone))


def test_equal_texts_share_a_shard(spark):
    rows = sample(4, 90) + [(k, "a hot text " * 40, "en", "web", 0) for k in range(1000, 1600)] + [(k, None, "en", "web", 0) for k in range(2000, 2300)]
    docs = spark.createDataFrame(rows, DOCS).repartition(6)
    for shards in (16, 300):
        got = sharding.shard_documents(docs, shards).collect()
        assert len(got) == len(rows)
        text = {i: t or "" for i, t, *_ in rows if i not in (501, None)}
        where, loads, slots = defaultdict(set), Counter(), defaultdict(list)
        for r in got:
            if r["doc_id"] in text:
                where[text[r["doc_id"]]].add(r["shard"])
            loads[r["shard"]] += r["size"]
            slots[r["shard"]].append(r["slot"])
        assert all(len(x) == 1 for x in where.values())
        assert all(sorted(x) == list(range(len(x))) for x in slots.values())
        sizes = Counter()
        for _, t, *_ in rows:
            sizes[t or ""] += len((t or "").encode()) + 1
        assert max(loads.values()) <= max(max(sizes.values()), sum(sizes.values()) / shards + sorted(sizes.values())[-2])


def test_same_shards_again(spark):
    docs = spark.createDataFrame(sample(5, 90), DOCS)
    assert Counter(sharding.shard_documents(docs, 7).collect()) == Counter(sharding.shard_documents(docs.repartition(9), 7).collect())

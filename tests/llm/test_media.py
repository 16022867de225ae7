"""Chunks are stored once, and the features are what they say."""

import hashlib
import os
import random
from urllib.parse import urlparse

from tonearm.llm import media_chunks


def plain_features(payload):
    """Count, sum, sum of squares, changes of direction and the largest of 16 bins, one sample at a time."""
    rises = [(b > a) - (b < a) for a, b in zip(payload, payload[1:])]
    turns = sum(x != y for x, y in zip(rises, rises[1:])) if len(payload) > 2 else 0
    bins = [0] * 16
    total = squares = 0
    for b in payload:
        bins[b // 16] += 1
        total += b
        squares += b * b
    top = sorted(range(16), key=lambda k: (-bins[k], k))[:4]
    # a step that stays level counts as a direction of its own
    return f"n={len(payload)};sum={total};squares={squares};turns={turns};bins=" + ",".join(f"{k}:{bins[k]}" for k in top)


def test_copies_are_stored_once(spark):
    r = random.Random(3)
    base = ["".join(r.choice("abcdefgh ") for _ in range(30_000)) for _ in range(6)]
    rows = [(k, base[k % 6]) for k in range(300)] + [(1000 + k, "put before " + base[0]) for k in range(5)] + [(2000 + k, None if k % 2 else "") for k in range(400)] + [(7, base[1]), (None, base[2])]
    lists, folder = media_chunks.store_media(spark.createDataFrame(rows, "doc_id long, text string").repartition(12))
    got = media_chunks.read_media(lists, folder, with_payload=True).collect()
    assert len(got) == len(rows)
    root = urlparse(folder).path
    stored = sum(os.path.getsize(f"{root}/{f}") for f in os.listdir(root))
    one = {bytes(x["payload"]): x["media_bytes"] for x in got}
    assert stored <= sum(one.values())  # equal chunks of different payloads count once too
    assert sum(one.values()) - stored > 10_000
    frames = {(c["pack"], c["start"]): c["stored"] for x in lists.collect() for c in x["chunks"]}
    assert stored == sum(frames.values())
    for x in got:
        assert hashlib.sha256(bytes(x["payload"])).hexdigest() == x["payload_sha256"]
    for payload in list(one)[:4]:
        assert plain_features(payload) == next(x["feature"] for x in got if bytes(x["payload"]) == payload)

"""K-means with bounds against the plain rule, in integers."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from tonearm.llm import centroids


def brute(rows, k=8, rounds=10, size=64, seed=3):
    kept = [(i, [math.floor(float(np.float64(x)) * 1024) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    c = [list(v) for _, v in first]
    if not c:
        return Counter()
    far = lambda v, o: sum((a - b) ** 2 for a, b in zip(v, o))
    nearest = lambda v: min(range(len(c)), key=lambda j: (far(v, c[j]), j))
    for _ in range(rounds):
        own = [nearest(v) for _, v in kept]
        for j in range(len(c)):
            mine = [v for a, (_, v) in zip(own, kept) if a == j]
            if mine:
                c[j] = [sum(x) // len(mine) for x in zip(*mine)]
    own = [nearest(v) for _, v in kept]
    d = [far(v, c[a]) for a, (_, v) in zip(own, kept)]
    within = Counter()
    for a, x in zip(own, d):
        within[a] += x
    return Counter((i, a, x, within[a], sum(d), hashlib.sha256(",".join(map(str, c[a])).encode()).hexdigest()) for (i, _), a, x in zip(kept, own, d))


SCHEMA = "vec_id long, embedding array<float>, label int, cluster int"


def told(spark, rows, **more):
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], SCHEMA)
    return Counter(tuple(r) for r in centroids.cluster(df.repartition(3) if len(rows) > 5 else df, **more).collect())


@pytest.mark.parametrize("kind", ["blobs", "ties", "one hot vector", "few", "tiny"])
def test_equal_to_the_plain_rule(spark, kind):
    r = random.Random(kind)
    if kind == "ties":  # on a small lattice many distances are equal
        rows = [(k, [float(r.randrange(2)) for _ in range(3)]) for k in range(200)]
    elif kind == "one hot vector":
        rows = [(k, [0.5, -0.25, 0.125] if k % 3 else [r.gauss(0, 1) for _ in range(3)]) for k in range(200)]
    elif kind == "few":
        rows = [(k, [float(k), 0.0, 1.0]) for k in range(3)] + [(1, [1.0, 0.0, 1.0])]
    elif kind == "tiny":  # negative components that floor to -1
        rows = [(k, [r.choice([-1e-9, 0.0, 1e-9, -0.001]) for _ in range(3)]) for k in range(100)]
    else:
        spots = [[r.gauss(0, 1) for _ in range(3)] for _ in range(6)]
        rows = [(k, [x + r.gauss(0, 0.2) for x in r.choice(spots)]) for k in range(300)]
    rows = [(i, np.array(v, np.float32).tolist()) for i, v in rows]
    odd = [(900, None), (901, [1.0]), (902, [1.0, None, 2.0]), (903, [1.0, float("nan"), 0.0]), (904, [float("inf"), 0.0, 0.0]), (None, [0.5, 0.5, 0.5]), rows[0]]
    assert told(spark, rows + odd, size=3) == brute(rows + odd, size=3)


def test_edges(spark):
    assert told(spark, []) == Counter() and told(spark, [(1, [0.0]), (None, [1.0] * 64)]) == Counter()
    with pytest.raises(Exception, match="within"):
        told(spark, [(1, [1e6] * 64), (2, [0.0] * 64)])


def test_bounds_hold_and_spare_scans():
    """After each step the bounds are on the right side of the exact distances; with settled centroids nothing is scanned."""
    r = np.random.default_rng(5)
    v = (r.normal(size=(400, 8)) * 300 + r.integers(0, 4, (400, 1)) * 3_000).astype(np.int32)
    old = v[:6].astype(np.int64)
    state = np.zeros(400, np.int64), np.full(400, np.inf), np.zeros(400)
    scans = []
    for step in range(8):
        new = old + (r.integers(-40, 40, old.shape) if step else 0) // (step + 1)
        cluster, upper, lower, scan, _ = centroids.assigned(*state, old, new, lambda: v)
        d = centroids.distances(v, new)
        assert (cluster == d.argmin(1)).all()
        near = np.sqrt(np.sort(d, 1).astype(float))
        assert (upper >= near[:, 0] * (1 - 1e-15)).all() and (lower <= near[:, 1] * (1 + 1e-15)).all()
        state, old = (cluster, upper, lower), new
        scans.append(len(scan))
    assert scans[0] > 200 and sum(scans[1:]) < 400

    def unread():
        raise AssertionError("a block without ambiguous vectors is opened")

    assert len(centroids.assigned(*state, old, old, unread)[3]) == 0 or scans[-1] > 0

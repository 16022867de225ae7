"""The outlier rule has no cliff, and its half is exact however rows are dealt."""

import numpy as np
from pyspark.sql import functions as F

from tests.llm.test_outliers import corpus
from tonearm.llm import quality


def inverse(variance, turn):
    axes = np.linalg.qr(np.random.default_rng(turn).normal(size=(5, 5)))[0]
    cov = axes @ np.diag([variance, 0.5, 1.0, 1.5, 2.0]) @ axes.T
    sums = [0.0] * 5 + [1000 * cov[i, j] for i in range(5) for j in range(i, 5)]
    _, inv, logdet, rank = quality.estimate(1000, sums)
    return np.array(inv).reshape(5, 5), axes[:, 0], logdet, rank


def test_a_little_variance_changes_a_distance_a_little():
    """Along the direction of varying variance, from none to a unit's: two percent more never change its weight by a tenth."""
    steps, last = np.concatenate([[0.0], np.geomspace(1e-6, 1.0, 700)]), None
    for v in steps:
        inv, axis, logdet, rank = inverse(v, 3)
        now = axis @ inv @ axis
        assert 1 <= rank <= 5 and np.isfinite(logdet)
        if last is not None:
            assert abs(np.log(now / last[0])) < 0.1 and abs(rank - last[1]) < 0.1 and abs(logdet - last[2]) < 0.1
        last = now, rank, logdet
    assert abs(inverse(0.0, 1)[0] @ np.eye(5) - inverse(1e-9, 1)[0]).max() < 1e-3  # nothing at all, and hardly anything
    wide, axis, _, rank = inverse(0.3, 2)
    assert abs(axis @ wide @ axis - 1 / 0.3) < 0.01 and rank > 4.99


def test_verdicts_do_not_hang_on_partitions(spark):
    rows = corpus(11, 900, 60)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    stats = quality.text_statistics(docs)
    many = stats.crossJoin(spark.range(14)).withColumn("doc_id", F.col("doc_id") * 14 + F.col("id")).drop("id")  # a group beyond ten thousand
    told = [{r["doc_id"]: r["kept"] for r in quality.robust_outliers(many.repartition(n, "doc_id")).select("doc_id", "kept").collect()} for n in (3, 17)]
    assert told[0] == told[1] and len(told[0]) == 12_600 and 0 < sum(not k for k in told[0].values()) < 6_000


def test_medians_are_exact(spark, monkeypatch):
    r = np.random.default_rng(8)
    rows = [(g, float(v)) for g, n in (("a", 1), ("b", 2), ("c", 999), ("d", 5_000)) for v in (r.normal(size=n) if g != "d" else r.integers(0, 3, n))]
    df = spark.createDataFrame(rows, "model string, d double").repartition(5)
    want = {g: float(np.median([v for h, v in rows if h == g])) for g in "abcd"}
    assert {x["model"]: x["h"] for x in quality._median(df, F.broadcast, "model").collect()} == want
    monkeypatch.setattr(quality, "BRACKET", 10)  # the groups with ties have more, and go the other way
    assert {x["model"]: x["h"] for x in quality._median(df, F.broadcast, "model").collect()} == want

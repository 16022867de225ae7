"""Outliers against a search of its own for the least determinant, from many random starts."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import words_of
from tonearm.llm import quality


def vector(text):
    w = words_of(text)
    n, chars = max(1, len(w)), max(1, sum(map(len, w)))
    signs = sum(33 <= ord(c) < 127 and not c.isalnum() for c in text)
    lines = max(1, sum(bool(words_of(x)) for x in text.split("\n")))
    return [math.log(n), math.log(chars / n), math.log((signs + 5) / (chars + 5)), math.log(max(1, len(set(w))) / n), math.log(n / lines)]


def nearest(x, c, s, share):
    d = np.einsum("ni,ij,nj->n", x - c, np.linalg.inv(s), x - c)
    return d, x[d <= np.sort(d)[math.ceil(share * len(x)) - 1]]


def moments(h):
    return h.mean(0), np.cov(h.T, bias=True)


def least_determinant(x, starts=200):
    """Half with the least determinant that random starts reach, the determinant and the final squared distances."""
    r = np.random.default_rng(0)
    best = (np.inf, None)
    for _ in range(starts):
        c, s = moments(x[r.choice(len(x), 12, replace=False)])
        s = s + np.eye(5) * 1e-9
        for _ in range(60):
            _, h = nearest(x, c, s, 0.5)
            c, s = moments(h)
            det = np.linalg.slogdet(s)[1]
            if det < best[0] - 1e-12:
                best = (det, (c, s))
    c, s = best[1]
    d, _ = nearest(x, c, s, 0.5)
    factor = np.sort(d)[math.ceil(len(x) / 2) - 1] / 4.3515
    c, s = moments(x[d <= 12.8325 * factor])
    d, _ = nearest(x, c, s, 0.5)
    return best[0], d / (np.sort(d)[math.ceil(len(x) / 2) - 1] / 4.3515)


def corpus(seed, n, far):
    r = random.Random(seed)
    words = ["".join(r.choice("etaoinshr") for _ in range(r.randint(2, 9))) for _ in range(3000)]

    def text(k):
        odd = k >= n - far
        size = int(math.exp(r.gauss(5.3, 0.5))) + 50
        out = [r.choice(words[: 40 if odd and k % 2 else 3000]) + r.choice(["", "", "", "", ",", "."]) + ("#$" if odd and k % 2 == 0 and r.random() < 0.5 else "") for _ in range(size)]
        return "".join(w + ("\n" if r.random() < 0.05 else " ") for w in out)

    return [(k, text(k), "en", "web") for k in range(n)]


@pytest.mark.parametrize("seed, n, far", [(1, 400, 60), (2, 300, 100), (3, 500, 0)])
def test_the_least_determinant_is_found(spark, seed, n, far):
    rows = corpus(seed, n, far)
    x = np.array([vector(t) for _, t, *_ in rows])
    got = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)).collect()}
    fine = [k for k in range(n) if not got[k]["base_failed"]]
    det, want = least_determinant(x[fine])
    mine = np.array([got[k]["distance"] for k in fine])
    assert np.median(np.abs(mine / want - 1)) < 0.05
    assert [got[k]["kept"] for k, d in zip(fine, want) if abs(d / 50.6926 - 1) > 0.1] == [d <= 50.6926 for d in want if abs(d / 50.6926 - 1) > 0.1]
    assert not any(got[k]["kept"] for k in range(n - far, n)) and sum(got[k]["kept"] for k in range(n - far)) >= 0.99 * (n - far)


def test_concentration_reaches_the_brute_determinant(spark):
    """A third of the vectors lie far off: the best start's determinant is no more than that of 200 random ones."""
    r = np.random.default_rng(4)
    x = r.multivariate_normal(np.zeros(5), np.diag([1, 1, 1, 1, 1]) + 0.5, 500)
    x[:160] = r.multivariate_normal([6, -6, 5, 0, 6], np.eye(5) * 0.3, 160)
    df = spark.createDataFrame([("m", *map(float, v)) for v in x], "model string, " + ", ".join(f"{z} double" for z in quality.DIMS))
    got = quality.concentrated(df, F.broadcast).collect()
    assert len(got) == 1 and got[0]["steps"] < quality.MOST_STEPS
    assert got[0]["logdet"] <= least_determinant(x)[0] + 0.02


def test_what_most_documents_share_is_no_rule(spark):
    """Most have one line and no sign; others have more lines, some signs, and stay. What is far off in any direction goes."""
    r = random.Random(6)
    words = ["".join(r.choice("etaoinshr") for _ in range(r.randint(2, 9))) for _ in range(2000)]
    prose = lambda n: [r.choice(words) for _ in range(n)]
    rows = [(k, " ".join(prose(r.randint(60, 500)))) for k in range(200)] + [(200 + k, "\n".join(" ".join(prose(r.randint(20, 100))) for _ in range(r.randint(2, 4)))) for k in range(80)]
    rows += [(300 + k, ", ".join([" ".join(prose(r.randint(30, 90)))] * 1 + [" ".join(prose(r.randint(30, 90)))] * 1 + prose(r.randint(0, 4)))) for k in range(40)]
    rows += [(900, " ".join(w + "#$%&" for w in prose(200)))]
    kept = {x["doc_id"]: x["kept"] for x in quality.judge(spark.createDataFrame([(k, t, "en", "web") for k, t in rows], "doc_id long, text string, lang string, source string")).collect()}
    assert sum(kept[k] for k, _ in rows[:-1]) >= 0.98 * (len(rows) - 1) and not kept[900]


def test_small_groups_pool_and_odd_rows_pass(spark):
    rows = corpus(5, 200, 0)
    spread = [(k, t, ["en", "de", None][k % 3], f"host{k % 70}" if k % 3 else None) for k, t, *_ in rows] + [(None, None, None, None), (900, "", "xx", "y"), (901, "one word", "xx", "y")] + [(902, rows[0][1], "xx", "alone")] * 2
    df = spark.createDataFrame(spread, "doc_id long, text string, lang string, source string").withColumns({"kept": F.lit(1), "x0": F.lit(2), "model": F.lit(3)})
    got = quality.judge(df).collect()
    assert len(got) == len(spread)
    assert all(r["distance"] is not None and r["kept"] for r in got if not r["base_failed"])
    assert quality.judge(df.limit(30)).where("kept").count() > 20  # too few to judge: all that pass the base rules stay


def test_statistics_replace_columns_of_their_names(spark):
    df = spark.createDataFrame([(1, "a b\na b", "x")], "doc_id long, body string, text string").withColumn("n_words", F.lit(-1))
    assert quality.text_statistics(df, "body").select("doc_id", "n_words", "n_lines", "n_distinct").collect() == [(1, 4, 2, 2)]


def test_equal_documents_are_no_singular_estimate(spark):
    text = " ".join(f"w{k}" for k in range(80))
    rows = [(k, text, "en", "web") for k in range(300)] + [(1000, text + " and a few more", "en", "web"), (1001, text + " #" * 500, "en", "web")]
    kept = {r["doc_id"]: r["kept"] for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(kept[k] for k in range(300)) and not kept[1001]

"""Line dedup over all lines that two documents share."""

import random
from collections import defaultdict

from tests.llm.test_operators import words_of
from tonearm.llm import line_dedup


def dropped(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r["doc_id"]: r["text"] for r in line_dedup.drop_shared_lines(df, whole=True).collect()}


def test_refrains_and_short_common_lines_go(spark):
    song = "\n".join(f"verse {k} has its own few words\noh la la" for k in range(3))
    short = "\n".join(f"so {k}" for k in range(8))  # each line common and first elsewhere
    rows = [(k, f"title {k}\n{song}") for k in range(5)]
    rows += [(10 + k, f"so {k}\nonly {k}") for k in range(8)] + [(100 + k, f"head {k}\n{short}") for k in range(12)]
    got = dropped(spark, rows)
    assert got[0] == rows[0][1] and got[100] == f"head 0\n{short}"
    assert [got[k] for k in range(1, 5)] == [f"title {k}" for k in range(1, 5)]
    assert [got[100 + k] for k in range(1, 12)] == [f"head {k}" for k in range(1, 12)]


def test_pairs_are_those_of_brute_force(spark):
    r = random.Random(6)
    lines = [" ".join(r.choice("abcdefghij") * 3 for _ in range(r.randint(1, 8))) for _ in range(60)]
    rows = [(k, "\n".join(r.choice([*lines, ""]) for _ in range(r.randint(0, 25)))) for k in range(60)]
    have = {k: [(j, x) for j, x in enumerate(t.split("\n")) if words_of(x)] for k, t in rows}
    gone = defaultdict(set)
    for b in have:
        for a in range(b):
            matches = [(i, j) for i, (_, x) in enumerate(have[a]) for j, (_, y) in enumerate(have[b]) if x == y]
            found = line_dedup.aligned_blocks(matches, {j: len(words_of(y)) for j, (_, y) in enumerate(have[b])})
            gone[b] |= {have[b][j][0] for j in found}
    want = {k: "\n".join(x for j, x in enumerate(t.split("\n")) if j not in gone[k]) for k, t in rows}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x["doc_id"]: x["text"] for x in line_dedup.drop_shared_lines(df, rare=10**6, whole=True).collect()} == want

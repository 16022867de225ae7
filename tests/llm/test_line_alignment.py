"""Line dedup against a diff of its own, which shares no code with the operator."""

import random
from collections import defaultdict

import pytest

from tonearm.llm import line_dedup


def increasing(pairs):
    """Longest increasing list; of equally long ones, that with the least second places from its end on."""
    best = []
    for k, (a, b) in enumerate(pairs):
        before = [(n, y, j) for j, (n, x, y, _) in enumerate(best) if x < a and y < b]
        n = max((m for m, _, _ in before), default=0)
        back = min(((y, j) for m, y, j in before if m == n), default=(0, None))[1]
        best.append((n + 1, a, b, back))
    if not best:
        return []
    top = max(n for n, *_ in best)
    k = min((b, k) for k, (n, _, b, _) in enumerate(best) if n == top)[1]
    out = []
    while k is not None:
        out.append(best[k][1:3])
        k = best[k][3]
    return out[::-1]


def once(values):
    return [v for v in values if values.count(v) == 1]


def diff(a, b):
    """a, b: lists of (place, line). Aligned places of a region."""
    width = 1
    anchors = []
    while not anchors and width <= max(len(a), len(b)):
        left, right = ([(x[k][0], [y for _, y in x[k : k + width]]) for k in range(len(x) - width + 1) if x[k + width - 1][0] == x[k][0] + width - 1] for x in (a, b))
        single = [s for s in once([s for _, s in left]) if s in once([s for _, s in right])]
        place = {tuple(s): p for p, s in right}
        anchors = increasing([(p, place[tuple(s)]) for p, s in left if s in single])
        width *= 2
    if not anchors:
        n = next((k for k, (x, y) in enumerate(zip(a, b)) if x[1] != y[1]), min(len(a), len(b)))
        anchors = [(a[k][0], b[k][0]) for k in range(n)]
    if not anchors:
        n = next((k for k, (x, y) in enumerate(zip(a[::-1], b[::-1])) if x[1] != y[1]), min(len(a), len(b)))
        anchors = [(a[-k][0], b[-k][0]) for k in range(n, 0, -1)]
    if not anchors:
        return []
    out = list(anchors)
    edges = [(-1, -1), *anchors, (10**9, 10**9)]
    for (p, q), (r, s) in zip(edges, edges[1:]):
        x, y = [e for e in a if p < e[0] < r], [e for e in b if q < e[0] < s]
        if x and y:
            out += diff(x, y)
    return sorted(out)


def removed(first, second, least=10):
    """Numbers of the lines that the second text loses to the first."""
    have = [[(j, x) for j, x in enumerate(t.split("\n")) if x.split()] for t in (first, second)]
    a, b = [[x for _, x in side] for side in have]
    aligned = dict(diff([(p, x) for p, x in enumerate(a) if x in b], [(p, x) for p, x in enumerate(b) if x in a]))
    for step in (1, -1):
        for p in sorted(aligned, reverse=step < 0):
            q = aligned[p]
            while 0 <= p + step < len(a) and 0 <= q + step < len(b) and a[p + step] == b[q + step] and p + step not in aligned and q + step not in aligned.values():
                p, q = p + step, q + step
                aligned[p] = q
    out, block = set(), []
    for p, q in [*sorted(aligned.items()), (-9, -9)]:
        if block and (p, q) != (block[-1][0] + 1, block[-1][1] + 1):
            if sum(len(b[y].split()) for _, y in block) >= least:
                out |= {have[1][y][0] for _, y in block}
            block = []
        block.append((p, q))
    return out


def brute(texts):
    """All pairs of documents."""
    gone = defaultdict(set)
    for b in texts:
        for a in texts:
            if a < b:
                gone[b] |= removed(texts[a], texts[b])
    return {k: "\n".join(x for j, x in enumerate(t.split("\n")) if j not in gone[k]) for k, t in texts.items()}


def dropped(spark, texts, **more):
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    return {r["doc_id"]: r["text"] for r in line_dedup.drop_shared_lines(df, **more).collect()}


@pytest.mark.parametrize("seed, n, kinds", [(5, 70, 60), (6, 60, 12)])
def test_every_pair_is_aligned(spark, seed, n, kinds):
    r = random.Random(seed)
    lines = [" ".join(r.choice("abcdefghij") * 3 for _ in range(r.randint(1, 8))) for _ in range(kinds)]
    texts = {k: "\n".join(r.choice([*lines, ""]) for _ in range(r.randint(0, 25))) for k in range(n)}
    assert dropped(spark, texts, rare=10**6) == brute(texts)


@pytest.mark.parametrize("seed, n, rare", [(7, 60, 1), (8, 60, 2), (9, 90, 8)])
def test_runs_of_many_documents_are_lengthened(spark, seed, n, rare):
    """Texts that keep the order of their lines: then it doesn't matter which of the documents that share most is met."""
    r = random.Random(seed)
    lines = [" ".join(r.choice("abcdefghij") * 3 for _ in range(r.randint(1, 8))) + f" {k}" for k in range(40)]
    texts = {}
    for k in range(n):
        i = r.randrange(0, 20)
        j = r.randrange(i + 1, 40)
        kept = [x for x in lines[i:j] if r.random() < 0.96]
        texts[k] = "\n".join([*([f"own {k}"] if r.random() < 0.5 else []), *kept, *([f"tail {k}"] if r.random() < 0.5 else [])])
    assert dropped(spark, texts, rare=rare) == brute(texts)


@pytest.mark.parametrize("others", [0, 7, 5_000])
def test_how_many_share_less_does_not_matter(spark, others):
    hot = "a line of eleven words that stands in a great many"
    texts = {10: f"{hot}\nand more\nfirst", 20: f"{hot}\nand more\nsecond"} | {100 + k: f"{hot}\nother {k}" for k in range(others)}
    assert dropped(spark, texts) == {10: texts[10], 20: "second"} | {100 + k: f"other {k}" for k in range(others)}
    # One that comes before all of them shares less with 20 than 10 does.
    got = dropped(spark, texts | {1: f"{hot}\nnothing else"})
    assert got[20] == "second" and got[10] == "and more\nfirst"


def test_common_lines_dont_break_blocks(spark):
    block = "one two three four five six\nseven eight nine ten eleven twelve\nthirteen fourteen fifteen sixteen seventeen eighteen"
    texts = {1: f"first\n{block}", 2: f"{block}\nsecond"} | {10 + k: f"own {k}\n{block.splitlines()[1]}\nother {k}" for k in range(12)}
    got = dropped(spark, texts)
    assert got == texts | {2: "second"}


def test_copies_in_which_lines_repeat(spark):
    chorus = "\n".join(f"line {k} of a chorus" for k in range(5))
    texts = {1: f"{chorus}\n{chorus}", 2: f"{chorus}\n{chorus}", 3: f"{chorus}\n{chorus}\nand more", 4: "la la la\n" * 9 + "end", 5: "la la la\n" * 9 + "other"}
    assert dropped(spark, texts) == texts | {2: "", 3: "and more", 5: "other"}


def test_hot_copies_and_clashing_columns(spark):
    text = "a line of some words\nand another with some more words"
    rows = [(k, text, 1, 2, 3) for k in range(400)] + [(k, f"{text}\nown {k}", 1, 2, 3) for k in range(1000, 1400)] + [(5, text, 1, 2, 3), (None, text, 1, 2, 3), (7, None, 1, 2, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_lines int, n_removed int, block int")
    got = line_dedup.drop_shared_lines(df)
    assert got.columns == ["doc_id", "text", "block", "n_lines", "n_removed"]
    held = {(r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in got.collect()}
    want = {(0, text, 2, 0), (None, text, 2, 0), (7, None, 0, 0)} | {(k, "", 2, 2) for k in range(1, 400)} | {(k, f"own {k}", 3, 2) for k in range(1000, 1400)}
    assert held == want and got.count() == len(rows)


def watched(monkeypatch, *names):
    """The tables of these names that line dedup writes."""
    seen, real = {x: [] for x in names}, line_dedup.written

    def written(df, name):
        out = real(df, name)
        if name in seen:
            seen[name].append(out)
        return out

    monkeypatch.setattr(line_dedup, "written", written)
    return seen


def test_rows_of_a_group_grow_with_its_places(spark, monkeypatch):
    """Texts that share a beginning, each one of another length."""
    lines = [f"one two three four five six seven eight nine ten {k}" for k in range(60)]
    texts = {k: "\n".join([f"head {k}", *lines[: 2 + 17 * k % 59], f"tail {k}"]) for k in range(24)}
    seen = watched(monkeypatch, "strides")
    assert dropped(spark, texts) == brute(texts)
    rows = [x.count() for x in seen["strides"]]
    assert sum(rows) < 4 * rows[0]


def test_longest_shared_runs_pair_all_that_few_have(spark, monkeypatch):
    """A place that several runs lead to counts once, so what few have isn't taken for what many have."""
    r = random.Random(2)
    lines = [f"one two three four five six seven eight nine ten {k}" for k in range(40)]
    texts = {k: [f"head {k}", *(x if r.random() < 0.96 else f"{x} own {k}" for x in lines)] for k in range(40)}
    seen = watched(monkeypatch, "firsts", "pairs")
    dropped(spark, {k: "\n".join(t) for k, t in texts.items()})
    ids = {x["doc"]: x["doc_id"] for x in seen["firsts"][0].select("doc", "doc_id").collect()}
    pairs = {(ids[x["a"]], ids[x["doc"]]) for x in seen["pairs"][0].collect()}
    holders = defaultdict(list)
    for k, t in texts.items():
        for i in range(len(t)):
            for j in range(i + 1, len(t) + 1):
                holders[tuple(t[i:j])].append(k)
    want = set()
    for k, t in texts.items():
        for i in range(len(t)):
            shared = [x for j in range(i + 1, len(t) + 1) if min(x := holders[tuple(t[i:j])]) < k]
            if shared:
                have = shared[-1]
                want |= {(a, k) for a in have if a < k} if len(have) <= line_dedup.RARE else {(min(have), k)}
    assert want <= pairs

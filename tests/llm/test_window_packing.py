"""Packing into windows of several sizes: every id once, windows full, numbers without gaps."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.test_operators import DOCS
from tonearm.llm import queries, window_packing

PATH = queries.tokenizer(queries.WORD_BPE)


@given(st.lists(st.integers(1, 300), max_size=40), st.sampled_from([(8, 16, 32), (4, 64), (16,)]))
@settings(max_examples=150, deadline=None)
def test_windows_are_full_and_hold_each_id_once(lengths, tiers):
    runs = [window_packing.Run(k, 0, n, np.arange(n, dtype="<u4")) for k, n in enumerate(lengths)]
    windows, rest = window_packing.pack_runs(runs, tiers)
    assert all(sum(len(r.ids) for r in held) == size and size in tiers for size, held in windows)
    assert sum(len(r.ids) for r in rest) < tiers[0]
    spans = defaultdict(list)
    for r in [r for _, held in windows for r in held] + rest:
        assert list(r.ids) == list(range(r.start, r.start + len(r.ids)))
        spans[r.doc].append((r.start, r.start + len(r.ids)))
    for k, n in enumerate(lengths):
        own = sorted(spans[k])
        assert own[0][0] == 0 and own[-1][1] == n and all(a[1] == b[0] for a, b in zip(own, own[1:]))


def test_short_documents_fill_the_gaps_of_long_ones():
    run = lambda k, n: window_packing.Run(k, 0, n, np.zeros(n, "<u4"))
    windows, rest = window_packing.pack_runs([run(0, 30), run(1, 6), run(2, 27), run(3, 2), run(4, 5), run(5, 2)], (8, 16, 32))
    assert [[r.doc for r in held] for _, held in windows[:2]] == [[0, 3], [2, 4]]  # the longest piece that fits
    assert [(size, [r.doc for r in held]) for size, held in windows[2:]] == [(8, [1, 5])] and not rest


def check(docs, got, tokenizer=PATH, end=2):
    t = Tokenizer.from_file(tokenizer)
    t.no_truncation()
    t.no_padding()
    want = sorted((d, tuple([*t.encode(text or "", add_special_tokens=False).ids, end])) for d, text, *_ in docs if d is not None)
    parts, windows = defaultdict(list), defaultdict(list)
    for r in got:
        if r["doc_id"] is not None:
            parts[r["doc_id"]].append(r)
        windows[r["sequence_id"]].append(r)
    for d, ids in want:
        own = sorted(parts[d], key=lambda r: r["start"])
        assert {r["doc_tokens"] for r in own} == {len(ids)}
        at = 0
        for r in own:
            assert r["start"] == at and r["length"] > 0 and r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    assert sorted(windows) == list(range(len(windows)))
    short = 0
    for held in windows.values():
        at = 0
        for r in sorted(held, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096 and len({(r["window"], r["step"]) for r in held}) == 1
        short += at != held[0]["window"]
    assert short <= 1
    return windows


@pytest.mark.parametrize("cells", [(2_000_000, 8_192, 512), (900, 8_192, 3), (10**9, 2, 4)])
def test_each_id_lies_in_one_piece(spark, cells):
    r = random.Random(3)
    docs = [(k, " ".join(r.choice(["alpha", "Beta,", "gamma's", "δέλτα", "x" * 30, "1234"]) for _ in range(r.choice([0, 3, 40, 300, 900, 2_500, 6_000]))), "en", "web", 0) for k in range(70)]
    docs += [(100, None, None, None, None), (101, "", "en", "web", 0), (102, " \n\t", "en", "web", 0)]
    df = spark.createDataFrame(docs, DOCS).repartition(3, "doc_id")
    got = window_packing.pack(df, PATH, 2, cell_ids=cells[0], cell_docs=cells[1], merge=cells[2]).collect()
    windows = check(docs, got)
    steps = defaultdict(list)
    for held in windows.values():
        steps[held[0]["window"], held[0]["step"]].append(sum(r["length"] ** 2 for r in held))
    numbers = sorted(s for _, s in steps)
    assert numbers == list(range(len(numbers)))
    for window in {w for w, _ in steps}:
        own = [len(v) * window for (w, _), v in sorted(steps.items()) if w == window]
        assert all(n == window_packing.STEP_IDS for n in own[:-1])


def test_steps_are_balanced():
    r = random.Random(4)
    costs = [r.randrange(1, 10**6) ** 2 for _ in range(640)]
    order = np.argsort(window_packing.spread(costs))
    sums = [sum(costs[k] for k in order[i : i + 16]) for i in range(0, 640, 16)]
    plain = [sum(costs[i : i + 16]) for i in range(0, 640, 16)]
    assert sorted(order.tolist()) == list(range(640)) and np.std(sums) < np.std(plain) / 3


def test_rows_that_repeat_and_none_at_all(spark):
    docs = [(None, "one two three", None, None, None)] * 5 + [(4, "a b", "en", "web", 0)] * 3
    got = window_packing.pack(spark.createDataFrame(docs, DOCS), PATH, 2).collect()
    assert sum(r["length"] for r in got if r["doc_id"] is None) == 5 * [r for r in got if r["doc_id"] is None][0]["doc_tokens"]
    assert window_packing.pack(spark.createDataFrame([], DOCS), PATH, 2).count() == 0
    clash = spark.createDataFrame([(1, "a b c", 5, 6)], "doc_id long, text string, start int, size int")
    assert window_packing.pack(clash, PATH, 2).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window", "step"]


def test_very_long_texts_are_encoded_in_parts(monkeypatch):
    r = random.Random(6)
    text = " ".join("".join(r.choice("abcdé.") for _ in range(r.randrange(1, 9))) for _ in range(5_000)) + "y" * 700
    monkeypatch.setattr(window_packing, "PART_CHARS", 500)
    encoder = window_packing.PieceEncoder.of(PATH, "<u4")
    parts = list(window_packing._parts(text))
    assert "".join(parts) == text and len(parts) > 20
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    assert np.frombuffer(b"".join(x for p in parts for x in encoder.encode([p])), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids

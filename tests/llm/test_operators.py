"""Operators against brute force, on rows with nulls, empty and long texts, ties and repeats."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonearm.llm import bpe, chat_format, line_dedup, media_chunks, mixing, quality, queries, sharding, simhash, substring_dedup, token_files

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
BLANKS = "\t\n\x0b\x0c\r "


def words_of(text):
    out, now = [], ""
    for c in text or "":
        if c in BLANKS:
            out, now = (out + [now] if now else out), ""
        else:
            now += c
    return out + [now] if now else out


def sample(seed=3, n=60):
    """Documents that share passages, with copies, near copies and every odd text."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefghäß") for _ in range(r.randint(1, 7))) for _ in range(400)]
    passage = [" ".join(r.choice(vocabulary) for _ in range(k)) for k in (70, 50, 49)]
    rows = []
    for k in range(n):
        body = [" ".join(r.choice(vocabulary) for _ in range(r.randint(3, 90)))]
        if k % 3 == 0:
            body.append(passage[k % 9 // 3])
        if k % 4 == 0:
            body.append("a line that many documents share, with enough words to count as one block of its own")
        r.shuffle(body)
        rows.append((k * 7 % 101, "\n".join(body), ["en", "de"][k % 2], ["web", "books"][k % 5 == 0], 0))
    rows += [(500, rows[5][1], "en", "web", 0), (501, rows[5][1].replace(" ", "  ", 1), "en", "web", 0), (501, rows[6][1], "en", "web", 0), (501, rows[6][1], "en", "web", 0)]
    rows += [(502, None, None, None, None), (503, "", "en", None, 0), (504, " \n\t ", "en", "web", 3), (505, "one", "en", "web", 3), (506, "Two WORDS", "en", "web", 9), (None, rows[7][1], "en", "web", 0), (None, None, None, None, None)]
    rows += [(507, " ".join(r.choice(vocabulary) for _ in range(30_000)), "de", "books", 0), (508, " x y\x1cz <|endoftext|> #*$%", "en", "web", 0), (509, "word " * 200, "en", "web", 0)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return sample()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(5).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def key(r):
    return str(sorted((k, str(v)) for k, v in r.items()))


def same(df, want):
    got = [r.asDict() for r in df.collect()]
    assert sorted(got, key=key) == sorted(want, key=key)


def test_substring_dedup(docs, rows, nothing):
    firsts = {}
    for i, text, *_ in rows:
        w = words_of(text)
        for k in range(len(w) - 49):
            s = tuple(w[k : k + 50])
            if i is not None:
                firsts[s] = min(firsts.get(s, i), i)
    want = []
    for i, text, *_ in rows:
        w, gone = words_of(text), set()
        for k in range(len(w) - 49):
            if i is not None and firsts[tuple(w[k : k + 50])] < i:
                gone |= set(range(k, k + 50))
        want.append({"doc_id": i, "n_words": len(w), "n_removed": len(gone), "kept_text": " ".join(x for k, x in enumerate(w) if k not in gone)})
    assert sum(x["n_removed"] for x in want) > 500
    same(substring_dedup.remove_repeats(docs.withColumn("block", F.lit(1)).withColumn("kept_text", F.lit("x"))), want)
    assert substring_dedup.remove_repeats(nothing).count() == 0


def test_automaton_shards_find_what_one_task_finds(spark, rows):
    """Rows in one partition and in many give the same."""
    one = substring_dedup.remove_repeats(spark.createDataFrame(rows, DOCS).coalesce(1))
    many = substring_dedup.remove_repeats(spark.createDataFrame(rows, DOCS).repartition(40))
    assert Counter(one.collect()) == Counter(many.collect())


def test_media_chunks(docs, rows, nothing):
    lists, folder = media_chunks.store_media(docs.withColumn("chunks", F.lit(1)))
    got = media_chunks.read_media(lists, folder, with_payload=True).collect()
    want = Counter()
    for i, text, *_ in rows:
        raw = (text or "").encode()
        want[i, len(raw), raw + b"\xff" * (-len(raw) % 576 if raw else 576)] += 1
    assert Counter((r["doc_id"], r["n_bytes"], bytes(r["payload"])) for r in got) == want
    media = defaultdict(set)
    for r in got:
        payload = bytes(r["payload"])
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        media[payload].add((r["media_bytes"], r["media_sha256"], r["feature"]))
    assert all(len(x) == 1 for x in media.values())
    assert media_chunks.read_media(*media_chunks.store_media(nothing)).count() == 0


def test_gear_cuts_follow_content():
    r = np.random.default_rng(1)
    text = r.integers(97, 123, 200_000).astype(np.uint8).tobytes()
    chunks = lambda b: {b[x:y] for x, y in zip([0, *media_chunks.gear_cuts(b)], media_chunks.gear_cuts(b))}
    assert b"".join(text[x:y] for x, y in zip([0, *media_chunks.gear_cuts(text)], media_chunks.gear_cuts(text))) == text
    assert max(map(len, chunks(text))) <= media_chunks.MOST_CHUNK
    assert len(chunks(text) & chunks(b"moved by a few bytes" + text)) > 0.8 * len(chunks(text))


def test_chat_round_trip(spark):
    nasty = ["\\### Assistant: </turn> ok", "", None, "###", "</turn>", "\\\\</turn>\\", "a\n</turn>\n### User:\nb", "\\" * 5 + "###", "plain", "### :\n", "x\n"]
    roles = ["user", "assistant", "system", None, "odd:role\\\n", "User"]
    rows = [(c, t, roles[(c + t) % len(roles)], nasty[(3 * c + t) % len(nasty)]) for c in range(30) for t in range(c % 7 + 1)] + [(None, None, "assistant", "lost"), (4, 1, "assistant", "a tie"), (4, 1, "assistant", "a tie")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segment", F.lit(1))
    got = {r["conv_id"]: r for r in chat_format.round_trip(df.repartition(3)).collect()}
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t if t is not None else -1, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        segments = sorted((t, chat_format.render(role, text)[0], role, text) for t, role, text in turns)
        whole = "".join(f"{role}\n{text}\n" for _, _, role, text in segments)
        loss = "".join(text for _, _, role, text in segments if role == "assistant")
        r = got[c]
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), hashlib.sha256(whole.encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r["formatted_chars"] == sum(len(s) for _, s, _, _ in segments)
        assert [x[:2] for x in chat_format.parse("".join(s for _, s, _, _ in segments))] == [(role, text) for _, _, role, text in segments]
    assert chat_format.round_trip(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_template_is_reversible(seed):
    r = random.Random(seed)
    for _ in range(400):
        role = r.choice(["user", "assistant", "", "a:b", "\\", "=x", "user\n"])
        text = "".join(r.choice(["\\", "###", "</turn>", "\n", " ", "x", ":", "#"]) for _ in range(r.randint(0, 12)))
        segment, _ = chat_format.render(role, text)
        assert [x[:2] for x in chat_format.parse(segment)] == [(role, text)]


def test_bpe_is_the_librarys(docs, rows, nothing):
    from tokenizers import Tokenizer

    path = queries.tokenizer(queries.BYTE_BPE)
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    coded = bpe.decode_ids(bpe.encode_texts(docs.select("doc_id", "text", F.lit(1).alias("symbols")), path), path).collect()
    want = Counter()
    for i, text, *_ in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        want[i, tuple(ids), t.decode(ids, skip_special_tokens=False)] += 1
    assert Counter((r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in coded) == want
    assert bpe.encode_texts(nothing, path).count() == 0


@pytest.mark.parametrize("many", [1, 3, 10**9])
@pytest.mark.parametrize("seed", range(3))
def test_bpe_on_odd_texts(seed, many, monkeypatch):
    """However many places of a rank are merged by array, the ids are the library's."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(bpe, "MANY_PLACES", many)

    path = queries.tokenizer(queries.BYTE_BPE)
    t, codec, decoder, r = Tokenizer.from_file(path), bpe.ByteBpe(path), bpe.ByteDecoder(path), random.Random(seed)
    t.no_truncation()
    t.no_padding()
    alphabet = list("aeinst THE019'.,!?-_\n\t\r\x0b\x1c\x85  　éß漢😀") + ["'s", "  ", "<|endoftext|>", "ing", "‍", "́", "aaaaa", "ababab", "the"]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(500)]
    for text, raw in zip(texts, codec.encode(texts)):
        ids = np.frombuffer(raw, "<i4").tolist()
        assert ids == t.encode(text, add_special_tokens=False).ids, text
        assert decoder.decode(ids) == t.decode(ids, skip_special_tokens=False)


def least_capacity(sizes, shards):
    """By trying all capacities that the greedy pass can end at."""

    def fits(c):
        n, at = 1, 0
        for s in sizes:
            if s > c:
                return False
            if at + s > c:
                n, at = n + 1, 0
            at += s
        return n <= shards

    low, high = max(sizes, default=0), sum(sizes)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(mid) else (mid + 1, high)
    return low


def test_sharding(spark, docs, rows, nothing):
    got = sharding.shard_documents(docs.withColumns({"g": F.lit(1), "shard": F.lit(2)}), 16).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    slots = defaultdict(list)
    for r in got:
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < 16
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert sharding.shard_documents(nothing, 16).count() == 0


@pytest.mark.parametrize("n, shards", [(1, 4), (5, 4), (300, 7), (3000, 16)])
def test_minimax_is_the_least_capacity(spark, n, shards):
    r = random.Random(n)
    groups = sorted((r.getrandbits(64) - 2**63, r.choice([1, 5, 900, r.randint(1, 4000)])) for _ in range(n))
    df = spark.createDataFrame(groups, "g long, size long")
    alone, lasts = sharding.cut_points(df, shards)
    rest = [(g, s) for g, s in groups if g not in set(alone)]
    loads = Counter(sum(g > last for last in lasts) for g, _ in rest)
    sums = defaultdict(int)
    for g, s in rest:
        sums[sum(g > last for last in lasts)] += s
    assert len(loads) <= shards - len(alone)
    assert max(sums.values(), default=0) == least_capacity([s for _, s in rest], shards - len(alone))


def test_line_dedup(spark, docs, nothing):
    shared = "\n".join(f"line {k} of the shared block with a few words" for k in range(4))
    rows = [(1, f"top of one\n{shared}\nend of one"), (2, f"{shared}\nanother end"), (3, f"\n\nfront\n{shared}"), (4, "line 1 of the shared block with a few words\nown"), (5, "x\ny\nz"), (6, "x\ny"), (7, None), (8, ""), (None, shared), (2, f"{shared}\nanother end"), (9, shared.replace("\n", "\n\n"))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"line": F.lit(1), "gone": F.lit("x"), "c0": F.lit(2)})
    got = line_dedup.drop_shared_lines(df).collect()
    assert Counter((r["doc_id"], r["text"], r["n_removed"]) for r in got) == Counter({
        (1, rows[0][1], 0): 1, (2, "another end", 4): 2, (3, "\n\nfront", 4): 1, (4, "own", 1): 1, (5, "x\ny\nz", 0): 1, (6, "x\ny", 0): 1, (7, None, 0): 1, (8, "", 0): 1, (None, shared, 0): 1, (9, "\n\n", 4): 1,
    })
    assert all((r["line"], r["gone"], r["c0"]) == (1, "x", 2) for r in got)
    assert line_dedup.drop_shared_lines(nothing).count() == 0
    assert line_dedup.drop_shared_lines(docs).count() == docs.count()


def test_patience_aligns_in_order():
    assert line_dedup.patience([(0, 0), (1, 1), (2, 2), (1, 5), (5, 1)]) == [(0, 0), (1, 1), (2, 2)]
    assert line_dedup.patience([(0, 1), (1, 0)]) in ([(0, 1)], [(1, 0)])
    assert line_dedup.patience([]) == []


def test_token_files(docs, rows, nothing):
    from tokenizers import Tokenizer

    path = queries.tokenizer(queries.WORD_BPE)
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    for vocabulary in (queries.WORD_BPE_IDS, 2**20):
        got = token_files.read_token_files(*token_files.write_token_files(docs.withColumn("part", F.lit(1)), path, 1, vocabulary), vocabulary).collect()
        want = Counter()
        for i, text, *_ in rows:
            ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
            want[i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
        assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
        got.sort(key=lambda r: r["start"])
        assert [r["doc_id"] is not None and r["doc_id"] for r in got] == sorted((r["doc_id"] is not None and r["doc_id"] for r in got), key=lambda x: (x is not False, x))
        at = 0
        for r in got:
            assert r["start"] == at
            at += r["n_tokens"]
    assert token_files.read_token_files(*token_files.write_token_files(nothing, path, 1, queries.WORD_BPE_IDS), queries.WORD_BPE_IDS).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_pieces_encode_as_the_whole(seed):
    from tokenizers import Tokenizer

    path, r = queries.tokenizer(queries.WORD_BPE), random.Random(seed)
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    alphabet = list("aeinstTHEÉß019'.,!?-_\n\t\r\x0b\x1c\x85  　漢İ😀σΣ") + ["'s", "  ", "<|endoftext|>", "<|startoftext|>", "ing ", "‍", "́", "</w>", "hello"]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 50))) for _ in range(500)]
    for text, raw in zip(texts, token_files.PieceEncoder(path, "<u2").encode(texts)):
        assert np.frombuffer(raw, "<u2").tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)


def brute_fingerprint(text):
    import xxhash

    w = words_of("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    """Least id of each fingerprint's component, by union of all pairs within two bits."""
    root = {f: f for f in prints}

    def find(f):
        while root[f] != f:
            root[f] = root[root[f]]
            f = root[f]
        return f

    fs = list(prints)
    for i, a in enumerate(fs):
        for b in fs[:i]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    least = {}
    for f, ids in prints.items():
        ids = [i for i in ids if i is not None]
        if ids:
            least[find(f)] = min(min(ids), least.get(find(f), 10**9))
    return {f: least.get(find(f)) for f in fs}


def test_simhash(docs, rows, nothing):
    prints = defaultdict(list)
    for i, text, *_ in rows:
        prints[brute_fingerprint(text)].append(i)
    component = brute_components(prints)
    got = simhash.near_duplicates(docs.withColumn("fp", F.lit(1))).collect()
    assert Counter((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in got) == Counter((i, brute_fingerprint(t), component[brute_fingerprint(t)]) for i, t, *_ in rows)
    assert simhash.near_duplicates(nothing).count() == 0


@pytest.mark.parametrize("dense", [False, True])
def test_links_reach_all_within_two_bits(spark, dense):
    r = random.Random(dense)
    prints = set()
    for _ in range(60):
        f = r.getrandbits(64)
        for _ in range(r.choice([1, 2, 5, 120 if dense else 6])):
            prints.add(f)
            for b in r.sample(range(64), r.choice([1, 2, 2, 3])):
                f ^= 1 << b
    signed = lambda f: f - 2**64 if f >= 2**63 else f
    df = spark.createDataFrame([(signed(f),) for f in prints], "fp long")
    pairs = simhash.links(df).collect()
    assert not dense or len(prints) > 2000
    roots = {x["node"]: x["root"] for x in simhash.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    want = brute_components({f: [k] for k, f in enumerate(sorted(prints))})
    groups, mine = defaultdict(set), defaultdict(set)
    for f in prints:
        groups[want[f]].add(f)
        mine[roots.get(signed(f), signed(f))].add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def brute_targets(sizes, weights=(5.0, 2.0, 1.0), most=3.0):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    out, free = {}, list(order)
    while free:
        left = sum(sizes.values()) - sum(out.values())
        over = [s for s in free if left * weight[s] / sum(weight[x] for x in free) > most * sizes[s]]
        out |= {s: most * sizes[s] for s in over} if over else {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        free = [s for s in free if s not in over] if over else []
    return out


def test_mixing(spark, docs, rows, nothing):
    first = mixing.mix_documents(docs.withColumns({"row": F.lit(1), "size": F.lit(2)})).collect()
    again = mixing.mix_documents(docs.repartition(3)).collect()
    assert Counter((r["doc_id"], r["size"], r["taken"]) for r in first) == Counter((r["doc_id"], r["size"], r["taken"]) for r in again)
    sizes = defaultdict(int)
    for _, text, _, source, _ in rows:
        sizes[source] += len(words_of(text))
    want = brute_targets(sizes)
    taken = defaultdict(int)
    for r in first:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 and 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    total = sum(sizes.values())
    assert all(abs(taken[s] - want[s]) <= 0.01 * total for s in sizes), (taken, want)
    assert mixing.mix_documents(nothing).count() == 0


def test_mixed_texts_hold_the_words_taken(docs, rows):
    taken = Counter()
    for r in mixing.mix_documents(docs).collect():
        taken[r["source"]] += r["taken"]
    held = Counter()
    for r in mixing.mixed_texts(docs).collect():
        held[r["source"]] += len(words_of(r["text"]))
    assert held == taken


@pytest.mark.parametrize("n", [3, 1000, 200_000])
def test_schedule_keeps_to_its_shares(spark, n):
    shares = [(0, 55), (1, 30), (2, 0), (3, 15)]
    got = mixing._schedule(spark.createDataFrame(shares, "source_no long, words long"), n, 100).toPandas()
    assert sorted(got["slot"]) == list(range(n))
    for no, share in shares:
        mine = got[got["source_no"] == no].sort_values("slot")
        assert list(mine["block"]) == list(range(len(mine)))
        assert abs(len(mine) - share / 100 * n) <= 3 + np.log2(n)


def brute_stats(text):
    w = words_of(text)
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words_of(line):
            dup += line in seen
            seen.add(line)
    triples = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    covered = {k + j for k in range(len(w) - 2) if triples[tuple(w[k : k + 3])] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(covered)


def test_quality_statistics(docs, rows, nothing):
    got = quality.judge(docs.withColumns({"model": F.lit(1), "f0": F.lit(2), "kept": F.lit(3)})).collect()
    assert Counter((r["doc_id"], *(r[s] for s in quality.STATS)) for r in got) == Counter((i, *brute_stats(t)) for i, t, *_ in rows)
    for r in got:
        failed = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert r["base_failed"] == failed and not (failed and r["kept"])
    assert quality.judge(nothing).count() == 0


def test_outliers_go_and_the_rest_stays(spark):
    r = random.Random(1)
    words = ["".join(r.choice("etaoinshr") for _ in range(r.randint(2, 8))) for _ in range(3000)]
    prose = [(k, " ".join(r.choice(words) for _ in range(r.randint(80, 500))), "en", "web") for k in range(600)]
    junk = [(1000 + k, " ".join(r.choice(words) + " " + "#*$%" * 4 for _ in range(200)), "en", "web") for k in range(20)] + [(1100 + k, " ".join("".join(r.choice("etaoinshr") for _ in range(60)) for _ in range(150)), "en", "web") for k in range(20)]
    kept = {x["doc_id"]: x["kept"] for x in quality.judge(spark.createDataFrame(prose + junk, "doc_id long, text string, lang string, source string")).collect()}
    assert sum(kept[k] for k, *_ in prose) >= 595 and not any(kept[k] for k, *_ in junk)

"""Substring dedup by repeated-phrase automata.

Each document is reduced to phrases of 16 words, one in any 35 consecutive ones (the least hash), so
two documents that share 50 words share a phrase. Phrases of more than one document are confirmed by a
Spark window over their hashes. A task packs the documents it reads into blocks of bounded size, kept
compressed in the shared folder. Automata are sharded by block: a block's one holds the confirmed phrases
that stand in that block (others can't occur there, for each document has its own phrases), and all its
documents stream through it, which locates every occurrence.
The windows around the occurrences are compared over the whole corpus by a rolling hash and a digest of
their words themselves, and a window goes where a smaller document has it too.

Automata don't grow with the corpus, no document meets an automaton other than its block's, and texts
are never shuffled: a hot phrase or window has one row for each block, with its least and largest doc_id.
The rolling hashes are polynomials and can be made to collide (they choose what to look at); the digest is
XXH3 of the window's words as they stand, so both agree on different words with a chance of about 2**-128,
and on words made to break the polynomials with one of 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import by_block, column, grouped, opened, packed, tasks_for
from .common import new_path, text_or_empty, written

WINDOW, PHRASE, SEED = 50, 16, 50
CHUNK_BYTES = 2**20
#: Odd multiplier of the polynomial hashes, and those of the final mix.
BASE = 0x9E3779B97F4A7C15
MIX, SPREAD = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC2B2AE3D27D4EB4F)
SEPARATOR = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
BYTES = np.random.default_rng(1).integers(0, 2**64, 256, np.uint64)

_POWERS: list[tuple[np.ndarray, np.ndarray]] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i mod 2**64 for i up to n at least."""
    if not _POWERS or len(_POWERS[0][0]) <= n:
        size = max(1 << 16, n + n // 4)
        up, down = (np.full(size, b % 2**64, np.uint64) for b in (BASE, pow(BASE, -1, 2**64)))
        up[0] = down[0] = 1
        _POWERS[:] = [(np.multiply.accumulate(up), np.multiply.accumulate(down))]
    return _POWERS[0]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * MIX
    return h ^ (h >> np.uint64(29))


def _sums(x: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x * _powers(len(x))[1][: len(x)], out=sums[1:])
    return sums


def rolling(x: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of each run of so many values."""
    n = len(x) - length + 1
    sums = _sums(x)
    return _mixed((sums[length:] - sums[:n]) * _powers(n)[0][:n])


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of some documents, and where each document's words begin.

    data: the documents' UTF-8 bytes end to end, offsets: where they begin, and the end. Works on whole
    arrays; no word becomes a Python object.
    """
    n = len(data)
    gap = SEPARATOR[data]
    before, after = np.ones(n, bool), np.ones(n, bool)
    before[1:], after[:-1] = gap[:-1], gap[1:]
    inner = offsets[(offsets > 0) & (offsets < n)]
    before[inner], after[inner - 1] = True, True
    first, last = np.flatnonzero(~gap & before), np.flatnonzero(~gap & after) + 1
    sums = _sums(BYTES[data])
    out = _mixed((sums[last] - sums[first]) * _powers(n)[0][first] + (last - first).astype(np.uint64) * SPREAD)
    return out, np.searchsorted(first, offsets)


def digests(words: list[bytes], starts: np.ndarray, window: int) -> np.ndarray:
    """A 64-bit digest of each window of words, from the words themselves."""
    from xxhash import xxh3_64_digest

    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)  # a space further
    begins = np.append(0, ends[:-1])
    return np.frombuffer(b"".join([xxh3_64_digest(flat[a:b], SEED) for a, b in zip(begins[starts].tolist(), (ends[starts + window - 1] - 1).tolist())]), np.uint64)


def _slide(h: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Least or largest of each run of width values, by doubling."""
    f, at = (np.minimum if least else np.maximum), 1
    while at < width:
        step = min(at, width - at)
        h = f(h[: len(h) - step], h[step:])
        at += step
    return h


def phrase_places(h: np.ndarray, width: int) -> np.ndarray:
    """Where the least hash of some run of width phrases stands; equal ones all count."""
    low = _slide(h, width, True)
    edge = np.zeros(width - 1, h.dtype)
    return np.flatnonzero(_slide(np.concatenate([edge, low, edge]), width, False) == h)


def _chunks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of documents of about CHUNK_BYTES: the first one's number, their bytes, their offsets."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_binary(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK_BYTES, "right")) - 1)
        yield i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


PHRASES = "f long, block long, place long, low long, high long"


def _pack(folder: str, window: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each block's phrases, with a row without a phrase first."""
        plain = (pa.RecordBatch.from_arrays([x.column("doc_id"), x.column("text").cast(pa.large_binary())], names=["doc_id", "text"]) for x in batches)
        for name, table in packed(folder, plain, "text"):
            known, doc_ids, texts = _opened(table)
            fs_, docs, places = [], [], []
            for i, data, offsets in _chunks(texts):
                x, bounds = word_hashes(data, offsets)
                for k in np.flatnonzero((np.diff(bounds) >= window) & known[i : i + len(offsets) - 1]):
                    h = rolling(x[bounds[k] : bounds[k + 1]], PHRASE)
                    at = phrase_places(h, window - PHRASE + 1)
                    fs_.append(h[at])
                    docs.append(np.full(len(at), doc_ids[i + k]))
                    places.append(at + ((i + k) << 32))
            f, doc, place = (np.concatenate([np.zeros(0, np.int64).view(t), *x]) for t, x in ((np.uint64, fs_), (np.int64, docs), (np.int64, places)))
            order = np.lexsort((doc, f))
            f, doc, place = f[order], doc[order], place[order]
            head = np.flatnonzero(np.concatenate([[True], f[1:] != f[:-1]])[: len(f)])
            high = doc[np.append(head[1:], len(f)) - 1] if len(head) else doc
            n = len(head)
            columns = [pa.array(np.append(0, f[head].view(np.int64)), mask=np.append(True, np.zeros(n, bool))), np.full(n + 1, name), *(np.append(0, x) for x in (place[head], doc[head], high))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["f", "block", "place", "low", "high"])

    return pack


def _opened(table: pa.Table) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Which rows have ids, the ids, and the texts of a block."""
    ids = column(table, "doc_id")
    return ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False), column(table, "text")


def _points(x: np.ndarray) -> str:
    """Words as code points, equal ones alike (surrogates are left out)."""
    v = (x % np.uint64(1_000_003)).astype(np.uint32) + np.uint32(256)
    return (v + np.uint32(2048) * (v >= 0xD800)).tobytes().decode("utf-32-le")


WINDOWS = "block long, w1 long, w2 long, low long, high long"


def _locate(folder: str, window: int):
    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        for name, rows in grouped(batches):
            known, doc_ids, texts = _opened(opened(folder, name))
            hashed = []
            for i, data, offsets in _chunks(texts):
                x, bounds = word_hashes(data, offsets)
                hashed += [(i + k, x[a:b]) for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())) if b - a >= window and known[i + k]]
            stream = {k: _points(x) for k, x in hashed}
            automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
            for place in rows.column("place").to_pylist():
                at = place & 0xFFFFFFFF
                automaton.add_word(stream[place >> 32][at : at + PHRASE])
            automaton.make_automaton()
            found = [[], [], []]
            for k, x in hashed:
                ends = np.fromiter((e for e, _ in automaton.iter(stream[k])), np.int64)
                if not len(ends):
                    continue
                n = len(x) - window + 1
                cover = np.zeros(n + 1, np.int32)  # windows that hold a located phrase
                np.add.at(cover, np.clip(ends + 1 - window, 0, n), 1)
                np.add.at(cover, np.clip(ends - PHRASE + 2, 0, n), -1)
                at = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
                found[0].append(rolling(x, window)[at])
                found[1].append(digests(texts[k].as_py().split(), at, window))
                found[2].append(np.full(len(at), doc_ids[k]))
            if not found[0]:
                continue
            w1, w2, doc = (np.concatenate(x) for x in found)
            order = np.lexsort((doc, w2, w1))
            w1, w2, doc = w1[order], w2[order], doc[order]
            head = np.flatnonzero(np.concatenate([[True], (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])]))
            last = np.append(head[1:], len(w1)) - 1
            for i in range(0, len(head), 50_000):
                h, t = head[i : i + 50_000], last[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), name)), pa.array(w1[h].view(np.int64)), pa.array(w2[h].view(np.int64)), pa.array(doc[h]), pa.array(doc[t])], names=["block", "w1", "w2", "low", "high"])

    return locate


KEPT = "doc_id long, n_words long, n_removed long, kept_text string"


def _remove(folder: str, window: int):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, rows in grouped(batches):
            table = opened(folder, name)
            ids, (known, doc_ids, texts) = column(table, "doc_id"), _opened(table)
            rows = rows.filter(pa.compute.is_valid(rows.column("w1")))
            w1, w2, least = (rows.column(c).to_numpy() for c in ("w1", "w2", "least"))
            w1, w2 = w1.view(np.uint64), w2.view(np.uint64)
            order = np.argsort(w1)
            hashes = w1[order]
            key = w1 * SPREAD + w2
            order = np.argsort(key)
            key, w1, w2, least = key[order], w1[order], w2[order], least[order]
            for i, data, offsets in _chunks(texts):
                x, bounds = word_hashes(data, offsets)
                count, removed, kept, raw = [], [], [], data.tobytes()
                for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                    words, gone = raw[offsets[k] : offsets[k + 1]].split(), 0
                    if b - a >= window and len(key) and known[i + k]:
                        h = rolling(x[a:b], window)
                        goes = np.flatnonzero(hashes[np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)] == h)
                        if len(goes):
                            h, own = h[goes], digests(words, goes, window)
                            at = np.minimum(np.searchsorted(key, h * SPREAD + own), len(key) - 1)
                            goes = goes[(w1[at] == h) & (w2[at] == own) & (least[at] < doc_ids[i + k])]
                        if len(goes):
                            cover = np.zeros(b - a + 1, np.int32)
                            np.add.at(cover, goes, 1)
                            np.add.at(cover, goes + window, -1)
                            stays = np.cumsum(cover[:-1]) == 0
                            gone = len(words) - int(stays.sum())
                            words = compress(words, stays.tolist())
                    count.append(b - a)
                    removed.append(gone)
                    kept.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays([ids.slice(i, len(count)), pa.array(count, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])

    return remove


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and kept_text, a row for each row of docs.

    A word goes if it is in a window of so many words that also starts in a document with a smaller
    doc_id; windows are those of the input. Kept words are joined by one space. A null text has no words;
    a row with a null doc_id keeps all its words and takes none from others. Rows with equal doc_ids don't
    take words from each other. window is more than 16.
    """
    spark = docs.sparkSession
    folder = new_path(spark, "blocks")
    picked = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    phrases = written(picked.mapInArrow(_pack(folder, window), PHRASES), "phrases")
    blocks = phrases.where("f is null").select("block")
    by_phrase = Window.partitionBy("f")  # a row for each block
    spread = phrases.where("f is not null").withColumns({"least": F.min("low").over(by_phrase), "most": F.max("high").over(by_phrase)})
    confirmed = spread.where("least < most").select("block", "place")
    windows = confirmed.repartition(tasks_for(blocks), "block").sortWithinPartitions("block").mapInArrow(_locate(folder, window), WINDOWS)
    least = windows.withColumn("least", F.min("low").over(Window.partitionBy("w1", "w2")))
    judged = least.where("least < high").select("block", "w1", "w2", "least")
    return by_block(judged, blocks).mapInArrow(_remove(folder, window), KEPT)

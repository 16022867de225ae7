"""BPE encoding and decoding with a pair occurrence index.

The distinct words of a partition lie end to end in one list of symbols. An index maps each pair of
neighbours to all its places in that list; the active ranks are applied in ascending order, each at all
its places at once (frequent ones by array), and the lists of the pairs next to a merge are updated. Ids
of a text are those of its pieces. A partition may hold more distinct words than a worker's memory, so
words are indexed as they first appear, at most BATCH_WORDS at once, and each once for the partition as
long as the caches hold it; a merge never spans words, so ids don't depend on how they are dealt.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, tidy

#: Pieces and words whose ids a task keeps at most.
CACHE_PIECES, CACHE_WORDS = 200_000, 300_000
#: Words that are merged at once, and places from which on a rank is applied to all of them by array.
BATCH_WORDS, MANY_PLACES = 60_000, 128
#: Bits of an id in a pair's key.
ID_BITS = 24
#: A run without white space and one space before it, or white space; 0x1C to 0x1F aren't white space here.
PIECE = re.compile(r" ?[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+(?![\S\x1c-\x1f])|[^\S\x1c-\x1f]+")
_CODECS: dict[tuple[type, str], ByteBpe | ByteDecoder] = {}


def _read(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def codec(kind: type, path: str):
    """A worker's own encoder or decoder, kept from one task to the next."""
    if (kind, path) not in _CODECS:
        _CODECS[kind, path] = kind(path)
    return _CODECS[kind, path]


class ByteDecoder:
    """The bytes that each id of a byte-level vocabulary stands for."""

    def __init__(self, path: str) -> None:
        told = _read(path)
        special = {t["id"]: t["content"] for t in told["added_tokens"]}
        byte_of = _byte_alphabet()
        self.bytes_of = {k: bytes(byte_of[c] for c in t) for t, k in told["model"]["vocab"].items() if k not in special} | {k: t.encode() for k, t in special.items()}

    def decode(self, ids: list[int]) -> str:
        """Bytes of the ids as UTF-8; what isn't becomes U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


class ByteBpe:
    """A byte-level BPE vocabulary, its merges, and the ids of the pieces seen. ValueError for ids of more than ID_BITS bits."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        told = _read(path)
        vocabulary: dict[str, int] = told["model"]["vocab"]
        if max(vocabulary.values(), default=0) >> ID_BITS:
            raise ValueError(f"a vocabulary with ids of more than {ID_BITS} bits")
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in told["model"]["merges"]]
        self.merges = [(vocabulary[a], vocabulary[b], vocabulary[a + b]) for a, b in pairs]
        self.rank = {a << ID_BITS | b: rank for rank, (a, b, _) in enumerate(self.merges)}
        self.keys, self.key_ranks = (np.array(x, np.int64) for x in zip(*sorted(self.rank.items())))
        self.symbol = {c: k for c, k in vocabulary.items() if len(c) == 1}
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        rules = told | {"model": {"type": "BPE", "vocab": {}, "merges": []}, "added_tokens": [], "post_processor": None}
        self.split = Tokenizer.from_str(json.dumps(rules)).pre_tokenizer.pre_tokenize_str  # the library's own rules, without its vocabulary
        first = told.get("pre_tokenizer") or {}
        self.plain = first.get("type") == "ByteLevel" and first.get("use_regex", True) and not first.get("add_prefix_space") and not told.get("normalizer")
        self.shown = {b: c for c, b in _byte_alphabet().items()}
        self.words: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}

    def forget(self) -> None:
        """Gives back what was kept of texts; workers outlive their tasks."""
        self.words.clear()
        self.known.clear()

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 for pairs that don't merge; what is below 0 is no symbol."""
        keys = left.astype(np.int64) << ID_BITS | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((self.keys[at] == keys) & (left >= 0) & (right >= 0), self.key_ranks[at], -1)

    def indexed(self, at: np.ndarray, ranks: np.ndarray) -> Iterator[tuple[int, list[int]]]:
        """Places by rank, ascending, without those of rank -1."""
        order = np.argsort(ranks, kind="stable")
        at, ranks = at[order], ranks[order]
        heads = np.flatnonzero(np.diff(ranks, prepend=-1))
        for i, j in zip(heads.tolist(), [*heads[1:].tolist(), len(at)]):
            yield int(ranks[i]), at[i:j].tolist()

    def merge(self, words: list[str]) -> list[bytes]:
        """Ids of words of the byte alphabet, all at once. The pair occurrence index is places: rank to positions."""
        told: list[int] = [-1]
        for w in words:
            told += map(self.symbol.__getitem__, w)
            told.append(-1)  # words don't touch
        n = len(told)
        flat, nexts, befores = np.array(told, np.int32), np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        symbols, after, before = memoryview(flat), memoryview(nexts), memoryview(befores)  # the same arrays, for one place at a time
        rank_of, merges, bits = self.rank.get, self.merges, ID_BITS
        places = dict(self.indexed(np.arange(n - 1), self.ranks(flat[:-1], flat[1:])))
        active = sorted(places)

        def add(near: int, found: list[int]) -> None:
            if near in places:
                places[near] += found
            else:
                places[near] = found
                heappush(active, near)

        while active:
            rank = heappop(active)
            a, b, new = merges[rank]
            found = places.pop(rank)
            if len(found) >= MANY_PLACES and a != b:  # places of a pair of two symbols never overlap
                at = np.unique(np.array(found, np.int32))
                at = at[flat[at] == a]
                at = at[flat[nexts[at]] == b]
                right = nexts[at]
                flat[at], flat[right] = new, -2
                beyond = nexts[right]
                nexts[at], befores[beyond] = beyond, at
                left = befores[at]
                for p, r in ((left, self.ranks(flat[left], flat[at])), (at, self.ranks(flat[at], flat[beyond]))):
                    for near, where in self.indexed(p, r):
                        add(near, where)
                continue
            for at in sorted(found):
                if symbols[at] != a:
                    continue  # merged meanwhile
                right = after[at]
                if symbols[right] != b:
                    continue
                symbols[at], symbols[right] = new, -2
                beyond, left = after[right], before[at]
                after[at], before[beyond] = beyond, at
                for key, place in ((symbols[left] << bits | new, left), (new << bits | symbols[beyond], at)):
                    near = rank_of(key)
                    if near is not None:
                        add(near, [place])
        flat = flat[flat != -2]
        raw, cuts = flat.astype("<i4").tobytes(), np.flatnonzero(flat == -1).tolist()
        return [raw[4 * x + 4 : 4 * y] for x, y in zip(cuts, cuts[1:])]

    def cut(self, piece: str) -> list[str]:
        """A piece as words of the byte alphabet. Letters after at most one space are a word by the byte-level rules, a mark after them another; the rest is the library's to cut."""
        if piece in self.special:
            return [piece]
        body = piece[1:] if piece[0] == " " else piece
        if self.plain and body:
            if body.isalpha():
                return [self.spelled(piece)]
            if body[-1] in ".,;:!?" and body[:-1].isalpha():
                return [self.spelled(piece[:-1]), body[-1]]
        return [w for w, _ in self.split(piece)]

    def spelled(self, text: str) -> str:
        """A text in characters that stand for its bytes."""
        return text.replace(" ", self.shown[32]) if text.isascii() else text.encode().decode("latin-1").translate(self.shown)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        split = [self.pieces(t) for t in texts]
        if len(self.known) > CACHE_PIECES:
            self.known.clear()
        known, special = self.known, self.special
        new = list(set().union(*split) - known.keys())
        cut = list(map(self.cut, new))
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        words = self.words
        fresh = list(set().union(*cut) - words.keys() - special.keys())
        for k in range(0, len(fresh), BATCH_WORDS):
            words.update(zip(fresh[k : k + BATCH_WORDS], self.merge(fresh[k : k + BATCH_WORDS])))
        for piece, own in zip(new, cut):
            known[piece] = np.array([special[piece]], "<i4").tobytes() if piece in special else b"".join([words[w] for w in own])
        return [b"".join(map(known.__getitem__, x)) for x in split]

    def pieces(self, text: str) -> list[str]:
        """A text as special tokens and runs at whose ends a word always ends."""
        if not any(x in text for x in self.special):
            return PIECE.findall(text)
        return [p for part in self.at_special.split(text) for p in ([part] if part in self.special else PIECE.findall(part))]


def _byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte: itself where it prints, else the next free one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


def _encode(path: str):
    @tidy
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ByteBpe, path)
        for batch in batches:
            names = [n for n in batch.schema.names if n != "text"]
            for k in range(0, len(batch), 1_000):
                part = batch.slice(k, 1_000)
                flat = own.encode(part.column("text").to_pylist())
                ends = np.cumsum([0, *(len(x) // 4 for x in flat)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(flat), "<i4")))
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), ids], names=[*names, "ids"])
        own.forget()

    return encode


def encode_texts(docs: DataFrame, tokenizer_path: str, text_col: str = "text") -> DataFrame:
    """docs with ids, the text's token ids, in place of the text.

    A null or empty text has none; rows and other columns stay, but for one named ids, or text beside the
    text's own, which is replaced. No rows give no rows.
    """
    rest = [f for f in docs.schema.fields if f.name not in (text_col, "text", "ids")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), "ids array<int>"])
    return docs.select(*(f"`{f.name}`" for f in rest), text_or_empty(text_col).alias("text")).mapInArrow(_encode(tokenizer_path), schema)


def _decode(path: str, ids_col: str):
    @tidy
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ByteDecoder, path)
        for batch in batches:
            names, column = batch.schema.names, batch.column(ids_col)
            values, ends = column.values.to_numpy(), column.offsets.to_numpy()  # no nulls: decode_ids() fills them
            texts = [own.decode(values[a:b].tolist()) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*names, "decoded"])

    return decode


def decode_ids(encoded: DataFrame, tokenizer_path: str, ids_col: str = "ids") -> DataFrame:
    """encoded with decoded, the text that the ids stand for. Null ids give an empty text; a column named decoded is replaced."""
    encoded = encoded.drop("decoded") if ids_col != "decoded" else encoded.withColumnRenamed("decoded", "ids")
    ids_col = "ids" if ids_col == "decoded" else ids_col
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields), "decoded string"])
    return encoded.withColumn(ids_col, F.coalesce(F.col(f"`{ids_col}`"), F.array().cast("array<int>"))).mapInArrow(_decode(tokenizer_path, ids_col), schema)

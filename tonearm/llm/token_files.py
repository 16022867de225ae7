"""Token ids as flat files: unsigned integers, 64-bit document offsets, memory-mapped.

Documents are range-partitioned and sorted by id; a partition is one .bin file of ids, one .idx file
of its documents' first positions (64-bit, one more than documents) and one .doc file of their ids.
Where a file's ids start in the whole corpus is the prefix sum of the partitions' lengths.

Files on a file system of the machine (a shared mount) are memory-mapped; those of a store that can't be
mapped are read whole, one at a time: at most the ids of about FILE_TEXT_BYTES of text, or of one longer text.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import new_path, parts_for, text_bytes, text_or_empty, written

FILE_TEXT_BYTES = 32 * 2**20
CACHE_PIECES = 800_000
NO_ID = -(2**63)


#: Where a letter meets a full stop or comma, a token always ends.
WORD_END = re.compile("(?<=[A-Za-zÀ-ÖØ-öø-ÿ])(?=[.,])")
_ENCODERS: dict[tuple[str, str], PieceEncoder] = {}


class PieceEncoder:
    """Encodes texts piece by piece, each distinct piece once.

    The tokenizer drops white space and lower-cases before it merges, so no token spans a space or a line
    break, and a text's ids are those of its pieces between them, in lower case. A worker keeps the cache
    from one task to the next; it is emptied when it is full.
    """

    @classmethod
    def of(cls, path: str, kind: str) -> PieceEncoder:
        if (path, kind) not in _ENCODERS:
            _ENCODERS[path, kind] = cls(path, kind)
        return _ENCODERS[path, kind]

    def __init__(self, path: str, kind: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.kind, self.known = np.dtype(kind), {"": b""}
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that end a word
        self.closes[[k for t, k in vocabulary.items() if t.endswith("</w>")]] = True

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian integers."""
        split = [WORD_END.sub(" ", t.lower() if t.isascii() and "<|" not in t else t).replace("\n", " ").split(" ") for t in texts]
        known = self.known
        if len(known) > CACHE_PIECES:
            known.clear()
            known[""] = b""
        new = [p for p in {p for s in split for p in s} if p not in known]
        rest = [p for p in new if not p.isalpha()]
        alone = [p for p in new if p.isalpha()]  # a word each: many of them make a text, and the ids show where they end
        for k in range(0, len(alone), 256):
            words = alone[k : k + 256]
            ids = np.array(self.tokenizer.encode(" ".join(words), add_special_tokens=False).ids, np.int64)
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) != len(words):
                rest += words
                continue
            known.update(zip(words, (x.astype(self.kind).tobytes() for x in np.split(ids, ends[:-1]))))
        for piece, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)):
            known[piece] = np.array(e.ids, self.kind).tobytes()
        return [b"".join([known[p] for p in s]) for s in split]


def _write(folder: str, path: str, kind: str, end_id: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, end, size = PieceEncoder.of(path, kind), np.array([end_id], kind).tobytes(), np.dtype(kind).itemsize
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root)
        name, part, at, docs = uuid.uuid4().hex, TaskContext.get().partitionId(), 0, 0
        with fs.open_output_stream(f"{root}/{name}.bin") as ids, fs.open_output_stream(f"{root}/{name}.idx") as idx, fs.open_output_stream(f"{root}/{name}.doc") as doc:
            idx.write(np.zeros(1, "<i8").tobytes())
            for batch in batches:
                doc.write(batch.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                texts = batch.column("text").to_pylist()
                for k in range(0, len(texts), 500):
                    for x in encoder.encode(texts[k : k + 500]):
                        ids.write(x + end)
                        at += len(x) // size + 1
                        docs += 1
                        idx.write(np.array([at], "<i8").tobytes())
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "name": [name], "docs": pa.array([docs], pa.int64()), "ids": pa.array([at], pa.int64())})

    return write


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int, vocabulary: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, str]:
    """Writes the files; returns their manifest (part, name, docs, ids, base) and their folder.

    Ids are 16 bits wide where the vocabulary fits, else 32. A null text has only the end id, a null
    doc_id comes first. Equal doc_ids stand in the order of a hash of their texts. A task that fails
    leaves files that the manifest doesn't name.
    """
    spark = docs.sparkSession
    folder, kind = new_path(spark, "tokens"), "<u2" if vocabulary <= 2**16 else "<u4"
    picked = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    parts = parts_for(text_bytes(picked), FILE_TEXT_BYTES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ranged = picked.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    manifest = written(ranged.mapInArrow(_write(folder, tokenizer_path, kind, end_id), "part long, name string, docs long, ids long"), "manifest")
    base = F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each file
    return manifest.withColumn("base", base), folder


READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _read(folder: str, kind: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        local = isinstance(fs, pafs.LocalFileSystem)

        def opened(path: str) -> np.ndarray | bytes:
            return pa.memory_map(path).read_buffer() if local else fs.open_input_file(path).read_buffer()

        for batch in batches:
            for r in batch.to_pylist():
                if not r["docs"]:
                    continue
                ids = np.frombuffer(opened(f"{root}/{r['name']}.bin"), kind)
                at = np.frombuffer(opened(f"{root}/{r['name']}.idx"), "<i8")
                doc = np.frombuffer(opened(f"{root}/{r['name']}.doc"), "<i8")
                for k in range(0, len(doc), 4096):
                    a, b = at[k : k + 4096], at[k + 1 : k + 4097]
                    crc = [zlib.crc32(ids[i:j].astype("<u4").tobytes()) for i, j in zip(a[: len(b)].tolist(), b.tolist())]
                    own = doc[k : k + 4096]
                    yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64(), mask=own == NO_ID), pa.array(a[: len(b)] + r["base"]), pa.array(b - a[: len(b)]), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return read


def read_token_files(manifest: DataFrame, folder: str, vocabulary: int) -> DataFrame:
    """A row for each document of the files: doc_id, start in the corpus, n_tokens with the end id, and the crc32 of its ids as 32-bit integers."""
    return manifest.repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), "name").mapInArrow(_read(folder, "<u2" if vocabulary <= 2**16 else "<u4"), READ)

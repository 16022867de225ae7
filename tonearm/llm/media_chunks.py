"""Media columns: content-defined chunking of binary payloads.

A payload is cut where a rolling gear hash of its last 32 bytes has twelve leading zeros. Texts wait in
blocks (see blocks.py) while Spark groups the chunk digests and picks one owner of all equal chunks; only
the owners' chunks are then compressed, into pack files of the shared folder, so equal chunks are stored
once in the whole corpus. A Spark join gives every chunk the address of its stored copy, and a document is
an ordered list of addresses. Only digests and addresses are shuffled, never payload bytes, and a digest
that a large share of all documents has is joined by broadcast. Reading follows the lists, joins the frames
and checks the payload's digest.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import column, grouped, opened, packed
from .common import joined_hot, new_path, remove_folder, text_or_empty, written

SAMPLE_BYTES = 576
CUT_BITS, LEAST_CHUNK, MOST_CHUNK = 12, 1_024, 16_384
#: Text bytes of a block, and blocks whose chunks share a pack file.
BLOCK_BYTES, PACK_BLOCKS = 16 * 2**20, 32
#: Blocks stand beside the packs until these are whole, so they are pressed harder than texts that wait only.
BLOCK_LEVEL = 6


def _gear_table() -> np.ndarray:
    """256 fixed 32-bit values from a digest of the byte."""
    return np.array([int.from_bytes(hashlib.blake2b(bytes([b]), digest_size=4).digest(), "little") for b in range(256)], np.uint32)


GEAR = _gear_table()


def gear_cuts(payload: bytes) -> list[int]:
    """Ends of the chunks of a payload."""
    h = GEAR[np.frombuffer(payload, np.uint8)]
    for shift in (1, 2, 4, 8, 16):  # h[i] becomes the sum of GEAR[b[i - j]] << j for j under 2 * shift
        later = h.copy()
        later[shift:] += h[:-shift] << np.uint32(shift)
        h = later
    ends, at = [], 0
    for end in (np.flatnonzero(h < np.uint32(1 << (32 - CUT_BITS))) + 1).tolist():
        while end - at > MOST_CHUNK:
            at += MOST_CHUNK
            ends.append(at)
        if end - at >= LEAST_CHUNK:
            ends.append(end)
            at = end
    while len(payload) - at > MOST_CHUNK:
        at += MOST_CHUNK
        ends.append(at)
    if at < len(payload):
        ends.append(len(payload))
    return ends


def padded(text: bytes) -> bytes:
    """A text as a payload: bytes 255 up to a positive multiple of 576."""
    return text + b"\xff" * (max(1, -(-len(text) // SAMPLE_BYTES)) * SAMPLE_BYTES - len(text))


CHUNKED = "block long, row int, doc_id long, n_bytes long, payload_key string, chunks array<struct<digest: binary, start: long, raw: int>>"


def _chunk(folder: str):
    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("digest", pa.binary()), ("start", pa.int64()), ("raw", pa.int32())])))
        for name, table in packed(folder, batches, "text", BLOCK_BYTES, BLOCK_LEVEL):
            rows = []
            for row, (doc_id, text) in enumerate(zip(column(table, "doc_id").to_pylist(), column(table, "text").cast(pa.large_binary()).to_pylist())):
                payload, chunks, start = padded(text), [], 0
                for end in gear_cuts(payload):
                    chunks.append({"digest": hashlib.blake2b(payload[start:end], digest_size=16).digest(), "start": start, "raw": end - start})
                    start = end
                rows.append((name, row, doc_id, len(text), hashlib.sha256(payload).hexdigest(), chunks))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=["block", "row", "doc_id", "n_bytes", "payload_key", "chunks"])

    return chunk


STORED = "digest binary, pack long, start long, stored int, raw int"


def _store(blocks: str, folder: str):
    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Compresses the owners' chunks of the task's blocks into one pack; gives their addresses."""
        import zstandard

        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root)
        press, pack, at, out = zstandard.ZstdCompressor(level=3, write_content_size=True), TaskContext.get().taskAttemptId(), 0, None
        schema = pa.schema([("digest", pa.binary()), ("pack", pa.int64()), ("start", pa.int64()), ("stored", pa.int32()), ("raw", pa.int32())])
        try:
            for name, owned in grouped(batches):
                texts, last, rows = column(opened(blocks, name), "text").cast(pa.large_binary()), None, []
                for c in owned.to_pylist():
                    if c["row"] != last:
                        last, payload = c["row"], padded(texts[c["row"]].as_py())
                    frame = press.compress(payload[c["first"] : c["first"] + c["raw"]])
                    if out is None:
                        out = fs.open_output_stream(f"{root}/{pack}.pack")
                    out.write(frame)
                    rows.append({"digest": c["digest"], "pack": pack, "start": at, "stored": len(frame), "raw": c["raw"]})
                    at += len(frame)
                yield pa.RecordBatch.from_pylist(rows, schema)
        finally:
            if out is not None:
                out.close()

    return store


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, str]:
    """Payloads as chunk lists: doc_id, n_bytes, payload_key, chunks (pack, start, stored, raw in order), and the folder of the packs.

    A null text is an empty payload of padding. Every row has its own list, repeated rows too; equal chunks
    are stored once. A task that fails leaves a pack that no list names. No rows give no rows.
    """
    spark = docs.sparkSession
    blocks, folder = new_path(spark, "blocks"), new_path(spark, "packs")
    picked = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    told = written(picked.mapInArrow(_chunk(blocks), CHUNKED), "chunks")
    each = told.select("block", "row", F.posexplode("chunks").alias("seq", "c")).select("block", "row", "seq", F.col("c.digest").alias("digest"), F.col("c.start").alias("first"), F.col("c.raw").alias("raw"))
    owners = written(each.groupBy("digest").agg(F.min(F.struct("block", "row", "first", "raw")).alias("owner"), F.count(F.lit(1)).alias("count")), "owners")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), told.select("block").distinct().count() // PACK_BLOCKS)
    owned = owners.select("digest", "owner.*").repartition(parts, "block").sortWithinPartitions("block", "row", "first")
    stored = written(owned.mapInArrow(_store(blocks, folder), STORED), "addresses")
    remove_folder(blocks)  # all that is kept of the texts is in the packs
    addressed = joined_hot(each.select("block", "row", "seq", "digest"), stored, "digest", owners.select("digest", "count"))
    lists = addressed.groupBy("block", "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.struct("pack", "start", "stored", "raw").alias("c")))), lambda x: x["c"]).alias("chunks"))
    return told.select("block", "row", "doc_id", "n_bytes", "payload_key").join(lists, ["block", "row"]).select("doc_id", "n_bytes", "payload_key", "chunks"), folder


def _features(payload: bytes) -> str:
    """Count, sum, sum of squares and changes of direction of the samples, and the four largest of 16 histogram bins."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64)
    bins = np.bincount(x >> 4, minlength=16)
    turns = int(np.count_nonzero(np.diff(np.sign(np.diff(x))))) if len(x) > 2 else 0
    top = ",".join(f"{b}:{bins[b]}" for b in sorted(range(16), key=lambda b: (-bins[b], b))[:4])
    return f"n={len(x)};sum={x.sum()};squares={(x * x).sum()};turns={turns};bins={top}"


READ = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_chunks long"


def _read(folder: str, with_payload: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        fs, root = pafs.FileSystem.from_uri(folder)
        unpress, files = zstandard.ZstdDecompressor(), {}
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                frames = []
                for c in r["chunks"]:
                    if c["pack"] not in files:
                        if len(files) >= 64:
                            files.pop(next(iter(files))).close()
                        files[c["pack"]] = fs.open_input_file(f"{root}/{c['pack']}.pack")
                    frames.append(files[c["pack"]].read_at(c["stored"], c["start"]))
                payload = b"".join(unpress.decompress(x, max_output_size=c["raw"]) for x, c in zip(frames, r["chunks"]))
                key, media = hashlib.sha256(payload).hexdigest(), b"".join(frames)
                if key != r["payload_key"]:
                    raise ValueError(f"document {r['doc_id']}: the stored payload isn't the one that was written")
                row = {"doc_id": r["doc_id"], "n_bytes": r["n_bytes"], "payload_bytes": len(payload), "payload_sha256": key, "tail_crc32": zlib.crc32(payload[-32:]), "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "feature": _features(payload), "n_chunks": len(frames)}
                rows.append(row | ({"payload": payload} if with_payload else {}))
            kinds = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("n_chunks", pa.int64())]
            yield pa.RecordBatch.from_pylist(rows, pa.schema(kinds + [("payload", pa.binary())] * with_payload))

    return read


def read_media(lists: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """What the chunk lists name, read back, verified and described; with_payload adds the bytes.

    media_bytes and media_sha256 are those of the compressed frames in order, so equal payloads have
    equal values whichever stored copy a list names. Fails if a payload isn't the one written.
    """
    return lists.mapInArrow(_read(folder, with_payload), READ + ", payload binary" * with_payload)

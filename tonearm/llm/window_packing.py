"""Hierarchical packing of documents into windows of several context sizes.

Documents are routed to the smallest tier that holds them (what is longer fills whole windows of the longest tier
first), each tier's windows are opened by its own documents, the longest first, and the gap of a window is
filled from shorter tiers: the longest piece that fits, and where none does, the head of the shortest that is
longer. So every window but the last of all is full, and a window has one cut at most.

A task packs cells of bounded size as it encodes them, so ids are neither stored nor shuffled. What a cell can't
put into a full window of the smallest tier goes on, with its ids, to a cell of the next level, which packs
the rests of up to MERGE cells; so all that is ever padded is one window of the whole corpus.

Windows of one context size are dealt to step groups of equally many ids. Within a cell they follow each other by
a golden-ratio walk through their attention cost (sum of squared lengths), so that each run of consecutive
windows has costs from the whole range, and so has a step group.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_or_empty, written
from .token_files import PieceEncoder

TIERS = (512, 1_024, 2_048, 4_096)
#: Ids of a step group, the same for each context size.
STEP_IDS = 65_536
#: A cell is closed at so many ids or documents; a cell of a higher level takes the rests of so many cells.
CELL_IDS, CELL_DOCS, MERGE = 2_000_000, 8_192, 512
#: Longer texts are encoded in parts that end at a space.
PART_CHARS = 1_000_000
GOLDEN, MODULUS = 1_327_217_885, 2**31

PIECE = "level int, part int, cell int, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, seq int, place int, offset int, size int, rest binary"


@dataclass
class Run:
    """Consecutive ids of a document: doc_id, where they start in it, its number of ids, and the ids."""

    doc: int | None
    start: int
    total: int
    ids: np.ndarray

    def cut(self, n: int) -> tuple[Run, Run]:
        return Run(self.doc, self.start, self.total, self.ids[:n]), Run(self.doc, self.start + n, self.total, self.ids[n:])


class Pool:
    """Runs by length. Present lengths are bits of one number, so the next shorter and longer ones are found at once."""

    def __init__(self, runs: list[Run]) -> None:
        self.by_length: dict[int, list[Run]] = {}
        self.present = 0
        for r in reversed(runs):  # so that equal lengths go in the order of the input
            self.put(r)

    def put(self, run: Run) -> None:
        self.by_length.setdefault(len(run.ids), []).append(run)
        self.present |= 1 << len(run.ids)

    def take(self, length: int) -> Run:
        held = self.by_length[length]
        run = held.pop()
        if not held:
            self.present ^= 1 << length
        return run

    def longest(self, most: int) -> int:
        """The greatest length up to most, or 0."""
        return max(0, (self.present & ((1 << most + 1) - 1)).bit_length() - 1)

    def shortest_over(self, least: int) -> int:
        over = self.present >> least + 1
        return least + 1 + (over & -over).bit_length() - 1


def pack_runs(runs: list[Run], tiers: tuple[int, ...] = TIERS) -> tuple[list[tuple[int, list[Run]]], list[Run]]:
    """Full windows (tier, runs in order) and what is left over, less than the smallest tier."""
    windows: list[tuple[int, list[Run]]] = []
    top, rests = tiers[-1], []
    for r in runs:
        while len(r.ids) >= top:
            head, r = r.cut(top)
            windows.append((top, [head]))
        if len(r.ids):
            rests.append(r)
    pool = Pool(rests)
    while pool.present:
        held = [pool.take(pool.present.bit_length() - 1)]
        size = tiers[bisect_left(tiers, len(held[0].ids))]
        gap = size - len(held[0].ids)
        while gap and pool.present:
            if fits := pool.longest(gap):
                held.append(pool.take(fits))
            else:
                head, tail = pool.take(pool.shortest_over(gap)).cut(gap)
                held.append(head)
                pool.put(tail)
            gap -= len(held[-1].ids)
        if not gap:
            windows.append((size, held))
            continue
        for tier in reversed(tiers):  # the last window isn't full: its runs fill smaller ones
            while sum(len(r.ids) for r in held) >= tier:
                own, need = [], tier
                while need:
                    first = held.pop(0)
                    if len(first.ids) > need:
                        first, tail = first.cut(need)
                        held.insert(0, tail)
                    own.append(first)
                    need -= len(first.ids)
                windows.append((tier, own))
        return windows, held
    return windows, []


def spread(costs: list[int]) -> np.ndarray:
    """A place for each window: consecutive places have costs from the whole range."""
    n = len(costs)
    walk = np.argsort(np.arange(n, dtype=np.int64) * GOLDEN % MODULUS, kind="stable")
    place = np.empty(n, np.int64)
    place[np.argsort(np.asarray(costs, np.int64), kind="stable")[walk]] = np.arange(n)
    return place


def _rows(level: int, part: int, cell: int, runs: list[Run], tiers: tuple[int, ...], last: bool) -> pa.RecordBatch:
    """A cell's pieces, and its rest: runs with ids, or, at the last level, one more window."""
    windows, rest = pack_runs(runs, tiers)
    if last and rest:
        n = sum(len(r.ids) for r in rest)
        windows, rest = [*windows, (tiers[-1] if n & n - 1 else n, rest)], []
    place: dict[int, int] = {}
    for size in {s for s, _ in windows}:
        own = [k for k, (s, _) in enumerate(windows) if s == size]
        place.update(zip(own, spread([sum(len(r.ids) ** 2 for r in windows[k][1]) for k in own]).tolist()))
    out = []
    for k, (size, held) in enumerate(windows):
        offset = 0
        for r in held:
            out.append((r.doc, r.start, len(r.ids), zlib.crc32(r.ids.astype("<u4").tobytes()), r.total, k, place[k], offset, size, None))
            offset += len(r.ids)
    out += [(r.doc, r.start, len(r.ids), None, r.total, None, None, k, None, r.ids.astype("<u4").tobytes()) for k, r in enumerate(rest)]
    names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "seq", "place", "offset", "size", "rest")
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
    columns = list(zip(*out)) or [()] * len(names)
    same = {n: pa.array(np.full(len(out), x, np.int32)) for n, x in (("level", level), ("part", part), ("cell", cell))}
    return pa.RecordBatch.from_pydict(same | {n: pa.array(list(c), t) for n, c, t in zip(names, columns, kinds)})


def _parts(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > PART_CHARS:
        cut = text.rfind(" ", at, at + PART_CHARS)
        cut = text.find(" ", at + PART_CHARS) if cut <= at else cut
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def _encoded(path: str, end_id: int, tiers: tuple[int, ...], cell_ids: int, cell_docs: int):
    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, end = PieceEncoder.of(path, "<u4"), np.array([end_id], "<u4").tobytes()
        part, cell, held, size = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            docs = batch.column("doc_id").to_pylist()
            for k in range(0, len(docs), 256):
                texts = batch.column("text").slice(k, 256).to_pylist()
                short = iter(encoder.encode([t for t in texts if len(t) <= PART_CHARS]))
                for doc, t in zip(docs[k : k + 256], texts):
                    coded = next(short) if len(t) <= PART_CHARS else b"".join(x for p in _parts(t) for x in encoder.encode([p]))
                    ids = np.frombuffer(coded + end, "<u4")
                    held.append(Run(doc, 0, len(ids), ids))
                    size += len(ids)
                    if size >= cell_ids or len(held) >= cell_docs:
                        yield _rows(0, part, cell, held, tiers, False)
                        cell, held, size = cell + 1, [], 0
        if held:
            yield _rows(0, part, cell, held, tiers, False)

    return encoded


def _merged(level: int, tiers: tuple[int, ...], last: bool):
    def merged(key: tuple, table: pa.Table) -> pa.Table:
        rows = table.sort_by([("part", "ascending"), ("cell", "ascending"), ("offset", "ascending")]).to_pylist()
        runs = [Run(r["doc_id"], r["start"], r["doc_tokens"], np.frombuffer(r["rest"], "<u4")) for r in rows]
        return pa.Table.from_batches([_rows(level, 0, int(key[0].as_py()), runs, tiers, last)])

    return merged


def pack(
    docs: DataFrame, tokenizer_path: str, end_id: int, tiers: tuple[int, ...] = TIERS, step_ids: int = STEP_IDS, cell_ids: int = CELL_IDS, cell_docs: int = CELL_DOCS, merge: int = MERGE, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, window (its context size) and step.

    sequence_id counts windows from 0 without gaps. A step takes step_ids ids of one context size, its last one may have
    fewer. Only the last window of all may be padded, to the longest tier, unless its length is a power of two. A null text has only the end id, a null doc_id stays null;
    equal rows are packed each for itself; an empty table gives no rows; other columns are not read.
    """
    picked = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    now = written(picked.mapInArrow(_encoded(tokenizer_path, end_id, tiers, cell_ids, cell_docs), PIECE), "pieces")
    pieces, level = now.where("rest is null"), 0
    while cells := now.where("rest is not null").select("part", "cell").distinct().count():
        level, groups = level + 1, -(-cells // merge)
        group = F.pmod(F.xxhash64("part", "cell"), F.lit(groups)) if level == 1 else F.col("cell") % groups
        rests = now.where("rest is not null").withColumn("g", group)
        now = written(rests.groupBy("g").applyInArrow(_merged(level, tiers, groups == 1), PIECE), "rests")
        pieces = pieces.unionByName(now.where("rest is null"))
    return numbered(pieces, step_ids)


def numbered(pieces: DataFrame, step_ids: int) -> DataFrame:
    """Pieces with the numbers of their windows and steps, from prefix sums over a row for each cell and context size."""
    cell = ["level", "part", "cell"]
    counts = written(pieces.groupBy(*cell, "size").agg(F.count_distinct("seq").alias("n")), "windows")
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = counts.groupBy(*cell).agg(F.sum("n").alias("n")).select(*cell, before(Window.orderBy(*cell)).alias("base"))
    per_step = F.greatest(F.lit(1), F.floor(F.lit(step_ids) / F.col("size")))
    # Steps of a context size follow those of the shorter ones. A row for each size.
    sizes = counts.groupBy("size").agg(F.sum("n").alias("n")).withColumn("n", F.ceil(F.col("n") / per_step)).select("size", before(Window.orderBy("size")).alias("since"))
    laid = counts.select(*cell, "size", before(Window.partitionBy("size").orderBy(*cell)).alias("first")).join(bases, cell).join(F.broadcast(sizes), "size")
    at = F.col("first") + F.col("place")
    return pieces.join(laid, [*cell, "size"]).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("seq")).cast("long").alias("sequence_id"), F.col("offset").cast("long").alias("offset"), F.col("size").cast("long").alias("window"),
        (F.col("since") + (at - at % per_step) / per_step).cast("long").alias("step"),
    )

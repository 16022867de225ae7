"""Texts that wait where they were read: blocks of rows in the shared folder, compressed.

A task packs its rows into blocks of bounded size and hands on narrow keys (block, row); joins and
aggregates work on those, and what they find comes back to each block by its number. So texts are never
shuffled, whatever their size, and the plan is the same at every size. A block's number tells the attempt
of the task that wrote it, so a block that a failed attempt left behind is named by no row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import new_path, tidy, written

BLOCK_BYTES = 6 * 2**20
#: Bits of a row's number in its block, and of a block's number in its task.
ROW_BITS, TASK_BITS = 16, 15
#: Blocks that a task goes through, one after the other, where there are more than the session's shuffle partitions.
TASK_BLOCKS = 64


def _ends(column: pa.Array) -> np.ndarray:
    """Where the values of a text or binary column begin and end, from 0 on."""
    kind = np.int64 if pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type) else np.int32
    ends = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return ends - ends[0] if len(ends) else np.zeros(1, np.int64)


def packed(folder: str, batches: Iterator[pa.RecordBatch], text: str, most: int = BLOCK_BYTES, level: int = 1) -> Iterator[tuple[int, pa.Table]]:
    """Writes rows as blocks of about so many bytes of text, under 2**16 rows each, by zstd of a level; gives each block's number and rows."""
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root)
    held: list[pa.RecordBatch] = []
    size = rows = count = 0

    def block() -> tuple[int, pa.Table]:
        nonlocal held, size, rows, count
        table = pa.Table.from_batches(held).combine_chunks()
        held, size, rows = [], 0, 0
        name = TaskContext.get().taskAttemptId() << TASK_BITS | count
        count += 1
        with fs.open_output_stream(f"{root}/{name}.block") as sink, pa.ipc.new_file(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", level))) as out:
            out.write_table(table)
        return name, table

    for batch in batches:
        ends = _ends(batch.column(text))
        i = 0
        while i < len(batch):
            j = max(i + 1, int(np.searchsorted(ends, ends[i] + most - size, "right")) - 1)
            j = min(j, i + (1 << ROW_BITS) - rows)
            held.append(batch.slice(i, j - i))
            size += int(ends[j] - ends[i])
            rows += j - i
            i = j
            if size >= most or i < len(batch) or rows >> ROW_BITS:
                yield block()
    if held:
        yield block()


def numbered(block: str, row: str) -> Column:
    """One number for each row of all blocks."""
    return F.shiftleft(F.col(block), ROW_BITS).bitwiseOR(F.col(row).cast("long"))


def opened(folder: str, name: int) -> pa.Table:
    fs, root = pafs.FileSystem.from_uri(folder)
    with fs.open_input_file(f"{root}/{name}.block") as source:
        return pa.ipc.open_file(source).read_all().combine_chunks()


def column(table: pa.Table, name: str) -> pa.Array:
    """A column of a block as one array."""
    found = table.column(name).combine_chunks()
    return found if isinstance(found, pa.Array) else found.chunk(0)


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """The rows of each block, from batches that are sorted by block."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        blocks = batch.column("block").to_numpy()
        cuts = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1).tolist(), len(blocks)]
        for i, j in zip(cuts, cuts[1:]):
            if held and j > i and held[0].column("block")[0].as_py() != blocks[i]:
                yield held[0].column("block")[0].as_py(), pa.Table.from_batches(held)
                held = []
            if j > i:
                held.append(batch.slice(i, j - i))
    if held:
        yield held[0].column("block")[0].as_py(), pa.Table.from_batches(held)


def tasks_for(blocks: DataFrame) -> int:
    """How many tasks go through blocks. blocks: a row for each."""
    n = blocks.count()
    return max(1, min(n, max(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // TASK_BLOCKS))))


def by_block(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """rows brought to their blocks, sorted by block. Each block has a row of nulls too, so that one for which nothing was found is read as well."""
    return rows.unionByName(blocks, allowMissingColumns=True).repartition(tasks_for(blocks), "block").sortWithinPartitions("block")


class Blocks:
    """Documents packed into blocks once: narrow marks of each, and the documents that something was found about."""

    def __init__(self, docs: DataFrame, text_col: str, mark: Callable[[list[bytes | None]], list[pa.Array]], schema: str) -> None:
        """mark gives the columns of schema for some texts. marks: block, row and these columns, and c0, c1, ... for docs' columns but the text."""
        self.names, self.folder = docs.columns, new_path(docs.sparkSession, "blocks")
        inner = docs.toDF(*(f"c{k}" for k in range(len(self.names))))
        self.text = f"c{self.names.index(text_col)}"
        self.inner = inner.withColumn(self.text, F.col(self.text).cast("string")).schema
        kept = [f for f in self.inner.fields if f.name != self.text]
        told = ", ".join(["block long", "row int", *(f"{f.name} {f.dataType.simpleString()}" for f in kept), schema])
        picked = inner.withColumn(self.text, F.col(self.text).cast("string"))
        self.marks = written(picked.mapInArrow(_marked(self.folder, self.text, mark, [f.name for f in kept], [c.split()[0] for c in schema.split(", ")]), told), "marks")

    def column(self, name: str) -> str:
        """What marks call a column of docs."""
        return f"c{self.names.index(name)}"

    def rows(self, wanted: DataFrame, *extra: str) -> DataFrame:
        """The documents of the wanted block and row, each as often as it is wanted; extra: columns of wanted that go along."""
        wanted = written(wanted.select("block", "row", *(F.col(c).alias(f"x{k}") for k, c in enumerate(extra))), "wanted")
        n = tasks_for(wanted.select("block").distinct())
        names = [f.name for f in self.inner.fields]
        more = [f"x{k}" for k in range(len(extra))]
        schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in self.inner.fields), *(f"{x} {wanted.schema[x].dataType.simpleString()}" for x in more)])
        found = wanted.repartition(n, "block").sortWithinPartitions("block", "row").mapInArrow(_taken(self.folder, names, more), schema)
        return found.toDF(*self.names, *extra)


def _marked(folder: str, text: str, mark, kept: list[str], own: list[str]):
    @tidy
    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, table in packed(folder, batches, text):
            for at in range(0, table.num_rows, 2_000):
                part = table.slice(at, 2_000)
                n = part.num_rows
                found = mark(part.column(text).combine_chunks().cast(pa.large_binary()).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, name)), pa.array(np.arange(at, at + n, dtype=np.int32)), *(column(part, c) for c in kept), *found], names=["block", "row", *kept, *own])

    return marked


def _taken(folder: str, names: list[str], extra: list[str]):
    @tidy
    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, rows in grouped(batches):
            table = opened(folder, name)
            for at in range(0, rows.num_rows, 2_000):
                part = rows.slice(at, 2_000)
                found = table.take(column(part, "row"))
                yield pa.RecordBatch.from_arrays([*(column(found, c) for c in names), *(column(part, c) for c in extra)], names=[*names, *extra])

    return taken

"""Sharding by a minimax contiguous partition of atomic groups.

Rows with equal texts are one atomic group. Groups stand in the order of a 64-bit hash of the text;
the smallest capacity with which a greedy pass fits them into the shards is found by binary search,
and the order is cut there. The search never sees all groups: it works on cells (hash ranges) of
summed sizes, and of the cells that a cut can fall into the largest MOST_SPLIT are split, 64-fold a
round, until the bounds from whole cells and from divisible cells meet. So a round brings the driver at
most 64 * MOST_SPLIT cells, however many groups there are and whatever their sizes.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_or_empty, written

FIRST_BITS, MORE_BITS, MOST_SPLIT = 12, 6, 256
#: Rows of a slot cell; the window that numbers slots never holds more than about so many.
CELL_ROWS = 20_000


def _ends(bounds: list[int], capacity: int, shards: int, whole: list[bool]) -> list[int]:
    """Greedy ends in a list of prefix sums; between two of them a cut can fall anywhere unless that cell is whole."""
    out, at = [], 0
    for _ in range(shards):
        if at + capacity >= bounds[-1]:
            at = bounds[-1]
        else:
            k = bisect_right(bounds, at + capacity)
            at = max(at, bounds[k - 1]) if whole[k - 1] else at + capacity
        out.append(at)
    return out


def _smallest(bounds: list[int], shards: int, whole: list[bool], low: int) -> int:
    high = max(low, bounds[-1])
    while low < high:
        mid = (low + high) // 2
        if _ends(bounds, mid, shards, whole)[-1] >= bounds[-1]:
            high = mid
        else:
            low = mid + 1
    return low


def _cells(groups: DataFrame, bits: Column, key: Column) -> list[tuple[int, ...]]:
    """Summed sizes by the first bits of the hash: first hash, last hash, size, largest group, groups, bits, key."""
    rows = groups.groupBy(bits.alias("bits"), key.alias("key")).agg(F.min("g"), F.max("g"), F.sum("size"), F.max("size"), F.count(F.lit(1))).collect()
    return sorted(tuple(int(v) for v in (*r[2:], r["bits"], r["key"])) for r in rows)


def _split(groups: DataFrame, cells: list[tuple[int, ...]]) -> list[tuple[int, ...]]:
    """The cells into which some cells fall when more bits count. The filter is a set of keys for each width, not a chain of ranges."""
    parts = []
    for bits in sorted({c[5] for c in cells}):
        wider = min(64, bits + MORE_BITS)
        key = F.shiftright("g", 64 - bits)
        parts.append(F.when(key.isin([c[6] for c in cells if c[5] == bits]), F.struct(F.lit(wider).alias("bits"), F.shiftright("g", 64 - wider).alias("key"))))
    found = groups.withColumn("cell", F.coalesce(*parts)).where("cell is not null")
    return _cells(found, F.col("cell.bits"), F.col("cell.key"))


def cut_points(groups: DataFrame, shards: int) -> tuple[list[int], list[int]]:
    """The groups above the mean, each with a shard of its own, and the last hash of each other shard.

    groups: g long, size long, a row for each group. At most shards - 1 groups stand alone, for each
    holds more than the mean of what is left; the rest is cut into the other shards.
    """
    total = int(groups.agg(F.sum("size")).first()[0] or 0)
    alone: list[int] = []
    for g, size in groups.orderBy(F.desc("size"), "g").select("g", "size").head(shards - 1):
        if size * (shards - len(alone)) <= total:
            break
        alone.append(g)
        total -= size
    shards -= len(alone)
    rest = groups.where(~F.col("g").isin(alone)) if alone else groups
    cells = _cells(rest, F.lit(FIRST_BITS), F.shiftright("g", 64 - FIRST_BITS))
    if not cells:
        return alone, []
    largest = max(c[3] for c in cells)
    while True:
        bounds = [0, *accumulate(c[2] for c in cells)]
        single = [c[4] == 1 for c in cells]
        low = max(largest, -(-total // shards))
        low = _smallest(bounds, shards, [*single, True], low)
        high = _smallest(bounds, shards, [True] * len(bounds), low)
        if low == high:
            ends = _ends(bounds, high, shards, [True] * len(bounds))
            return alone, [cells[bounds.index(e) - 1][1] for e in ends[:-1] if 0 < e < bounds[-1]]
        coarse, fine = _ends(bounds, low, shards, [True] * len(bounds)), _ends(bounds, high, shards, [*single, True])
        split = {k for a, b in zip(coarse, fine) for k in range(bisect_right(bounds, a) - 1, min(bisect_right(bounds, b), len(cells))) if not single[k]}
        split = set(sorted(split, key=lambda k: (-cells[k][2], k))[:MOST_SPLIT])
        cells = sorted([c for k, c in enumerate(cells) if k not in split] + _split(rest, [cells[k] for k in split]))


def shard_documents(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size (UTF-8 bytes + 1), text_crc32, law, shard, slot (0, 1, ... in each shard) and grown_shard (null).

    Sizes of shards are as equal as the order of the groups allows; a group above the mean has a
    shard of its own. A null text is an empty one. Rows with equal texts share a shard, repeated
    rows have a slot each, an empty table gives no rows. Two texts whose 64-bit hashes agree count
    as one group. Slots follow a hash of the row within the shard, so no task numbers a whole shard.
    """
    text = text_or_empty(text_col)
    base = written(docs.select(F.col(f"`{id_col}`").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("g")), "sizes")
    groups = written(base.groupBy("g").agg(F.sum("size").alias("size")), "groups")
    alone, lasts = cut_points(groups, shards)
    longs = lambda values: F.array(*map(F.lit, values)).cast("array<bigint>")
    shard = F.size(F.filter(longs(lasts), lambda last: F.col("g") > last)) + len(alone)
    if alone:
        shard = F.coalesce(F.nullif(F.array_position(longs(alone), F.col("g")), F.lit(0)) - 1, shard)
    cells = max(1, base.count() // CELL_ROWS * 4)
    placed = base.withColumns({"shard": shard.cast("int"), "cell": F.pmod(F.xxhash64("doc_id", "g"), F.lit(cells)).cast("int")})
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("shard", "cell").count().select("shard", "cell", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    number = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("doc_id", "g"))
    return placed.join(starts, ["shard", "cell"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + number - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )

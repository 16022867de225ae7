"""SimHash near-dedup by segment-popcount embedding.

A 64-bit fingerprint becomes the vector of bit counts of its 32 segments of two bits. The Manhattan
distance of two vectors is at most the Hamming distance of the fingerprints, so links lie within a
range of 2 in that space. Its axes are grouped; two points within the range differ in at most two
groups, so they share a grid cell over the other groups. Cells are joined by equality, Manhattan
distance filters, and Hamming distance decides. Cells with many fingerprints aren't paired: two
fingerprints are within two bits if and only if some point is within one bit of both, so those are
linked through such points, 65 for each fingerprint, and none of them has more than 65 neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import joined_hot, written

SHINGLE, SEED, RANGE = 3, 42, 2
SEGMENTS = 32
LOW_BITS = 0x5555555555555555
#: Cells with more fingerprints are linked through points, not pairs.
PAIRED_CELL = 16
#: Chance that two independent segments of two random bits have equal counts.
SAME_COUNT = 0.375
BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: bytes) -> int:
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        return xxh64_intdigest(b" ".join(words), SEED)
    return majority(np.array([xxh64_intdigest(b"%b %b %b" % s, SEED) for s in zip(words, words[1:], words[2:])], np.uint64))


def majority(h: np.ndarray) -> int:
    """The 64 bits that over half the hashes have."""
    counts = np.bincount((h.view(np.uint8).reshape(-1, 8) + np.arange(0, 2048, 256)).ravel(), minlength=2048).reshape(8, 256) @ BITS
    return int(np.packbits((2 * counts > len(h)).ravel(), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = np.fromiter((fingerprint(t or b"") for t in batch.column("text").cast(pa.binary()).to_pylist()), np.uint64, len(batch))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (the fingerprint's 64 bits as a long), a row for each row of docs. A text without words, or null, has 0."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(_fingerprints, "doc_id long, fp long")


def _vector(fp: Column) -> Column:
    """The counts of 32 segments, two bits each in one long."""
    a, b = fp.bitwiseAND(F.lit(LOW_BITS)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(LOW_BITS))
    return F.shiftleft(a.bitwiseAND(b), 1).bitwiseOR(a.bitwiseXOR(b))


def _manhattan(u: Column, v: Column) -> Column:
    """Distance of two vectors of counts 0, 1, 2: one where only the low bits differ or both do (1 and 2), two where only the high bits do."""
    x = u.bitwiseXOR(v)
    low = x.bitwiseAND(F.lit(LOW_BITS))
    high = F.shiftrightunsigned(x, 1).bitwiseAND(F.lit(LOW_BITS))
    return F.bit_count(low) + 2 * F.bit_count(high.bitwiseAND(F.bitwise_not(low)))


def _masks(count: int) -> list[int]:
    """Masks of all groups of segments but two, for as many groups as keep cells of random fingerprints under one each."""
    groups = 4
    while groups < 16 and count * SAME_COUNT ** (SEGMENTS * (groups - RANGE) / groups) > 1:
        groups += 1
    edges = [SEGMENTS * g // groups * 2 for g in range(groups + 1)]
    whole = [((1 << edges[g + 1]) - 1) ^ ((1 << edges[g]) - 1) for g in range(groups)]
    masks = [sum(whole) - sum(whole[g] for g in out) for out in combinations(range(groups), RANGE)]
    return [m - 2**64 if m >= 2**63 else m for m in masks]


def links(prints: DataFrame) -> DataFrame:
    """u, v: pairs of distinct fingerprints that connect all fingerprints within two bits of each other.

    prints: fp, without repeats. Every two such fingerprints are linked directly or through others.
    """
    masks = _masks(prints.count())
    vector = _vector(F.col("fp"))
    keys = F.array(*(F.struct(F.lit(k).cast("byte").alias("grid"), vector.bitwiseAND(F.lit(m)).alias("cell")) for k, m in enumerate(masks)))
    placed = prints.select("fp", F.explode(keys).alias("key"))
    counts = written(placed.groupBy("key").count().where("count > 1"), "counts")
    full = written(joined_hot(placed, counts, "key", counts).select("fp", "key.grid", "key.cell", "count"), "cells")
    few = full.where(F.col("count") <= PAIRED_CELL)
    a, b = few.select("grid", "cell", F.col("fp").alias("u")), few.select("grid", "cell", F.col("fp").alias("v"))
    near = a.join(b, ["grid", "cell"]).where((F.col("u") < F.col("v")) & (_manhattan(_vector(F.col("u")), _vector(F.col("v"))) <= RANGE))
    pairs = near.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= RANGE).select("u", "v")
    dense = full.where(F.col("count") > PAIRED_CELL).select("fp").distinct()
    flips = [0] + [1 << k if k < 63 else -(2**63) for k in range(64)]
    points = dense.select("fp", F.explode(F.transform(F.array(*map(F.lit, flips)), lambda x: F.col("fp").bitwiseXOR(x))).alias("point"))
    stars = points.groupBy("point").agg(F.array_sort(F.collect_list("fp")).alias("all")).where(F.size("all") > 1)  # at most 65 fingerprints
    through = stars.select(F.col("all")[0].alias("u"), F.explode(F.slice("all", F.lit(2), F.size("all") - 1)).alias("v"))
    return pairs.union(through).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: the least node of each connected component, by alternating stars; u, v longs, u <> v."""
    now, seen = written(edges.select(F.greatest("u", "v").alias("v"), F.least("u", "v").alias("u")).distinct(), "edges"), None
    while True:
        both = now.union(now.select(F.col("u").alias("v"), F.col("v").alias("u")))  # v: the node, u: its neighbour
        least = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = both.where("u > v").join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("u <> v").distinct()
        own = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(own, "v")
        now = written(small.select(F.col("u").alias("v"), F.col("m").alias("u")).where("u <> v").union(own.select("v", F.col("m").alias("u"))).distinct(), "edges")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if state == seen:
            return now.select(F.col("v").alias("node"), F.col("u").alias("root")).union(now.select(F.col("u").alias("node"), F.col("u").alias("root"))).distinct()
        seen = state


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp and component_id (the least doc_id reachable over links of at most two bits), a row for each row of docs.

    Texts without words share fingerprint 0. A null doc_id is never a component's least; a component of
    null ids only has a null component_id. Repeated rows are one component. No rows give no rows.
    """
    marked = written(fingerprints(docs, id_col, text_col), "prints")
    firsts = written(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "firsts")
    roots = components(links(firsts.select("fp")))
    led = firsts.join(roots, firsts["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    leads = led.groupBy("root").agg(F.min("first").alias("component_id"))
    named = written(led.join(leads, "root").select(F.col("fp").alias("of"), "component_id"), "components")
    return marked.join(named, marked["fp"] == named["of"]).select("doc_id", "fp", "component_id")

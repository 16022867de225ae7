"""Near copies by Jaccard similarity of word shingles.

Two texts are linked if their sets of 5-word shingles have a Jaccard similarity of 0.8 or more. Candidates come
from SimHash fingerprints of those shingles first: texts of one fingerprint, and fingerprints that the grid over
segment bit counts (see simhash.py) links within two bits. A 64-bit fingerprint is too coarse to find all pairs (at
0.8 they differ in about ten bits), so texts are also candidates if they share one of 32 bands of five least
hashes: a pair at 0.8 is missed with a chance of 0.8**5 not met 32 times (3 in a million), a closer one more
rarely. Each candidate is then verified exactly on its texts.

Cells with many texts aren't paired at first: hubs are compared with their cell, a third of the bands in each
round, and cells whose texts are all connected are done. What is left are cells of texts that have much in common, as
pages of one template have, but aren't alike. There candidates share one of their rarest shingles: two sets with a
Jaccard similarity of 0.8 share at least 80 % of either, so they share one of the rarest 20 % (and one more) of
each, if both are ordered alike. That loses no pair, and a template's own shingles, which all have, are never
among the rarest.

Texts wait in blocks (see blocks.py): only those of candidates are brought together, and only documents that
stay are read again, so a text is shuffled if it is a candidate's and not else.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import simhash
from .blocks import Blocks
from .common import joined_hot, tidy, written
from .simhash import SEED, components

SHINGLE, LEAST = 5, 0.8
BANDS, ROWS = 32, 5
#: Cells with more texts are linked through hubs first.
PAIRED_CELL = 16
HUB_ROUNDS = 3
_DRAWN = np.random.default_rng(SEED)
XORS, FACTORS = (_DRAWN.integers(0, 2**63, BANDS * ROWS, np.uint64)[:, None] for _ in range(2))
MIX = _DRAWN.integers(0, 2**63, ROWS, np.uint64) | np.uint64(1)


def shingles(text: bytes) -> set[bytes]:
    """The distinct runs of five lower-case words; the words themselves where there are fewer."""
    words = text.lower().split()
    if len(words) < SHINGLE:
        return {b" ".join(words)} if words else set()
    return {b" ".join(s) for s in zip(*(words[k:] for k in range(SHINGLE)))}


def jaccard(a: set, b: set) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both) if a or b else 1.0


def hashes(found: set[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter((xxh64_intdigest(s, SEED) for s in found), np.uint64, len(found))


def band_keys(h: np.ndarray) -> list[int]:
    """A key for each band, equal for two texts if the band's least hashes of shingles are."""
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for k in range(0, len(h), 1024):
        mixed = (h[None, k : k + 1024] ^ XORS) * (FACTORS | np.uint64(1))
        np.minimum(least, mixed.min(axis=1), out=least)
    keys = (least.reshape(BANDS, ROWS) ^ (least.reshape(BANDS, ROWS) >> np.uint64(29))) * MIX
    return (keys.sum(axis=1, dtype=np.uint64) ^ np.arange(BANDS, dtype=np.uint64)).view(np.int64).tolist()


def _marks(texts: list[bytes | None]) -> list[pa.Array]:
    """uid (of the text in lower case, its words parted by one space), distinct shingles, fingerprint, and a key for each band."""
    from xxhash import xxh64_intdigest

    uids, sizes, prints, keys = [], [], [], []
    for text in texts:
        found = shingles(text or b"")
        uids.append(xxh64_intdigest(b" ".join((text or b"").lower().split()), SEED + 1) - 2**63)
        sizes.append(len(found))
        h = hashes(found)
        prints.append(simhash.majority(h) if found else 0)
        keys.append(band_keys(h) if found else [])
    return [pa.array(uids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int64()))]


def packed(docs: DataFrame, text_col: str = "text") -> Blocks:
    return Blocks(docs, text_col, _marks, "uid long, size long, fp long, keys array<long>")


def _verify(least: float):
    @tidy
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known, us, vs = {}, [], []
            for u, v, a, b in zip(*(batch.column(c).to_pylist() for c in ("u", "v", "a", "b"))):
                for node, text in ((u, a), (v, b)):
                    if node not in known:
                        known[node] = shingles(text.encode())
                if jaccard(known[u], known[v]) >= least:
                    us.append(u)
                    vs.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return verify


def _verified(pairs: DataFrame, blocks: Blocks, firsts: DataFrame, least: float) -> DataFrame:
    """The pairs of uids (u < v) that are as similar as that. firsts: uid, block and row of one text of each uid."""
    pairs = written(pairs.distinct(), "pairs")
    wanted = pairs.select(F.col("u").alias("uid")).union(pairs.select(F.col("v").alias("uid"))).distinct()
    text = blocks.names[int(blocks.text[1:])]
    texts = written(blocks.rows(firsts.join(wanted, "uid", "left_semi"), "uid").select("uid", F.col(f"`{text}`").alias("text")), "texts")
    a, b = texts.select(F.col("uid").alias("u"), F.col("text").alias("a")), texts.select(F.col("uid").alias("v"), F.col("text").alias("b"))
    return written(pairs.join(a, "u").join(b, "v").select("u", "v", "a", "b").mapInArrow(_verify(least), "u long, v long"), "verified")


@tidy
def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A 64-bit hash of each distinct shingle of each text."""
    for batch in batches:
        for uid, text in zip(batch.column("uid").to_pylist(), batch.column("text").to_pylist()):
            h = hashes(shingles(text.encode()))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), uid)), pa.array(h.view(np.int64))], names=["uid", "h"])


def _by_rare_shingles(open_: DataFrame, blocks: Blocks, firsts: DataFrame, least: float) -> DataFrame:
    """u, v: pairs of open texts of different labels that share one of their rarest shingles. open_: uid, size, label."""
    nodes = written(open_.select("uid", "size", "label").distinct(), "open")
    text = blocks.names[int(blocks.text[1:])]
    texts = blocks.rows(firsts.join(nodes, "uid", "left_semi"), "uid").select("uid", F.col(f"`{text}`").alias("text"))
    held = written(texts.mapInArrow(_hashes, "uid long, h long"), "shingles")
    common = held.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    ranked = held.join(common, "h", "left").withColumn("n", F.coalesce("n", F.lit(1))).join(nodes, "uid")
    rank = F.row_number().over(Window.partitionBy("uid").orderBy("n", "h"))  # the shingles of a text
    rare = ranked.withColumn("k", rank).where(F.col("k") <= F.col("size") - F.ceil(F.lit(least) * F.col("size") - 1e-9) + 1)
    rare = written(rare.where("n > 1").select("uid", "h", "size", "label"), "rare")
    other = rare.select(F.col("uid").alias("other"), "h", F.col("size").alias("other_size"), F.col("label").alias("other_label"))
    near = (F.col("size") >= least * F.col("other_size")) & (F.col("other_size") >= least * F.col("size"))
    return rare.join(other, "h").where((F.col("uid") < F.col("other")) & (F.col("label") != F.col("other_label")) & near).select(F.col("uid").alias("u"), F.col("other").alias("v"))


def by_fingerprint(firsts: DataFrame) -> DataFrame:
    """u, v: a text of each fingerprint with the others of it, and with one of each fingerprint that the grid links to it. firsts: uid and fp."""
    heads = written(firsts.groupBy("fp").agg(F.min("uid").alias("head"), F.count(F.lit(1)).alias("n")), "heads")
    several = heads.where("n > 1").select("fp", "head", F.col("n").alias("count"))
    same = joined_hot(firsts.select("uid", "fp"), several.select("fp", "head"), "fp", several.select("fp", "count")).where(F.col("uid") != F.col("head")).select("head", F.col("uid").alias("other"))
    met = simhash.links(heads.select("fp"))
    one, two = heads.select(F.col("fp").alias("u"), F.col("head")), heads.select(F.col("fp").alias("v"), F.col("head").alias("other"))
    near = met.join(one, "u").join(two, "v").select("head", "other")
    return same.union(near).select(F.least("head", "other").alias("u"), F.greatest("head", "other").alias("v"))


def links(blocks: Blocks, least: float = LEAST) -> DataFrame:
    """u, v: links that connect all texts which candidates connect."""
    # Of equal texts one stands for all; their sizes and keys are equal too.
    firsts = written(blocks.marks.where("size > 0").groupBy("uid").agg(F.min(F.struct("block", "row", "size", "fp", "keys")).alias("first")).select("uid", "first.*"), "firsts")
    placed = firsts.select("uid", "size", F.posexplode("keys").alias("band", "cell"))
    cells = written(placed.join(placed.groupBy("band", "cell").count().where("count > 1"), ["band", "cell"]), "cells")
    near = (F.col("size") >= least * F.col("other_size")) & (F.col("other_size") >= least * F.col("size"))  # needed for that similarity
    few = cells.where(F.col("count") <= PAIRED_CELL)
    other = few.select("band", "cell", F.col("uid").alias("other"), F.col("size").alias("other_size"))
    pairs = few.join(other, ["band", "cell"]).where((F.col("uid") < F.col("other")) & near).select(F.col("uid").alias("u"), F.col("other").alias("v"))
    pairs = pairs.union(by_fingerprint(firsts.select("uid", "fp")))
    dense, found = cells.where(F.col("count") > PAIRED_CELL), None
    # Dense cells: hubs first, and at last pairs by rare shingles.
    for turn in range(HUB_ROUNDS + 1):
        if found is None:
            open_ = dense.withColumn("label", F.col("uid"))
        else:
            roots = components(found)
            labels = dense.join(roots, dense["uid"] == roots["node"], "left").select("band", "cell", "uid", "size", F.coalesce("root", "uid").alias("label"))
            split = labels.groupBy("band", "cell").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("band", "cell")
            open_ = written(labels.join(split, ["band", "cell"]), "open")
            if not open_.limit(1).count():
                break
        if turn < HUB_ROUNDS:
            hub = F.min_by(F.struct("uid", "size", "label"), F.xxhash64("uid", "band", "cell", F.lit(turn))).alias("hub")
            theirs = open_.where(F.col("band") % HUB_ROUNDS == turn).groupBy("band", "cell").agg(hub).select("band", "cell", F.col("hub.uid").alias("other"), F.col("hub.size").alias("other_size"), F.col("hub.label").alias("other_label"))
            more = open_.join(theirs, ["band", "cell"]).where((F.col("label") != F.col("other_label")) & near).select(F.least("uid", "other").alias("u"), F.greatest("uid", "other").alias("v"))
        else:
            more = _by_rare_shingles(open_, blocks, firsts.select("uid", "block", "row"), least)
        new = _verified(more if found is not None else pairs.union(more), blocks, firsts.select("uid", "block", "row"), least)
        found = new if found is None else found.union(new)
    return found


def groups(blocks: Blocks, least: float = LEAST) -> DataFrame:
    """The marks (but for keys) with group, a long that is equal for texts which links connect. Texts without words are one group."""
    roots = written(components(links(blocks, least)).withColumnRenamed("node", "uid"), "roots")
    marks = blocks.marks.drop("size", "fp", "keys")
    # Equal texts, and all empty ones, have one uid; only those with a link are joined, the hot ones by broadcast.
    met = joined_hot(marks, roots, "uid", marks.join(roots, "uid", "left_semi").groupBy("uid").count()).withColumnRenamed("root", "group")
    return met.unionByName(marks.join(roots, "uid", "left_anti").withColumn("group", F.col("uid")))


def grouped(docs: DataFrame, text_col: str = "text", least: float = LEAST) -> DataFrame:
    """docs with group (see groups()); a column of that name is replaced. Null texts are ones without words, no rows give no rows."""
    blocks = packed(docs.drop("group"), text_col)
    return blocks.rows(groups(blocks, least), "group")


def one_of_each(docs: DataFrame, *order: str, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """One document of each group: that with the least id, nulls last, then the least text hash, then by the columns named.

    Of rows that are equal in all of these one stays.
    """
    blocks = packed(docs.withColumn("_text_hash", F.xxhash64(F.col(f"`{text_col}`").cast("string"))), text_col)
    key = [F.col(blocks.column(c)) for c in (id_col, "_text_hash", *order)]
    lead = F.min(F.struct(key[0].isNull().alias("nameless"), *(c.alias(f"k{i}") for i, c in enumerate(key)), "block", "row")).alias("lead")
    return blocks.rows(groups(blocks, least).groupBy("group").agg(lead).select("lead.block", "lead.row")).drop("_text_hash")

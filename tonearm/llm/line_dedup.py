"""Line dedup by pairwise alignment.

Documents are paired by runs of lines: a run is the fewest lines from a line on that hold enough words,
so each block that may go begins with a run of both documents. A run is rarer than its lines, so a line
that stands everywhere doesn't pair anything by itself. The documents of a run that few have are all paired.
A run that many have is lengthened line by line (in strides of 1, 2, 3, 4, 8, 12, 16, ... lines, from the longest on that an earlier
document shares, and again from there), until few have it or no earlier document shares more: so each place
meets a document that shares the most with it, however many share less, and pairs grow with the runs.
A pair is then aligned in full, over all lines of
both documents, by patience diff (lines once in both, the longest increasing run of them, then between
and beside them), and aligned blocks of enough words are deleted from the later document.

Equal texts are paired once: all but the first of them lose every line, and the first stands for them.
Texts wait in blocks (see blocks.py) and are never shuffled; what is joined are line digests, with hot
runs and hot documents split over tasks.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import by_block, column, grouped, numbered, opened, packed
from .common import HOT_KEYS, joined_hot, new_path, tidy, written
from .substring_dedup import _mixed, _powers, _sums

#: Places that share a run are all paired if they are at most so many; beyond it, the run is lengthened (see document_pairs()).
RARE = 8
#: Aligned blocks with fewer words stay.
LEAST_WORDS = 10
DIGEST = 16
#: Parts that the lines of a document with a hot share of all pairs are copied to.
SALTS = 64


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest run of pairs, sorted by the first, whose second values increase."""
    tops: list[int] = []
    at: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, b) in enumerate(pairs):
        i = bisect_left(tops, b)
        if i == len(tops):
            tops.append(b)
            at.append(k)
        else:
            tops[i], at[i] = b, k
        back[k] = at[i - 1] if i else -1
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def patience(matches: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Aligned places (in the earlier, in the later document) from all places of equal lines."""
    a: dict[int, int] = {}
    b: dict[int, int] = {}
    told = set(matches)
    for x, y in sorted(told):  # places that match are the same line
        a[x] = b[y] = a.get(x, b.get(y, x))
    return [m for m in patience_lines(a, b) if m in told]


def patience_lines(a: dict[int, object], b: dict[int, object]) -> list[tuple[int, int]]:
    """Aligned places from the lines at the places of both documents; repeated lines are never paired in full.

    A region is split at what stands once on both sides: lines, or, where there are none, runs of 2, 4, ...
    lines. One without such is split at its common beginning, else at its common end, else it stays
    unaligned. At last, lines beside an aligned line are aligned if they are equal.
    """
    common = set(a.values()) & set(b.values())
    known: set[tuple[int, int]] = set()
    work = [tuple([(p, x) for p, x in sorted(side.items()) if x in common] for side in (a, b))]
    while work:
        xs, ys = work.pop()
        anchors = _anchors(xs, ys) or _edge(xs, ys) or _edge(xs[::-1], ys[::-1])[::-1]
        if not anchors:
            continue
        known.update(anchors)
        parts: tuple[dict, dict] = ({}, {})
        for side, rows in enumerate((xs, ys)):
            edges = [e[side] for e in anchors]
            for p, x in rows:
                k = bisect_left(edges, p)
                if k == len(edges) or edges[k] != p:
                    parts[side].setdefault(k, []).append((p, x))
        work += [(parts[0][k], parts[1][k]) for k in parts[0].keys() & parts[1].keys()]
    taken_a, taken_b = {x for x, _ in known}, {y for _, y in known}
    for step in (1, -1):
        for x, y in sorted(known, reverse=step < 0):
            while x + step in a and a[x + step] == b.get(y + step) and x + step not in taken_a and y + step not in taken_b:
                x, y = x + step, y + step
                known.add((x, y))
                taken_a.add(x)
                taken_b.add(y)
    return sorted(known)


def _anchors(xs: list[tuple[int, object]], ys: list[tuple[int, object]]) -> list[tuple[int, int]]:
    """The longest increasing list of places of what stands once on both sides: lines, else runs of 2, 4, ... lines."""
    width = 1
    while xs and ys:
        left, right = Counter(x for _, x in xs), Counter(y for _, y in ys)
        if left.keys().isdisjoint(right):
            return []
        at = {y: p for p, y in ys if right[y] == 1}
        anchors = _increasing([(p, at[x]) for p, x in xs if left[x] == 1 and x in at])
        if anchors:
            return anchors
        names: dict[tuple, int] = {}  # of runs twice as wide
        xs, ys = ([(p, names.setdefault((x, y), len(names))) for (p, x), (q, y) in zip(rows, rows[width:]) if q == p + width] for rows in (xs, ys))
        xs, ys, width = list(xs), list(ys), 2 * width
    return []


def _edge(xs: list[tuple[int, object]], ys: list[tuple[int, object]]) -> list[tuple[int, int]]:
    """Places of the lines that both begin with."""
    out = []
    for (p, x), (q, y) in zip(xs, ys):
        if x != y:
            break
        out.append((p, q))
    return out


def aligned_blocks(matches: list[tuple[int, int]], words: dict[int, int], least: int = LEAST_WORDS) -> list[int]:
    """Places in the later document of the aligned blocks with enough words; a block is consecutive in both."""
    return _blocks(patience(matches), words, least)


def _blocks(aligned: list[tuple[int, int]], words: dict[int, int] | np.ndarray, least: int) -> list[int]:
    out: list[int] = []
    block: list[tuple[int, int]] = []
    for a, b in [*aligned, (-9, -9)]:
        if block and (a, b) != (block[-1][0] + 1, block[-1][1] + 1):
            if sum(words[y] for _, y in block) >= least:
                out += [y for _, y in block]
            block = []
        block.append((a, b))
    return out


def runs(digests: list[bytes], words: list[int], least: int) -> tuple[list[int], list[int]]:
    """The run that begins at each of a document's first lines, as 64-bit digest, and its number of lines. Later lines begin none."""
    out, sizes, end, held = [], [], 0, 0
    for start in range(len(words)):
        while end < len(words) and held < least:
            held += words[end]
            end += 1
        if held < least:
            break
        out.append(int.from_bytes(blake2b(b"".join(digests[start:end]), digest_size=8).digest(), "little", signed=True))
        sizes.append(end - start)
        held -= words[start]
    return out, sizes


PACKED = "block long, row int, doc_id long, text_key binary, lines binary, words array<int>, runs array<long>, sizes array<int>"


def _pack(folder: str, id_col: str, text_col: str, least: int):
    @tidy
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document with an id and a text, after a row for its block."""
        fs, root = pafs.FileSystem.from_uri(folder)
        for name, table in packed(folder, batches, text_col):
            rows: list[tuple] = [(name, None, None, None, None, None, None, None)]
            for row, (doc_id, text) in enumerate(zip(column(table, id_col).to_pylist(), column(table, text_col).cast(pa.large_binary()).to_pylist())):
                if doc_id is None or text is None:
                    continue
                lines = [x for x in text.split(b"\n") if x and not x.isspace()]
                words = [len(x.split()) for x in lines]
                digests = [blake2b(x, digest_size=DIGEST).digest() for x in lines]
                rows.append((name, row, doc_id, blake2b(text, digest_size=DIGEST).digest(), b"".join(digests), words, *runs(digests, words, least)))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()))
            columns = [pa.array(x, t) for x, t in zip(zip(*rows), kinds)]
            with fs.open_output_stream(f"{root}/{name}.lines") as sink, pa.ipc.new_file(sink, pa.schema([("row", pa.int32()), ("lines", pa.binary())])) as out:
                out.write(pa.RecordBatch.from_arrays([columns[1].slice(1), columns[4].slice(1)], names=["row", "lines"]))
            yield pa.RecordBatch.from_arrays(columns, names=["block", "row", "doc_id", "text_key", "lines", "words", "runs", "sizes"])

    return pack


STRIDES = "block long, row int, doc long, doc_id long, start int, len int, seeks boolean, last long, places long, stride int, unit int, key long, far long"


def _strides(folder: str):
    @tidy
    def strides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each place the keys of its lines with 1, 2, 3, 4, 8, 12, 16, ... more, below its limit and as far as the document goes.

        unit: lines from a stride to the next one, far: the key with those too, null where the document ends before.
        """
        fs, root = pafs.FileSystem.from_uri(folder)
        for name, rows in grouped(batches):
            rows = rows.filter(pa.compute.is_valid(rows.column("row")))
            if not rows.num_rows:
                continue
            with fs.open_input_file(f"{root}/{name}.lines") as source:
                told = pa.ipc.open_file(source).read_all().combine_chunks()
            row, start, length, below = (rows.column(c).to_numpy().astype(np.int64) for c in ("row", "start", "len", "below"))
            needed, which = np.unique(row, return_inverse=True)
            lines = told.column("lines").take(pa.array(np.searchsorted(told.column("row").to_numpy(), needed)))
            # The sums of the block's documents end to end; a document's last one is at its limit.
            parts = [_sums(np.frombuffer(x.as_buffer(), np.uint64)[::2]) for x in lines]
            last = np.cumsum([len(x) for x in parts]) - 1
            first, sums = last + 1 - np.array([len(x) for x in parts]), np.concatenate(parts)
            begin, limit = first[which] + start, last[which]
            rest = limit - begin - length  # lines that follow
            power, unit = _powers(int(start.max()))[0], 1

            def keys(at: np.ndarray, stride: int) -> np.ndarray:
                ends = np.minimum((begin + length + stride)[at], limit[at])
                return _mixed((sums[ends] - sums[begin[at]]) * power[start[at]]).view(np.int64)

            while (np.minimum(rest, below - 1) >= unit).any():
                for stride in (unit, 2 * unit, 3 * unit):
                    at = np.flatnonzero(np.minimum(rest, below - 1) >= stride)
                    own = [column(rows.select([c]).take(pa.array(at)), c) for c in ("row", "doc", "doc_id", "start", "len", "seeks", "last", "places")]
                    found = [pa.array(np.full(len(at), stride, np.int32)), pa.array(np.full(len(at), unit, np.int32)), pa.array(keys(at, stride)), pa.array(keys(at, stride + unit), mask=rest[at] < stride + unit)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), name)), *own, *found], names=[c.split()[0] for c in STRIDES.split(", ")])
                unit *= 4

    return strides


def _known(held: DataFrame, key: str) -> DataFrame:
    """Of each key that several documents have the first one, and how many places have it. last, places: the largest doc_id of those a row stands for, and how many."""
    found = held.groupBy(key).agg(F.min(F.struct("doc_id", "doc")).alias("first"), F.max("last").alias("final"), F.sum("places").alias("count"))
    return found.where("first.doc_id < final").drop("final")


def _all_pairs(few: DataFrame, key: str, later: DataFrame) -> DataFrame:
    """a, doc: each of some later places with the earlier documents of its key. few: places of keys that few have."""
    return few.select(key, F.col("doc").alias("a"), F.col("doc_id").alias("a_id")).join(later.select(key, "doc", "doc_id"), key).where("a_id < doc_id").select("a", "doc")


def _fewer(going: DataFrame, rare: int) -> DataFrame:
    """going with one place for those that don't seek and are alike up to the next stride, where they are many: that of the first document.

    They have the same keys until then, which stay hot by them, so nothing is told of any but the first one and their number.
    """
    rest = going.where("not seeks and far is not null")
    place = F.struct("doc_id", "doc", "block", "row", "start", "len", "below")
    alike = written(rest.groupBy("far").agg(F.min(place).alias("place"), F.max("last").alias("last"), F.sum("places").alias("places")).where(F.col("places") > rare), "alike")
    others = going.where("seeks or far is null").unionByName(rest.join(alike.select("far").hint("merge"), "far", "left_anti"))
    return others.drop("far").unionByName(alike.select("place.*", F.lit(False).alias("seeks"), "last", "places"))


def document_pairs(firsts: DataFrame, blocks: DataFrame, folder: str, rare: int = RARE) -> DataFrame:
    """a, doc: two documents, the second with the larger doc_id, that share a run. firsts: doc (its number), block, row, doc_id, runs and sizes.

    Places of a run that few have are all paired. Each other place is paired with the first document that has its run, and then,
    while an earlier document shares more lines with it, with the first of those that share so much.
    """
    runs_of = firsts.select("block", "row", "doc", "doc_id", "sizes", F.posexplode("runs").alias("start", "run"))
    held = written(runs_of.select("block", "row", "doc", "doc_id", "start", F.get("sizes", F.col("start")).alias("len"), "run"), "runs")
    known = written(_known(held.withColumns({"last": F.col("doc_id"), "places": F.lit(1)}), "run"), "known")
    met = written(joined_hot(held, known, "run", known.select("run", "count")), "met")
    few, many = met.where(F.col("count") <= rare), met.where(F.col("count") > rare)
    pairs = _all_pairs(few, "run", few)
    later = F.col("doc_id") > F.col("first.doc_id")
    found = [pairs, many.where(later).select(F.col("first.doc").alias("a"), "doc")]
    # below: a stride that a place need not try, for no earlier document shares so much with those that seek.
    now = many.select("block", "row", "doc", "doc_id", "start", "len", F.lit(True).alias("seeks"), F.lit(2**31 - 1).alias("below"), F.col("doc_id").alias("last"), F.lit(1).cast("long").alias("places"))
    while True:
        keyed = written(by_block(now, blocks).mapInArrow(_strides(folder), STRIDES), "strides")
        if not keyed.limit(1).count():
            break
        # Rows are narrow and of few kinds of keys; adaptive execution splits the partition of a hot one.
        met = written(keyed.join(_known(keyed, "key").hint("merge"), "key"), "met")
        # The most lines that a place shares with an earlier document; the first document of all has none, but others may meet it.
        best = met.where(later & F.col("seeks")).groupBy("block", "row", "start").agg(F.max(F.struct("stride", "unit", "key", "count", "first")).alias("best"), F.first("doc").alias("doc"), F.first("doc_id").alias("doc_id"))
        best = written(best.select("block", "row", "start", "doc", "doc_id", "best.*"), "best")
        found.append(_all_pairs(met.where(F.col("count") <= rare), "key", best.where(F.col("count") <= rare)))
        found.append(best.where(F.col("count") > rare).select(F.col("first.doc").alias("a"), "doc"))
        # No earlier document shares the next stride, so only what lies between is left, and nothing where that is the next line.
        hot = best.where((F.col("count") > rare) & (F.col("unit") > 1))
        # All places of a key that is still hot go on, for others may share more with them; those seek that have found it the longest.
        going = met.join(hot.select("key").distinct(), "key", "left_semi")
        own = hot.select("block", "row", "start", "key", F.lit(True).alias("found"))
        going = going.join(own, ["block", "row", "start", "key"], "left")
        now = written(going.select("block", "row", "doc", "doc_id", "start", (F.col("len") + F.col("stride")).cast("int").alias("len"), F.col("found").isNotNull().alias("seeks"), F.col("unit").alias("below"), "last", "places", "far"), "going")
        now = _fewer(now, rare)
    out = found[0]
    for x in found[1:]:
        out = out.union(x)
    return out.distinct()


def _align(least: int):
    @tidy
    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From rows sorted by earlier document: its lines come first and are held while its later documents stream by."""
        held, first = None, {}
        for batch in batches:
            docs, gone = [], []
            for a, doc, lines, words in zip(*(batch.column(c).to_pylist() for c in ("a", "doc", "lines", "words"))):
                own = {k: lines[DIGEST * k : DIGEST * (k + 1)] for k in range(len(lines) // DIGEST)}
                if doc is None:
                    held, first = a, own
                    continue
                assert a == held
                found = _blocks(patience_lines(first, own), words, least)
                if found:
                    docs.append(doc)
                    gone.append(sorted(set(found)))
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(gone, pa.list_(pa.int32()))], names=["doc", "gone"])

    return align


def _aligned(pairs: DataFrame, firsts: DataFrame, least: int) -> DataFrame:
    """doc, gone: places among its lines that each pair takes from its later document.

    An earlier document's lines are sent once for all its pairs, or once for each salt if it has many; a later
    document's once for each pair.
    """
    pairs = written(pairs, "pairs")
    counts = pairs.groupBy("a").count()
    total = pairs.count()
    hot = written(counts.where(F.col("count") * HOT_KEYS > total + 100 * HOT_KEYS).select("a", F.lit(SALTS).alias("salts")), "hot")
    salt = F.when(F.col("salts").isNotNull(), F.pmod(F.xxhash64("doc"), F.lit(SALTS))).otherwise(0).cast("int").alias("salt")
    salted = written(pairs.join(F.broadcast(hot), "a", "left").select("a", "doc", salt), "salted")  # hot: under HOT_KEYS rows
    earlier = salted.select("a", "salt").distinct().join(firsts.select(F.col("doc").alias("a"), "lines").hint("merge"), "a").select("a", "salt", F.lit(None).cast("long").alias("doc"), "lines", F.lit(None).cast("array<int>").alias("words"))
    later = salted.join(firsts.select("doc", "lines", "words").hint("merge"), "doc").select("a", "salt", "doc", "lines", "words")
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = earlier.union(later).repartition(n, "a", "salt").sortWithinPartitions("a", "salt", F.col("doc").asc_nulls_first())
    return met.select("a", "doc", "lines", "words").mapInArrow(_align(least), "doc long, gone array<int>")


def _drop(folder: str, text_col: str, names: list[str]):
    @tidy
    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, found in grouped(batches):
            table = opened(folder, name)
            gone = {row: None if every else set(places) for row, every, places in zip(*(found.column(c).to_pylist() for c in ("row", "every", "gone"))) if row is not None}
            for at in range(0, table.num_rows, 2_000):
                part = table.slice(at, 2_000)
                texts, counts, removed = [], [], []
                for row, text in enumerate(part.column(text_col).to_pylist(), at):
                    lines = text.split("\n") if text is not None else []
                    counts.append(len(lines))
                    if row not in gone:
                        texts.append(text)
                        removed.append(0)
                        continue
                    kept, place, lost = [], 0, gone[row]
                    for x in lines:
                        raw = x.encode()
                        if raw and not raw.isspace():
                            place += 1
                            if lost is None or place - 1 in lost:
                                continue
                        kept.append(x)
                    texts.append("\n".join(kept))
                    removed.append(len(lines) - len(kept))
                own = {text_col: pa.array(texts, pa.string()), "n_lines": pa.array(counts, pa.int64()), "n_removed": pa.array(removed, pa.int64())}
                yield pa.RecordBatch.from_arrays([own[c] if c in own else column(pa.table([part.column(c)], [c]), c) for c in names], names=names)

    return drop


def drop_shared_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS, rare: int = RARE, whole: bool = True) -> DataFrame:
    """docs with n_lines, n_removed (long) and the text without the lines of aligned blocks.

    Lines are what stands between line breaks. Kept lines stay as they are, joined by line breaks. Lines
    without a word are never removed, nor counted in a block. Rows with a null doc_id or text stay as
    they are; rows with equal doc_ids aren't compared, and equal rows are treated alike. A text that stands
    under a smaller doc_id too loses all its lines, if they have enough words. Extra columns stay, but for
    those named n_lines and n_removed, which the counts replace. No rows give no rows. whole has no effect
    any more: pairs are always aligned over all their lines.
    """
    spark = docs.sparkSession
    folder = new_path(spark, "blocks")
    kept = [f for f in docs.schema.fields if f.name not in ("n_lines", "n_removed")]
    names = [f.name for f in kept] + ["n_lines", "n_removed"]
    picked = docs.select(*(F.col(f"`{f.name}`").cast("string" if f.name == text_col else "long" if f.name == id_col else f.dataType).alias(f.name) for f in kept))
    rows = written(picked.mapInArrow(_pack(folder, id_col, text_col, least_words), PACKED), "lines")
    blocks, told = rows.where("row is null").select("block"), rows.where("row is not null")
    # One row of each text stands for all: that with the least doc_id.
    own = F.struct("doc_id", "block", "row")
    enough = F.aggregate("words", F.lit(0), lambda s, x: s + x) >= least_words
    texts = written(told.groupBy("text_key").agg(F.min(own).alias("first"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("count")), "texts")
    number = numbered("first.block", "first.row")
    leads = texts.select(F.col("first.block").alias("block"), F.col("first.row").alias("row"), number.alias("doc"))
    firsts = written(told.join(leads, ["block", "row"]).select("doc", "block", "row", "doc_id", "lines", "words", "runs", "sizes"), "firsts")
    gone = _aligned(document_pairs(firsts, blocks, folder, rare), firsts, least_words)
    gone = written(gone.groupBy("doc").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone")), "gone")
    # The first row's lines, those of repeated rows with the same doc_id, and all lines of later copies.
    narrow = told.select("block", "row", "doc_id", "text_key", enough.alias("enough"))
    many = texts.where("count > 1").select("text_key", "first", number.alias("doc"))
    copies = written(joined_hot(narrow, many, "text_key", texts.where("count > 1").select("text_key", "count")), "copies")
    later = copies.where("doc_id > first.doc_id and enough").select("block", "row", F.lit(True).alias("every"), F.lit(None).cast("array<int>").alias("gone"))
    alone = firsts.join(gone, "doc").select("block", "row", F.lit(False).alias("every"), "gone")
    repeats = copies.where("doc_id = first.doc_id and struct(block, row) <> struct(first.block, first.row)").join(gone, "doc").select("block", "row", F.lit(False).alias("every"), "gone")
    schema = ", ".join(f"`{n}` {t}" for n, t in zip(names, [*(picked.schema[f.name].dataType.simpleString() for f in kept), "long", "long"]))
    return by_block(later.union(alone).union(repeats), blocks).mapInArrow(_drop(folder, text_col, names), schema)

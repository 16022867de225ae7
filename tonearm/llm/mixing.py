"""Mixing sources to target weights by a low-discrepancy schedule.

Slot i of the mixture maps the i-th point of a golden-ratio (Weyl) sequence through the sources'
cumulative shares, so that every prefix of the schedule is close to the target shares. The documents
of a source lie end to end in a shuffled order, at most three times over, cut into blocks of equally
many words; the r-th slot of a source takes its r-th block. All of it is joins and windows over
ranges of documents, sources or slots; the only windows that span more run over a row for each range, to sum
what comes before. So there may be any number of sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, joined_hot, written

WEIGHTS = (5.0, 2.0, 1.0)
#: 2**31 divided by the golden ratio, odd: point i is i * GOLDEN mod 2**31 over 2**31.
GOLDEN, MODULUS = 1_327_217_885, 2**31
BLOCK_WORDS, LEAST_SLOTS = 2_048, 16_384
#: Slots of a chunk: the largest windows over the schedule.
CHUNK = 65_536
#: Each round of filling targets stops at least one more source at its most, and in practice many; this only guards the loop.
MOST_ROUNDS = 200


def word_count(text: Column) -> Column:
    """Words of a text, null: 0. Counted without building them."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = 3.0) -> DataFrame:
    """sources (source, source_size) with source_no, in the order of their names, and target, the words of each.

    Targets share the whole by weight. A source whose share is above most times its size stops there and the rest is shared
    again; which ones stop is told by a level that only rises, so a round is one sum over the sources and the
    driver sees the level alone.
    """
    placed = written(numbered(sources, [F.col("source").asc_nulls_last()]), "sources")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("source_no") % len(weights) + 1).cast("int"))
    stop = F.lit(float(most)) * F.col("source_size")
    weighed, level, seen = placed.withColumns({"weight": weight, "stop": stop}), None, -1
    for _ in range(MOST_ROUNDS):
        over = F.lit(False) if level is None else F.lit(level[0]) * F.col("weight") / F.lit(level[1]) > F.col("stop")
        # A source that has stopped stays so: the level rises.
        told = weighed.agg(F.sum("source_size"), F.count_if(over), F.sum(F.when(over, F.col("stop"))), F.sum(F.when(~over, F.col("weight")))).first()
        if told[0] is None or told[1] == seen:
            break
        seen, level = told[1], (float(told[0]) - (told[2] or 0.0), told[3] or 1.0)
    level = level or (0.0, 1.0)
    share = F.lit(level[0]) * F.col("weight") / F.lit(level[1])
    return weighed.withColumn("target", F.when(share > F.col("stop"), F.col("stop")).otherwise(share)).drop("weight", "stop")


def numbered(rows: DataFrame, order: list[Column], name: str = "source_no") -> DataFrame:
    """rows with their places in an order, from 0: places in ranges, and the rows of the ranges before."""
    laid = written(rows.repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "ranges")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = laid.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first")).select("_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))  # a row for each range
    return laid.join(F.broadcast(bases), "_part").withColumn(name, F.col("_base") + F.col("_at") - F.col("_first")).drop("_part", "_at", "_first", "_base")


def _schedule(sources: DataFrame, slots: int, total: int) -> DataFrame:
    """slot, source_no and block: which block of which source stands at each place of the mixture.

    sources: source_no and words (its part of total). A point meets the source whose words it falls among: points and the
    sources' first words are laid in ranges together, and each point takes the last source before it.
    """
    spark = sources.sparkSession
    order = [F.col("source_no")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = written(sources.where("words > 0").repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "shares")
    before = lambda w: F.coalesce(F.sum("words").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = laid.groupBy("part").agg(F.sum("words").alias("words")).select("part", before(Window.orderBy("part")).alias("base"))  # a row for each range
    edges = laid.join(F.broadcast(bases), "part").select((F.col("base") + before(Window.partitionBy("part").orderBy("source_no"))).alias("p"), "source_no")
    point = F.least(F.lit(total - 1), F.floor((F.pmod(F.col("id"), F.lit(MODULUS)) * GOLDEN % MODULUS) / float(MODULUS) * total)).cast("long")
    points = spark.range(slots).select(point.alias("p"), F.col("id").alias("slot"))
    both = edges.select("p", "source_no", F.lit(None).cast("long").alias("slot")).unionByName(points.withColumn("source_no", F.lit(None).cast("long")).select("p", "source_no", "slot"))
    ranged = written(both.repartitionByRange(parts, "p", F.col("slot").asc_nulls_first()).withColumn("part", F.spark_partition_id()), "points")
    lasts = ranged.groupBy("part").agg(F.max("source_no").alias("last"))  # edges rise with their sources
    carried = lasts.select("part", F.max("last").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))  # a row for each range
    seen = F.max("source_no").over(Window.partitionBy("part").orderBy("p", F.col("slot").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    picked = ranged.withColumn("seen", seen).join(F.broadcast(carried), "part").where("slot is not null").select("slot", F.greatest("seen", "carried").alias("source_no"), F.floor(F.col("slot") / CHUNK).cast("long").alias("chunk"))
    earlier = Window.partitionBy("source_no").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = picked.groupBy("source_no", "chunk").count().select("source_no", "chunk", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("start"))
    rank = F.row_number().over(Window.partitionBy("source_no", "chunk").orderBy("slot"))
    return picked.join(starts, ["source_no", "chunk"]).select("slot", "source_no", (F.col("start") + rank - 1).alias("block"))


def shuffle_key(seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def mix_plan(sized: DataFrame, seed: int = 7, weights: tuple[float, ...] = WEIGHTS, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """The documents with their source's numbers, and the mixture's pieces.

    sized: row (unique), doc_id, source, text_hash, size. Returns (documents with source_size, target), and
    (slot, row, epoch, first_word, words): the words first_word .. first_word + words - 1 of a document, taken in that slot, in the
    given pass over its source. A source gets its rounded target to the word: its last block is cut there, and a block that
    no point hits stands at its even place among the slots. Sources without words get nothing.
    """
    keyed = sized.withColumn("source_key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    totals = written(keyed.groupBy("source_key", "source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("count")), "totals")
    known = written(targets(totals.drop("count"), weights, float(most)).withColumn("goal", F.least(F.round("target").cast("long"), F.lit(most) * F.col("source_size"))), "targets")
    words, goal = known.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("goal"), F.lit(0))).first()
    docs = joined_hot(keyed, known.drop("source"), "source_key", totals.select("source_key", "count")).drop("source_key")
    block = max(1, min(BLOCK_WORDS, words // LEAST_SLOTS))
    slots = -(-words // block)
    if not words:
        return docs, docs.select(F.lit(0).cast("long").alias("slot"), "row", F.lit(0).alias("epoch"), F.lit(0).cast("long").alias("first_word"), F.lit(0).cast("long").alias("words")).limit(0)
    schedule = _schedule(known.select("source_no", F.col("goal").alias("words")), slots, goal)
    # Documents lie end to end, by source and key, in ranges: places in a range, and the words of the source's ranges before.
    order = ["source_no", "key", "size", "text_hash", "row"]
    parts = int(sized.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    narrow = docs.where("size > 0").select("row", "source_no", "source_size", "goal", "size", "text_hash", shuffle_key(seed).alias("key"))
    laid = written(narrow.repartitionByRange(parts, *order).withColumn("cell", F.spark_partition_id()), "laid")
    before = Window.partitionBy("source_no").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = laid.groupBy("source_no", "cell").agg(F.sum("size").alias("cell_size")).select("source_no", "cell", F.coalesce(F.sum("cell_size").over(before), F.lit(0)).alias("cell_start"))
    within = F.sum("size").over(Window.partitionBy("source_no", "cell").orderBy("key", "size", "text_hash", "row").rowsBetween(Window.unboundedPreceding, 0))
    placed = laid.withColumn("within", within).join(starts, ["source_no", "cell"]).withColumn("start", F.col("cell_start") + F.col("within") - F.col("size"))
    passes = placed.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(most)))).withColumn("at", F.col("start") + F.col("epoch") * F.col("source_size")).where(F.col("at") < F.col("goal"))
    pieces = passes.withColumn("block", F.explode(F.sequence(F.expr(f"at div {block}"), F.expr(f"(at + size - 1) div {block}"))))
    first = F.greatest(F.col("at"), F.col("block") * block)
    last = F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * block, F.col("goal"))
    even = F.floor((F.col("block") + 0.5) / F.ceil(F.col("goal") / block) * slots).alias("even")
    cut = pieces.select("source_no", "block", even, "row", "epoch", (first - F.col("at")).alias("first_word"), (last - first).alias("words")).where("words > 0")
    return docs, cut.join(schedule, ["source_no", "block"], "left").select(F.coalesce("slot", "even").alias("slot"), "row", "epoch", "first_word", "words")


def _steady(docs: DataFrame) -> DataFrame:
    """docs, such that its rows come in the same order whenever it is read: as it is if no shuffle stands before it, else written."""
    return written(docs, "docs") if "Exchange" in docs._jdf.queryExecution().executedPlan().toString() else docs


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """row (the place in docs), doc_id, source, size and text_hash."""
    text = F.col(f"`{text_col}`")
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"), word_count(text).alias("size"), F.xxhash64(text).alias("text_hash"))


def mix_documents(docs: DataFrame, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size (words), source_size, target (of the source) and taken, a row for each row of docs.

    A null text has no words, a null source is a source that stands last. Documents without words are
    taken 0 times. No document is taken more than three times. Repeated rows count as documents of
    their own; no rows give no rows. Each source's words are its rounded target.
    """
    sized = written(_sized(docs, id_col, text_col, source_col), "sized")
    placed, pieces = mix_plan(sized, seed)
    taken = pieces.groupBy("row").agg(F.sum("words").alias("taken"))
    return placed.join(taken, "row", "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_texts(docs: DataFrame, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs as the mixture takes them: a row for each pass over a document, its text cut to the words taken.

    A document that is taken whole keeps its text as it stands; one that the end of its source's share
    cuts keeps the words taken, joined by one space. Documents without words are left out.
    """
    docs = _steady(docs)
    sized = written(_sized(docs, id_col, text_col, source_col), "sized")
    _, pieces = mix_plan(sized, seed)
    spans = written(pieces.groupBy("row", "epoch").agg(F.min("first_word").alias("first_word"), F.sum("words").alias("words")), "spans")
    names = [f"c{k}" for k in range(len(docs.columns))]  # whatever the columns are named
    text = names[docs.columns.index(text_col)]
    left = docs.toDF(*names).select(*names, F.monotonically_increasing_id().alias("row"))
    words = F.slice(F.regexp_extract_all(text, F.lit(f"({WORD})")), (F.col("first_word") + 1).cast("int"), F.col("words").cast("int"))
    cut = F.when(F.col("words") == word_count(F.col(text)), F.col(text)).otherwise(F.array_join(words, " "))
    return left.join(spans, "row").select(*((cut if n == text else F.col(n)).alias(c) for n, c in zip(names, docs.columns)))

"""Conversation repair: the cheapest edits that give a regular order of roles, by a fold in Spark SQL.

Window functions mark each turn's first fault, sorted turn structs are collected, and aggregate() folds them: it carries
four (cost, audit) structs, one for each state of the output so far (empty, after a system, user or
assistant turn), and takes the least struct of the ways that lead to a state. Costs come first and audits second,
so the least struct is also the cheapest with the ASCII-least audit.

Turns lie in ranges of (conversation, turn) and are folded in chunks of bounded length. A conversation of several
chunks folds each from all four states it can begin in, and chunks are then multiplied in groups, level by level,
as matrices over (least, plus); the path of states tells each chunk its own edits. So a conversation that holds
a third of all turns is dealt over as many tasks as any others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

# What an edit costs.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States of the output so far.
STATES = ("e", "s", "u", "a")
LEGAL = ("su", "ua", "au")
#: Turns of a chunk, and chunks that one fold multiplies.
CHUNK, WIDTH = 256, 16
SPACE = " \t\n\x0b\x0c\r"


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role and text after the damage that the crc32 of `conv_id:turn` picks; nulls are one space."""
    said = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"))
    named = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    hit = said.withColumn("hit", F.crc32(named.cast("binary")) % 20).where("hit != 0")
    text = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("hit") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return hit.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def laid_out(turns: DataFrame) -> DataFrame:
    """Turns in the order of their conversation: part and pos, which rises over all parts. Of equal turn numbers the order is role, then md5 of the text."""
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "digest", "tie"]
    marked = turns.withColumns({"digest": F.md5(F.col("text").cast("binary")), "tie": F.monotonically_increasing_id()})
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = marked.repartitionByRange(n, *order).sortWithinPartitions(*order).drop("tie")
    return written(placed.withColumns({"part": F.spark_partition_id(), "pos": F.monotonically_increasing_id()}), "turns")


def flagged(laid: DataFrame) -> DataFrame:
    """conv_id, turn, part, pos, initial, blank, duplicate and truncated of each turn; at most one of the three is true.

    Repeats are found in each part by a window, and only the first of each part are compared over parts.
    """
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    narrow = laid.select("conv_id", "turn", "part", "pos", "role", "digest", F.substring("role", 1, 1).alias("initial"), (bare == "").alias("blank"), (~F.substring(bare, -1, 1).isin(*".!?")).alias("open"))
    here = Window.partitionBy("conv_id", "part", "role", "digest").orderBy("pos")
    seen = written(narrow.withColumn("first", F.row_number().over(here) == 1), "seen")
    same = ["conv_id", "role", "digest"]
    over = seen.where("first").groupBy(*same).agg(F.min("pos").alias("least"), F.count(F.lit(1)).alias("parts"), F.collect_list("pos").alias("all")).where("parts > 1")  # a position for each part
    late = over.select(F.explode(F.filter("all", lambda p: p > F.col("least"))).alias("pos"), F.lit(True).alias("late"))
    found = seen.join(late, "pos", "left")
    repeat = ~F.col("first") | F.col("late").isNotNull()
    return found.select("conv_id", "turn", "part", "pos", "initial", "blank", (~F.col("blank") & repeat).alias("duplicate"), (~F.col("blank") & ~repeat & F.col("open")).alias("truncated"))


def chunked(flags: DataFrame) -> DataFrame:
    """conv_id, at (0, 1, ... in the conversation), chunks (their number) and turns: the sorted structs of each chunk."""
    no = F.floor((F.row_number().over(Window.partitionBy("conv_id", "part").orderBy("pos")) - 1) / CHUNK)
    turn = F.struct("pos", "initial", (F.col("blank") | F.col("duplicate")).alias("gone"), F.when(F.col("truncated"), TRUNCATED).otherwise(0).cast("long").alias("extra"))
    many = flags.withColumn("no", no).groupBy("conv_id", "part", "no").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    conv = Window.partitionBy("conv_id")
    return many.select("conv_id", (F.row_number().over(conv.orderBy("part", "no")) - 1).alias("at"), F.count(F.lit(1)).over(conv).alias("chunks"), "turns")


# --- the fold


def _way(cost: Column, audit: Column) -> Column:
    return F.struct(cost.cast("long").alias("cost"), audit.cast("string").alias("audit"))


def _then(way: Column, cost, letters) -> Column:
    """A way with one more edit; null where there is no such way."""
    return F.when(way.isNotNull(), _way(way["cost"] + cost, F.concat(way["audit"], letters if isinstance(letters, Column) else F.lit(letters))))


def _inserted(ways: Column) -> dict[str, Column]:
    """The states after turns have been inserted."""
    e, s, u, a = (ways[x] for x in STATES)
    return {"e": e, "s": s, "u": F.least(u, _then(e, INSERT, "I"), _then(s, INSERT, "I"), _then(a, INSERT, "I")), "a": F.least(a, _then(u, INSERT, "I"), _then(e, 2 * INSERT, "II"), _then(s, 2 * INSERT, "II"))}


def _folded(ways: Column, turn: Column) -> Column:
    """The states after a turn was deleted, kept or given another role, with inserted turns before it."""
    # The states after insertions are used several times; a list of one keeps them from being computed each time.
    opened = F.array(F.struct(*(w.alias(x) for x, w in _inserted(ways).items())))

    def after(now: Column) -> Column:
        stays, extra, initial = ~turn["gone"], turn["extra"], turn["initial"]
        gone = {x: _then(now[x], DELETE, "D") for x in STATES}
        to = lambda letter: (extra + F.when(initial == letter, 0).otherwise(REROLE), F.when(initial == letter, "K").otherwise("R"))
        before_user = F.least(now["e"], now["s"], now["a"])
        return F.struct(
            gone["e"].alias("e"),
            F.least(gone["s"], F.when(stays & (initial == "s"), _then(now["e"], extra, "K"))).alias("s"),
            F.least(gone["u"], F.when(stays, _then(before_user, *to("u")))).alias("u"),
            F.least(gone["a"], F.when(stays, _then(now["u"], *to("a")))).alias("a"),
        )

    return F.element_at(F.transform(opened, after), 1)


def _from(state: str, turns: Column) -> Column:
    """The fold of turns for an output that is in a state."""
    start = F.struct(*((_way(F.lit(0), F.lit("")) if x == state else F.lit(None).cast("struct<cost:bigint,audit:string>")).alias(x) for x in STATES))
    kind = "struct<" + ",".join(f"{x}:struct<cost:bigint,audit:string>" for x in STATES) + ">"
    return F.aggregate(turns, start.cast(kind), lambda ways, turn: _folded(ways, turn).cast(kind))


WAYS = "struct<" + ",".join(f"{x}:struct<cost:bigint,audit:string,path:string>" for x in STATES) + ">"
MATRIX = "struct<" + ",".join(f"{x}:{WAYS}" for x in STATES) + ">"


def _matrix() -> Column:
    """A chunk's matrix: for each state it may begin in, the ways to the states it ends in. The first chunk begins with the empty output."""
    rows = []
    for x in STATES:
        ways = F.struct(*(F.when(F.col(f"from_{x}")[y].isNotNull(), F.struct(F.col(f"from_{x}")[y]["cost"].alias("cost"), F.col(f"from_{x}")[y]["audit"].alias("audit"), F.lit(x).alias("path"))).alias(y) for y in STATES))
        rows.append((ways if x == "e" else F.when(F.col("at") > 0, ways)).alias(x))
    return F.struct(*rows).cast(MATRIX)


def _times(one: Column, two: Column) -> Column:
    """The product of two matrices over (least, plus)."""

    def linked(p: Column, q: Column) -> Column:
        return F.when(p.isNotNull() & q.isNotNull(), F.struct((p["cost"] + q["cost"]).alias("cost"), F.concat(p["audit"], q["audit"]).alias("audit"), F.concat(p["path"], q["path"]).alias("path")))

    return F.struct(*(F.struct(*(F.least(*(linked(one[x][z], two[z][y]) for z in STATES)).alias(y) for y in STATES)).alias(x) for x in STATES)).cast(MATRIX)


def chosen(chunks: DataFrame) -> DataFrame:
    """conv_id, cost, audit and path of each conversation; path: the state before each chunk, then the last one."""
    now, left = chunks.select("conv_id", "at", _matrix().alias("m")), chunks.agg(F.max("at")).first()[0] or 0
    while left:  # as often as a chunk number can be divided by WIDTH
        left //= WIDTH
        listed = now.groupBy("conv_id", F.floor(F.col("at") / WIDTH).alias("at")).agg(F.array_sort(F.collect_list(F.struct("at", "m"))).alias("ms"))
        now = listed.select("conv_id", "at", F.aggregate(F.slice("ms", 2, WIDTH), F.element_at("ms", 1)["m"], lambda acc, x: _times(acc, x["m"])).alias("m"))
    end = lambda x, cost, letters: F.when(F.col(f"m.e.{x}").isNotNull(), F.struct((F.col(f"m.e.{x}.cost") + cost).alias("cost"), F.concat(F.col(f"m.e.{x}.audit"), F.lit(letters)).alias("audit"), F.concat(F.col(f"m.e.{x}.path"), F.lit(x)).alias("path")))
    best = F.least(end("e", 0, ""), end("a", 0, ""), end("u", INSERT, "I"), end("s", 2 * INSERT, "II"))
    return now.select("conv_id", best.alias("best")).select("conv_id", "best.*")


# --- what comes out of it


def edits(chunks: DataFrame, best: DataFrame) -> DataFrame:
    """conv_id, at, seq, edit, role (of a user or assistant turn, where the edit sets it) and pos (null: inserted), in the order of conv_id, at and seq."""
    states = best.select("conv_id", F.posexplode(F.split("path", "")).alias("at", "state"))
    states = states.where("state != ''").select(F.col("conv_id").alias("conv"), F.col("at").alias("no"), "state")
    # Each chunk with the states around it: both are rows of the path.
    begun = states.withColumnRenamed("state", "begin")
    ended = states.select("conv", (F.col("no") - 1).alias("no"), F.col("state").alias("end"))
    around = begun.unionByName(ended, allowMissingColumns=True).groupBy("conv", "no").agg(F.max("begin").alias("begin"), F.max("end").alias("end")).where("no >= 0 and end is not null")
    joined = chunks.join(around, chunks["conv_id"].eqNullSafe(around["conv"]) & (chunks["at"] == around["no"]))
    audit = F.coalesce(*(F.when((F.col("begin") == x) & (F.col("end") == y), F.col(f"from_{x}")[y]["audit"]) for x in STATES for y in STATES))
    tail = F.when(F.col("at") < F.col("chunks") - 1, "").when(F.col("end") == "u", "I").when(F.col("end") == "s", "II").otherwise("")
    letters = joined.select("conv_id", "at", "begin", "turns", F.posexplode(F.split(F.concat(audit, tail), "")).alias("seq", "edit")).where("edit != ''")
    before = Window.partitionBy("conv_id", "at").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    count = lambda c: F.coalesce(F.count_if(c).over(before), F.lit(0))
    row = letters.withColumn("k", (count(F.col("edit") != "I") + 1).cast("int")).withColumn("turn", F.when(F.col("edit") != "I", F.try_element_at("turns", F.col("k")))).drop("turns")
    # Users and assistants take turns; a system turn that is kept comes before both.
    spoken = (F.col("edit") != "D") & ~((F.col("edit") == "K") & (F.col("turn.initial") == "s"))
    odd = (count(spoken) + F.when(F.col("begin") == "u", 1).otherwise(0)) % 2 == 1
    return row.select("conv_id", "at", "seq", "edit", F.when(F.col("edit").isin("R", "I"), F.when(odd, "assistant").otherwise("user")).alias("role"), F.col("turn.pos").alias("pos"))


def repaired_turns(laid: DataFrame, plan: DataFrame) -> DataFrame:
    """conv_id, at, seq, edit, role and text of the turns after repair; their order is conv_id, at, seq."""
    texts = laid.select("pos", F.col("role").alias("was"), "text")
    own = plan.where("edit in ('K', 'R')").join(texts, "pos").select("conv_id", "at", "seq", "edit", F.coalesce("role", "was").alias("role"), "text")
    return own.unionByName(plan.where("edit = 'I'").select("conv_id", "at", "seq", "edit", "role", F.lit("").alias("text")))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """sha256 of each conversation's lines, from rows sorted by conversation."""
    now, digest = None, None

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"conv": pa.array([now], pa.int64()), "repaired_sha256": [digest.hexdigest()]})

    for batch in batches:
        for conv, line in zip(batch.column("conv_id").to_pylist(), batch.column("line").to_pylist()):
            if digest is None or conv != now:
                if digest is not None:
                    yield told()
                now, digest = conv, hashlib.sha256(line.encode())
            else:
                digest.update(("\n" + line).encode())
    if digest is not None:
        yield told()


def repair(turns: DataFrame, damage: bool = True) -> tuple[DataFrame, DataFrame]:
    """One row for each conv_id of turns, and the turns after repair.

    The first: gaps, blank, duplicate, truncated, illegal, cost and audit. The second: conv_id, at, seq, edit, role, text. turns: conv_id,
    turn, role, text; other columns are not read. Rows with a null conv_id are one conversation; null turns come first, equal ones by role,
    then md5 of the text; equal rows are duplicates; null roles and texts are one space. An empty table gives no rows.
    """
    rows = damaged(turns) if damage else turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")))
    laid = laid_out(rows)
    flags = written(flagged(laid), "flags")
    plain = chunked(flags)
    many = F.col("chunks") > 1
    chunks = written(plain.select("*", *((_from(x, F.col("turns")) if x == "e" else F.when(many, _from(x, F.col("turns")))).alias(f"from_{x}") for x in STATES)), "chunks")
    best = written(chosen(chunks), "repairs")
    counts = flags.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"), *(F.count_if(F.col(c)).alias(c) for c in ("blank", "duplicate", "truncated")))
    ends = chunks.select("conv_id", "at", F.element_at("turns", 1)["initial"].alias("head"), F.element_at("turns", -1)["initial"].alias("last"), "turns")
    inner = F.size(F.filter(F.arrays_zip(F.slice("turns", 1, F.size("turns") - 1).alias("p"), F.slice("turns", 2, F.size("turns")).alias("q")), lambda x: ~F.concat(x["p"]["initial"], x["q"]["initial"]).isin(*LEGAL)))
    met = F.lag("last").over(Window.partitionBy("conv_id").orderBy("at"))
    ill = ends.select("conv_id", inner.alias("inner"), F.when(met.isNotNull() & ~F.concat(met, "head").isin(*LEGAL), 1).otherwise(0).alias("met")).groupBy("conv_id").agg(F.sum(F.col("inner") + F.col("met")).alias("illegal"))
    told = _joined(turns.select(F.col("conv_id").cast("long").alias("conv_id")).distinct(), counts, ill, best.select("conv_id", "cost", "audit"))
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return told.select("conv_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers), F.coalesce("audit", F.lit("")).alias("audit")), repaired_turns(laid, edits(chunks, best))


def _joined(left: DataFrame, *others: DataFrame) -> DataFrame:
    """Rows by conv_id with those of other tables, where they have one; null is an id too."""
    for other in others:
        right = other.withColumnRenamed("conv_id", "_conv")
        left = left.join(right, left["conv_id"].eqNullSafe(right["_conv"]), "left").drop("_conv")
    return left


def digests(turns: DataFrame) -> DataFrame:
    """conv_id and the sha256 of `role:text` lines. A digest needs its conversation in order: one sorted stream, of which only the state is held."""
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines = turns.select("conv_id", "at", "seq", F.concat_ws(":", "role", "text").alias("line"))
    hashed = lines.repartition(n, "conv_id").sortWithinPartitions("conv_id", "at", "seq").select("conv_id", "line").mapInArrow(_digests, "conv long, repaired_sha256 string")
    return hashed.withColumnRenamed("conv", "conv_id")


def repaired(turns: DataFrame) -> DataFrame:
    """repair()'s first table with repaired_sha256."""
    told, out = repair(turns)
    return _joined(told, digests(out)).withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)))

"""Exact quantiles by selection: ranks are found by histograms over ever smaller ranges.

A round counts the values of a target's range in BINS bins; the bin that holds the rank is the next range, from the least to
the greatest value that is in it. A range of one value is an answer; when no range has more than LEAF values
left, they are sorted. So no task holds more than the bins of a range or LEAF values, however many
distinct values there are, and nothing is sorted or shuffled but counts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import kept, shared_dir

BINS, LEAF = 1_024, 4_096


def _targets(rows: DataFrame, by: list[str], fractions: list[float]) -> DataFrame:
    """by, n, k (place in fractions), side (lower or upper neighbour), rank in the range, part (how far between both), low and high."""
    whole = rows.groupBy(*by).agg(F.sum("w").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).where("n > 0")
    at = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(float(p)).alias("p")) for k, p in enumerate(fractions)))
    each = whole.withColumn("f", F.explode(at)).withColumn("place", F.col("f.p") * (F.col("n") - 1))
    sides = F.array(F.struct(F.lit(0).alias("side"), F.floor("place").alias("rank")), F.struct(F.lit(1).alias("side"), F.ceil("place").alias("rank")))
    told = each.withColumn("s", F.explode(sides))
    return told.select(*by, "n", F.col("f.k").alias("k"), F.col("s.side").alias("side"), F.col("s.rank").alias("rank"), (F.col("place") - F.floor("place")).alias("part"), "low", "high", F.col("n").alias("left"))


def _within(rows: DataFrame, open_targets: DataFrame, by: list[str]) -> DataFrame:
    """Rows beside each open target whose range they are in. Targets: two a group and fraction."""
    named = open_targets.select(*(F.col(c).alias(f"_{c}") for c in by), "k", "side", "rank", "low", "high")
    if by:
        met = rows.join(named, [rows[c].eqNullSafe(named[f"_{c}"]) for c in by])
    else:
        met = rows.crossJoin(F.broadcast(named))  # two rows a fraction
    return met.where(F.col("x").between(F.col("low"), F.col("high")))


def narrowed(rows: DataFrame, targets: DataFrame, by: list[str], bins: int = BINS) -> DataFrame:
    """Open targets with the bin that holds their rank as range."""
    own = [f"_{c}" for c in by] + ["k", "side"]
    met = _within(rows, targets, by)
    place = F.least(F.lit(bins - 1), F.floor((F.col("x") - F.col("low")) / (F.col("high") - F.col("low")) * bins))
    # A range so wide that its length overflows is halved at its middle.
    middle = F.when(F.col("x") == F.col("high"), bins - 1).when(F.col("x") > F.col("low") / 2 + F.col("high") / 2, bins - 2).otherwise(F.when(F.col("x") == F.col("low"), 0).otherwise(1))
    wide = (F.col("high") - F.col("low")) == float("inf")
    counted = met.withColumn("bin", F.when(wide, middle).otherwise(place)).groupBy(*own, "rank", "bin").agg(F.sum("w").alias("count"), F.min("x").alias("first"), F.max("x").alias("last"))
    before = F.coalesce(F.sum("count").over(Window.partitionBy(*own).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # at most a row for each bin
    found = counted.withColumn("before", before).where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("count")))
    new = found.select(*(F.col(f"_{c}").alias(f"n_{c}") for c in by), F.col("k").alias("n_k"), F.col("side").alias("n_side"), (F.col("rank") - F.col("before")).alias("n_rank"), "first", "last", "count")
    same = [targets[c].eqNullSafe(new[f"n_{c}"]) for c in by] + [targets["k"] == new["n_k"], targets["side"] == new["n_side"]]
    return targets.join(new, same).select(*by, "n", "k", "side", F.col("n_rank").alias("rank"), "part", F.col("first").alias("low"), F.col("last").alias("high"), F.col("count").alias("left"))


def _sorted_leaves(rows: DataFrame, targets: DataFrame, by: list[str]) -> DataFrame:
    """Open targets of few values, with the value at their rank as range."""
    own = [f"_{c}" for c in by] + ["k", "side"]
    values = _within(rows, targets, by).groupBy(*own, "rank", "x").agg(F.sum("w").alias("w")).groupBy(*own, "rank").agg(F.array_sort(F.collect_list(F.struct("x", "w"))).alias("held"))
    step = lambda a, v: F.struct((a["seen"] + v["w"]).alias("seen"), F.when(a["found"].isNull() & (a["seen"] + v["w"] > F.col("rank")), v["x"]).otherwise(a["found"]).alias("found"))
    at = F.aggregate("held", F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("double").alias("found")), step)["found"]
    new = values.select(*(F.col(f"_{c}").alias(f"n_{c}") for c in by), F.col("k").alias("n_k"), F.col("side").alias("n_side"), at.alias("found"))
    same = [targets[c].eqNullSafe(new[f"n_{c}"]) for c in by] + [targets["k"] == new["n_k"], targets["side"] == new["n_side"]]
    return targets.join(new, same).select(*by, "n", "k", "side", "rank", "part", F.col("found").alias("low"), F.col("found").alias("high"), F.lit(1).cast("long").alias("left"))


def quantiles(values: DataFrame, column: str, fractions: list[float], by: list[str] | None = None, weight: str | None = None, bins: int = BINS, leaf: int = LEAF) -> DataFrame:
    """by, n and q: for each group its number of values and their exact quantiles, between two values in proportion. weight: how often a value counts.

    Nulls are left out, as are values of no weight; a group without values has no row. Null is a group too.
    """
    by = by or []
    w = F.col(f"`{weight}`").cast("long") if weight else F.lit(1).cast("long")
    rows = values.select(*by, F.col(f"`{column}`").cast("double").alias("x"), w.alias("w")).where("x is not null and w > 0")
    now, done = kept(_targets(rows, by, fractions), "targets"), []
    while True:
        done.append(now.where("low = high"))
        wide = now.where("low < high")
        left = wide.agg(F.max("left")).first()[0]
        if left is None:
            break
        now = kept(_sorted_leaves(rows, wide, by) if left <= leaf else narrowed(rows, wide, by, bins), "targets")
    found = done[0]
    for d in done[1:]:
        found = found.unionByName(d)
    both = found.groupBy(*by, "n", "k").agg(F.max("part").alias("part"), F.max(F.when(F.col("side") == 0, F.col("low"))).alias("lo"), F.max(F.when(F.col("side") == 1, F.col("low"))).alias("hi"))
    one = both.withColumn("v", F.when(F.col("part") == 0, F.col("lo")).otherwise(F.col("lo") * (1 - F.col("part")) + F.col("hi") * F.col("part")))
    return one.groupBy(*by, "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda s: s["v"]).alias("q"))


def gaps(points: DataFrame, x: str) -> DataFrame:
    """gap: the distance of each point from the one before it, in ranges; each range's first point meets the last one of the ranges before."""
    spark = points.sparkSession
    path = f"{shared_dir(spark)}/tonearm-points-{uuid.uuid4().hex}"
    points.select(F.col(x).alias("x")).where("x is not null").repartitionByRange("x").withColumn("part", F.spark_partition_id()).write.parquet(path)
    laid = spark.read.schema(f"x {points.schema[x].dataType.simpleString()}, part int").parquet(path)
    lasts = laid.groupBy("part").agg(F.max("x").alias("last"))
    before = lasts.select("part", F.lag("last").over(Window.orderBy("part")).alias("earlier"))  # a row for each range
    inside: Column = F.lag("x").over(Window.partitionBy("part").orderBy("x"))
    return laid.withColumn("inside", inside).join(before, "part").select((F.col("x") - F.coalesce("inside", "earlier")).alias("gap")).where("gap is not null")

"""Statistics that charts need."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import days as day_sequence
from .selection import gaps, quantiles


def nice_step(low: float, high: float, bins: int) -> float:
    """A step of 1, 2 or 5 times a power of ten that gives about so many bins."""
    raw = (high - low) / max(1, bins)
    if raw <= 0:
        return 1.0
    power = 10.0 ** math.floor(math.log10(raw))
    error = raw / power
    return power * (10 if error >= math.sqrt(50) else 5 if error >= math.sqrt(10) else 2 if error >= math.sqrt(2) else 1)


def summary(values: DataFrame, column: str, weight: str | None = None) -> DataFrame:
    """One row: n, low, high, mean and exact median; with weights each value counts so often and is never written out."""
    w = F.col(weight) if weight else F.lit(1)
    mean = F.sum(F.col(column) * w) / F.sum(w)
    told = values.where(F.col(column).isNotNull()).agg(F.coalesce(F.sum(w), F.lit(0)).cast("long").alias("n"), F.min(column).alias("low"), F.max(column).alias("high"), mean.cast("double").alias("mean"))
    middle = quantiles(values, column, [0.5], weight=weight).agg(F.max(F.col("q")[0]).alias("median"))
    return told.crossJoin(F.broadcast(middle))  # one row each


def histogram(values: DataFrame, column: str, low: float, step: float, weight: str | None = None) -> DataFrame:
    """bin (lower end) and count of the bins that have values."""
    w = F.col(weight) if weight else F.lit(1)
    at = F.floor((F.col(column) - F.lit(low)) / F.lit(step)) * F.lit(step) + F.lit(low)
    return values.where(F.col(column).isNotNull()).groupBy(at.cast("double").alias("bin")).agg(F.sum(w).cast("long").alias("count"))


def expanded(buckets: DataFrame, value: str, count: str) -> DataFrame:
    """Bucket counts as that many rows."""
    return buckets.where(F.col(count) > 0).select(F.explode(F.array_repeat(F.col(value), F.col(count).cast("int"))).alias(value))


def donut(rows: DataFrame, label: str, value: str, slices: int = 8) -> DataFrame:
    """The largest slices, the rest as one, and each one's share. rows: a row for each label."""
    place = F.row_number().over(Window.orderBy(F.desc(value), label))
    top = rows.orderBy(F.desc(value), label).limit(slices).withColumn("place", place)  # at most slices rows
    all_of = rows.agg(F.sum(value).alias("whole"), F.count("*").alias("labels"))
    kept = top.agg(F.sum(value).alias("kept"), F.count("*").alias("shown"))
    rest = all_of.crossJoin(F.broadcast(kept)).where("labels > shown")  # one row each
    other = rest.select(F.concat(F.lit("Other ("), (F.col("labels") - F.col("shown")).cast("string"), F.lit(")")).alias("label"), (F.col("whole") - F.col("kept")).alias("value"), F.lit(slices + 1).alias("place"))
    both = top.select(F.col(label).alias("label"), F.col(value).alias("value"), "place").unionByName(other).crossJoin(F.broadcast(all_of.select("whole")))  # one row
    return both.select("label", "value", "place", (F.col("value") / F.nullif("whole", F.lit(0))).alias("share"))


def bar_shares(rows: DataFrame, label: str, value: str) -> DataFrame:
    whole = rows.agg(F.sum(value).alias("whole"))
    return rows.crossJoin(F.broadcast(whole)).select(F.col(label).alias("label"), F.col(value).alias("value"), (F.col(value) / F.nullif("whole", F.lit(0))).alias("share"))  # one row


def heat_thresholds(days: DataFrame, value: str, steps: int = 5, gamma: float = 0.45) -> DataFrame:
    """One row: the values that part the shades of a calendar, quantiles over days that aren't zero."""
    return quantiles(days.where(F.col(value) > 0), value, [(i / steps) ** gamma for i in range(1, steps)]).agg(F.max("q").alias("thresholds"))


def calendar(days: DataFrame, day: str, value: str, low, high) -> DataFrame:
    """Every day from one to another with its value, week (from the Monday of the first week) and weekday (0 is Monday)."""
    spine = days.sparkSession.range(1).select(F.explode(day_sequence(F.lit(low).cast("date"), F.lit(high).cast("date"))).alias("d"))
    start = F.date_sub(F.lit(low).cast("date"), F.weekday(F.lit(low).cast("date")))
    joined = spine.join(days.select(F.col(day).cast("date").alias("d"), F.col(value).alias("value")), "d", "left")
    week = F.call_function("div", F.date_diff("d", start).cast("long"), F.lit(7).cast("long"))
    return joined.select(F.col("d").cast("string").alias("day"), F.coalesce("value", F.lit(0)).alias("value"), week.alias("week"), F.weekday("d").alias("weekday"))


def cumulative(rows: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """rows with a running total of each series. Series are buckets of time, not events."""
    return rows.withColumn("running", F.sum(value).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def median_gap(points: DataFrame, x: str) -> DataFrame:
    """One row: the median distance of neighbouring points."""
    return quantiles(gaps(points, x), "gap", [0.5]).agg(F.max(F.col("q")[0]).alias("median_gap"))


def bump_series(ranks: DataFrame, most: int) -> DataFrame:
    """Rows within the shown ranks, and each key's place by the period, then rank, it first appears at."""
    shown = ranks.where(F.col("rank") <= most)
    firsts = shown.groupBy("key").agg(F.min(F.struct("period", "rank", "key")).alias("first"))
    placed = firsts.select("key", F.row_number().over(Window.orderBy("first")).alias("place"))  # a row for each shown key
    return shown.join(placed, "key")


def sparkline(points: DataFrame, order: str, value: str, last: int = 24) -> DataFrame:
    """One row: first and last of the newest points, and the change between them in percent; null from zero."""
    newest = points.orderBy(F.desc(order)).limit(last)
    ends = newest.agg(F.min_by(value, order).alias("first"), F.max_by(value, order).alias("last"), F.count("*").alias("points"))
    return ends.withColumn("change", (F.col("last") - F.col("first")) * 100.0 / F.nullif("first", F.lit(0)))


def chip_sizes(rows: DataFrame, label: str, weight: str) -> DataFrame:
    most = rows.agg(F.max(weight).alias("most"))
    return rows.crossJoin(F.broadcast(most)).select(F.col(label).alias("label"), F.sqrt(F.col(weight) / F.nullif("most", F.lit(0))).alias("size"))  # one row


def history_figures(months: DataFrame, totals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Minutes outside the library by month; hours an active day."""
    outside = months.select("period", F.greatest(F.lit(0), F.col("minutes") - F.col("library_minutes")).alias("outside_minutes"))
    figures = totals.select((F.col("ms_played") / 3_600_000.0 / F.nullif("active_days", F.lit(0))).alias("hours_a_day"))
    return outside, figures


def resolved_share(coverage: DataFrame) -> DataFrame:
    """The share of all plays that are resolved, from their coverage; null where there are none."""
    return coverage.select((F.col("resolved") / F.nullif("plays", F.lit(0))).alias("resolved_share"))


def lag_in_years(rows: DataFrame, days: str) -> DataFrame:
    return rows.withColumn("years", F.col(days) / 365.25)


def trailing_mean(rows: DataFrame, order: str, value: str, width: int = 3) -> DataFrame:
    """The mean of the last few points of a bounded series."""
    return rows.withColumn("trailing_mean", F.avg(value).over(Window.orderBy(order).rowsBetween(1 - width, 0)))


def added_genres(rows: DataFrame, own: str, other: str) -> DataFrame:
    """rows with added: genres of the other list that the own one lacks, whatever their case."""
    lower = lambda c: F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.lower(x))
    return rows.withColumn("added", F.array_sort(F.array_except(lower(other), lower(own))))

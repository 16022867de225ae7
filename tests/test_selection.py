"""Exact quantiles by selection against sorted values and DuckDB."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tonearm.operators import charts, selection


def brute(values, p):
    s = sorted(values)
    at = p * (len(s) - 1)
    lo, hi, part = s[int(at // 1)], s[min(len(s) - 1, int(-(-at // 1)))], at - at // 1
    return lo if part == 0 else lo * (1 - part) + hi * part


KINDS = {
    "ties": lambda r: float(r.randrange(4)), "wide": lambda r: r.choice([-1, 1]) * 10.0 ** r.uniform(-300, 300), "close": lambda r: 1.0 + r.randrange(5) * 2.0**-52, "one far": lambda r: 1e18 if r.random() < 0.01 else r.random(), "same": lambda r: 7.0,
    "extreme": lambda r: r.choice([1.7e308, -1.7e308, 0.0, 5e-324, 1.0]),
}


@pytest.mark.parametrize("kind, leaf", [*((k, 50) for k in KINDS), ("ties", 0), ("close", 0)])
def test_quantiles_are_exact(spark, kind, leaf):
    r = random.Random(kind)
    rows = [(r.choice(["a", "b", None]), KINDS[kind](r)) for _ in range(400)] + [("a", None), ("c", None), ("d", 3.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {x["g"]: (x["n"], x["q"]) for x in selection.quantiles(df, "v", [0, 0.25, 0.5, 0.99, 1], ["g"], bins=16, leaf=leaf).collect()}
    for g in ("a", "b", None, "d"):
        own = [v for h, v in rows if h == g and v is not None]
        assert got[g][0] == len(own) and got[g][1] == pytest.approx([brute(own, p) for p in (0, 0.25, 0.5, 0.99, 1)], rel=1e-15, abs=0)
    assert set(got) == {"a", "b", None, "d"}


def test_weights_and_no_rows(spark):
    df = spark.createDataFrame([(1.0, 3), (2.0, 0), (5.0, 2), (9.0, None)], "v double, w int")
    assert [tuple(x) for x in selection.quantiles(df, "v", [0.5, 0.75], weight="w", leaf=0).collect()] == [(5, [1.0, 5.0])]
    assert selection.quantiles(df.where("false"), "v", [0.5]).collect() == []
    assert charts.summary(df.where("false"), "v").first()["median"] is None and charts.heat_thresholds(df.where("false"), "v").first()[0] is None


def test_no_task_takes_all_values(spark):
    """Half a million distinct values: what is exchanged is counts of bins, and what is sorted is a leaf."""
    df = spark.range(500_000).select((F.xxhash64("id") / 1e9).alias("v"))
    got = selection.quantiles(df, "v", [0.1, 0.5]).first()["q"]
    values = [x[0] for x in df.collect()]
    assert got == pytest.approx([brute(values, 0.1), brute(values, 0.5)], rel=1e-15)
    rows = df.withColumnsRenamed({"v": "x"}).withColumn("w", F.lit(1).cast("long"))
    plan = selection.narrowed(rows, selection._targets(rows, [], [0.5]), [])._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan and "percentile" not in plan


def test_gaps_over_ranges(spark):
    r = random.Random(2)
    xs = [r.randrange(10**6) for _ in range(3_000)]
    df = spark.createDataFrame([(x,) for x in xs] + [(None,)], "x long").repartition(7)
    s = sorted(xs)
    assert sorted(x[0] for x in selection.gaps(df, "x").collect()) == sorted(b - a for a, b in zip(s, s[1:]))
    want = duckdb.sql(f"select quantile_cont(g, 0.5) from (select unnest({[b - a for a, b in zip(s, s[1:])]}) as g)").fetchall()[0][0]
    assert charts.median_gap(df, "x").first()[0] == want

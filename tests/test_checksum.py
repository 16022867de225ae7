"""The digest of ordered text is computed in blocks, never from a list of all rows."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tonearm.operators import derive


@pytest.mark.parametrize("n", [0, 1, 60_000])
def test_text_checksum_streams(spark, n):
    rows = spark.range(n).select(F.concat(F.lit("é"), F.pmod(F.col("id") * 7919, F.lit(n or 1)).cast("string")).alias("id"), F.when(F.col("id") % 3 > 0, F.repeat(F.lit("x"), 40)).alias("a"))
    lines = sorted((r["id"], f"{r['id']}|{r['a'] or ''}") for r in rows.collect())
    got = derive.text_checksum(rows, "id", ["a"])
    assert [r["checksum"] for r in got.collect()] == [hashlib.md5("\n".join(x for _, x in lines).encode()).hexdigest()]
    assert "collect_list" not in got._jdf.queryExecution().toString()

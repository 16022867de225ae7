"""Numeric entities are decoded by Spark itself, each once."""

import re

from pyspark.sql import functions as F

from tonearm.functions import text


def decoded(s: str) -> str:
    def shown(m):
        code = int(m[1][1:], 16) if m[1][0] == "x" else int(m[1])
        return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else m[0]

    return re.sub(r"&#(x[0-9a-fA-F]+|[0-9]+);", shown, s)


def test_numeric_entities(spark):
    given = ["", "plain", "&#65;&#x42;", "a&#x1F600;b&#128512;c", "&#38;#60; &#x26;lt;", "&#0065;&#x00041;", "&#1114111;&#1114112;&#xD800;&#57343;&#57344;", "&#99999999999999999999999;&#xFFFFFFFFFFFFFFFFFFFF;", "&#;&#x;&#xG;&#12", "&#228;&#8364;&#x3042;", "&#65279;x&#xFEFF;", "&#00000000000000000000065;", "&#9;|&#10;|", "&#x65;&#65;&#101;"]
    df = spark.createDataFrame(list(enumerate(given)), "id int, s string")
    out = df.select("id", text._numeric_entities(F.col("s")).alias("t"))
    assert [r["t"] for r in out.orderBy("id").collect()] == [decoded(s) for s in given]
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    assert df.select(text._numeric_entities(F.lit(None).cast("string")).alias("t")).where("t is not null").count() == 0

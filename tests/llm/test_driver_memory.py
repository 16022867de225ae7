"""A run of several stages lets the driver's heap shrink."""

import gc

from tonearm.llm import common


def test_a_run_clears_the_driver_now_and_then(spark, monkeypatch):
    seen, collect = [], gc.collect
    monkeypatch.setattr(gc, "collect", lambda *a: seen.append(1) or collect(*a))
    monkeypatch.setattr(common, "_CLEARED", [0.0])
    monkeypatch.setattr(common, "CLEARED_EVERY", 1)
    common.written(spark.range(3), "alone")
    assert not seen
    monkeypatch.setattr(common, "CLEARED_EVERY", 3_600)
    monkeypatch.setattr(common, "_CLEARED", [float("-inf")])
    with common.scope():
        assert common.written(spark.range(3), "one").count() == 3 and common.written(spark.range(3), "two").count() == 3
    assert len(seen) == 1

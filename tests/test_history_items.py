"""History files are read item by item."""

import io
import json
import random

import pytest

from tonearm.sources.history import array_items


@pytest.mark.parametrize("size", [1, 3, 7, 64, 1 << 20])
def test_items_are_those_of_the_whole_text(size):
    r = random.Random(size)
    rows = [{"a": r.random(), "b": "ä\"]},{[ \\ 漢" * r.randint(0, 3), "c": [1, {"d": None}]} for _ in range(60)] + [1, 12.5, "x", None, []]
    for text in (json.dumps(rows), json.dumps(rows, indent=2, ensure_ascii=False), "﻿ [ ] ", "[1]"):
        assert list(array_items(io.BytesIO(text.encode()), size)) == json.loads(text.lstrip("﻿"))


@pytest.mark.parametrize("text", ["", "{}", "[1, 2", '[{"a": 1}, {"b"', "[1, x]"])
def test_broken_files_fail(text):
    with pytest.raises(ValueError):
        list(array_items(io.BytesIO(text.encode())))

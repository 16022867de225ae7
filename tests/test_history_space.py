"""Items of history files, however wide the space between them and wherever a piece ends."""

import io
import json
import random

import pytest

from tonearm.sources.history import array_items


class Counted(io.BytesIO):
    most = 0

    def read(self, size=-1):
        assert size > 0
        return super().read(size)


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, 1 << 20])
@pytest.mark.parametrize("space", ["", " ", " " * 63, " " * 70, "\n" + "\t" * 500 + "\r\n"])
def test_any_white_space(size, space):
    items = [{"a": 1, "b": "],[ é \\\" \U0001f600"}, {"a": [1, {"c": None}]}, 12345, -1.5e3, "x", True, None, [], {}]
    text = space + "[" + space + (space + "," + space).join(json.dumps(i, ensure_ascii=False) for i in items) + space + "]" + space
    assert list(array_items(Counted(text.encode()), size)) == items
    assert list(array_items(Counted(b"\xef\xbb\xbf" + text.encode()), size)) == items
    assert list(array_items(Counted((space + "[" + space + "]").encode()), size)) == []


@pytest.mark.parametrize("text", ["", "  ", "{}", "[", "[1", "[1,", "[1,]", "[1 2]", "[{]", '[{"a":1}', "[1]x", "[,1]", "1", '["a', "[1]]"])
@pytest.mark.parametrize("size", [1, 1 << 20])
def test_what_is_no_array_is_refused(text, size):
    with pytest.raises(ValueError):
        list(array_items(io.BytesIO(text.encode()), size))


def test_little_is_held():
    """Between two items stands more white space than a piece; what is read ahead is a piece at most."""
    rng, read = random.Random(1), 0

    class Stream(io.BytesIO):
        def read(self, size=-1):
            nonlocal read
            piece = super().read(size)
            read += len(piece)
            return piece

    items = [{"n": k, "s": "x" * rng.randrange(50)} for k in range(200)]
    body, ends = b"[", []
    for k, i in enumerate(items):
        body += (b"," if k else b"") + b" " * rng.choice([0, 5_000]) + json.dumps(i).encode()
        ends.append(len(body))
    for end, item in zip(ends, array_items(Stream(body + b" " * 9_000 + b"]"), 256)):
        assert read <= end + 256

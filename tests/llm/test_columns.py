"""Extra columns whose names clash with what the operators make."""

import pytest
from pyspark.sql import functions as F

from tonearm.llm import bpe, chat_format, line_dedup, media_chunks, mixing, quality, queries, sharding, simhash, substring_dedup, token_files

NAMES = ("ids", "decoded", "n_lines", "n_removed", "_hash", "_size", "_copy", "row", "block", "copy", "size", "words", "key", "shard", "slot", "fp", "n_words", "kept", "distance", "model", "gone", "lines", "chunks", "digest", "number", "text_hash")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, "a b c d", "en", "web"), (1, "a b c d", "en", "web"), (2, None, None, None), (None, "", "en", "web"), (3, "e f " * 40, "de", "web")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.select("*", *(F.lit(k).alias(n) for k, n in enumerate(NAMES)))


def test_tokens(odd):
    path = queries.tokenizer(queries.BYTE_BPE)
    coded = bpe.decode_ids(bpe.encode_texts(odd, path), path)
    assert sorted(coded.columns) == sorted({*odd.columns, "ids", "decoded"} - {"text"})
    assert sorted(r["decoded"] for r in coded.collect()) == sorted(["a b c d"] * 2 + ["", "", "e f " * 40])
    assert token_files.read_token_files(*token_files.write_token_files(odd, queries.tokenizer(queries.WORD_BPE), 1, queries.WORD_BPE_IDS), queries.WORD_BPE_IDS).count() == 5


def test_ids_too_wide(tmp_path):
    path = tmp_path / "wide.json"
    path.write_text('{"model": {"vocab": {"a": 16777216}, "merges": []}, "added_tokens": []}')
    with pytest.raises(ValueError):
        bpe.ByteBpe(str(path))


def test_lines(odd):
    got = line_dedup.drop_shared_lines(odd)
    assert sorted(got.columns) == sorted(odd.columns) and got.where("n_removed = 0").count() == 5
    assert got.select("copy").distinct().count() == 1


def test_mixture(odd):
    got = mixing.mixed_texts(odd)
    assert got.columns == odd.columns and got.count() > 0
    assert got.select("_hash", "_size", "_copy").distinct().collect() == [(4, 5, 6)]
    assert mixing.mix_documents(odd).count() == 5


def test_the_rest(odd):
    assert quality.judge(odd).count() == 5 and quality.text_statistics(odd).where("n_words = 4").count() == 2
    assert quality.robust_outliers(quality.text_statistics(odd)).columns.count("kept") == 1
    assert substring_dedup.remove_repeats(odd).count() == 5 and simhash.near_duplicates(odd).count() == 5
    assert sharding.shard_documents(odd).count() == 5
    assert media_chunks.read_media(*media_chunks.store_media(odd)).count() == 5


def test_turns(spark):
    df = spark.createDataFrame([(1, 0, "user", "x", 3), (1, 1, "assistant", None, 3)], "conv_id long, turn long, role string, text string, segment int").withColumns({"escapes": F.lit(1)})
    assert chat_format.round_trip(df).select("n_turns").collect() == [(2,)]

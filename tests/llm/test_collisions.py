"""Texts on which polynomial hashes mod 2**64 collide whatever their base."""

from tonearm.llm import substring_dedup


def thue_morse(n):
    return "".join("ab"[k.bit_count() & 1] for k in range(n))


def test_words_that_collide_are_different_words(spark):
    word = thue_morse(2048)
    other = word.translate({97: "b", 98: "a"})
    shared = " ".join(f"w{k}" for k in range(49))
    df = spark.createDataFrame([(1, f"{shared} {word}"), (2, f"{shared} {other}"), (3, f"{shared} {word}")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["n_removed"]) for r in substring_dedup.remove_repeats(df).collect()) == [(1, 0), (2, 0), (3, 50)]


def test_runs_of_words_that_collide_are_different(spark):
    """Two words in the order of a Thue-Morse sequence and of its complement, as windows of 2048 words."""
    order = thue_morse(2048)
    rows = [(1, " ".join(order)), (2, " ".join(order.translate({97: "b", 98: "a"})))]
    got = {r["doc_id"]: r["n_removed"] for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), window=2048).collect()}
    assert got == {1: 0, 2: 0}

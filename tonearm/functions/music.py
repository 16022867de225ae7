"""Names of keys, tempos and traits."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# The twelve notes upwards, flats spelled as sharps; the letter of each mode and the note of its first place.
NOTES = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]
MODES = {"major": ("B", "B"), "minor": ("A", "G#")}
FIFTH = 7
# Upper ends of the tempo labels.
TEMPOS = [(70, "slow"), (100, "mid-tempo"), (125, "upbeat"), (145, "fast")]
# The traits, in the order in which ties are shown.
TRAITS = ["danceable", "happy", "sad", "party", "relaxed", "aggressive", "acoustic", "electronic", "instrumental", "bright", "tonal"]


def musical_key(key: Column, scale: Column) -> Column:
    root = F.replace(key, F.lit("#"), F.lit("♯"))
    return F.when(key != "", F.when(scale != "", F.concat_ws(" ", root, scale)).otherwise(root))


def camelot(key: Column, scale: Column) -> Column:
    """Place of a key on the circle of fifths, 1 to 12, with the letter of its mode."""
    places = {f"{NOTES[(NOTES.index(first) + FIFTH * k) % 12]} {mode}": f"{k + 1}{letter}" for mode, (letter, first) in MODES.items() for k in range(12)}
    table = F.create_map(*(F.lit(x) for x in chain.from_iterable(places.items())))
    return F.element_at(table, F.concat_ws(" ", key, F.lower(scale)))


def tempo_label(bpm: Column) -> Column:
    label = F.when(bpm.isNull(), F.lit(None))
    for below, name in TEMPOS:
        label = label.when(bpm < below, name)
    return label.otherwise("very fast")


def traits(least: float = 0.6) -> Column:
    """Names of the traits of at least so much, the strongest first; ties in the order of TRAITS."""
    all_of = F.array(*(F.struct((-F.coalesce(F.col(t).cast("double"), F.lit(0.0))).alias("minus"), F.lit(k).alias("k"), F.lit(t).alias("name")) for k, t in enumerate(TRAITS)))
    return F.transform(F.array_sort(F.filter(all_of, lambda s: s["minus"] <= -least)), lambda s: s["name"])

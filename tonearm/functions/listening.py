"""What a play, a device and a country mean."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A play counts as heard from so many milliseconds on; slack of an estimate.
COMPLETION_MS, BREAK_MS = 30_000, 60_000
# Device families and the patterns that tell them, the first that fits counts.
DEVICES = [
    ("iOS", ["ios%", "%iphone%", "%ipad%"]),
    ("Android", ["android%"]),
    ("Speaker & partner", ["partner%", "%cast%", "%sonos%", "%speaker%"]),
    ("Web player", ["%web_player%", "web player%"]),
    ("Windows", ["windows%"]),
    ("macOS", ["osx%", "os x%", "macos%"]),
    ("Linux", ["linux%"]),
]


def heard(prefix: str = "") -> Column:
    """Milliseconds heard: as reported, else as estimated, else null."""
    return F.coalesce(F.col(prefix + "ms_played"), F.col(prefix + "estimated_ms"))


def completed() -> Column:
    return F.count_if(heard() >= COMPLETION_MS)


def skipped() -> Column:
    return F.count_if(heard() < COMPLETION_MS)


def device(platform: Column) -> Column:
    family = F.when(platform.isNull(), "Unknown")
    for name, patterns in DEVICES:
        fits = F.lit(False)
        for p in patterns:
            fits = fits | platform.ilike(p)
        family = family.when(fits, name)
    return family.otherwise("Other")


def country(code: Column) -> Column:
    return F.coalesce(F.nullif(code, F.lit("ZZ")), F.lit("Unknown"))


def within(column: str, r) -> Column:
    """The half-open window of a range."""
    return (F.col(column) >= F.lit(r.start)) & (F.col(column) < F.lit(r.end))

"""Windows of time: presets, picked days, and the instants of local midnights."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import UTC, date, datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_ZONE = "Europe/Stockholm"
# Presets, and where a scope without rows starts.
PRESETS = ("all", "1y", "6m", "90d", "30d", "ytd")
EARLIEST = datetime(2008, 1, 1)


@dataclass(frozen=True)
class Range:
    """start <= instant < end, both naive UTC; buckets are in tz."""

    start: datetime
    end: datetime
    tz: str = DEFAULT_ZONE
    preset: str = "custom"
    is_all_time: bool = False

    def local_day(self, which: str) -> date:
        at = self.start if which == "start" else self.end
        return at.replace(tzinfo=UTC).astimezone(ZoneInfo(self.tz)).date()

    def padded(self) -> Range:
        """With a year before it."""
        return Range(_back(self.start, years=1), self.end, self.tz, self.preset, self.is_all_time)


def _back(at: datetime, years: int = 0, months: int = 0) -> datetime:
    """So many months earlier. A day that the month lacks runs over into the next month."""
    n = at.year * 12 + at.month - 1 - 12 * years - months
    return at.replace(year=n // 12, month=n % 12 + 1, day=1) + timedelta(days=at.day - 1)


def midnight(day: str, tz: str, plus_days: int = 0) -> datetime:
    """When a local day begins, in naive UTC."""
    wall = datetime.fromisoformat(day) + timedelta(days=plus_days)
    return wall.replace(tzinfo=ZoneInfo(tz)).astimezone(UTC).replace(tzinfo=None)


def _bound(text: str | None, tz: str, is_end: bool) -> datetime | None:
    if not text:
        return None
    try:
        if re.fullmatch(r"\d{4}-\d{2}-\d{2}", text):
            return midnight(text, tz, int(is_end))
        at = datetime.fromisoformat(text)
    except ValueError:
        return None
    return at.astimezone(UTC).replace(tzinfo=None) if at.tzinfo else at


def scope_start(rows: DataFrame, column: str) -> datetime:
    """The earliest instant of a table, or 2008 where it has none."""
    return rows.agg(F.min(column)).first()[0] or EARLIEST


def resolve(start: datetime, now: datetime, tz: str = DEFAULT_ZONE, preset: str = "all", first: str | None = None, last: str | None = None) -> Range:
    """The window that a preset or two picked days mean. start: where the scope begins.

    Picked days beat the preset, stand in order whichever came first, and the last one is included. An
    unknown preset starts where the scope does without being all time.
    """
    if first or last:
        a, b = _bound(first, tz, False), _bound(last, tz, False)
        if a and b and b < a:
            first, last = last, first
        low, high = _bound(first, tz, False) or start, _bound(last, tz, True) or now
        return Range(min(low, high), high, tz)
    low = {
        "1y": lambda: _back(now, years=1),
        "6m": lambda: _back(now, months=6),
        "90d": lambda: now - timedelta(days=90),
        "30d": lambda: now - timedelta(days=30),
        "ytd": lambda: datetime(now.year, 1, 1),
    }.get(preset, lambda: start)()
    return Range(low, now, tz, preset, preset == "all")

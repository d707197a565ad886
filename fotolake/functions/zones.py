"""Offsets of zone abbreviations at a local time, from the zone database.

An abbreviation may stand for several zones and change its offset over time. For each one
there is a step function of local time, a sorted array of starts and offsets, in which the
last start not after a time is looked up by binary search. A step takes, among the zones
that use the abbreviation at that time, the preferred offset (``PREFERRED``) if one of them
has it, else the one that most zones have (zones with equal rules count once), else the
one nearest to UTC, east before west. Where no zone uses the abbreviation at that time, as
with summer time in winter, the preferred offset holds, else that of the nearest step
before, else after. Times outside ``YEARS`` count as the nearest year's.
"""

from __future__ import annotations

import zoneinfo
from bisect import bisect_right
from collections import Counter, defaultdict
from datetime import datetime, timedelta, timezone
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

YEARS = (1970, 2038)
# Which of several offsets an abbreviation means, in minutes.
PREFERRED = {
    "UTC": 0,
    "GMT": 0,
    "Z": 0,
    "BST": 60,
    "IST": 330,
    "CST": -360,
    "CDT": -300,
    "EST": -300,
    "EDT": -240,
    "MST": -420,
    "MDT": -360,
    "PST": -480,
    "PDT": -420,
    "AST": -240,
    "ADT": -180,
    # Not, or no longer, in the database.
    "BRT": -180,
    "ART": -180,
    "COT": -300,
    "PET": -300,
    "ICT": 420,
    "SGT": 480,
}
# Looked at this often for a change of rules; then found to the second.
_STEP = timedelta(days=28)
_EPOCH = datetime(1970, 1, 1)


def zone_intervals(name: str) -> tuple[tuple[int, int, str, int], ...]:
    """(local start, local end, abbreviation, offset in minutes) of a zone, in seconds of 1970."""
    zone = zoneinfo.ZoneInfo(name)

    def state(at: datetime) -> tuple[str, int]:
        local = at.astimezone(zone)
        return local.tzname(), int(local.utcoffset().total_seconds())

    first, last = (datetime(year, 1, 1, tzinfo=timezone.utc) for year in YEARS)
    start, own, at, out = first, state(first), first, []
    while at < last:
        after = min(at + _STEP, last)
        if state(after) != own:
            low, high = at, after
            while high - low > timedelta(seconds=1):
                middle = low + (high - low) // 2
                middle = middle.replace(microsecond=0)
                low, high = (middle, high) if state(middle) == own else (low, middle)
            out.append((start, high, *own))
            start, own, after = high, state(high), high
        at = after
    out.append((start, last, *own))
    epoch = _EPOCH.replace(tzinfo=timezone.utc)
    return tuple(
        (int((a - epoch).total_seconds()) + off, int((b - epoch).total_seconds()) + off, abbr, off // 60)
        for a, b, abbr, off in out
    )


@lru_cache(maxsize=1)
def abbreviation_steps() -> dict[str, tuple[list[int], list[int]]]:
    """Abbreviation -> starts (seconds of local time) and offsets (minutes) of its steps."""
    uses = defaultdict(set)
    for name in zoneinfo.available_timezones():
        intervals = zone_intervals(name)
        for start, end, abbr, minutes in intervals:
            if abbr.isalpha() and abbr.isupper():
                uses[abbr].add((start, end, minutes, hash(intervals)))
    steps = {abbr: ([_START], [minutes]) for abbr, minutes in PREFERRED.items()}
    steps |= {abbr: _steps(abbr, own) for abbr, own in uses.items()}
    return steps


_START = -(1 << 62)


def _steps(abbr: str, uses: set[tuple]) -> tuple[list[int], list[int]]:
    preferred = PREFERRED.get(abbr)
    changes = sorted({use[0] for use in uses} | {use[1] for use in uses})
    opens, closes = defaultdict(list), defaultdict(list)
    for start, end, minutes, _ in uses:
        opens[start].append(minutes)
        closes[end].append(minutes)
    now: Counter = Counter()
    starts, offsets, last = [], [], None
    for at in changes:
        now.subtract(closes[at])
        now.update(opens[at])
        used = {m: n for m, n in now.items() if n > 0}
        if not used:
            chosen = preferred if preferred is not None else last
        elif preferred in used:
            chosen = preferred
        else:
            chosen = min(used, key=lambda m: (-used[m], abs(m), -m))
        if chosen != last:
            starts.append(at)
            offsets.append(chosen)
        last = chosen
    # Before the first use of all: the preferred offset, else that of the first.
    starts[0] = _START
    if preferred is not None and offsets[0] != preferred:
        starts, offsets = [_START, changes[0], *starts[1:]], [preferred, *offsets]
    return starts, offsets


def offset_of(abbr: str, local: datetime) -> int | None:
    """The offset in minutes at a naive local time; None for an unknown abbreviation."""
    if abbr not in abbreviation_steps():
        return None
    starts, offsets = abbreviation_steps()[abbr]
    seconds = (local - _EPOCH) // timedelta(seconds=1)
    return offsets[bisect_right(starts, seconds) - 1]


def zone_minutes(abbr: Column, local: Column) -> Column:
    """Offset of an abbreviation at a local time (timestamp_ntz); NULL if unknown."""
    rows = [
        item
        for name, (starts, offsets) in sorted(abbreviation_steps().items())
        for item in (
            F.lit(name),
            F.struct(
                F.array(*map(F.lit, starts)).cast("array<long>").alias("starts"),
                F.array(*map(F.lit, offsets)).cast("array<int>").alias("offsets"),
            ),
        )
    ]
    steps = F.try_element_at(F.create_map(*rows), abbr)
    since = F.make_timestamp_ntz(*map(F.lit, (1970, 1, 1, 0, 0)), F.lit(0.0))
    seconds = F.timestamp_diff("SECOND", since, local)
    return F.get(steps["offsets"], _last_not_after(steps["starts"], seconds))


def _last_not_after(starts: Column, value: Column) -> Column:
    """Place of the last start that is not after ``value``, by halving the range."""
    most = max(len(own[0]) for own in abbreviation_steps().values())
    halvings = F.array(*(F.lit(1 << k) for k in range(most.bit_length() - 1, -1, -1)))
    return F.aggregate(
        halvings,
        F.lit(0),
        lambda at, width: F.when(
            (at + width < F.size(starts)) & (F.get(starts, at + width) <= value), at + width
        ).otherwise(at),
    )

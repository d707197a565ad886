"""Date and time expressions."""

from __future__ import annotations

from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

# Java pattern letters for the strftime directives Spark can
# print itself.
_PATTERNS = {
    "Y": "yyyy",
    "m": "MM",
    "d": "dd",
    "H": "HH",
    "I": "hh",
    "M": "mm",
    "S": "ss",
    "f": "SSSSSS",
    "y": "yy",
    "b": "MMM",
    "h": "MMM",
    "B": "MMMM",
    "a": "EEE",
    "A": "EEEE",
    "p": "a",
    "j": "DDD",
}

# Strftime shorthands and what they stand for.
_SHORTHANDS = {
    "c": "%a %b %e %H:%M:%S %Y",
    "D": "%m/%d/%y",
    "F": "%Y-%m-%d",
    "R": "%H:%M",
    "r": "%I:%M:%S %p",
    "T": "%H:%M:%S",
    "x": "%m/%d/%y",
    "X": "%H:%M:%S",
    "n": "\n",
    "t": "\t",
}


def parse_exif_datetime(text: Column) -> Column:
    """``YYYY:MM:DD hh:mm:ss`` to a naive timestamp; anything else is NULL."""
    shape = r"^\d{4}:\d{1,2}:\d{1,2}\s+\d{1,2}:\d{1,2}:\d{1,2}$"
    iso = F.regexp_replace(text, r"^(\d{4}):(\d{1,2}):(\d{1,2})\s+", "$1-$2-$3 ")
    return F.when(text.rlike(shape), iso.try_cast("timestamp_ntz"))


def check_zone(zone: str) -> str:
    """Reject an unknown zone on the driver, before any work starts."""
    try:
        ZoneInfo(zone)
    except (KeyError, ValueError, OSError) as error:
        raise ValueError(f"unknown time zone {zone!r}") from error
    return zone


def localize(naive: Column, zone: str | None) -> Column:
    """UTC time of a naive local time; a repeated hour counts as standard time."""
    if zone is None:
        return naive
    tz, utc = F.lit(check_zone(zone)), F.lit("UTC")
    first = F.convert_timezone(tz, utc, naive)
    later = first + F.expr("interval 1 hour")
    same_wall_clock = F.convert_timezone(utc, tz, later) == naive
    return F.when(same_wall_clock, later).otherwise(first)


def wall_clock(instant: Column, zone: str) -> Column:
    """Naive local time of an instant, to the second, whatever the session zone."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    seconds = F.unix_seconds(instant)
    utc = epoch + F.make_dt_interval(
        F.floor(seconds / 86400).cast("int"),
        F.lit(0),
        F.lit(0),
        F.pmod(seconds, F.lit(86400)).cast("decimal(18,6)"),
    )
    return F.convert_timezone(F.lit("UTC"), F.lit(check_zone(zone)), utc)


def isoyear(when: Column) -> Column:
    return F.extract(F.lit("YEAROFWEEK"), when).cast("int")


def isoweek(when: Column) -> Column:
    return F.weekofyear(when)


def isoday(when: Column) -> Column:
    return F.weekday(when) + 1


def strftime(when: Column, fmt: str) -> Column:
    """Print a time by a strftime format, translated once on the driver."""
    pieces: list[Column] = []
    pattern = literal = ""

    def close_literal() -> None:
        nonlocal pattern, literal
        if literal:
            pattern += "'" + literal.replace("'", "''") + "'"
            literal = ""

    def flush() -> None:
        nonlocal pattern
        close_literal()
        if pattern:
            pieces.append(F.date_format(when, pattern))
            pattern = ""

    for directive, char in _directives(fmt):
        if char is not None:
            literal += char
        elif directive in _PATTERNS:
            close_literal()
            letters = _PATTERNS[directive]
            if pattern.endswith(letters[0]):  # equal letters would run together
                flush()
            pattern += letters
        else:
            flush()
            pieces.append(_computed(when, directive))
    flush()
    if not pieces:
        return F.when(when.isNotNull(), F.lit(""))
    return F.concat(*pieces)


def _directives(fmt: str):
    """Yield (directive, None) or (None, character) for each step of ``fmt``."""
    steps = iter(fmt)
    for char in steps:
        if char != "%":
            yield None, char
            continue
        directive = next(steps, None)
        if directive is None:
            raise ValueError(f"format {fmt!r} ends in a lone %")
        if directive == "%":
            yield None, "%"
        elif directive in _SHORTHANDS:
            yield from _directives(_SHORTHANDS[directive])
        else:
            yield directive, None


def _computed(when: Column, directive: str) -> Column:
    """Directives without a Java pattern letter."""
    yearday = F.dayofyear(when)
    padded = {
        "G": (isoyear(when), 4, "0"),
        "V": (isoweek(when), 2, "0"),
        "C": (F.floor(F.year(when) / 100), 2, "0"),
        "g": (F.pmod(isoyear(when), F.lit(100)), 2, "0"),
        "e": (F.dayofmonth(when), 2, " "),
        "k": (F.hour(when), 2, " "),
        "U": (F.floor((yearday + 6 - (F.dayofweek(when) - 1)) / 7), 2, "0"),
        "W": (F.floor((yearday + 6 - F.weekday(when)) / 7), 2, "0"),
        "u": (isoday(when), 1, "0"),
        "w": (F.dayofweek(when) - 1, 1, "0"),
    }
    if directive in ("z", "Z"):  # naive times have no zone
        return F.when(when.isNotNull(), F.lit(""))
    if directive not in padded:
        raise ValueError(f"date format directive %{directive} is not supported")
    number, width, fill = padded[directive]
    return F.lpad(number.cast("string"), width, fill)


def date_tokens(when: Column, fmt: str = "%Y%m%d_%H%M%S") -> dict[str, Column]:
    """The date fields a name template may use."""
    return {
        "timestamp": strftime(when, fmt),
        "year": F.year(when),
        "month": F.month(when),
        "isoyear": isoyear(when),
        "isoweek": isoweek(when),
        "isoday": isoday(when),
    }

"""Text stamps printed on camera images: name, type, time and exposure."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fotolake.functions.binding import bind
from fotolake.functions.zones import zone_minutes

# Fixed value: the stamp's time, e.g. ``Mon Jan 05 2024 01:02:03 MST``.
_STAMP_TIME = (
    r"(Mon|Tue|Wed|Thu|Fri|Sat|Sun)\s+"
    r"(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+"
    r"([0-3]\d)\s+([12][09]\d{2})\s+([0-2]\d):?([0-5]\d):?([0-5]\d)\s+([A-Z]+)"
)
# Fixed value: what stands between the parts of a stamp.
_BETWEEN_PARTS = r"(?U)(?:\s*-\s*|\n)"
_MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec"
# Fixed value: the word before the exposure, and its digits.
_EXPOSURE = r"[Ee][Xx][A-Za-z]+[:;]\s*(\d+)"


def stamp_parts(text: Column) -> Column:
    """Split at dashes with their blanks, and at line ends."""
    return F.split(text, _BETWEEN_PARTS)


def strip_brackets(text: Column) -> Column:
    """Text without brackets at its ends; one character always stays."""
    return F.regexp_replace(F.regexp_replace(text, r"^\[+(?=.)", ""), r"(?<=.)\]+$", "")


def _stamp_time(text: Column) -> Column:
    """The first stamp time as ``year month day time zone``; NULL without one."""
    found = F.regexp_substr(text, F.lit(_STAMP_TIME))
    return F.regexp_replace(found, _STAMP_TIME, "$4 $2 $3 $5:$6:$7 $8")


def parse_stamp_datetime(text: Column) -> Column:
    """Struct of ``dt_utc`` and ``dt_iso`` (stamp time with its offset); NULLs if unreadable."""
    return bind(F.split(_stamp_time(text), " "), _times)


def _times(parts: Column) -> Column:
    def part(index: int) -> Column:
        return F.get(parts, F.lit(index))

    month = F.floor((F.instr(F.lit(_MONTHS), part(1)) + 3) / 4).cast("string")
    day = F.concat_ws("-", part(0), F.lpad(month, 2, "0"), part(2))
    local = F.concat(day, F.lit(" "), part(3))

    def timed(read: Column) -> Column:
        minutes = zone_minutes(read["zone"], read["naive"])
        return bind(F.struct(read["naive"].alias("naive"), minutes.alias("minutes")), both)

    def both(values: Column) -> Column:
        naive, minutes = values["naive"], values["minutes"]
        size = F.abs(minutes)
        offset = F.concat(
            F.when(minutes < 0, "-").otherwise("+"),
            F.lpad(F.floor(size / 60).cast("string"), 2, "0"),
            F.lit(":"),
            F.lpad((size % 60).cast("string"), 2, "0"),
        )
        return F.struct(
            (naive - F.make_dt_interval(F.lit(0), F.lit(0), minutes)).alias("dt_utc"),
            F.concat(F.date_format(naive, "yyyy-MM-dd HH:mm:ss"), offset).alias("dt_iso"),
        )

    naive = local.try_cast("timestamp_ntz").alias("naive")
    return bind(F.struct(naive, part(4).alias("zone")), timed)


def parse_exposure(text: Column) -> Column:
    """First whole number after a word such as ``Exposure:``."""
    digits = F.regexp_extract(text, _EXPOSURE, 1)
    return F.when(digits != "", digits.try_cast("int"))


def parse_stamp(text: Column) -> Column:
    """All stamp fields; NULLs unless the text splits into four parts or more."""
    read = F.struct(
        stamp_parts(text).alias("parts"),
        parse_stamp_datetime(text).alias("time"),
        parse_exposure(text).alias("exposure"),
    )
    return bind(read, _stamp_fields)


def _stamp_fields(read: Column) -> Column:
    parts, time = read["parts"], read["time"]
    whole = F.size(parts) >= 4
    return F.struct(
        F.when(whole, strip_brackets(F.get(parts, F.lit(0)))).alias("camera_name"),
        F.when(whole, F.get(parts, F.lit(1))).alias("camera_type"),
        F.when(whole, time["dt_iso"]).alias("dt_iso"),
        F.when(whole, time["dt_utc"]).alias("dt_utc"),
        F.when(whole, read["exposure"]).alias("exposure"),
    )

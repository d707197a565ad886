"""GPS expressions: rational arrays, degrees-minutes-seconds, WKT points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fotolake.functions.binding import bind

# References that make a coordinate negative. ``1`` is the
# altitude reference "below sea level".
NEGATIVE_REFS = ("W", "S", "1")


def parse_rational_array(text: Column) -> Column:
    """``[37, 25, 438923/10000]`` to doubles.

    A zero divisor leaves the numerator, more than one slash or unreadable
    text gives a NULL element.
    """
    items = F.split(F.regexp_replace(text, r"[\[\]]", ""), ",")

    def quotient(numbers: Column) -> Column:
        top, bottom = F.get(numbers, F.lit(0)), F.get(numbers, F.lit(1))
        return (
            F.when(F.size(numbers) == 1, top)
            .when((F.size(numbers) == 2) & (bottom == 0), top)
            .when(F.size(numbers) == 2, F.try_divide(top, bottom))
        )

    def number(item: Column) -> Column:
        parts = F.transform(F.split(item, "/"), lambda part: F.trim(part).try_cast("double"))
        return bind(parts, quotient)

    return F.transform(items, number)


def dms_to_decimal(parts: Column, ref: Column) -> Column:
    """Degrees of a degree-minute-second array; any NULL part gives NULL."""
    folded = F.aggregate(
        F.reverse(parts),
        F.struct(F.lit(0.0).alias("value"), F.lit(0.0).alias("carry")),
        lambda acc, part: F.struct(
            (part + acc["carry"]).alias("value"), ((part + acc["carry"]) / 60).alias("carry")
        ),
        lambda acc: acc["value"],
    )
    negative = F.coalesce(ref.isin(*NEGATIVE_REFS), F.lit(False))
    return F.when(negative, -folded).otherwise(folded)


def coordinate(value: Column, ref: Column) -> Column:
    return dms_to_decimal(parse_rational_array(value), ref)


def point_wkt(x: Column, y: Column, z: Column) -> Column:
    """WKT of a point, without its third ordinate when that is NULL."""
    def text(value: Column) -> Column:
        return value.cast("string")

    flat = F.concat(F.lit("POINT ("), text(x), F.lit(" "), text(y), F.lit(")"))
    solid = F.concat(
        F.lit("POINT Z ("), text(x), F.lit(" "), text(y), F.lit(" "), text(z), F.lit(")")
    )
    return F.when(z.isNull(), flat).otherwise(solid)

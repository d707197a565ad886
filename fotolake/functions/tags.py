"""Metadata tags: typed values, the JSON text per file, and reading it back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Field-type codes whose text is stored as a number if it is one.
INTEGER_FIELDS = ("B", "S", "L", "SB", "SS", "SL", "SR", "R")
FLOAT_FIELDS = ("F32", "F64")
MAKER_NOTE = "EXIF MakerNote"


def json_string(text: Column) -> Column:
    """``text`` as a quoted JSON string."""
    boxed = F.to_json(F.array(text))
    escaped = F.substring(boxed, F.lit(2), F.length(boxed) - 2)
    # Most text needs no escapes, and is cheaper to quote directly.
    plain = text.rlike(r'^[^"\\\x00-\x1f]*+$')
    return F.when(plain, F.concat(F.lit('"'), text, F.lit('"'))).otherwise(escaped)


def coerce_tag(value: Column, field_type: Column, key: Column) -> Column:
    """JSON token of a tag value: a number where type and text allow it, else text.

    A maker note keeps its raw values. NULL stays NULL.
    """
    is_integer = field_type.isin(*INTEGER_FIELDS) & value.rlike(r"^\s*[+-]?\d+\s*$")
    # The digits as they are: an integer may have more than any numeric type holds.
    digits = F.regexp_replace(F.regexp_replace(value, r"\s", ""), r"^\+|(?<=^[+-]?)0+(?=\d)", "")
    integer = F.when(digits == "-0", "0").otherwise(digits)
    real = F.when(field_type.isin(*FLOAT_FIELDS), F.trim(value).try_cast("double"))
    finite = F.when(F.abs(real) < F.lit(float("inf")), real.cast("string"))
    number = F.when(is_integer, integer).otherwise(finite)
    return F.coalesce(F.when(key != MAKER_NOTE, number), json_string(value))


def encode_bytes(value: Column) -> Column:
    """Raw bytes, such as a thumbnail, as base64 text on one line."""
    return F.regexp_replace(F.base64(value), r"\s", "")


def tags_to_json(tags: Column) -> Column:
    """JSON object of an array of (key, field_type, value), ordered by key.

    NULL when there are no tags. The last value wins when a key repeats.
    """
    tokens = F.map_from_entries(
        F.transform(
            F.sort_array(_last_per_key(tags)),
            lambda tag: F.struct(
                tag["key"], coerce_tag(tag["value"], tag["field_type"], tag["key"])
            ),
        )
    )
    members = F.transform(
        F.map_entries(tokens),
        lambda entry: F.concat(json_string(entry["key"]), F.lit(":"), entry["value"]),
    )
    text = F.concat(F.lit("{"), F.array_join(members, ","), F.lit("}"))
    return F.when(F.size(tags) > 0, text)


def _last_per_key(tags: Column) -> Column:
    keys = F.transform(tags, lambda tag: tag["key"])
    last = F.filter(
        tags,
        lambda tag, index: ~F.array_contains(F.slice(keys, index + 2, F.size(keys)), tag["key"]),
    )
    repeats = F.size(F.array_distinct(keys)) < F.size(keys)
    return F.when(repeats, last).otherwise(tags)


def json_tag(meta: Column, key: str) -> Column:
    """Text of one tag of the JSON object; NULL when absent."""
    return F.get_json_object(meta, f"$['{key}']")


def tag_map(meta: Column) -> Column:
    return F.from_json(meta, "map<string,string>")


def tag_variant(meta: Column) -> Column:
    """The JSON object of a file's tags as a VARIANT, parsed once; NULL if it is no JSON."""
    return F.try_parse_json(meta)


def typed_tag(variant: Column, key: str, kind: str) -> Column:
    """One tag of a variant as ``kind`` (``bigint``, ``double``, ``string``, ...).

    NULL where the tag is absent or its value is not of that kind.
    """
    return F.try_variant_get(variant, f"$['{key}']", kind)


def exif_tag(tags: Column, key: str) -> Column:
    """Value of one key in an array of (key, field_type, value)."""
    hits = F.filter(tags, lambda tag: tag["key"] == key)
    return F.get(hits, F.size(hits) - 1)["value"]

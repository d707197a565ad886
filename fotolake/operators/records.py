"""Long and wide forms of metadata."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fotolake.functions import paths, stamps, tags


def tags_long(tag: DataFrame) -> DataFrame:
    """One row per hash and tag."""
    return tag.select("md5hash", F.explode(tags.tag_map(F.col("meta"))).alias("key", "value"))


def typed_tags(tag: DataFrame, wanted: dict[str, tuple[str, str]]) -> DataFrame:
    """One row per hash with typed columns: name -> (key of the tag, kind).

    The object is parsed once for all columns.
    """
    parsed = tag.select("md5hash", tags.tag_variant(F.col("meta")).alias("_tags"))
    columns = (
        tags.typed_tag(F.col("_tags"), key, kind).alias(name) for name, (key, kind) in wanted.items()
    )
    return parsed.select("md5hash", *columns)


def tag_names(names: str) -> list[str]:
    """Names of a comma-separated list."""
    return [name.strip() for name in names.split(",") if name.strip()]


def select_tags(tags_of_files: DataFrame, names: str, by: str = "path") -> DataFrame:
    """Keep the named tags, one column each, one row per file that has any."""
    wanted = tag_names(names)
    kept = tags_of_files.where(F.col("key").isin(*wanted))
    return kept.groupBy(by).pivot("key", wanted).agg(F.max("value"))


def union_records(*frames: DataFrame) -> DataFrame:
    """Stack frames with unequal columns; a missing column is NULL."""
    return reduce(lambda one, two: one.unionByName(two, allowMissingColumns=True), frames)


def stamp_records(texts: DataFrame, base: str | None = None, ocr: str = "ocr") -> DataFrame:
    """Stamp fields of (path, text) rows; paths become relative to ``base``."""
    path = F.col("path") if base is None else paths.relative_path(F.col("path"), F.lit(base))
    stamp = stamps.parse_stamp(F.col(ocr))
    return texts.select(path.alias("path"), stamp.alias("stamp"), F.col(ocr).alias("ocr")).select(
        "path", "stamp.*", "ocr"
    )

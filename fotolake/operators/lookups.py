"""Joins of the photo table with its batches, tags and a new scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fotolake.functions import gps, paths
from fotolake.operators.changes import distinct_keys


def existing_paths(photo: DataFrame, imports: DataFrame) -> DataFrame:
    """Full path of every photo whose batch is known."""
    batches = imports.select(F.col("import_date").alias("dt_import"), "base_path", "local")
    path = paths.full_path(F.col("local"), F.col("base_path"), F.col("path"))
    return photo.select("path", "dt_import").join(batches, "dt_import").select(path.alias("path"))


def new_files_only(
    files: DataFrame, photo: DataFrame, imports: DataFrame, skip_check: bool = False
) -> DataFrame:
    """Scanned files the catalog does not have."""
    if skip_check:
        return files
    return files.join(existing_paths(photo, imports), "path", "left_anti").select(*files.columns)


def attach_batch(photo: DataFrame, imports: DataFrame) -> DataFrame:
    """Photos with base and locality of their batch, NULL when it is unknown."""
    batches = imports.select(F.col("import_date").alias("dt_import"), "base_path", "local")
    return photo.join(batches, "dt_import", "left")


def known_hashes(photo: DataFrame, scan: DataFrame) -> DataFrame:
    """Photos whose hash the scan has met."""
    return photo.join(distinct_keys(scan, "md5hash"), "md5hash", "left_semi").select(*photo.columns)


def ordered_catalog(photo: DataFrame, imports: DataFrame, by: str = "import_date") -> DataFrame:
    """Photos in order of batch date (or base) and path, for showing."""
    if by not in ("import_date", "base_path"):
        raise ValueError(f"by must be import_date or base_path, not {by!r}")
    first = "dt_import" if by == "import_date" else by
    return attach_batch(photo, imports).orderBy(first, "path")


def attach_tags(photo: DataFrame, tag: DataFrame) -> DataFrame:
    """Photos with their GPS tags."""
    return photo.select("ftype", "md5hash", "dt_orig").join(gps_tags(tag), "md5hash", "left")


def gps_tags(tag: DataFrame) -> DataFrame:
    """The six GPS tags of each metadata object, which is parsed once."""
    names = ("Longitude", "LongitudeRef", "Latitude", "LatitudeRef", "Altitude", "AltitudeRef")
    fields = ", ".join(f"`GPS GPS{name}` string" for name in names)
    return tag.select("md5hash", F.from_json("meta", fields).alias("gps")).select(
        "md5hash", *[F.col("gps")[f"GPS GPS{name}"].alias(f"GPS{name}") for name in names]
    )


def gps_location(tag: DataFrame, photo: DataFrame, keep_zero: bool = False) -> DataFrame:
    """Location of each hash that has photos and a usable position.

    A missing altitude is 0. Positions with a coordinate of exactly 0 count as
    unset unless ``keep_zero``. The tag table has one row per hash, so photos
    serve only as a filter.
    """
    x = gps.coordinate(F.col("GPSLongitude"), F.col("GPSLongitudeRef"))
    y = gps.coordinate(F.col("GPSLatitude"), F.col("GPSLatitudeRef"))
    z = F.when(F.col("GPSAltitude").isNull(), F.lit(0.0)).otherwise(
        gps.coordinate(F.col("GPSAltitude"), F.col("GPSAltitudeRef"))
    )
    point = F.struct(y.alias("lat"), x.alias("long"), z.alias("elev_m"))

    def usable(point: Column) -> Column:
        known = point["lat"].isNotNull() & point["long"].isNotNull()
        return known if keep_zero else known & (point["lat"] != 0) & (point["long"] != 0)

    # As a filtered array a point is computed once; a filter on its columns would
    # be pushed down and compute them again. Only points go into the join.
    points = gps_tags(tag).select("md5hash", F.inline(F.filter(F.array(point), usable)))
    points = points.join(distinct_keys(photo, "md5hash"), "md5hash", "left_semi")
    wkt = gps.point_wkt(F.col("long"), F.col("lat"), F.col("elev_m"))
    return points.withColumn("wkt", wkt)

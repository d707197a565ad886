"""Catalog changes: insert if absent, delete with its consequences, counts.

Every function takes tables and returns new ones; nothing is changed in place.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fotolake.functions import paths, tags, times
from fotolake.operators.ranking import number_rows
from fotolake.schemas import LOCATION, PHOTO, TAG, Catalog
from fotolake.session import cut_lineage

BATCH_KINDS = ("import", "update", "rename")


def in_utc(moment: datetime) -> datetime:
    """A moment as naive UTC time; a naive one is taken to be that already."""
    if moment.tzinfo is None:
        return moment
    return moment.astimezone(timezone.utc).replace(tzinfo=None)


def batch_key(moment: datetime) -> str:
    """UTC second of a batch, e.g. ``2024-01-02T03:04:05Z``."""
    return in_utc(moment).strftime("%Y-%m-%dT%H:%M:%SZ")


def distinct_keys(df: DataFrame, key: str) -> DataFrame:
    """Non-NULL values of a key, each once.

    Taken before a semi or anti join, so that a value held by very many rows
    reaches the join as one row.
    """
    return df.where(F.col(key).isNotNull()).select(key).distinct()


def absent_rows(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` whose key the table does not have.

    The table is first cut down to the keys of ``new``. When ``new`` is small
    Spark sends it to the table's tasks, so that a large table is not shuffled
    to take in a few rows. ``new`` is named twice: give it as a table or
    checkpoint if it is dear to compute.
    """
    met = table.select(key).join(new.select(key), key, "left_semi")
    return new.join(met, key, "left_anti")


def _insert_absent(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``new`` is unique in ``key``."""
    return table.unionByName(absent_rows(table, new, key).select(*table.columns))


def second_of(key: Column) -> Column:
    """A batch key as seconds, NULL if it is none."""
    return F.unix_seconds(F.try_to_timestamp(key, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")))


def key_of(second: Column) -> Column:
    return F.date_format(F.timestamp_seconds(second), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def free_key(imports: DataFrame, moment: datetime) -> str:
    """The key of the first second from ``moment`` on that no batch has."""
    start = int(in_utc(moment).replace(tzinfo=timezone.utc).timestamp())
    taken = (
        imports.where(F.col("import_date") >= batch_key(moment))
        .select(second_of(F.col("import_date")).alias("second"))
        .dropna()
        .distinct()
    )
    starts = imports.sparkSession.range(start, start + 1).select(F.col("id").alias("second"))
    after = taken.select((F.col("second") + 1).alias("second")).unionByName(starts)
    free = after.join(taken, "second", "left_anti").agg(F.min("second")).first()[0]
    return batch_key(datetime.fromtimestamp(free, timezone.utc))


def batch_row(imports: DataFrame, base: str, local: bool, kind: str, key: str) -> DataFrame:
    """One row of the batch table."""
    if kind not in BATCH_KINDS:
        raise ValueError(f"kind must be one of {BATCH_KINDS}, not {kind!r}")
    return imports.sparkSession.range(1).select(
        F.lit(key).alias("import_date"),
        paths.normalize_base(F.lit(base)).alias("base_path"),
        F.lit(local).alias("local"),
        F.lit(kind).alias("type"),
    )


def register_batch(
    imports: DataFrame, base: str, local: bool, kind: str, moment: datetime
) -> tuple[DataFrame, str]:
    """Batches with a new one at the first free second from ``moment`` on, and its key."""
    if kind not in BATCH_KINDS:
        raise ValueError(f"kind must be one of {BATCH_KINDS}, not {kind!r}")
    key = free_key(imports, moment)
    row = batch_row(imports, base, local, kind, key)
    return imports.unionByName(row.select(*imports.columns)), key


def register_bases(
    imports: DataFrame, bases: DataFrame, local: bool, kind: str, moment: datetime
) -> DataFrame:
    """New batches, one per base, at the first free seconds from ``moment`` on.

    ``bases`` has a ``base_path`` column. Bases in their order and free seconds in theirs
    are numbered and joined by their numbers.
    """
    if kind not in BATCH_KINDS:
        raise ValueError(f"kind must be one of {BATCH_KINDS}, not {kind!r}")
    start = int(in_utc(moment).replace(tzinfo=timezone.utc).timestamp())
    names = cut_lineage(
        bases.where(F.col("base_path").isNotNull()).select("base_path").distinct()
    )
    taken = cut_lineage(
        imports.where(F.col("import_date") >= batch_key(moment))
        .select(second_of(F.col("import_date")).alias("second"))
        .dropna()
        .distinct()
    )
    last = start + names.count() + taken.count()
    seconds = imports.sparkSession.range(start, last).select(F.col("id").alias("second"))
    free = seconds.join(taken, "second", "left_anti")
    one = F.lit(0).alias("_all")
    numbered = number_rows(names.select("base_path", one), ["_all"], ["base_path"], "_at")
    keys = number_rows(free.select("second", one), ["_all"], ["second"], "_at")
    return numbered.join(keys, "_at").select(
        key_of(F.col("second")).alias("import_date"),
        "base_path",
        F.lit(local).alias("local"),
        F.lit(kind).alias("type"),
    )


def photo_rows(
    records: DataFrame, import_date: str, base: str | None = None, zone: str | None = None
) -> DataFrame:
    """Photo table rows, with ``meta``, ``width`` and ``height``, of scan records.

    With ``base`` paths are stored relative to it. ``zone`` is the camera's.
    """
    path = F.col("path")
    if base is not None:
        path = paths.relative_path(path, F.lit(base))
    taken = times.parse_exif_datetime(tags.exif_tag(F.col("tags"), "EXIF DateTimeOriginal"))
    return records.where(F.col("ftype").isNotNull()).select(
        paths.normalize_separators(path).alias("path"),
        "fname",
        "ftype",
        "md5hash",
        times.localize(taken, zone).alias("dt_orig"),
        "dt_mod",
        F.lit(import_date).alias("dt_import"),
        tags.tags_to_json(F.col("tags")).alias("meta"),
        "width",
        "height",
    )


def upsert_hashes(hashes: DataFrame, new: DataFrame) -> DataFrame:
    """Add the hashes of ``new`` that are not known."""
    return _insert_absent(hashes, distinct_keys(new, "md5hash"), "md5hash")


def one_row_per_path(new: DataFrame) -> DataFrame:
    """The smallest row of each path, should a path come twice."""
    others = [column for column in new.columns if column != "path"]
    return (
        new.where(F.col("path").isNotNull())
        .groupBy("path")
        .agg(F.min(F.struct(*others)).alias("row"))
        .select("path", "row.*")
    )


def upsert_photos(photo: DataFrame, new: DataFrame) -> DataFrame:
    """Add rows whose path is not known; a known path keeps its row."""
    return _insert_absent(photo, one_row_per_path(new.select(*PHOTO.fieldNames())), "path")


def first_by_path(new: DataFrame, columns: list[str]) -> DataFrame:
    """One row per hash: that of the smallest path."""
    return (
        new.where(F.col("md5hash").isNotNull())
        .groupBy("md5hash")
        .agg(F.min_by(F.struct(*columns), "path").alias("row"))
        .select("md5hash", "row.*")
    )


def upsert_tags(tag: DataFrame, new: DataFrame) -> DataFrame:
    """Add one tag row per unknown hash: that of the smallest path."""
    return _insert_absent(tag, first_by_path(new, TAG.fieldNames()[1:]), "md5hash")


def upsert_locations(location: DataFrame, new: DataFrame) -> DataFrame:
    """Add one location per unknown hash; ``new`` is unique in md5hash."""
    return _insert_absent(location, new.select(*LOCATION.fieldNames()), "md5hash")


def drop_empty_batches(
    imports: DataFrame, photo: DataFrame, candidates: Column | None = None
) -> DataFrame:
    """Drop batches no photo refers to; ``candidates`` limits which may go."""
    used = distinct_keys(photo, "dt_import").withColumnRenamed("dt_import", "import_date")
    if candidates is None:
        return imports.join(used, "import_date", "left_semi")
    empty = imports.where(candidates).join(used, "import_date", "left_anti")
    return imports.join(empty.select("import_date"), "import_date", "left_anti")


def wipe(catalog: Catalog) -> Catalog:
    """All five tables without rows."""
    return Catalog.of({name: table.limit(0) for name, table in catalog.tables().items()})


def delete_photos(catalog: Catalog, gone: DataFrame) -> Catalog:
    """Delete the photos at the paths of ``gone``, then hashes left without one."""
    photo = catalog.photo.join(gone.select("path"), "path", "left_anti")
    return prune_orphan_hashes(catalog.replace(photo=photo))


def cascade_delete_batches(catalog: Catalog, batches: DataFrame) -> Catalog:
    """Delete batches (column import_date) with their photos and orphaned hashes."""
    batches = batches.select("import_date").distinct()
    photo = catalog.photo.join(
        batches.withColumnRenamed("import_date", "dt_import"), "dt_import", "left_anti"
    ).select(*PHOTO.fieldNames())
    imports = catalog.imports.join(batches, "import_date", "left_anti")
    return prune_orphan_hashes(catalog.replace(imports=imports, photo=photo))


def cascade_delete_hashes(catalog: Catalog, hashes: DataFrame) -> Catalog:
    """Delete hashes (column md5hash) with their photos, tags and locations."""
    gone = distinct_keys(hashes, "md5hash")
    return catalog.replace(
        hash=catalog.hash.join(gone, "md5hash", "left_anti"),
        photo=catalog.photo.join(gone, "md5hash", "left_anti").select(*PHOTO.fieldNames()),
        tag=catalog.tag.join(gone, "md5hash", "left_anti"),
        location=catalog.location.join(gone, "md5hash", "left_anti"),
    )


def orphans(catalog: Catalog) -> DataFrame:
    """Hashes no photo has."""
    return catalog.hash.join(distinct_keys(catalog.photo, "md5hash"), "md5hash", "left_anti")


def prune_orphan_hashes(catalog: Catalog) -> Catalog:
    """Drop hashes no photo has, with their tags and locations.

    No photo has such a hash, so the photo table stays as it is.
    """
    gone = orphans(catalog)
    return catalog.replace(
        hash=catalog.hash.join(distinct_keys(catalog.photo, "md5hash"), "md5hash", "left_semi"),
        tag=catalog.tag.join(gone, "md5hash", "left_anti"),
        location=catalog.location.join(gone, "md5hash", "left_anti"),
    )


def batch_counts(photo: DataFrame) -> DataFrame:
    """Photo rows of each batch."""
    return photo.groupBy("dt_import").agg(F.count("*").alias("photo_rows"))


def duplicate_paths(photo: DataFrame) -> DataFrame:
    """Paths more than one photo has; a catalog in order has none."""
    return photo.groupBy("path").agg(F.count("*").alias("n")).where(F.col("n") > 1)


def batch_is_empty(imports: DataFrame, photo: DataFrame) -> DataFrame:
    """Each batch with its photo rows and whether it has none."""
    counts = batch_counts(photo).withColumnRenamed("dt_import", "import_date")
    rows = F.coalesce("photo_rows", F.lit(0).cast("bigint"))
    return imports.join(counts, "import_date", "left").select(
        "import_date", rows.alias("photo_rows"), (rows == 0).alias("is_empty")
    )


def distinct_bases(plan: DataFrame, column: str = "new_base") -> DataFrame:
    return plan.select(column).distinct()


def hash_multiplicity(photo: DataFrame) -> DataFrame:
    """Catalog rows of each hash."""
    return (
        photo.where(F.col("md5hash").isNotNull())
        .groupBy("md5hash")
        .agg(F.count("path").alias("n"))
    )

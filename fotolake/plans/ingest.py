"""Adding scan records to a catalog."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from datetime import datetime

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fotolake.operators import changes, lookups
from fotolake.schemas import PHOTO, TAG, Catalog
from fotolake.session import cut_lineage
from fotolake.sources import files


def new_rows(
    catalog: Catalog,
    records: DataFrame,
    base: str,
    moment: datetime,
    local: bool = False,
    zone: str | None = None,
    geo: bool = True,
    key: str | None = None,
) -> dict[str, DataFrame]:
    """Rows of each table that a scan adds; nothing for an empty batch.

    The photos join a batch at the first free second from ``moment`` on, or the batch
    ``key`` of a scan that adds its rows in several parts.

    The scanned rows, which do not hold the files' bytes, are written to the
    checkpoint folder, and so are the accepted ones among them: every file is
    read once, and compared with the known photos once, for all five tables.
    """
    key = key or changes.free_key(catalog.imports, moment)
    found = changes.photo_rows(records, key, base if local else None, zone)
    found = cut_lineage(changes.one_row_per_path(found))
    accepted = cut_lineage(changes.absent_rows(catalog.photo, found, "path"))
    photo = accepted.select(*PHOTO.fieldNames())

    @inheritable_thread_target
    def hash_rows() -> DataFrame:
        hashes = changes.distinct_keys(accepted, "md5hash")
        return changes.absent_rows(catalog.hash, hashes, "md5hash")

    @inheritable_thread_target
    def import_rows() -> DataFrame:
        batch = changes.batch_row(catalog.imports, base, local, "import", key)
        return changes.absent_rows(catalog.imports, batch, "import_date").join(
            photo.select(F.col("dt_import").alias("import_date")).limit(1), "import_date", "left_semi"
        )

    # Planning takes longer than the rows of a small batch, so it goes side by side.
    with ThreadPoolExecutor(2) as pool:
        hashes, imports = pool.submit(hash_rows), pool.submit(import_rows)
        tag = changes.first_by_path(accepted, TAG.fieldNames()[1:])
        tag = changes.absent_rows(catalog.tag, tag, "md5hash")
        location = lookups.gps_location(tag, photo) if geo else catalog.location.limit(0)
        location = changes.absent_rows(catalog.location, location, "md5hash")
    return {
        "import": imports.result(), "hash": hashes.result(), "photo": photo, "tag": tag,
        "location": location,
    }


def add_rows(catalog: Catalog, rows: dict[str, DataFrame]) -> Catalog:
    return Catalog.of(
        {name: table.unionByName(rows[name].select(*table.columns))
         for name, table in catalog.tables().items()}
    )


def scan_into(
    spark: SparkSession,
    catalog: Catalog,
    root: str,
    moment: datetime,
    local: bool = False,
    zone: str | None = None,
    skip_check: bool = False,
    thumb: bool = False,
    maker: bool = False,
    geo: bool = True,
    file_zone: str = "UTC",
) -> Catalog:
    """Scan a tree and add what is new. Bytes of known files are not read.

    ``zone`` is the camera's, ``file_zone`` that in which file times are kept.
    """
    listing = files.list_files(spark, root)
    wanted = lookups.new_files_only(listing, catalog.photo, catalog.imports, skip_check)
    records = files.scan_listed(cut_lineage(wanted), file_zone, thumb=thumb, maker=maker)
    base = files.plain_root(root)
    return add_rows(catalog, new_rows(catalog, records, base, moment, local, zone, geo))

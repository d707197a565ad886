"""Incremental scans: each file is read once, in bounded batches.

The stream is one of listings. Every run lists the tree, writes the files it has not listed
before as further rows of a listing table, and a stream over that table reads the files. So
names and ages of files do not matter, and Spark's checkpoint keeps what has been read.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from fotolake.operators.changes import free_key
from fotolake.plans.ingest import new_rows
from fotolake.schemas import FILE, Catalog
from fotolake.session import cut_lineage
from fotolake.sources import catalogs, files

_LISTING = ["path", "modificationTime", "length"]


def extend_listing(
    spark: SparkSession, root: str, folder: str, files_per_batch: int = 10_000
) -> None:
    """Add the files below ``root`` that the listing table in ``folder`` lacks.

    No file of the table has more than ``files_per_batch`` rows.
    """
    schema = FILE.fieldNames()[:3]
    spark.createDataFrame([], FILE).select(*schema).write.mode("ignore").parquet(folder)
    known = spark.read.schema(_listing_schema()).parquet(folder).select("path")
    new = cut_lineage(
        files.list_files(spark, root).join(known, "path", "left_anti").select(*_LISTING)
    )
    parts = max(1, -(-new.count() // files_per_batch))
    writer = new.repartition(parts).write.option("maxRecordsPerFile", files_per_batch)
    writer.mode("append").parquet(folder)


def _listing_schema():
    return FILE[:3]


def listing_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of a listing table as a stream, one of its files at a time."""
    reader = spark.readStream.schema(_listing_schema()).option("maxFilesPerTrigger", 1)
    # Files of the table are never too old to be read.
    return reader.option("maxFileAge", "36500d").parquet(folder)


def batch_upsert(
    spark: SparkSession,
    folder: str,
    base: str,
    key: str,
    started: datetime,
    local: bool = False,
    zone: str | None = None,
    geo: bool = True,
    file_zone: str = "UTC",
    writer: str = "",
):
    """A ``foreachBatch`` function that adds the new rows of listed files to a catalog.

    Batch ``n`` becomes batch ``n + 1`` of the catalog and is compared with earlier batches
    only. A batch run again after its commit changes nothing; one that ended before it is
    written anew. ``writer`` names the stream: two streams on one catalog conflict. All
    batches of a scan share the batch ``key``.
    """
    known: dict[str, dict] = {}

    def upsert(batch: DataFrame, batch_id: int) -> None:
        place = batch_id + 1
        if catalogs.is_committed(spark, folder, place, writer):
            return
        catalog = catalogs.read_catalog(spark, folder, before=place, known=known)
        records = files.scan_listed(batch, file_zone)
        rows = new_rows(catalog, records, base, started, local, zone, geo, key)
        catalogs.append_batch(rows, folder, place, writer)

    return upsert


def ingest_stream(
    spark: SparkSession,
    root: str,
    folder: str,
    checkpoint: str,
    started: datetime,
    files_per_batch: int = 10_000,
    local: bool = False,
    zone: str | None = None,
    geo: bool = True,
    file_zone: str = "UTC",
) -> StreamingQuery:
    """Add all files not yet seen to the catalog in ``folder``, then stop.

    ``folder`` must hold a catalog (:func:`catalogs.write_catalog`, maybe of
    empty tables). ``checkpoint`` keeps what has been seen between runs: the listing and
    the state of the stream. The whole run is one batch, at a free second.
    """
    listing = f"{checkpoint}/listing"
    extend_listing(spark, root, listing, files_per_batch)
    key = free_key(catalogs.read_catalog(spark, folder).imports, started)
    base = files.plain_root(root)
    upsert = batch_upsert(
        spark, folder, base, key, started, local, zone, geo, file_zone, writer=checkpoint
    )
    return (
        listing_stream(spark, listing)
        .writeStream.foreachBatch(upsert)
        .option("checkpointLocation", f"{checkpoint}/stream")
        .trigger(availableNow=True)
        .start()
    )


def empty_catalog(spark: SparkSession, folder: str) -> Catalog:
    """Write an empty catalog to start from, and open it."""
    catalogs.write_catalog(Catalog.empty(spark), folder)
    return catalogs.read_catalog(spark, folder)

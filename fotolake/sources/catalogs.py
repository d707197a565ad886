"""Reading and writing catalogs.

A catalog folder holds one Parquet folder per table, split by ``batch_id``, and a manifest
per batch that names the files of all five tables. The manifest is written last, by a call
that fails if it is there already, and readers see only what manifests name. So a batch is
there with all its tables or not at all, what a broken job has left behind is never read,
and of two writers of one batch the second fails. A changed catalog is written to a new
folder, which also merges its batches.
"""

from __future__ import annotations

import json
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fotolake.functions.hashes import plain_hash
from fotolake.schemas import TABLES, Catalog

BATCH = "batch_id"
MANIFESTS = "_commits"


class CommitConflict(RuntimeError):
    """The batch exists already and is another writer's."""


def write_catalog(catalog: Catalog, folder: str) -> None:
    """Write a whole catalog to a new folder; an existing one is an error."""
    spark = catalog.photo.sparkSession
    if manifests(spark, folder):
        raise CommitConflict(f"a catalog exists in {folder}")
    _commit(spark, folder, 0, "", _write_tables(catalog.tables(), folder, 0))


def append_batch(
    new_rows: dict[str, DataFrame], folder: str, batch_id: int, writer: str = ""
) -> bool:
    """Add rows as batch ``batch_id``. False, with nothing done, if ``writer`` has added it.

    A batch of the same number by another writer is a ``CommitConflict``.
    """
    spark = new_rows["photo"].sparkSession
    if is_committed(spark, folder, batch_id, writer):
        return False
    files = _write_tables(new_rows, folder, batch_id)
    _commit(spark, folder, batch_id, writer, files)
    return True


def is_committed(spark: SparkSession, folder: str, batch_id: int, writer: str = "") -> bool:
    """Whether ``writer`` has added the batch."""
    manifest = _manifest(spark, folder, _manifest_name(batch_id))
    if manifest is None:
        return False
    if manifest["writer"] != writer:
        raise CommitConflict(f"batch {batch_id} in {folder} is another writer's")
    return True


def _write_tables(tables: dict[str, DataFrame], folder: str, batch_id: int) -> dict[str, list[str]]:
    """Write all tables to folders of this attempt; names of their files, below ``folder``.

    The tables are written side by side: of a small batch most time is planning.
    """
    attempt = uuid.uuid4().hex
    places = {name: f"{name}/{BATCH}={batch_id}/{attempt}" for name in tables}

    @inheritable_thread_target
    def write(name: str) -> None:
        rows = tables[name].select(*TABLES[name].fieldNames())
        rows.write.parquet(f"{folder}/{places[name]}")

    with ThreadPoolExecutor(len(tables)) as pool:
        list(pool.map(write, tables))
    return {
        name: [
            f"{places[name]}/{file}"
            for file in _names(table.sparkSession, f"{folder}/{places[name]}")
            if not file.startswith(("_", "."))
        ]
        for name, table in tables.items()
    }


def _path(spark: SparkSession, name: str):
    """A path of Spark's file systems, and the system it is on."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, folder: str) -> list[str]:
    path, system = _path(spark, folder)
    if not system.exists(path):
        return []
    return sorted(state.getPath().getName() for state in system.listStatus(path))


def _commit(spark: SparkSession, folder: str, batch_id: int, writer: str, files: dict) -> None:
    text = json.dumps({"batch": batch_id, "writer": writer, "files": files}) + "\n"
    path, system = _path(spark, f"{folder}/{MANIFESTS}/{_manifest_name(batch_id)}")
    try:
        out = system.create(path, False)
    except Exception as error:
        if system.exists(path):
            raise CommitConflict(f"batch {batch_id} in {folder} was added meanwhile") from error
        raise
    out.write(text.encode())
    out.close()


def manifests(
    spark: SparkSession,
    folder: str,
    before: int | None = None,
    known: dict[str, dict] | None = None,
) -> list[dict]:
    """The manifests of all batches (below ``before``), in order.

    One that is still being written is not there yet. ``known`` keeps those read between
    calls: a manifest never changes once it is there.
    """
    known = {} if known is None else known
    found = []
    for name in _names(spark, f"{folder}/{MANIFESTS}"):
        if not name.endswith(".json") or (before is not None and int(name[:-5]) >= before):
            continue
        manifest = known.get(name) or _manifest(spark, folder, name)
        if manifest is not None:
            known[name] = manifest
            found.append(manifest)
    return found


def _manifest_name(batch_id: int) -> str:
    return f"{batch_id:012d}.json"


def _manifest(spark: SparkSession, folder: str, name: str) -> dict | None:
    """One manifest; None if it is not there or still being written."""
    path, system = _path(spark, f"{folder}/{MANIFESTS}/{name}")
    if not system.exists(path):
        return None
    stream = system.open(path)
    text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    return json.loads(text) if text.endswith("\n") else None


def read_catalog(
    spark: SparkSession,
    folder: str,
    before: int | None = None,
    known: dict[str, dict] | None = None,
) -> Catalog:
    """Open a catalog, or its state before batch ``before``: the batches with manifests.

    ``known`` is that of :func:`manifests`.
    """
    batches = manifests(spark, folder, before, known)
    if not batches:
        raise FileNotFoundError(f"no catalog in {folder}")

    def table(name: str, schema: T.StructType) -> DataFrame:
        files = [f"{folder}/{file}" for batch in batches for file in batch["files"][name]]
        if not files:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(*files)

    return Catalog.of({name: table(name, schema) for name, schema in TABLES.items()})


def read_catalog_jdbc(spark: SparkSession, url: str, properties: dict[str, str]) -> Catalog:
    """Open the tables of a database. The JDBC driver is the caller's to supply.

    Tables keyed by hash are read in 256 parts by the first two hash digits.
    """
    parts = [f"md5hash LIKE '{n:02x}%'" for n in range(256)]
    keyed = [*parts[:-1], f"{parts[-1]} OR md5hash IS NULL"]

    def table(name: str, schema: T.StructType) -> DataFrame:
        if "md5hash" in schema.fieldNames():
            rows = spark.read.jdbc(url, name, predicates=keyed, properties=properties)
        else:
            rows = spark.read.jdbc(url, name, properties=properties)
        have = {
            f.name: F.col(f.name) if f.name in rows.columns else F.lit(None) for f in schema
        }
        if "md5hash" in have:
            have["md5hash"] = plain_hash(have["md5hash"].cast("string"))
        return rows.select(*[have[f.name].cast(f.dataType).alias(f.name) for f in schema])

    return Catalog.of({name: table(name, schema) for name, schema in TABLES.items()})

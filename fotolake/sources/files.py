"""Scans of file trees: listing, type, hash, size, metadata and read status."""

from __future__ import annotations

import functools
import hashlib
import os
import re
from collections.abc import Callable, Iterable, Iterator
from datetime import datetime, timezone
from itertools import islice

import pandas as pd
import pyarrow.fs
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fotolake import schemas
from fotolake.functions import images, paths, times
from fotolake.functions.hashes import content_hash
from fotolake.functions.templates import java_regex
from fotolake.session import cut_lineage
from fotolake.sources.exif import jpeg_dimensions, read_tags

# Bytes of files that one task reads, about; bytes read at once; bytes that tell type and size.
TASK_BYTES = 256 << 20
BLOCK_BYTES = 1 << 20
HEAD_BYTES = 64
# Metadata is read in blocks of this size.
SLICE_BYTES = 1 << 16
# Folders that a task lists, and files whose times and sizes it asks for, about.
FOLDERS_PER_TASK = 64
FILES_PER_TASK = 1_000
# Records that leave a reading task at once.
RECORDS = 1_000

# Fixed value: files of a database in use, never scanned.
SKIPPED_EXTENSIONS = (".sqlite-journal",)


def local_path(uri: Column) -> Column:
    """A ``file:`` URI as a plain path; other schemes stay as they are."""
    return F.regexp_replace(uri, "^file:/+", "/")


def plain_root(root: str) -> str:
    """A root the way :func:`local_path` spells the paths below it."""
    return re.sub("^file:/+", "/", root)


def list_files(
    spark: SparkSession,
    roots: str | Iterable[str],
    recursive: bool = True,
    modified_after: str | None = None,
) -> DataFrame:
    """One row per file below ``roots``: path, modificationTime, length.

    Tasks list one level of folders after the other; names starting with ``_`` or ``.``
    are files like any other. Folders that are links are not entered. Each level is
    written to the checkpoint folder. A folder's names are read by one task, its files'
    sizes and times by many: a flat folder of any number of files is spread over all. A
    file or folder that has gone meanwhile, or is closed to us, is left out by itself.
    """
    roots = [roots] if isinstance(roots, str) else list(roots)
    folders = spark.createDataFrame([(plain_root(root),) for root in roots], "path string")
    found: DataFrame | None = None
    while True:
        dealt = _dealt(folders, FOLDERS_PER_TASK)
        level = cut_lineage(dealt.mapInPandas(_list_level, _LISTED))
        own = _dealt(level.where("not folder").drop("folder"), FILES_PER_TASK)
        own = cut_lineage(own.mapInPandas(_with_state, _FILES))
        found = own if found is None else found.unionByName(own)
        folders = level.where("folder").select("path")
        if not recursive or folders.isEmpty():
            break
    if modified_after is not None:
        found = found.where(F.col("modificationTime") > F.lit(modified_after).cast("timestamp"))
    return filter_extension(found, SKIPPED_EXTENSIONS, keep=False)


def _dealt(rows: DataFrame, per_task: int) -> DataFrame:
    """Rows over tasks by their number, as each of them costs a call and hardly a byte."""
    return rows.repartition(max(1, -(-rows.count() // per_task)), "path")


_FILES = "path string, modificationTime timestamp, length long"
_LISTED = f"{_FILES}, folder boolean"


def _list_level(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for folder in batch["path"]:
            entries = _remote_entries(folder) if "://" in folder else _local_entries(folder)
            while rows := list(islice(entries, 10_000)):
                frame = pd.DataFrame(rows, columns=["path", "modificationTime", "length", "folder"])
                frame["modificationTime"] = pd.to_datetime(frame["modificationTime"], utc=True)
                yield frame.astype({"length": "Int64"})


def _local_entries(folder: str) -> Iterator[tuple]:
    """Names of a folder; times and sizes follow by ``_with_state``."""
    try:
        with os.scandir(folder) as entries:
            for entry in entries:
                path = f"{folder.rstrip('/')}/{entry.name}"
                if _holds(entry.is_dir, follow_symlinks=False):
                    yield path, None, None, True
                elif _holds(entry.is_file):
                    yield path, None, None, False
    except OSError:
        return  # the folder has gone or is closed


def _holds(test, **options) -> bool:
    try:
        return test(**options)
    except OSError:
        return False


def _with_state(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Listed files with time and size; those that have gone have no row."""
    for batch in batches:
        rows = []
        for path, stamp, length in batch.itertuples(index=False):
            if pd.isna(length):
                try:
                    state = os.stat(path)
                except OSError:
                    continue
                stamp = datetime.fromtimestamp(state.st_mtime, timezone.utc)
                length = state.st_size
            rows.append((path, stamp, int(length)))
        frame = pd.DataFrame(rows, columns=["path", "modificationTime", "length"])
        frame["modificationTime"] = pd.to_datetime(frame["modificationTime"], utc=True)
        yield frame


def _remote_entries(folder: str) -> Iterator[tuple]:
    filesystem, place = pyarrow.fs.FileSystem.from_uri(folder)
    selector = pyarrow.fs.FileSelector(place, allow_not_found=True)
    for entry in filesystem.get_file_info(selector):
        is_folder = entry.type == pyarrow.fs.FileType.Directory
        yield f"{folder.rstrip('/')}/{entry.base_name}", entry.mtime, entry.size or 0, is_folder


def scan_files(
    spark: SparkSession,
    roots: str | Iterable[str],
    recursive: bool = True,
    modified_after: str | None = None,
) -> DataFrame:
    """The files below ``roots`` with their bytes (path, modificationTime, length, content).

    ``scan_listed`` reads the same files and keeps their bytes in the reading tasks.
    """
    return read_listed(list_files(spark, roots, recursive, modified_after))


def filter_extension(
    files: DataFrame, exts: Iterable[str], ignore_case: bool = False, keep: bool = True
) -> DataFrame:
    """Keep or drop files by extension (with its dot)."""
    ext = paths.extension(F.col("path"))
    wanted = list(exts)
    if ignore_case:
        ext, wanted = F.lower(ext), [w.lower() for w in wanted]
    return files.where(ext.isin(*wanted) if keep else ~ext.isin(*wanted))


def filter_name(files: DataFrame, pattern: str) -> DataFrame:
    """Keep files whose name has a hit of a regular expression, such as ``.JPG|.jpg``."""
    return files.where(paths.basename(F.col("path")).rlike(java_regex(pattern)))


def distinct_files(*listings: DataFrame) -> DataFrame:
    """Set of paths of one or more listings."""
    combined = listings[0].select("path")
    for listing in listings[1:]:
        combined = combined.unionByName(listing.select("path"))
    return combined.distinct()


def modified_at(instant: Column, zone: str) -> Column:
    """File time as naive local time, to the second."""
    return times.wall_clock(instant, zone)


def image_header(content: Column, thumb: bool = False, maker: bool = False) -> Column:
    """Tags, and the size of JPEG and TIFF pictures. ``failed`` marks unreadable metadata."""

    @F.pandas_udf(schemas.HEADER)
    def read(batch: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(
            [_header(None if data is None else bytes(data), thumb, maker) for data in batch],
            columns=["tags", "width", "height", "failed"],
        ).astype({"width": "Int32", "height": "Int32"})

    return read(content)


def _header(data: bytes | _Slices | None, thumb: bool, maker: bool) -> tuple:
    if data is None:
        return None, None, None, False
    try:
        tags = read_tags(data, thumb, maker)
        failed = False
    except Exception:  # damaged metadata must not stop the scan
        tags, failed = [], True
    size = jpeg_dimensions(data) if data[:2] == b"\xff\xd8" else None
    if data[:2] in (b"II", b"MM"):
        named = {key: value for key, _, value in tags}
        pair = named.get("Image ImageWidth", ""), named.get("Image ImageLength", "")
        size = (int(pair[0]), int(pair[1])) if all(p.isdigit() for p in pair) else None
    width, height = size or (None, None)
    return tags or None, width, height, failed


def extract_tags(files: DataFrame, thumb: bool = False, maker: bool = False) -> DataFrame:
    """One row per file and tag: path, key, field_type, value."""
    return files.select(
        "path", F.explode(image_header(F.col("content"), thumb, maker)["tags"]).alias("tag")
    ).select("path", "tag.*")


def image_dimensions(spark: SparkSession, roots: str | Iterable[str]) -> DataFrame:
    """Width and height of each picture by decoding it; NULL when that fails.

    Decoding costs a full read; ``scan_records`` takes the size from the file
    header instead. The picture is not turned by its orientation tag.
    """
    roots = [roots] if isinstance(roots, str) else list(roots)
    reader = spark.read.format("image").option("dropInvalid", "false")
    origin = F.url_decode(F.replace(F.col("image.origin"), F.lit("+"), F.lit("%2B")))
    return reader.option("recursiveFileLookup", "true").load(roots).select(
        local_path(origin).alias("path"),
        F.when(F.col("image.width") > 0, F.col("image.width")).alias("width"),
        F.when(F.col("image.height") > 0, F.col("image.height")).alias("height"),
    )


def scan_records(
    files: DataFrame,
    zone: str = "UTC",
    update: bool = False,
    thumb: bool = False,
    maker: bool = False,
) -> DataFrame:
    """Read record of every file that is an image by its content.

    ``update`` takes every file, whatever its type, and leaves out metadata and size. A
    file whose bytes could not be read keeps its row, without type and hash.
    """
    content = F.col("content")
    header = F.lit(None).cast(schemas.HEADER) if update else image_header(content, thumb, maker)
    # The header is read for images only.
    kind = images.sniff_type(content)
    read = files.select(
        "path",
        "modificationTime",
        content.alias("head"),
        kind.alias("ftype"),
        content_hash(content).alias("md5hash"),
        content.isNull().alias("unread"),
        content,
    )
    if not update:
        read = read.where(F.col("ftype").isNotNull() | F.col("unread"))
    return _records(read.withColumn("header", header), zone, update)


def scan_listed(
    listing: DataFrame,
    zone: str = "UTC",
    update: bool = False,
    thumb: bool = False,
    maker: bool = False,
) -> DataFrame:
    """The records of :func:`scan_records` for listed files, read in the tasks that hold the rows.

    Only narrow records leave a reading task: hash, first bytes and metadata. A file passes
    through in blocks, and metadata is read from its places in it, so it may be of any size.
    """

    names = ("tags", "width", "height", "failed")
    columns = ["path", "modificationTime", "md5hash", "head", "unread", "header"]

    def look(file: pyarrow.NativeFile) -> tuple:
        return _header(None if update else _Slices(file), thumb, maker)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, tags = [], 0
        for batch in batches:
            for row in batch.itertuples(index=False):
                digest, head, header = _read_file(row.path, look)
                header = dict(zip(names, header or _header(None, thumb, maker), strict=True))
                rows.append((row.path, row.modificationTime, digest, head, digest is None, header))
                tags += len(header["tags"] or ())
                # Records have a first part of the file and its tags.
                if len(rows) >= RECORDS or tags >= 50 * RECORDS:
                    yield pd.DataFrame(rows, columns=columns)
                    rows, tags = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=columns)

    schema = (
        T.StructType()
        .add("path", T.StringType())
        .add("modificationTime", T.TimestampType())
        .add("md5hash", T.StringType())
        .add("head", T.BinaryType())
        .add("unread", T.BooleanType())
        .add("header", schemas.HEADER)
    )
    rows = spread_by_bytes(listing).select("path", "modificationTime", "length")
    read_rows = rows.mapInPandas(read, schema).withColumn("ftype", images.sniff_type(F.col("head")))
    if not update:
        read_rows = read_rows.where(F.col("ftype").isNotNull() | F.col("unread"))
    return _records(read_rows, zone, update)


def _records(read: DataFrame, zone: str, update: bool) -> DataFrame:
    size = images.header_dimensions(F.col("head"), F.col("ftype"))
    kept = ["path", "modificationTime", "ftype", "md5hash", "unread"]
    read = read.select(*kept, "header", size.alias("size"))

    def known(column: Column) -> Column:
        return F.lit(None).cast("int") if update else column

    return read.select(
        "path",
        paths.dirname(F.col("path")).alias("root"),
        paths.basename(F.col("path")).alias("fname"),
        "ftype",
        "md5hash",
        modified_at(F.col("modificationTime"), zone).alias("dt_mod"),
        read_message(F.col("path"), F.col("unread"), F.col("header.failed")).alias("msg"),
        F.col("header.tags").alias("tags"),
        known(F.coalesce("size.width", "header.width")).alias("width"),
        known(F.coalesce("size.height", "header.height")).alias("height"),
    )


def spread_by_bytes(listing: DataFrame) -> DataFrame:
    """The listed rows over as many tasks as their files' bytes call for."""
    n_bytes, n_files = listing.agg(F.sum("length"), F.count(F.lit(1))).first()
    least = min(n_files, listing.sparkSession.sparkContext.defaultParallelism)
    return listing.repartition(max(1, least, -(-(n_bytes or 0) // TASK_BYTES)), "path")


def read_message(path: Column, unread: Column, failed: Column) -> Column:
    outcome = F.when(unread, "read failure").when(failed, "tag failure").otherwise("read success")
    return F.concat(path, F.lit("|"), outcome)


def read_status(listing: DataFrame, records: DataFrame) -> DataFrame:
    """Message of every listed file, also of those that gave no record."""
    missing = listing.select("path").join(records.select("path"), "path", "left_anti")
    return records.select("path", "msg").unionByName(
        missing.withColumn("msg", F.concat("path", F.lit("|type failure")))
    )


def observe_scan(records: DataFrame, name: str = "scan") -> tuple[DataFrame, Observation]:
    """Records that count themselves while something else consumes them.

    After an action the observation holds ``files``, ``unread`` and ``tagged``;
    over the seconds of the action they give the read rate.
    """
    watch = Observation(name)
    counted = records.observe(
        watch,
        F.count(F.lit(1)).alias("files"),
        F.count_if(F.col("md5hash").isNull()).alias("unread"),
        F.count_if(F.col("tags").isNotNull()).alias("tagged"),
    )
    return counted, watch


def read_listed(listing: DataFrame) -> DataFrame:
    """The listed files with their bytes; one that cannot be read keeps its row with NULL content.

    Paths must be readable by every executor.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(len(batch)):  # one file per batch bounds the memory
                row = batch.iloc[at : at + 1].copy()
                row["content"] = [_content(row["path"].iloc[0])]
                yield row

    rows = spread_by_bytes(listing).select("path", "modificationTime", "length")
    return rows.mapInPandas(read, schemas.FILE)


def _open(path: str) -> pyarrow.NativeFile:
    if "://" in path:
        filesystem, path = pyarrow.fs.FileSystem.from_uri(path)
    else:
        filesystem = pyarrow.fs.LocalFileSystem()
    return filesystem.open_input_file(path)


def _content(path: str) -> bytes | None:
    """All bytes of a file; None if it cannot be read."""
    try:
        with _open(path) as file:
            return file.read()
    except (OSError, ValueError):
        return None


def _read_file(path: str, look: Callable[[pyarrow.NativeFile], tuple]) -> tuple:
    """MD5, first bytes and what ``look`` sees in the open file; Nones if it cannot be read."""
    try:
        digest, head = hashlib.md5(), b""
        with _open(path) as file:
            while block := file.read(BLOCK_BYTES):
                digest.update(block)
                head = head or block[:HEAD_BYTES]
            return digest.hexdigest(), head, look(file)
    except (OSError, ValueError):
        return None, None, None


class _Slices:
    """An open file whose slices are read when asked for, short ones by a few kept blocks."""

    def __init__(self, file: pyarrow.NativeFile):
        self._file, self._size = file, file.size()
        self._block = functools.lru_cache(8)(lambda n: file.read_at(SLICE_BYTES, n * SLICE_BYTES))

    def __len__(self) -> int:
        return self._size

    def __getitem__(self, key: int | slice):
        if not isinstance(key, slice):
            return self[key : key + 1][0]
        start, stop, _ = key.indices(self._size)
        first, last = start // SLICE_BYTES, (stop - 1) // SLICE_BYTES
        if stop <= start:
            return b""
        if last - first > 1:
            return self._file.read_at(stop - start, start)
        data = b"".join(self._block(n) for n in range(first, last + 1))
        return data[start - first * SLICE_BYTES : stop - first * SLICE_BYTES]

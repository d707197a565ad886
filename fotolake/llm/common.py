"""Shared helpers: tables in the shared folder, byte words, and streams of key groups."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fotolake.session import cut_lineage

# Words of lower-cased text in the sense of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ on UTF-8
# bytes: digits, a-z and every byte from 0x80 up stay, A-Z become a-z, others a space.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)

_U = np.uint64


def shared_folder(spark: SparkSession) -> str | None:
    """The folder named by ``spark.checkpoint.dir``, or None where it is unset."""
    return spark.conf.get("spark.checkpoint.dir", None) or (
        spark.sparkContext.getCheckpointDir() if spark.sparkContext.getCheckpointDir() else None
    )


def scratch(spark: SparkSession, label: str) -> str | None:
    """A new path below the shared folder, or None where that is unset."""
    folder = shared_folder(spark)
    return f"{folder}/{label}-{uuid.uuid4().hex}" if folder else None


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as a compressed table in the shared folder and read from there.

    This cuts the lineage: a lost executor costs a read, not a recomputation. Without
    a shared folder (tests) the session helper chooses one.
    """
    path = scratch(df.sparkSession, label)
    if path is None:
        return cut_lineage(df)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Delete a table made by ``stored`` once nothing reads it any more."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    for file in df.inputFiles()[:1]:
        parent = file.rpartition("/")[0]
        if folder and folder.split(":")[-1].strip("/") in parent:
            path = spark._jvm.org.apache.hadoop.fs.Path(parent)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_bytes(column: str = "text"):
    """The column as UTF-8 bytes, null as none."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def text_key(column: str = "text"):
    """A hash that tells rows of one id with different texts apart."""
    return F.xxhash64(F.coalesce(F.col(column).cast("binary"), F.lit(b"")), F.col(column).isNull())


def words(text: bytes) -> list[bytes]:
    """Lower-cased words of digits, letters and bytes above 0x7F."""
    return text.translate(_WORD_BYTES).split()


class WordHashes(dict):
    """64-bit hash of a word, remembered up to a bounded number of words."""

    LIMIT = 1 << 20

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, found: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, found), np.uint64, len(found))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (fixed multipliers of the public splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingle_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the word windows; fewer words than ``size`` are one window."""
    n = len(hashes)
    if not n:
        return hashes
    size = min(size, n)
    total = np.zeros(n - size + 1, np.uint64)
    for i in range(size):
        total = total * _U(0x9E3779B97F4A7C15) + hashes[i : n - size + 1 + i]
    return np.unique(mix(total + _U(size)))


def signed(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit values as the longs Spark stores."""
    return x.astype(np.uint64, copy=False).view(np.int64)


def arrow_map(df: DataFrame, make: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str):
    """Apply a function to every Arrow batch of ``df``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := make(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def whole_keys(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables that never split a run of equal keys, from batches sorted by those keys.

    Only the rows of the last key of a batch are held back for the next one.
    """
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        changed = np.zeros(batch.num_rows, bool)
        for key in keys:
            values = np.asarray(batch.column(batch.schema.get_field_index(key)))
            changed[1:] |= values[1:] != values[:-1]
        if rest:
            changed[0] = any(
                rest[-1].column(rest[-1].schema.get_field_index(key))[-1].as_py()
                != batch.column(batch.schema.get_field_index(key))[0].as_py()
                for key in keys
            )
        starts = np.flatnonzero(changed)
        if not len(starts):
            rest.append(batch)
            continue
        last = int(starts[-1])
        done = [*rest, batch.slice(0, last)] if last else rest
        if sum(b.num_rows for b in done):
            yield pa.Table.from_batches(done).combine_chunks()
        rest = [batch.slice(last)]
    if rest:
        yield pa.Table.from_batches(rest).combine_chunks()


def bytes_of(array: pa.Array) -> list[memoryview]:
    """Views of the values of a binary array, without copies."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    large = pa.types.is_large_binary(array.type)
    offsets = np.frombuffer(array.buffers()[1], np.int64 if large else np.int32)
    offsets = offsets[array.offset : array.offset + len(array) + 1]
    data = memoryview(array.buffers()[2]) if array.buffers()[2] is not None else memoryview(b"")
    return [data[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def list_array(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """Consecutive slices of ``values`` as an Arrow list array."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


@F.arrow_udf(T.BinaryType())
def packed(texts: pa.Array) -> pa.Array:
    """Values compressed one by one, so that a shuffle of whole texts moves less."""
    compress = zstandard.ZstdCompressor(level=1).compress
    return pa.array([compress(text.as_py()) for text in texts], pa.binary())


def unpack(value: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(value)


def row_key():
    """A hash of ``doc_id`` and ``text``: rows that agree in both are one document."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("binary"))

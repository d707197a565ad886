"""Line dedup by winnowing over line hashes.

A line is a stretch between line feeds that is not blank, compared without white space at
its ends. From each line runs a window: the shortest run of lines that has ``min_lines``
lines or ``min_words`` words. The smallest line hash of a window is its fingerprint, so two
equal windows always share one. Fingerprints that occur once are dropped; the windows of the
others are grouped by the hash of all their lines. This takes the place of joining positions
and extending matches: every window of a longer match is a window itself, so the groups cover
the same lines, without pairs of places of a common fingerprint. Lines in a window that also starts earlier (smaller doc_id, or the
same document further up) are deleted.

Defined results: null and empty texts stay as they are; documents without id come last, in
the order of a hash of their text; rows equal in doc_id and text count as one place and are
treated alike; other columns pass through untouched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fotolake.llm.common import arrow_map, mix, signed, stored, text_bytes, text_key

MIN_LINES = 3
MIN_WORDS = 50

_SPACE = b" \t\n\v\f\r"
_U = np.uint64


def _lines(text: bytes) -> list[bytes]:
    return [own for line in text.split(b"\n") if (own := line.strip(_SPACE))]


def _windows(lines: list[bytes], min_lines: int, min_words: int):
    """Per window: first line, end, hash of its lines, position of its fingerprint; and line hashes."""
    n = len(lines)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, lines), np.uint64, n)
    total = np.concatenate([[0], np.cumsum([len(line.split()) for line in lines])])
    start = np.arange(n)
    end = np.minimum(start + min_lines, np.searchsorted(total, total[:-1] + min_words))
    start, end = start[end <= n], end[end <= n]
    value = (end - start).astype(np.uint64)
    least = hashes[start]
    at = start.copy()
    for i in range(min_lines):
        inside = start + i < end
        own = hashes[np.minimum(start + i, n - 1)]
        value = np.where(inside, mix(value * _U(0x9E3779B97F4A7C15) + own), value)
        lower = inside & (own <= least)
        least, at = np.where(lower, own, least), np.where(lower, start + i, at)
    return start, end, value, at, hashes


_PRINTS = (
    "doc_id long, text_key long, print long, place int, "
    "windows array<struct<window:long,start:int,end:int>>"
)


def fingerprints(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS):
    """One row per selected line: its hash, its place, and the windows that chose it."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        for text in batch.column(2):
            lines = _lines(text.as_py())
            found.append(_windows(lines, min_lines, min_words) if lines else None)
        rows = [i for i, own in enumerate(found) if own is not None and len(own[0])]
        parts = [found[i] for i in rows]
        if not parts:
            return None
        # Windows that chose the same line stand next to each other.
        firsts = [np.flatnonzero(np.diff(own[3], prepend=-1)) for own in parts]
        lengths = np.concatenate(
            [np.diff(first, append=len(own[0])) for first, own in zip(firsts, parts, strict=True)]
        )
        windows = pa.StructArray.from_arrays(
            [
                pa.array(signed(np.concatenate([own[2] for own in parts])), pa.int64()),
                pa.array(np.concatenate([own[0] for own in parts]), pa.int32()),
                pa.array(np.concatenate([own[1] for own in parts]), pa.int32()),
            ],
            names=["window", "start", "end"],
        )
        row = np.repeat(rows, [len(first) for first in firsts])
        place = np.concatenate([own[3][first] for first, own in zip(firsts, parts, strict=True)])
        prints = np.concatenate(
            [own[4][own[3][first]] for first, own in zip(firsts, parts, strict=True)]
        )
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        return pa.record_batch(
            [
                batch.column(0).take(pa.array(row)),
                batch.column(1).take(pa.array(row)),
                pa.array(signed(prints), pa.int64()),
                pa.array(place, pa.int32()),
                pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), windows),
            ],
            names=["doc_id", "text_key", "print", "place", "windows"],
        )

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        text_key().alias("text_key"),
        text_bytes().alias("text"),
    )
    return arrow_map(rows, make, _PRINTS)


def repeated_windows(prints: DataFrame) -> DataFrame:
    """Windows that also start earlier: doc_id, text_key, start, end.

    The counts are written before they are joined: a join of two plain shuffles lets Spark
    split a print or window that very many documents share.
    """
    often = prints.groupBy("print").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("print")
    often = stored(often, "often")
    windows = prints.join(often, "print").select("doc_id", "text_key", F.inline("windows"))
    # Documents without id come last.
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key", "start")
    firsts = (
        windows.groupBy("window")
        .agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("window", "first")
    )
    firsts = stored(firsts, "firsts")
    return (
        windows.join(firsts, "window")
        .where(~place.eqNullSafe(F.col("first")))
        .select("doc_id", "text_key", "start", "end")
    )


_DELETED = (
    T.StructType()
    .add("text", T.StringType())
    .add("n_lines", T.LongType())
    .add("n_removed", T.LongType())
)


def _delete(texts: pa.Array, spans: pa.Array) -> pa.Array:
    kept, totals, removed = [], [], []
    for text, own in zip(texts, spans, strict=True):
        data = text.as_py()
        if data is None:
            kept.append(None), totals.append(0), removed.append(0)
            continue
        pieces = data.split(b"\n")
        at = [i for i, piece in enumerate(pieces) if piece.strip(_SPACE)]
        drop = {at[i] for s in own.as_py() or () for i in range(s["start"], s["end"])}
        if drop:
            data = b"\n".join(piece for i, piece in enumerate(pieces) if i not in drop)
        kept.append(data), totals.append(len(at)), removed.append(len(drop))
    return pa.StructArray.from_arrays(
        [
            pa.array(kept, pa.binary()).cast(pa.string()),
            pa.array(totals, pa.int64()),
            pa.array(removed, pa.int64()),
        ],
        names=["text", "n_lines", "n_removed"],
    )


_delete_lines = F.arrow_udf(_delete, _DELETED)


def dedup_lines(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS):
    """``docs`` without later repeated runs in ``text``, and a struct ``line_dedup``.

    The struct has n_lines (not blank, before) and n_removed.
    """
    prints = stored(fingerprints(docs, min_lines, min_words), "prints")
    spans = (
        repeated_windows(prints)
        .groupBy("doc_id", "text_key")
        .agg(F.collect_set(F.struct("start", "end")).alias("_spans"))
        .select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "_spans")
    )
    keyed = docs.select(F.struct("*").alias("_row"), text_key().alias("_own"))
    same = F.col("_row.doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_key"))
    done = keyed.join(spans, same, "left").withColumn(
        "_done", _delete_lines(F.col("_row.text").cast("binary"), "_spans")
    )
    fields = [
        F.col("_done.text").alias(name) if name == "text" else F.col("_row")[name].alias(name)
        for name in docs.columns
    ]
    return done.select(
        *fields, F.struct("_done.n_lines", "_done.n_removed").alias("line_dedup")
    )

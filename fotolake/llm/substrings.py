"""Exact removal of repeated byte strings, by interval expansion on a Burrows-Wheeler order.

Every window of ``length`` bytes belongs to the anchor it holds: the leftmost of its grams
of ``GRAM`` bytes with the smallest hash. Equal windows have equal anchors, so windows are
compared within anchors only. Consecutive windows with one anchor form a piece, about
thirty windows wide.

* Equal pieces need no look at their bytes: all but the earliest are removed whole. They are
  combined in each task before the shuffle.
* Where an anchor has several different pieces, their bytes are put together, and suffix
  intervals are expanded breadth-first by their common prefix: an interval of suffixes that
  share a prefix is extended backward by the symbols that stand before them, in
  Burrows-Wheeler order, which gives the intervals of the next longer prefix. Intervals of
  one suffix are dropped; expansion stops at ``length``. The suffixes of a last interval are
  equal windows, and all but the earliest are removed.
* An anchor with more than ``HOT_PIECES`` different pieces is not put in one task: its windows
  are compared as aggregates over window hashes, which combine before the shuffle.

Earlier means a smaller doc_id, or the same document and an earlier start.

Defined results: a null text is empty; texts shorter than ``length`` keep all bytes;
documents without id come after all others, by a hash of their text; rows equal in doc_id
and text are one place and are treated alike; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fotolake.llm.common import bytes_of, mix, packed, signed, stored, text_bytes, unpack, whole_keys

LENGTH = 100
GRAM = 32
HOT_PIECES = 20_000
# Bytes that are hashed at once, pieces that are combined at once, bytes that are expanded at once.
_BLOCK_BYTES = 1 << 20
_BLOCK_PIECES = 1 << 19
_EXPAND_BYTES = 1 << 22

_U = np.uint64
_WIDTH_BITS = _U(8)
# A place is a document (doc_id and the 64-bit key of its text) and a start in it.
_PIECES = "anchor long, body long, doc_id long, key long, start long, width int, done boolean"


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    value = data.astype(np.uint64) + _U(1)
    factor, n = 0x9E3779B97F4A7C15, 1
    while n < GRAM:
        value = value[:-n] * _U(factor) + value[n:]
        factor = factor * factor % (1 << 64)
        n *= 2
    return mix(value)


def _anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Gram hashes, and for each window the position of its anchor."""
    grams = _gram_hashes(data)
    # The low bits hold the position, so that the smallest value is also the leftmost.
    least = (grams & ~_U(0xFFFFFFFF)) | np.arange(len(grams), dtype=np.uint64)
    wide, n = length - GRAM + 1, 1
    while 2 * n <= wide:
        least = np.minimum(least[:-n], least[n:])
        n *= 2
    if wide > n:
        least = np.minimum(least[: n - wide], least[wide - n :])
    return grams, (least & _U(0xFFFFFFFF)).astype(np.int64)


def _pieces_of(texts: list, length: int):
    """Pieces of a list of texts: anchor, body hash, index of the text, start in it, width."""
    joined = b"".join(texts)
    size = np.array([len(text) for text in texts])
    first = np.cumsum(size) - size
    data = np.frombuffer(joined, np.uint8)
    grams, anchor = _anchors(data, length)
    # Windows inside one text.
    n = np.maximum(size - length + 1, 0)
    text = np.repeat(np.arange(len(texts)), n)
    window = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[text]
    at = anchor[window]
    fresh = np.ones(len(window), bool)
    fresh[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
    head = np.flatnonzero(fresh)
    width = np.diff(head, append=len(window))
    start = window[head]
    digest = xxhash.xxh3_64_intdigest
    body = np.fromiter(
        (
            digest(joined[a:b])
            for a, b in zip(start.tolist(), (start + width + length - 1).tolist(), strict=True)
        ),
        np.uint64,
        len(start),
    )
    own = text[head]
    return grams[at[head]], body, own, start - first[own], width


def pieces(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Pieces of all texts. Those repeated within a block of a task are marked ``done``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, ids, found, size, total = [], [], [], 0, 0
        for batch in batches:
            keys = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            for key, text in zip(keys, bytes_of(batch.column(2)), strict=True):
                if len(text) < length:
                    continue
                texts.append(text)
                ids.append(key)
                size += len(text)
                if size >= _BLOCK_BYTES:
                    found.append((ids, *_pieces_of(texts, length)))
                    total += len(found[-1][1])
                    texts, ids, size = [], [], 0
                if total >= _BLOCK_PIECES:
                    yield from _combined(found)
                    found, total = [], 0
            # The texts are views of this batch.
            if texts:
                found.append((ids, *_pieces_of(texts, length)))
                total += len(found[-1][1])
                texts, ids, size = [], [], 0
        if found:
            yield from _combined(found)

    return docs.select("doc_id", "key", "text").mapInArrow(run, _PIECES)


def _combined(found: list) -> Iterator[pa.RecordBatch]:
    ids = [key for part in found for key in part[0]]
    shift = np.cumsum([0, *(len(part[0]) for part in found)])
    anchor, body, _, start, width = (np.concatenate([part[k] for part in found]) for k in range(1, 6))
    doc = np.concatenate([part[3] + shift[i] for i, part in enumerate(found)])
    missing = np.array([key[0] is None for key in ids])
    doc_id = np.array([key[0] or 0 for key in ids], np.int64)
    key = np.array([key[1] for key in ids], np.int64)
    missing, doc_id, key = missing[doc], doc_id[doc], key[doc]
    order = np.lexsort((start, key, doc_id, missing, body, anchor))
    same = np.zeros(len(order), bool)
    a, b = order[1:], order[:-1]
    same[1:] = (anchor[a] == anchor[b]) & (body[a] == body[b])
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    lead = order[head]
    later = np.zeros(len(order), bool)
    later[order] = same & _other_place((missing, doc_id, key, start), order, lead)
    body = (body & ~_U(0xFF)) | (width.astype(np.uint64) & _U(0xFF))
    # Pieces that are settled need no partner: they are spread by their place.
    spread = mix(key.view(np.uint64) + doc_id.view(np.uint64)) + start.astype(np.uint64)
    anchor = np.where(later, mix(spread), anchor)
    for i in range(0, len(order), 1 << 17):
        cut = slice(i, i + (1 << 17))
        yield pa.record_batch(
            [
                pa.array(signed(anchor[cut]), pa.int64()),
                pa.array(signed(body[cut]), pa.int64()),
                pa.array(doc_id[cut], pa.int64(), mask=missing[cut]),
                pa.array(key[cut], pa.int64()),
                pa.array(start[cut], pa.int64()),
                pa.array(width[cut], pa.int32()),
                pa.array(later[cut]),
            ],
            names=["anchor", "body", "doc_id", "key", "start", "width", "done"],
        )


def _other_place(columns: tuple, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows ``a`` and ``b`` differ in one of the columns that make a place."""
    return np.logical_or.reduce([column[a] != column[b] for column in columns])


_SETTLED = "doc_id long, key long, start long, width int, anchor long"


def settle(found: DataFrame) -> DataFrame:
    """Removed windows, and the earliest pieces of anchors that have several different ones.

    Rows with an ``anchor`` are such pieces, the others are to be removed. The rows stream
    by in order; only the first row of the last body is remembered.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            done = np.asarray(batch.column(6))
            if done.any():
                yield _settled(batch.filter(pa.array(done)), False)
                batch = batch.filter(pa.array(~done))
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([*([held[0]] if held else []), batch]).combine_chunks()
            rows = table.to_batches()[0]
            anchor, body, key, start = (np.asarray(rows.column(k)) for k in (0, 1, 3, 4))
            doc_id = np.asarray(rows.column(2).fill_null(0))
            missing = np.asarray(rows.column(2).is_null())
            new_anchor = np.ones(len(anchor), bool)
            new_anchor[1:] = anchor[1:] != anchor[:-1]
            fresh = new_anchor.copy()
            fresh[1:] |= body[1:] != body[:-1]
            head = np.maximum.accumulate(np.where(fresh, np.arange(len(anchor)), 0))
            later = ~fresh & _other_place((missing, doc_id, key, start), np.arange(len(head)), head)
            heads = np.flatnonzero(fresh)
            before = ~new_anchor[heads]
            after = np.append(before[1:], False)
            if held:
                before[0] = held[1]
            several = before | after
            # Whether the last body has a successor is seen with the next batch.
            last = int(heads[-1])
            open_now = heads[:-1][several[:-1]]
            held = rows.slice(last, 1), bool(before[-1])
            if later.any():
                yield _settled(rows.filter(pa.array(later)), False)
            if len(open_now):
                yield _settled(rows.take(pa.array(open_now)), True)
        if held and held[1]:
            yield _settled(held[0], True)

    dealt = found.repartition("anchor").sortWithinPartitions(
        "anchor", "body", F.col("doc_id").asc_nulls_last(), "key", "start"
    )
    return dealt.mapInArrow(run, _SETTLED)


def _settled(rows: pa.RecordBatch, is_open: bool) -> pa.RecordBatch:
    anchor = rows.column(0) if is_open else pa.nulls(rows.num_rows, pa.int64())
    return pa.record_batch(
        [*(rows.column(k) for k in (2, 3, 4, 5)), anchor],
        names=["doc_id", "key", "start", "width", "anchor"],
    )


_OPEN = "anchor long, doc_id long, key long, start long, width int, body binary"


def open_bodies(docs: DataFrame, settled: DataFrame, length: int) -> DataFrame:
    """The bytes of the pieces that have to be compared."""
    own = (
        settled.where("anchor is not null")
        .groupBy("doc_id", "key")
        .agg(F.collect_list(F.struct("anchor", "start", "width")).alias("open"))
    )
    joined = _join_docs(docs, own, "inner").select("doc_id", "key", "packed", "open")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for doc_id, key, text, found in zip(*(batch.column(k) for k in range(4)), strict=True):
                data, own = unpack(text.as_py()), {"doc_id": doc_id.as_py(), "key": key.as_py()}
                for piece in found.as_py():
                    start = piece["start"]
                    body = data[start : start + piece["width"] + length - 1]
                    rows.append({**piece, **own, "body": body})
                    size += len(body)
                if size > 1 << 24:
                    yield pa.RecordBatch.from_pylist(rows, _OPEN_TYPE)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _OPEN_TYPE)

    # Repeated rows of a document yield its pieces once each; equal places do no harm.
    return joined.mapInArrow(run, _OPEN)


_OPEN_TYPE = pa.schema(
    [
        ("anchor", pa.int64()),
        ("doc_id", pa.int64()),
        ("key", pa.int64()),
        ("start", pa.int64()),
        ("width", pa.int32()),
        ("body", pa.binary()),
    ]
)


def _join_docs(docs: DataFrame, own: DataFrame, how: str) -> DataFrame:
    """Whole texts, compressed for the way, with the rows of their document."""
    texts = docs.withColumn("packed", packed(F.col("text"))).drop("text")
    own = own.select(
        F.xxhash64("doc_id", "key").alias("row"),
        F.col("doc_id").alias("_id"),
        F.col("key").alias("_key"),
        *(c for c in own.columns if c not in ("doc_id", "key")),
    )
    same = (texts["row"] == own["row"]) & texts["doc_id"].eqNullSafe(own["_id"])
    return texts.join(own, same & (texts["key"] == own["_key"]), how)


def last_intervals(data: np.ndarray, window: np.ndarray, length: int, step: int = 4) -> np.ndarray:
    """Groups of equal windows: for each window the number of its interval, -1 if it is alone.

    ``window`` has the starts. Suffixes are named by the window they will become: at prefix
    length n, window w stands for the suffix at w + length - n. Each round takes the suffixes
    of all intervals in order, reads the symbol of ``step`` bytes before each, and sorts by
    symbol and interval, as the LF mapping of a Burrows-Wheeler transform does; runs of equal
    symbol and interval are the intervals of the prefix that is ``step`` bytes longer.
    """
    result = np.full(len(window), -1, np.int64)
    live = np.arange(len(window))
    interval = np.zeros(len(window), np.uint64)
    depth = 0
    while depth < length and len(live):
        size = step if (length - depth) % step == 0 else (length - depth) % step
        at = window[live] + (length - depth - size)
        symbol = np.zeros(len(live), np.uint64)
        for i in range(size):
            symbol = (symbol << _U(8)) | data[at + i]
        key = (symbol << _U(32)) | interval
        order = np.argsort(key, kind="stable")
        key = key[order]
        fresh = np.ones(len(key), bool)
        fresh[1:] = key[1:] != key[:-1]
        number = np.cumsum(fresh) - 1
        several = np.bincount(number)[number] > 1
        live = live[order][several]
        interval = number[several].astype(np.uint64)
        depth += size
    result[live] = interval.astype(np.int64)
    return result


_REMOVED = "doc_id long, key long, start long, end long"


def expand(opened: DataFrame, length: int) -> DataFrame:
    """Spans that the comparison of different pieces of an anchor removes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for table in whole_keys(batches, ["anchor"]):
            # Keep whole anchors together and expand several at once.
            for part in _anchor_parts(table):
                waiting.append(part)
                size += part.num_rows * (length + GRAM)
                if size >= _EXPAND_BYTES:
                    yield _expanded(pa.Table.from_batches(waiting).combine_chunks(), length)
                    waiting, size = [], 0
        if waiting:
            yield _expanded(pa.Table.from_batches(waiting).combine_chunks(), length)

    dealt = opened.repartition("anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(run, _REMOVED)


def _anchor_parts(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Parts of at most about ``_EXPAND_BYTES`` that end where an anchor ends."""
    rows = table.to_batches()[0]
    anchor = np.asarray(rows.column(0))
    ends = np.append(np.flatnonzero(anchor[1:] != anchor[:-1]) + 1, len(anchor))
    most, first = _EXPAND_BYTES // (LENGTH + GRAM), 0
    while first < len(anchor):
        i = int(np.searchsorted(ends, first + most, side="right"))
        last = int(ends[i - 1]) if i and ends[i - 1] > first else int(ends[min(i, len(ends) - 1)])
        yield rows.slice(first, last - first)
        first = last


def _expanded(table: pa.Table, length: int) -> pa.RecordBatch:
    rows = table.to_batches()[0]
    bodies = bytes_of(rows.column(5))
    data = np.frombuffer(b"".join(bodies), np.uint8)
    size = np.array([len(body) for body in bodies])
    width = size - length + 1
    first = np.cumsum(size) - size
    piece = np.repeat(np.arange(len(size)), width)
    offset = np.arange(len(piece)) - np.repeat(np.cumsum(width) - width, width)
    group = last_intervals(data, first[piece] + offset, length)
    start = np.asarray(rows.column(3))[piece] + offset
    key = np.asarray(rows.column(2))[piece]
    doc_id = np.asarray(rows.column(1).fill_null(0))[piece]
    missing = np.asarray(rows.column(1).is_null())[piece]
    place = missing, doc_id, key, start
    inside = np.flatnonzero(group >= 0)
    order = inside[np.lexsort((*(column[inside] for column in place[::-1]), group[inside]))]
    fresh = np.ones(len(order), bool)
    fresh[1:] = group[order[1:]] != group[order[:-1]]
    lead = order[np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))] if len(order) else order
    later = order[_other_place(place, order, lead)]
    return _runs(np.sort(later), piece, place, length)


def _runs(windows, piece, place, length) -> pa.RecordBatch:
    """Consecutive removed windows of a piece as one span."""
    fresh = np.ones(len(windows), bool)
    fresh[1:] = (windows[1:] != windows[:-1] + 1) | (piece[windows[1:]] != piece[windows[:-1]])
    head = np.flatnonzero(fresh)
    n = np.diff(head, append=len(windows))
    missing, doc_id, key, start = (column[windows[head]] for column in place)
    return pa.record_batch(
        [
            pa.array(doc_id, pa.int64(), mask=missing),
            pa.array(key, pa.int64()),
            pa.array(start, pa.int64()),
            pa.array(start + n + length - 1, pa.int64()),
        ],
        names=["doc_id", "key", "start", "end"],
    )


_WINDOWS = "anchor long, one long, two long, doc_id long, key long, start long"


def hot_windows(opened: DataFrame, length: int) -> DataFrame:
    """The same for anchors with very many pieces, as aggregates over window hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, hashes, offset = [], [], []
            for i, body in enumerate(bytes_of(batch.column(5))):
                for k in range(len(body) - length + 1):
                    row.append(i)
                    offset.append(k)
                    hashes.append(xxhash.xxh3_128_digest(body[k : k + length]))
            if not row:
                continue
            both = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
            start = np.asarray(batch.column(3))[row] + np.array(offset)
            yield pa.record_batch(
                [
                    batch.column(0).take(pa.array(row)),
                    pa.array(both[:, 0].copy()),
                    pa.array(both[:, 1].copy()),
                    batch.column(1).take(pa.array(row)),
                    batch.column(2).take(pa.array(row)),
                    pa.array(start, pa.int64()),
                ],
                names=["anchor", "one", "two", "doc_id", "key", "start"],
            )

    windows = opened.mapInArrow(run, _WINDOWS)
    at = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key", "start")
    firsts = windows.groupBy("anchor", "one", "two").agg(F.min(at).alias("first"))
    firsts = stored(firsts, "firsts")
    return (
        windows.join(firsts, ["anchor", "one", "two"])
        .where(~at.eqNullSafe(F.col("first")))
        .select("doc_id", "key", "start", (F.col("start") + length).alias("end"))
    )


def removed_spans(docs: DataFrame, length: int = LENGTH, hot_pieces: int = HOT_PIECES) -> DataFrame:
    """doc_id, key, start, end of byte spans to remove; spans may overlap. ``docs`` is keyed."""
    settled = stored(settle(pieces(docs, length)), "settled")
    whole = settled.where("anchor is null").select(
        "doc_id",
        "key",
        "start",
        (F.col("start") + F.col("width") + (length - 1)).alias("end"),
    )
    hot = (
        settled.where("anchor is not null")
        .groupBy("anchor")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > hot_pieces)
        .select("anchor")
    )
    opened = stored(open_bodies(docs, settled, length), "opened")
    spans = whole.unionByName(expand(opened.join(hot, "anchor", "left_anti"), length))
    return spans.unionByName(hot_windows(opened.join(hot, "anchor", "left_semi"), length))


_KEPT = "struct<n_removed:long,n_spans:long,kept_sha256:string,kept:binary>"


def _cut(text: bytes, spans: list) -> tuple[int, int, bytes]:
    removed, count, kept, at, reach = 0, 0, [], 0, -1
    for start, end in sorted(spans):
        if start > reach:
            count += 1
            kept.append(text[at:start])
            removed += end - start
            at = reach = end
        elif end > reach:
            removed += end - reach
            at = reach = end
    kept.append(text[at:])
    return removed, count, b"".join(kept)


def _kept_texts(with_text: bool):
    @F.arrow_udf(_KEPT)
    def kept(texts: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
        rows = []
        for text, start, end in zip(texts, starts, ends, strict=True):
            spans = list(zip(start.as_py() or (), end.as_py() or (), strict=True))
            removed, count, rest = _cut(unpack(text.as_py()), spans)
            rows.append((removed, count, hashlib.sha256(rest).hexdigest(), rest if with_text else None))
        columns = list(zip(*rows, strict=True)) or [[], [], [], []]
        return pa.StructArray.from_arrays(
            [
                pa.array(columns[0], pa.int64()),
                pa.array(columns[1], pa.int64()),
                pa.array(columns[2], pa.string()),
                pa.array(columns[3], pa.binary()),
            ],
            names=["n_removed", "n_spans", "kept_sha256", "kept"],
        )

    return kept


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, key, row, n_bytes, text (bytes): key tells texts of one doc_id apart."""
    key = F.xxhash64(F.col("text").cast("binary"))
    doc_id = F.col("doc_id").cast("long")
    return docs.select(
        doc_id.alias("doc_id"),
        key.alias("key"),
        F.xxhash64(doc_id, key).alias("row"),
        F.octet_length(text_bytes()).cast("long").alias("n_bytes"),
        text_bytes().alias("text"),
    )


def dedup_substrings(
    docs: DataFrame, length: int = LENGTH, with_text: bool = True, hot_pieces: int = HOT_PIECES
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes left), for every row."""
    rows = keyed(docs)
    # A span list is as long as its document has pieces.
    spans = (
        removed_spans(rows, length, hot_pieces)
        .groupBy("doc_id", "key")
        .agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    )
    kept = _kept_texts(with_text)
    return (
        _join_docs(rows, spans, "left")
        .withColumn("_out", kept("packed", F.col("spans.start"), F.col("spans.end")))
        .select("doc_id", "n_bytes", "_out.*")
    )

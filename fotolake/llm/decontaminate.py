"""Benchmark decontamination with a positional inverted index.

The index is cut by documents: a segment holds all words of some documents, its
sorted terms, and for each term the positions where it stands. Building it and
searching it move no rows between tasks, so no term, however frequent, makes a hot
partition. A search takes each phrase, starts from the term of it that is rarest in
the segment, shifts its positions to the phrase's start, and intersects them with
the shifted lists of the other terms, rarest first.

Defined results: null, empty and word-free texts have no words and no hits;
repeated rows are answered each; items with equal ids count once; an item without an
id is searched, but cannot be named; an item without words has no phrase; columns
besides the named ones are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fotolake.llm.common import list_array, text_bytes, words

# Words of a segment. A longer document makes a longer segment of its own.
SEGMENT_WORDS = 1 << 20
# Phrases that one pass over the index takes; more are taken in further passes.
PASS_PHRASES = 200_000
# Candidate positions that are intersected at once.
_CHUNK = 1 << 21

_SEGMENT = (
    "segment string, doc_ids array<long>, n_words array<int>, terms array<binary>, "
    "ends array<int>, deltas binary"
)


def build_index(docs: DataFrame) -> DataFrame:
    """Segments of a positional index over the words of ``doc_id, text``.

    Words of a segment are numbered from 0 with a hole of one after each document, so
    that no run of numbers crosses documents.
    """
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")
    ).mapInArrow(_segments, _SEGMENT)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids, counts, found, n = [], [], [], 0
    task, done = TaskContext.get().partitionId(), 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            own = words(text.as_py())
            ids.append(doc_id)
            counts.append(len(own))
            found.append(own)
            n += len(own)
            if n >= SEGMENT_WORDS:
                yield _segment(f"{task}-{done}", ids, counts, found)
                ids, counts, found, n, done = [], [], [], 0, done + 1
    if ids:
        yield _segment(f"{task}-{done}", ids, counts, found)


def _segment(name: str, ids: list, counts: list, found: list) -> pa.RecordBatch:
    number: dict[bytes, int] = {}
    term = np.fromiter(
        (number.setdefault(word, len(number)) for own in found for word in own),
        np.int32,
        sum(counts),
    )
    position = np.arange(len(term), dtype=np.int32) + np.repeat(
        np.arange(len(counts), dtype=np.int32), counts
    )
    by_name = sorted(number)
    rank = np.empty(len(number), np.int32)
    rank[[number[name] for name in by_name]] = np.arange(len(number), dtype=np.int32)
    term = rank[term] if len(term) else term
    order = np.argsort(term, kind="stable")
    deltas = np.diff(position[order], prepend=np.int32(0)).astype("<i4")
    ends = np.cumsum(np.bincount(term, minlength=len(number))).astype(np.int32)
    return pa.record_batch(
        [
            pa.array([name]),
            pa.array([ids], pa.list_(pa.int64())),
            pa.array([counts], pa.list_(pa.int32())),
            pa.array([by_name], pa.list_(pa.binary())),
            list_array(ends, np.array([len(ends)]), pa.int32()),
            pa.array([deltas.tobytes()], pa.binary()),
        ],
        names=["segment", "doc_ids", "n_words", "terms", "ends", "deltas"],
    )


class _Postings:
    """One segment, with a sorted key for each posting: term number and position."""

    def __init__(self, name, doc_ids, n_words, terms, ends, deltas):
        self.name = name
        self.doc_ids = doc_ids
        self.n_words = np.asarray(n_words, np.int64)
        self.first = np.cumsum(self.n_words + 1) - self.n_words - 1
        self.size = int((self.n_words + 1).sum())
        self.number = {term: i for i, term in enumerate(terms)}
        self.ends = np.asarray(ends, np.int64)
        self.starts = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)
        self.position = np.cumsum(np.frombuffer(deltas, "<i4"), dtype=np.int64)
        self.key = np.repeat(np.arange(len(self.ends)), self.ends - self.starts) * self.size
        self.key += self.position

    def doc_of(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, position, side="right") - 1

    def has(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        key = term * self.size + position
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return (self.key[at] == key) & (position >= 0)

    def numbers(self, phrases: list[tuple[bytes, ...]]) -> tuple[np.ndarray, np.ndarray]:
        """Term numbers of the phrases that have all their terms here, -1 as padding."""
        get, known, rows = self.number.get, [], []
        for i, phrase in enumerate(phrases):
            row = [get(word, -1) for word in phrase]
            if min(row) >= 0:
                known.append(i)
                rows.append(row)
        width = max(map(len, rows), default=1)
        padded = np.full((len(rows), width), -1, np.int64)
        for i, row in enumerate(rows):
            padded[i, : len(row)] = row
        return np.array(known, np.int64), padded

    def rarest_first(self, table: np.ndarray) -> np.ndarray:
        length = np.where(table >= 0, (self.ends - self.starts)[table], np.iinfo(np.int64).max)
        return np.argsort(length, axis=1, kind="stable")

    def spread(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each of the terms all its positions: row number and position."""
        n = self.ends[term] - self.starts[term]
        row = np.repeat(np.arange(len(term)), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + self.starts[term][row]
        return row, self.position[at]

    def phrase_starts(self, phrases: list[tuple[bytes, ...]]) -> tuple[np.ndarray, np.ndarray]:
        """Every occurrence: number of the phrase and position of its first word."""
        known, table = self.numbers(phrases)
        if not len(known):
            return known, known
        order = self.rarest_first(table)
        hits, starts = [], []
        for part in _parts(self.ends - self.starts, table[np.arange(len(table)), order[:, 0]]):
            own, sequence = table[part], order[part]
            row, start = self.spread(own[np.arange(len(own)), sequence[:, 0]])
            start = start - sequence[row, 0]
            for k in range(1, own.shape[1]):
                offset = sequence[row, k]
                term = own[row, offset]
                keep = (term < 0) | self.has(np.maximum(term, 0), start + offset)
                row, start = row[keep], start[keep]
            hits.append(known[part][row])
            starts.append(start)
        return np.concatenate(hits), np.concatenate(starts)

    def near(self, groups: list[tuple[bytes, ...]], within: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of a group's rarest term that have all other terms at most ``within`` away."""
        known, table = self.numbers(groups)
        if not len(known):
            return known, known
        order = self.rarest_first(table)
        hits, found = [], []
        for part in _parts(self.ends - self.starts, table[np.arange(len(table)), order[:, 0]]):
            own, sequence = table[part], order[part]
            row, position = self.spread(own[np.arange(len(own)), sequence[:, 0]])
            for k in range(1, own.shape[1]):
                term = own[row, sequence[row, k]]
                doc = self.doc_of(position)
                low = np.maximum(position - within, self.first[doc])
                high = np.minimum(position + within, self.first[doc] + self.n_words[doc] - 1)
                base = np.maximum(term, 0) * self.size
                n = np.searchsorted(self.key, base + high, side="right") - np.searchsorted(
                    self.key, base + low
                )
                keep = (term < 0) | (n > 0)
                row, position = row[keep], position[keep]
            hits.append(known[part][row])
            found.append(position)
        return np.concatenate(hits), np.concatenate(found)


def _parts(length: np.ndarray, rarest: np.ndarray) -> Iterator[slice]:
    """Slices of the phrases whose candidate positions fit in a chunk."""
    total = np.cumsum(length[rarest])
    first = 0
    while first < len(rarest):
        done = total[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(total, done + _CHUNK, side="right")))
        yield slice(first, last)
        first = last


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[_Postings]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield _Postings(*(batch.column(k)[i].as_py() for k in range(6)))


def item_phrases(benchmark: DataFrame, size: int = 10) -> DataFrame:
    """Distinct phrases (``words``) of ``item_id, text`` with the ids that hold them (``items``)."""

    def run(batches):
        for batch in batches:
            ids, phrases = [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = words(text.as_py())
                for i in range(max(1, len(own) - size + 1) if own else 0):
                    ids.append(item)
                    phrases.append(own[i : i + size])
            yield pa.record_batch(
                [pa.array(ids, pa.int64()), pa.array(phrases, pa.list_(pa.binary()))],
                names=["item_id", "words"],
            )

    rows = benchmark.select(
        F.col("item_id").cast("long").alias("item_id"), text_bytes().alias("text")
    ).mapInArrow(run, "item_id long, words array<binary>")
    return rows.groupBy("words").agg(F.collect_set("item_id").alias("items"))


def phrase_matches(index: DataFrame, phrases: DataFrame) -> DataFrame:
    """Per document of the index: the spans that phrases cover, and the items they belong to.

    ``index`` is a written table of ``build_index``. Returns doc_id, n_words, spans
    (start and end word, joined where they touch), items. The phrases go to every task
    in passes of about ``PASS_PHRASES``; answers of several passes are joined by segment
    and document.
    """
    n_passes = -(-phrases.count() // PASS_PHRASES) or 1
    dealt = phrases.withColumn("_pass", F.pmod(F.xxhash64("words"), F.lit(n_passes)))
    if n_passes == 1:
        return _search(index, dealt).drop("_segment", "_ordinal")
    answers = None
    for i in range(n_passes):
        own = _search(index, dealt.where(F.col("_pass") == i))
        answers = own if answers is None else answers.unionByName(own)
    return (
        answers.groupBy("_segment", "_ordinal")
        .agg(
            F.first("doc_id").alias("doc_id"),
            F.first("n_words").alias("n_words"),
            F.flatten(F.collect_list("spans")).alias("spans"),
            F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
        )
        .mapInArrow(_join_spans, _ANSWER)
        .drop("_segment", "_ordinal")
    )


_ANSWER = (
    "_segment string, _ordinal int, doc_id long, n_words long, "
    "spans array<struct<start:int,end:int>>, items array<long>"
)


def _search(index: DataFrame, phrases: DataFrame) -> DataFrame:
    rows = phrases.select("words", "items").collect()
    texts = [tuple(bytes(word) for word in row["words"]) for row in rows]
    items = [row["items"] for row in rows]
    del rows

    def run(batches):
        for segment in _opened(batches):
            phrase, start = segment.phrase_starts(texts)
            yield _answers(segment, phrase, start, texts, items)

    return index.mapInArrow(run, _ANSWER)


def _answers(segment, phrase, start, texts, items) -> pa.RecordBatch:
    n_docs = len(segment.doc_ids)
    change = np.zeros(segment.size + 1, np.int64)
    end = start + np.array([len(texts[i]) for i in phrase.tolist()], np.int64)
    np.add.at(change, start, 1)
    np.add.at(change, end, -1)
    hit = np.cumsum(change) > 0
    edges = np.flatnonzero(np.diff(hit.astype(np.int8), prepend=np.int8(0)))
    first, last = edges[0::2], edges[1::2]
    doc = segment.doc_of(first)
    lengths = np.bincount(doc, minlength=n_docs)
    spans = pa.StructArray.from_arrays(
        [
            pa.array(first - segment.first[doc], pa.int32()),
            pa.array(last - segment.first[doc], pa.int32()),
        ],
        names=["start", "end"],
    )
    named: dict[int, set] = {}
    for d, p in set(zip(segment.doc_of(start).tolist(), phrase.tolist(), strict=True)):
        named.setdefault(d, set()).update(items[p])
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.record_batch(
        [
            pa.array([segment.name] * n_docs, pa.string()),
            pa.array(np.arange(n_docs), pa.int32()),
            pa.array(segment.doc_ids, pa.int64()),
            pa.array(segment.n_words, pa.int64()),
            pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans),
            pa.array([sorted(named.get(d, ())) for d in range(n_docs)], pa.list_(pa.int64())),
        ],
        names=["_segment", "_ordinal", "doc_id", "n_words", "spans", "items"],
    )


def _join_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index("spans")
        joined = []
        for spans in batch.column(at).to_pylist():
            own: list[dict] = []
            for span in sorted(spans, key=lambda s: (s["start"], s["end"])):
                if own and span["start"] <= own[-1]["end"]:
                    own[-1]["end"] = max(own[-1]["end"], span["end"])
                else:
                    own.append(dict(span))
            joined.append(own)
        yield batch.set_column(at, batch.schema.field(at), pa.array(joined, batch.schema.field(at).type))


def proximity_matches(index: DataFrame, groups: DataFrame, within: int) -> DataFrame:
    """Places where all terms of a group (``words``, ``items``) stand close together.

    One row per position of the group's rarest term that has every other term at most
    ``within`` words away in the same document: doc_id, word, items. The groups are a
    stated query set, taken in passes of about ``PASS_PHRASES``.
    """
    n_passes = -(-groups.count() // PASS_PHRASES) or 1
    dealt = groups.withColumn("_pass", F.pmod(F.xxhash64("words"), F.lit(n_passes)))
    answers = None
    for i in range(n_passes):
        own = _near(index, dealt.where(F.col("_pass") == i), within)
        answers = own if answers is None else answers.unionByName(own)
    return answers


def _near(index: DataFrame, groups: DataFrame, within: int) -> DataFrame:
    rows = groups.select("words", "items").collect()
    terms = [tuple(dict.fromkeys(bytes(word) for word in row["words"])) for row in rows]
    items = [row["items"] for row in rows]
    del rows

    def run(batches):
        for segment in _opened(batches):
            group, position = segment.near(terms, within)
            doc = segment.doc_of(position)
            yield pa.record_batch(
                [
                    pa.array([segment.doc_ids[d] for d in doc.tolist()], pa.int64()),
                    pa.array(position - segment.first[doc], pa.int64()),
                    pa.array([items[g] for g in group.tolist()], pa.list_(pa.int64())),
                ],
                names=["doc_id", "word", "items"],
            )

    return index.mapInArrow(run, "doc_id long, word long, items array<long>")


def overlap_report(index: DataFrame, phrases: DataFrame) -> DataFrame:
    """Counts per document: n_words, n_hit (words inside a phrase), items, contaminated."""
    hit = F.aggregate("spans", F.lit(0), lambda total, s: total + s["end"] - s["start"])
    return phrase_matches(index, phrases).select(
        "doc_id",
        "n_words",
        hit.cast("long").alias("n_hit"),
        "items",
        (hit > 0).alias("contaminated"),
    )

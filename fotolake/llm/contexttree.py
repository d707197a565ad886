"""Language-model scores by context-tree weighting over bytes.

A byte is eight binary decisions; each has a context tree of its own, whose nodes are the
preceding 0 to ``DEPTH`` bytes. A node's Krichevsky-Trofimov estimate is mixed, with weight
one half before any data, with the product of its children's mixtures; so all depths take
part, each by how well it has predicted the training texts. A text's score adds the log10
probabilities of its bytes (A-Z lower-cased) and of its end. ``bits_per_byte`` gives the
code length.

The counts of the whole training part are a table of byte strings of ``DEPTH + 1`` bytes,
and the tree is a table per depth: going up, nodes are grouped to their shorter contexts;
going down, every node takes the mixture of its shorter context by a join. No table is
sent to the driver.

The model comes to the texts by shards: a task gathers whole texts up to ``SHARD_BYTES``
and writes the words and byte strings that occur in them once, with their counts in
training texts. Summed over shards these rows are the model's counts; joined with the
finished model they are all that the shard's texts need. A word that stands in every text
is thus a row per shard, never a row per text, and counts are combined before the shuffle.

Defined results: a null text is an empty one, which has an end; a null id counts as the
empty id, which is held out; repeated rows are scored and counted each; without training
texts all counts are 0 and every decision has probability one half; other columns are
ignored. A text longer than a shard is a shard of its own.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fotolake.llm.common import bytes_of, stored, text_bytes, whole_keys

DEPTH = 4
SHARD_BYTES = 1 << 26
HELD_OUT_OF = 10
# Distinct byte strings that are merged at once.
_MERGE = 1 << 21
# Bytes of text that are cut to strings at once.
_PART = 1 << 21
# Tokens have no white space, so a space can stand for the end of a text.
_END_TOKEN = b" "
# A byte that UTF-8 does not have.
_END = b"\xff"
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

_DOC, _WORD, _GRAM = 0, 1, 2
_ROWS = (
    "kind int, shard long, doc_id long, held_out boolean, packed binary, "
    "word binary, gram long, n long"
)
_SCORES = (
    "doc_id long, held_out boolean, n_bytes long, n_tokens long, n_known long, "
    "base_score double, score double"
)


def is_held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % HELD_OUT_OF == 0


def tokens(data: bytes) -> list[bytes]:
    """Words of lower-cased bytes, and the end."""
    return [*data.split(), _END_TOKEN]


def byte_strings(data: bytes, depth: int, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Every byte from ``start`` to ``stop``, the end included, with the ``depth`` bytes before it.

    Before the first byte stand zeros.
    """
    whole = bytes(depth) + data + _END
    stop = len(data) + 1 if stop is None else stop
    part = np.frombuffer(whole, np.uint8)[start : stop + depth].astype(np.uint64)
    out = np.zeros(stop - start, np.uint64)
    for j in range(depth + 1):
        out = (out << np.uint64(8)) | part[j : j + stop - start]
    return out


class _Asked:
    """Distinct words and byte strings of a shard, with their counts in training texts."""

    def __init__(self, depth: int) -> None:
        self.depth = depth
        self.words: Counter = Counter()
        self.grams: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.waiting: tuple[list, list] = ([], [])
        self.n_waiting = self.n_grams = self.n_bytes = 0

    def add(self, data: bytes, held_out: bool) -> None:
        found = tokens(data)
        if held_out:
            for word in set(found):
                self.words[word] += 0
        else:
            self.words.update(found)
        for start in range(0, len(data) + 1, _PART):
            stop = min(start + _PART, len(data) + 1)
            self.waiting[held_out].append(byte_strings(data, self.depth, start, stop))
            self.n_waiting += stop - start
            if self.n_waiting >= _PART:
                self.settle()
        self.n_bytes += len(data) + 1

    def settle(self) -> None:
        for held_out, parts in enumerate(self.waiting):
            if parts:
                gram, count = np.unique(np.concatenate(parts), return_counts=True)
                self.grams.append(gram)
                self.counts.append(np.zeros_like(count) if held_out else count)
                self.n_grams += len(gram)
        self.waiting, self.n_waiting = ([], []), 0
        if self.n_grams >= _MERGE and len(self.grams) > 2:
            self.merge()

    def merge(self) -> None:
        gram, own = np.unique(np.concatenate(self.grams), return_inverse=True)
        count = np.bincount(own, np.concatenate(self.counts), len(gram)).astype(np.int64)
        self.grams, self.counts, self.n_grams = [gram], [count], 0

    def batches(self, shard: int) -> Iterator[pa.RecordBatch]:
        self.settle()
        if self.grams:
            self.merge()
            for i in range(0, len(self.grams[0]), 1 << 18):
                gram = self.grams[0][i : i + (1 << 18)].view(np.int64)
                yield _rows(_GRAM, shard, gram=gram, n=self.counts[0][i : i + (1 << 18)])
        names = list(self.words)
        for i in range(0, len(names), 1 << 16):
            part = names[i : i + (1 << 16)]
            n = np.array([self.words[name] for name in part], np.int64)
            yield _rows(_WORD, shard, word=pa.array(part, pa.binary()), n=n)


def _rows(kind: int, shard: int, **given) -> pa.RecordBatch:
    size = len(next(iter(given.values())))
    kinds = {
        "kind": pa.int32(), "shard": pa.int64(), "doc_id": pa.int64(), "held_out": pa.bool_(),
        "packed": pa.binary(), "word": pa.binary(), "gram": pa.int64(), "n": pa.int64(),
    }
    given |= {"kind": np.full(size, kind, np.int32), "shard": np.full(size, shard, np.int64)}
    arrays = [
        pa.array(given[name], own) if name in given else pa.nulls(size, own)
        for name, own in kinds.items()
    ]
    return pa.record_batch(arrays, names=list(kinds))


def sharded(docs: DataFrame, depth: int = DEPTH, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Rows of texts, of words and of byte strings, each with its shard.

    Written before it is used, so that a shard stays as it is when a task is run again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        shard = asked = None
        for batch in batches:
            names, parts = batch.column(1).to_pylist(), batch.column(0)
            rows, size = ([], [], []), 0
            for part, doc_id, text in zip(parts, names, bytes_of(batch.column(2)), strict=True):
                shard = part.as_py() << 32 if shard is None else shard
                asked = asked or _Asked(depth)
                data, held_out = bytes(text).translate(_LOWER), is_held_out(doc_id)
                asked.add(data, held_out)
                for column, value in zip(rows, (doc_id, held_out, pack(data)), strict=True):
                    column.append(value)
                size += len(rows[2][-1])
                full = asked.n_bytes >= shard_bytes
                if full or size > _PART:
                    yield _doc_rows(shard, rows)
                    rows, size = ([], [], []), 0
                if full:
                    yield from asked.batches(shard)
                    shard, asked = shard + 1, None
            if rows[0]:
                yield _doc_rows(shard, rows)
        if asked:
            yield from asked.batches(shard)

    return docs.select(
        F.spark_partition_id().cast("long").alias("part"),
        F.col("doc_id").cast("long").alias("doc_id"),
        text_bytes().alias("text"),
    ).mapInArrow(run, _ROWS)


def _doc_rows(shard: int, rows: tuple) -> pa.RecordBatch:
    return _rows(_DOC, shard, doc_id=rows[0], held_out=rows[1], packed=rows[2])


# --- the tree ------------------------------------------------------------------


def log_gamma(x: Column) -> Column:
    """ln of the gamma function for x > 0, by Stirling's series at x + 8."""
    z = x + 8
    series = 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z)
    shift = F.lit(0.0)
    for k in range(0, 8, 2):
        shift = shift + F.log((x + k) * (x + (k + 1)))
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - shift


def _with_estimate(nodes: DataFrame) -> DataFrame:
    """``own``: ln of the block probability that the node's estimator gives its decisions."""
    n0, n1 = F.col("n0").cast("double"), F.col("n1").cast("double")
    block = log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1) - math.log(math.pi)
    return nodes.withColumn("own", F.when(F.col("n0") + F.col("n1") > 0, block).otherwise(F.lit(0.0)))


_NODES = "context long, node int, n0 long, n1 long"


def deepest_nodes(grams: DataFrame) -> DataFrame:
    """context, node, n0, n1: the decisions in every context of the byte strings.

    Byte strings are dealt by their contexts, which have 256 strings at most, and sorted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_keys(batches, ["context"]):
            context, gram, n = (table.column(c).to_numpy() for c in ("context", "gram", "n"))
            byte, parts = gram & 255, []
            for k in range(8):
                name, bit = _decision(byte, k)
                key = context * 256 + name
                first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                ones = np.add.reduceat(n * bit, first)
                all_of = np.add.reduceat(n, first)
                parts.append((context[first], name[first], all_of - ones, ones))
            columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
            columns[1] = columns[1].astype(np.int32)
            yield pa.record_batch(list(map(pa.array, columns)), names=["context", "node", "n0", "n1"])

    rows = grams.select(F.shiftrightunsigned("gram", 8).alias("context"), "gram", "n")
    dealt = rows.repartition("context").sortWithinPartitions("context", "gram")
    return dealt.mapInArrow(run, _NODES)


def _decision(byte: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Node and bit of the k-th decision of bytes."""
    return (1 << k) | (byte >> (8 - k)), (byte >> (7 - k)) & 1


def grow(grams: DataFrame, depth: int = DEPTH) -> DataFrame:
    """context, node, p: for every context of ``depth`` bytes the probability of bit 1.

    ``grams`` has gram and n; strings with n = 0 only have their contexts named.
    """
    half = math.log(0.5)
    deepest = _with_estimate(deepest_nodes(grams)).select(
        "context", "node", "n0", "n1", F.col("own").alias("mixed"),
        F.lit(1.0).alias("stay"), F.lit(0.0).alias("go"),
    )
    levels = [stored(deepest, "nodes")]
    for d in range(depth - 1, -1, -1):
        shorter = F.col("context").bitwiseAND(F.lit((1 << 8 * d) - 1)).alias("context")
        grouped = levels[-1].groupBy(shorter, "node").agg(
            F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("mixed").alias("below")
        )
        own, below = F.col("own") + half, F.col("below") + half
        mixed = F.greatest(own, below) + F.log1p(F.exp(-F.abs(own - below)))
        grouped = _with_estimate(grouped).withColumn("mixed", mixed)
        level = grouped.select(
            "context", "node", "n0", "n1", "mixed",
            F.exp(own - F.col("mixed")).alias("stay"),
            F.exp(below - F.col("mixed")).alias("go"),
        )
        levels.append(stored(level, "nodes"))
    levels.reverse()
    estimate = (F.col("n1") + 0.5) / (F.col("n0") + F.col("n1") + 1)
    above = levels[0].select(
        "context", "node",
        (F.col("stay") * estimate).alias("p"), F.col("go").alias("left"),
    )
    for d in range(1, depth + 1):
        shorter = F.col("context").bitwiseAND(F.lit((1 << 8 * (d - 1)) - 1))
        upper = above.select(
            F.col("context").alias("_context"), F.col("node").alias("_node"),
            F.col("p").alias("_p"), "left",
        )
        joined = levels[d].join(
            upper, (shorter == F.col("_context")) & (F.col("node") == F.col("_node"))
        )
        above = stored(
            joined.select(
                "context", "node",
                (F.col("_p") + F.col("left") * F.col("stay") * estimate).alias("p"),
                (F.col("left") * F.col("go")).alias("left"),
            ),
            "mixtures",
        )
    return above.select("context", "node", "p")


def string_scores(grams: DataFrame, tree: DataFrame) -> DataFrame:
    """gram, value: log10 probability of the last byte of every string after the others.

    The strings and the nodes of a context, 256 and 255 at most, come to one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_keys(batches, ["context"]):
            context, gram, node, p = (table.column(c).to_numpy() for c in range(4))
            is_node = gram < 0
            # Sorted, as the rows are.
            names, p = context[is_node] * 256 + node[is_node], p[is_node]
            context, gram = context[~is_node], gram[~is_node]
            value = np.zeros(len(gram))
            for k in range(8):
                own, bit = _decision(gram & 255, k)
                one = p[np.searchsorted(names, context * 256 + own)]
                value += np.log10(np.where(bit == 1, one, 1 - one))
            yield pa.record_batch([pa.array(gram), pa.array(value)], names=["gram", "value"])

    strings = grams.select(
        F.shiftrightunsigned("gram", 8).alias("context"),
        "gram",
        F.lit(0).alias("node"),
        F.lit(0.0).alias("p"),
    )
    nodes = tree.select("context", F.lit(-1).cast("long").alias("gram"), "node", "p")
    dealt = nodes.unionByName(strings).repartition("context")
    dealt = dealt.sortWithinPartitions("context", "gram", "node")
    return dealt.mapInArrow(run, "gram long, value double")


# --- scores --------------------------------------------------------------------


def score_texts(
    docs: DataFrame, depth: int = DEPTH, shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """Per row: doc_id, held_out, n_bytes, n_tokens, n_known, train_tokens, base_score, score."""
    rows = stored(sharded(docs, depth, shard_bytes), "shards")
    asked_words = rows.where(F.col("kind") == _WORD).select("shard", "word", "n")
    asked_grams = rows.where(F.col("kind") == _GRAM).select("shard", "gram", "n")
    words = stored(asked_words.groupBy("word").agg(F.sum("n").alias("value")), "words")
    n_all, n_distinct = words.agg(F.sum("value"), F.count_if(F.col("value") > 0)).first()
    n_all = n_all or 0
    grams = stored(asked_grams.groupBy("gram").agg(F.sum("n").alias("n")), "grams")
    values = stored(string_scores(grams, grow(grams, depth)), "values")
    # One table of all that the shards asked for; counts are whole as doubles.
    model = (
        asked_grams.join(values, "gram")
        .select("shard", F.lit(None).cast("binary").alias("word"), "gram", "value")
        .unionByName(
            asked_words.join(words, "word").select(
                "shard", "word", F.lit(None).cast("long").alias("gram"),
                F.col("value").cast("double").alias("value"),
            )
        )
    )
    texts = rows.where(F.col("kind") == _DOC).select(
        F.col("shard").alias("own_shard"), "doc_id", "held_out", "packed"
    )
    under = math.log10(n_all + 0.1 * (n_distinct + 1))

    def score(texts: pa.Table, model: pa.Table) -> pa.Table:
        return _score_shard(texts, model, depth, under)

    both = texts.groupBy("own_shard").cogroup(model.groupBy("shard"))
    found = both.applyInArrow(score, _SCORES)
    return found.withColumn("train_tokens", F.lit(n_all).cast("long"))


class _Finder:
    """Places of values in a sorted array: by a table of slots, the few others by search."""

    def __init__(self, values: np.ndarray) -> None:
        self.order = np.argsort(values)
        self.values = values[self.order]
        bits = max(8, (4 * len(values)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.slots = np.zeros(1 << bits, np.int32)
        self.slots[self._slot(self.values)] = np.arange(len(values), dtype=np.int32)

    def _slot(self, values: np.ndarray) -> np.ndarray:
        return (values * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def __call__(self, values: np.ndarray) -> np.ndarray:
        found = self.slots[self._slot(values)]
        wrong = np.flatnonzero(self.values[found] != values)
        found[wrong] = np.searchsorted(self.values, values[wrong])
        return found


def _score_shard(texts: pa.Table, model: pa.Table, depth: int, under: float) -> pa.Table:
    gram, value = model.column("gram"), model.column("value")
    is_word = gram.is_null()
    names = model.column("word").filter(is_word).to_pylist()
    counts = dict(zip(names, value.filter(is_word).to_pylist(), strict=True))
    gram = gram.filter(gram.is_valid()).to_numpy().view(np.uint64)
    value = value.filter(model.column("gram").is_valid()).to_numpy()
    find = _Finder(gram)
    value = value[find.order]
    unpack = zstandard.ZstdDecompressor().decompress
    out = []
    rows = zip(*(texts.column(c) for c in ("doc_id", "held_out", "packed")), strict=True)
    for doc_id, held_out, packed in rows:
        data = unpack(packed.as_py())
        found = tokens(data)
        count = np.fromiter(map(counts.__getitem__, found), float, len(found))
        score = 0.0
        for start in range(0, len(data) + 1, _PART):
            stop = min(start + _PART, len(data) + 1)
            own = byte_strings(data, depth, start, stop)
            score += float(value[find(own)].sum())
        out.append(
            (
                doc_id.as_py(), held_out.as_py(), len(data), len(found), int((count > 0).sum()),
                float((np.log10(count + 0.1) - under).sum()), score,
            )
        )
    kinds = (pa.int64(), pa.bool_(), *[pa.int64()] * 3, pa.float64(), pa.float64())
    columns = list(zip(*out, strict=True)) or [()] * len(kinds)
    names = [part.split()[0] for part in _SCORES.split(", ")]
    return pa.table(
        [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=names
    )


def bits_per_byte() -> Column:
    """Code length of a scored text, per byte, its end included."""
    return -F.col("score") * F.lit(math.log2(10)) / (F.col("n_bytes") + 1)

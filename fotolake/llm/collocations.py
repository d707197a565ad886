"""Phrase collocations by partitioned mining of frequent phrases.

A phrase of up to five words is frequent if it occurs ``support`` times in its language.
Tasks gather whole texts to shards of about ``SHARD_WORDS`` words, and each shard is mined
completely in memory: it reports every phrase of the step's lengths once, with its count.
Spark adds these up by the words themselves, and what reaches the support is frequent.

Words come first, then pairs, then longer phrases. A step only looks at phrases whose
shorter parts are all frequent, by the exact counts of the steps before. No shard has a
threshold of its own, as it would fall with every further shard: the rows of a step are
the distinct phrases of its shards, which at most keep pace with the input, no phrase is
kept silent, and no text is read again to complete a count.

Frequent phrases are told to the tasks by one bit set over hashes of at most ``MAX_BITS``
bits, whatever their number. A bit set by chance only lets one more phrase be counted,
which is then dropped by its exact count, so neither counts nor results depend on hashes.

Scores use decimals of 38 digits and whole division.

Defined results: null texts have no words; a null language is ``und``; repeated rows count
each; a language without words has no rows; phrases never cross a separator or a text;
texts of any length are cut at separators to several shards, with equal counts; equal
scores stand by count and by phrase in byte order; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fotolake.llm.common import WordHashes, bytes_of, mix, signed, stored, text_bytes

SUPPORT = 100
LONGEST = 5
SHARD_WORDS = 1 << 22
TOP = 2000
# 8 MB: what a pass sends to every task at most.
MAX_BITS = 1 << 26
_PROBES = 3
# Bytes of a text that a shard takes at once.
_PART = 1 << 20

_U = np.uint64
_BREAK = b"."
# A-Z to a-z, tab to space, and the separators of pieces to one of them.
_BYTES = bytes(
    b + 32 if 65 <= b <= 90
    else 32 if b == 9
    else 46 if b in b".,;:!?\n\v\f\r"
    else b
    for b in range(256)
)

# What a task sends at once.
_ROWS, _BYTES_SENT = 1 << 16, 1 << 24
_COUNTED = "lang string, phrase binary, n long"
_NAMED = "lang string, phrase binary, size int, hash long, f long"


class _Shard:
    """Some texts, per language, as parts with one kind of space and of break."""

    def __init__(self) -> None:
        self.texts: dict[str, list[bytes]] = {}
        self.size = 0

    def add(self, lang: str, part: bytes) -> None:
        self.texts.setdefault(lang, []).append(part)
        # Words and breaks, or some more.
        self.size += part.count(b" ") + part.count(_BREAK) + 1

    def take_open(self, lang: str) -> list[bytes]:
        """What follows the last break of ``lang``, taken out of the shard."""
        parts, rest = self.texts[lang], []
        while parts:
            part = parts.pop()
            start = part.rfind(_BREAK) + 1
            rest.append(part[start:])
            if start:
                parts.append(part[:start])
                break
        return rest[::-1]

    def numbered(self) -> tuple[pa.Array, dict[str, np.ndarray]]:
        """Distinct words, and per language their numbers in order; a break is 0."""
        found = [pa.array([_BREAK], pa.large_binary())]
        found += [_words(b" ".join(parts)) for parts in self.texts.values()]
        names, *ids = pa.chunked_array(found).dictionary_encode().chunks
        numbers = (own.indices.to_numpy() for own in ids)
        return names.dictionary, dict(zip(self.texts, numbers, strict=True))


def _words(data: bytes) -> pa.Array:
    """Words and breaks: what lies between spaces, with every break on its own."""
    own = np.frombuffer(data, np.uint8)
    there, ends = own != 32, own == _BREAK[0]
    first = there.copy()
    first[1:] &= ~there[:-1] | ends[:-1] | ends[1:]
    starts = np.flatnonzero(first[there])
    offsets = np.append(starts, np.count_nonzero(there))
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(own[there])]
    return pa.Array.from_buffers(pa.large_binary(), len(starts), buffers)


def _parts(text: memoryview) -> Iterator[tuple[bytes, bool]]:
    """Parts of a text, cut at spaces, and whether it ends here."""
    data = bytes(text).translate(_BYTES)
    start = 0
    while (end := data.find(b" ", start + _PART)) >= 0:
        yield data[start:end], False
        start = end
    yield data[start:] + _BREAK, True


def shards(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[_Shard]:
    """Shards of batches of lang, text."""
    shard = _Shard()
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), bytes_of(batch.column(1)), strict=True):
            for part, ends in _parts(text):
                shard.add(lang, part)
                if shard.size < most:
                    continue
                rest = [] if ends else shard.take_open(lang)
                if not any(shard.texts.values()):
                    # One piece fills the shard: it stays whole.
                    shard.texts[lang] = rest
                    continue
                yield shard
                shard = _Shard()
                for part in rest:
                    shard.add(lang, part)
    if shard.texts:
        yield shard


def _in_bits(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    width = _U(len(bits) * 64 - 1)
    found = np.ones(len(hashes), bool)
    for probe in range(_PROBES):
        at = (hashes >> _U(probe * 19)) & width
        found &= (bits[(at >> _U(6)).astype(np.int64)] >> (at & _U(63))) & _U(1) > 0
    return found


def _name(words: np.ndarray) -> np.ndarray:
    """Hashes of phrases: rows of hashes of words."""
    name = np.full(len(words), words.shape[1], np.uint64)
    for own in words.T:
        name = mix(name * _U(0x9E3779B97F4A7C15) ^ own)
    return name


def _distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A place of each distinct key, its count, and the number of the key at each place."""
    order = np.argsort(key)
    ordered = key[order]
    new = np.ones(len(key), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    starts = np.flatnonzero(new)
    own = np.empty(len(key), np.int64)
    own[order] = np.cumsum(new) - 1
    return order[starts], np.diff(starts, append=len(key)), own


def _distinct_words(
    ids: np.ndarray, at: np.ndarray, n_ids: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same of words, by place in ``ids``: they are numbers already."""
    words = ids[at]
    counts = np.bincount(words, minlength=n_ids)
    there = np.flatnonzero(counts)
    place, number = np.zeros(n_ids, np.int64), np.zeros(n_ids, np.int64)
    place[words] = at
    number[there] = np.arange(len(there))
    return place[there], counts[there], number[words]


def mined(
    ids: np.ndarray, hashes: np.ndarray, sizes: tuple[int, ...], known: np.ndarray | None
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per length of ``sizes``, which follow each other: length, places and counts of the phrases.

    ``ids`` are words, 0 for a break; ``hashes`` those of the words by id. A phrase needs
    both its parts of one word less; parts shorter than ``sizes`` need their bits in ``known``.
    """
    n_ids = len(hashes)
    kept = ids.astype(np.int64)
    for size in range(1, sizes[-1] + 1):
        if size == 1:
            at = np.flatnonzero(kept)
            place, counts, own = _distinct_words(ids, at, n_ids)
        else:
            at = np.flatnonzero((kept[:-1] > 0) & (kept[1:] > 0))
            at = at[at + size - 1 < len(ids)]
            first, counts, own = _distinct(kept[at] * n_ids + ids[at + size - 1])
            place = at[first]
        if not len(at):
            return
        number = np.arange(1, len(place) + 1)
        if size in sizes:
            yield size, place, counts
        else:
            name = _name(hashes[ids[place[:, None] + np.arange(size)]])
            number[~_in_bits(known, name)] = 0
        kept = np.zeros(len(ids), np.int64)
        kept[at] = number[own]


def _counted(
    texts: DataFrame, most: int, sizes: tuple[int, ...], known: np.ndarray | None
) -> DataFrame:
    """Phrases of the lengths ``sizes`` (lang, phrase, f) whose shorter parts are ``known``.

    With words come rows without phrase: the words of a language.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_hash = WordHashes()
        for shard in shards(batches, most):
            words, numbers = shard.numbered()
            hashes = word_hash.of(words.to_pylist())
            lengths = pc.binary_length(words).to_numpy() + 1
            for lang, ids in numbers.items():
                if 1 in sizes:
                    yield _batch(lang, pa.nulls(1, pa.binary()), np.array([(ids > 0).sum()]))
                for size, place, counts in mined(ids, hashes ^ _salt(lang), sizes, known):
                    spans = ids[place[:, None] + np.arange(size)]
                    # Rows of one count and length follow each other: the shuffle packs them better.
                    order = np.lexsort((lengths[spans].sum(axis=1), counts))
                    spans, counts = spans[order], counts[order]
                    for cut in _cuts(lengths[spans].sum(axis=1)):
                        own = [words.take(pa.array(column)) for column in spans[cut].T]
                        yield _batch(lang, _joined(own), counts[cut])

    # Shards report a phrase once, so nothing is to be added up before the shuffle.
    return (
        texts.mapInArrow(run, _COUNTED)
        .repartition("lang", "phrase")
        .groupBy("lang", "phrase")
        .agg(F.sum("n").alias("f"))
    )


def _salt(lang: str) -> np.uint64:
    return mix(np.array([WordHashes()[lang.encode()]], np.uint64))[0]


def _cuts(lengths: np.ndarray) -> Iterator[slice]:
    """Slices of bounded rows and, but for single rows, bytes."""
    ends = np.cumsum(lengths)
    full = np.searchsorted(ends, np.arange(_BYTES_SENT, ends[-1], _BYTES_SENT))
    starts = np.unique(np.concatenate([np.arange(0, len(ends), _ROWS), full])).tolist()
    yield from map(slice, starts, [*starts[1:], len(ends)])


def _joined(words: list[pa.Array]) -> pa.Array:
    space = pa.scalar(b" ", pa.large_binary())
    return pc.binary_join_element_wise(*words, space).cast(pa.binary())


def _batch(lang: str, phrases: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
    langs = pa.array([lang] * len(phrases), pa.string())
    columns = [langs, phrases, pa.array(counts.astype(np.int64))]
    return pa.record_batch(columns, names=["lang", "phrase", "n"])


def _named(phrases: DataFrame) -> DataFrame:
    """With size and hash; rows without phrase have no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_hash, salts = WordHashes(), {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            words = [p.split(b" ") if p else [] for p in batch.column(1).to_pylist()]
            sizes = np.fromiter(map(len, words), np.int32, len(words))
            salts |= {lang: _salt(lang) for lang in set(langs) - salts.keys()}
            hashes = np.zeros(len(words), np.uint64)
            for size in set(sizes.tolist()) - {0}:
                rows = np.flatnonzero(sizes == size)
                flat = word_hash.of([w for i in rows for w in words[i]]).reshape(-1, size)
                salt = np.array([salts[langs[i]] for i in rows], np.uint64)
                hashes[rows] = _name(flat ^ salt[:, None])
            own, phrase, f = batch.columns
            columns = [own, phrase, pa.array(sizes), pa.array(signed(hashes)), f]
            yield pa.record_batch(columns, names=["lang", "phrase", "size", "hash", "f"])

    return phrases.mapInArrow(run, _NAMED).withColumn("phrase", F.col("phrase").cast("string"))


def bit_set(phrases: DataFrame, max_bits: int = MAX_BITS) -> np.ndarray:
    """Bits of the ``hash`` of all rows: 16 a row, ``max_bits`` at most.

    Equal words of 64 bits are combined before the shuffle; the driver receives the words,
    whose number is bounded by ``max_bits``.
    """
    count = phrases.count()
    n_bits = min(max_bits, max(1 << 10, 1 << (16 * count - 1).bit_length() if count else 0))
    probes = F.array(
        *(F.shiftrightunsigned("hash", 19 * p).bitwiseAND(F.lit(n_bits - 1)) for p in range(_PROBES))
    )
    at = phrases.select(F.explode(probes).alias("at"))
    # The value of a shift by a column.
    words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("bits")
    )
    found = words.toArrow()
    bits = np.zeros(n_bits // 64, np.uint64)
    bits[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return bits


def frequent_phrases(
    docs: DataFrame,
    support: int = SUPPORT,
    longest: int = LONGEST,
    shard_words: int = SHARD_WORDS,
) -> tuple[DataFrame, DataFrame]:
    """Phrases (lang, phrase, size, f) with f >= support, and words per lang."""
    texts = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
        text_bytes().alias("text"),
    )
    # Beyond three words few phrases are left, so two lengths share a reading of the texts.
    longer = (tuple(range(s, min(s + 2, longest + 1))) for s in range(4, longest + 1, 2))
    steps = [(1,), (2,), (3,), *longer]
    found, known = [], None
    for sizes in steps[: max(longest, 1)]:
        counts = _counted(texts, shard_words, sizes, known)
        enough = (F.col("f") >= support) | F.col("phrase").isNull()
        found.append(stored(_named(counts.where(enough)), "frequent"))
        frequent = reduce(DataFrame.unionByName, found).where("size > 0")
        if sizes[-1] < longest:
            known = bit_set(frequent)
    langs = found[0].where("size = 0").select("lang", F.col("f").alias("words"))
    return frequent.drop("hash"), langs


def _whole(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("decimal(38,0)")


def collocations(
    docs: DataFrame,
    support: int = SUPPORT,
    longest: int = LONGEST,
    top: int = TOP,
    shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """The ``top`` phrases of every language: lang, rank, phrase, a, l, r, n, score."""
    frequent, langs = frequent_phrases(docs, support, longest, shard_words)
    frequent = stored(frequent, "phrases")
    phrases = frequent.where("size > 1").withColumnRenamed("f", "a")
    words = F.split("phrase", " ")
    cut = F.col("cut")
    cuts = phrases.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("size") - 1))).select(
        "lang", "phrase", "size", "a", "cut",
        F.array_join(F.slice(words, F.lit(1), cut), " ").alias("head"),
        F.array_join(F.slice(words, cut + 1, F.col("size")), " ").alias("tail"),
    )
    heads = frequent.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    tails = frequent.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r"))
    scored = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).join(langs, "lang")
    scored = scored.withColumn(
        "over", _whole(F.lit(1000)) * _whole("a") * _whole("words")
    ).withColumn("under", _whole("l") * _whole("r"))
    lowest = scored.groupBy("lang", "phrase", "a", F.col("words").alias("n")).agg(
        F.min(F.struct(F.expr("over div under").alias("score"), "cut", "l", "r")).alias("best")
    )
    # Of phrases inside longer ones, those one word shorter suffice: counts only fall.
    size = F.col("size")
    inner = F.array(
        F.array_join(F.slice(words, F.lit(1), size - 1), " "),
        F.array_join(F.slice(words, F.lit(2), size - 1), " "),
    )
    held = (
        phrases.where("size > 2")
        .select("lang", F.explode(inner).alias("phrase"), "a")
        .groupBy("lang", "phrase")
        .agg(F.max("a").alias("longer"))
    )
    own = (
        lowest.join(held, ["lang", "phrase"], "left")
        .where("longer is null or longer < a")
        .select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")
    )
    order = [F.col("score").desc(), F.col("a").desc(), "phrase"]
    # First within parts, so that no task orders all phrases of a language.
    part = F.pmod(F.xxhash64("phrase"), F.lit(256))
    first = Window.partitionBy("lang", "_part").orderBy(*order)
    own = own.withColumn("_part", part).withColumn("_rank", F.row_number().over(first))
    ranked = own.where(F.col("_rank") <= top).withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    )
    return ranked.where(F.col("rank") <= top).select(
        "lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score")
    )

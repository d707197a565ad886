"""Similarity of two paths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters of the shorter path that fit one machine word.
_WORD = 64
# Cells (pairs x window starts) worked on at once.
_CELLS = 1 << 16


@F.arrow_udf(T.IntegerType())
def partial_ratio(one: pa.Array, two: pa.Array) -> pa.Array:
    """Best-window similarity as a whole number from 0 to 100.

    The shorter path is laid over every window of its length in the longer one; a window
    counts by the longest common subsequence. An empty path is like nothing (0); null
    with anything gives null.
    """
    scores = np.zeros(len(one), np.int32)
    pairs = []
    for i, (a, b) in enumerate(zip(one.to_pylist(), two.to_pylist(), strict=True)):
        if a and b:
            pairs.append((i, a, b) if len(a) <= len(b) else (i, b, a))
    # Pairs of like sizes share their arrays.
    pairs.sort(key=lambda p: (len(p[1]), len(p[2])))
    start = 0
    while start < len(pairs):
        stop, cells = start, 0
        while stop < len(pairs) and (stop == start or cells < _CELLS):
            cells = (stop - start + 1) * (len(pairs[stop][2]) - len(pairs[start][1]) + 1)
            stop += 1
        part = pairs[start:stop]
        if len(part[-1][1]) > _WORD:
            for i, short, long in part:
                scores[i] = _score(_long_match(short, long), len(short))
        else:
            for (i, short, _), most in zip(part, _matches(part).tolist(), strict=True):
                scores[i] = _score(most, len(short))
        start = stop
    missing = np.asarray(one.is_null()) | np.asarray(two.is_null())
    return pa.array(scores, pa.int32(), mask=missing)


def _score(matched: int, size: int) -> int:
    """100 * matched / size, halves up."""
    return (200 * matched + size) // (2 * size)


def _matches(pairs: list[tuple[int, str, str]]) -> np.ndarray:
    """Longest common subsequence with the best window, for pairs of short and long paths.

    A bit per character of the short path; all pairs and windows go one character on at
    a time (the usual bit-parallel recurrence, which carries upwards only).
    """
    short = [np.frombuffer(p[1].encode("utf-32-le"), np.uint32) for p in pairs]
    long = [np.frombuffer(p[2].encode("utf-32-le"), np.uint32) for p in pairs]
    sizes = np.array([len(s) for s in short])
    widths = np.array([len(s) for s in long])
    letters, number = np.unique(np.concatenate(short), return_inverse=True)
    # The last column is that of all letters the short paths lack, and of what is beyond the end.
    masks = np.zeros((len(pairs), len(letters) + 1), np.uint64)
    row = np.repeat(np.arange(len(pairs)), sizes)
    place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    np.bitwise_or.at(masks, (row, number), np.uint64(1) << place.astype(np.uint64))
    padded = np.full((len(pairs), widths.max() + sizes.max()), len(letters))
    for i, own in enumerate(long):
        at = np.searchsorted(letters, own)
        at[at == len(letters)] = 0
        padded[i, : len(own)] = np.where(letters[at] == own, at, len(letters))
    n_windows = int((widths - sizes).max()) + 1
    free = np.full((len(pairs), n_windows), ~np.uint64(0))
    rows = np.arange(len(pairs))[:, None]
    for j in range(sizes.max()):
        mask = masks[rows, padded[:, j : j + n_windows]]
        mask[sizes <= j] = 0
        hit = free & mask
        free = (free + hit) | (free - hit)
    own_bits = ~np.uint64(0) >> (64 - sizes).astype(np.uint64)
    # Windows that start too late see fewer letters and never win.
    return np.bitwise_count(~free & own_bits[:, None]).max(axis=1)


def _long_match(short: str, long: str) -> int:
    """The same with whole numbers of any length."""
    masks: dict[str, int] = {}
    for i, c in enumerate(short):
        masks[c] = masks.get(c, 0) | 1 << i
    full, best = (1 << len(short)) - 1, 0
    for start in range(len(long) - len(short) + 1):
        free = full
        for c in long[start : start + len(short)]:
            hit = free & masks.get(c, 0)
            free = ((free + hit) | (free - hit)) & full
        best = max(best, len(short) - free.bit_count())
    return best


def partial_levenshtein(one: Column, two: Column) -> Column:
    """Best-window similarity by edit distance, between 0 and 1."""
    swap = F.length(one) > F.length(two)
    short = F.when(swap, two).otherwise(one)
    long = F.when(swap, one).otherwise(two)
    size = F.length(short)
    starts = F.sequence(F.lit(1), F.length(long) - size + 1)
    scores = F.transform(
        starts, lambda start: 1 - F.levenshtein(F.substring(long, start, size), short) / size
    )
    return F.when(size > 0, F.array_max(scores)).when(size == 0, F.lit(0.0))


# --- all pairs of two lists of paths ------------------------------------------------

Words = list[np.ndarray]


def ratio_block(ones: list[str], twos: list[str]) -> np.ndarray:
    """``partial_ratio`` of every path of ``ones`` with every one of ``twos``, in bytes."""
    scores = np.zeros((len(ones), len(twos)), np.uint8)
    for at, size, matched in _best_windows(ones, twos, _common, np.max):
        scores[at] = (200 * matched + size) // (2 * size)
    return scores


def levenshtein_block(ones: list[str], twos: list[str]) -> np.ndarray:
    """100 * ``partial_levenshtein`` of every path of ``ones`` with every one of ``twos``."""
    scores = np.zeros((len(ones), len(twos)))
    for at, size, distance in _best_windows(ones, twos, _distance, np.min):
        scores[at] = 100 * (1 - distance / size)
    return scores


def _best_windows(ones: list[str], twos: list[str], kernel, best) -> Iterator[tuple]:
    """For each path, as the shorter one, its best windows in all longer paths of the other list.

    Yields places in the scores, the size of the shorter path and the values there. Of paths
    of equal length that of ``ones`` is the shorter. Empty paths are in no pair.
    """
    letters = {c: i for i, c in enumerate(sorted({c for path in (*ones, *twos) for c in path}))}
    for flip, short, long in ((False, ones, twos), (True, twos, ones)):
        order = sorted(range(len(long)), key=lambda i: -len(long[i]))
        sizes = np.array([len(long[i]) for i in order], np.int64)
        # A column per long path, longest first; what is beyond its end is no letter at all.
        codes = np.full((sizes.max(initial=0), len(long)), len(letters))
        for column, i in enumerate(order):
            codes[: len(long[i]), column] = [letters[c] for c in long[i]]
        places = np.array(order, np.int64)
        for i, path in enumerate(short):
            size = len(path)
            n = int(np.count_nonzero(sizes > size if flip else sizes >= size))
            if not size or not n:
                continue
            # Half words for short paths, as half the bytes are moved.
            word = np.uint32 if size <= _WORD // 2 else np.uint64
            masks = np.zeros((-(-size // _WORD), len(letters) + 1), word)
            for at, c in enumerate(path):
                masks[at // _WORD, letters[c]] |= word(1 << at % _WORD)
            values = kernel(masks, codes[: sizes[0], :n], size)
            inside = np.arange(len(values))[:, None] <= sizes[:n] - size
            worst = 0 if best is np.max else size
            values = best(np.where(inside, values, worst), axis=0)
            yield ((places[:n], i) if flip else (i, places[:n])), size, values


def _common(masks: np.ndarray, codes: np.ndarray, size: int) -> np.ndarray:
    """Longest common subsequences with all windows: a row per start, a column per long path."""
    seen = [mask[codes] for mask in masks]
    width = len(codes) - size + 1
    free = [np.full((width, codes.shape[1]), ~mask.dtype.type(0)) for mask in masks]
    for j in range(size):
        here = [s[j : j + width] for s in seen]
        moved = _plus(free, [f & h for f, h in zip(free, here, strict=True)])
        free = [m | (f & ~h) for m, f, h in zip(moved, free, here, strict=True)]
    return _count([~f for f in free], size)


def _distance(masks: np.ndarray, codes: np.ndarray, size: int) -> np.ndarray:
    """Edit distances to all windows, by the usual bits of vertical steps up and down."""
    seen = [mask[codes] for mask in masks]
    width = len(codes) - size + 1
    up = [np.full((width, codes.shape[1]), ~mask.dtype.type(0)) for mask in masks]
    down = [np.zeros_like(u) for u in up]
    for j in range(size):
        here = [s[j : j + width] for s in seen]
        carried = _plus([h & u for h, u in zip(here, up, strict=True)], up)
        level = [(c ^ u) | h for c, u, h in zip(carried, up, here, strict=True)]
        right = _shift([d | ~(x | u) for d, x, u in zip(down, level, up, strict=True)], 1)
        left = _shift([u & x for u, x in zip(up, level, strict=True)], 0)
        steep = [h | d for h, d in zip(here, down, strict=True)]
        up = [x | ~(s | r) for x, s, r in zip(left, steep, right, strict=True)]
        down = [r & s for r, s in zip(right, steep, strict=True)]
    return size + _count(up, size) - _count(down, size)


def _plus(a: Words, b: Words) -> Words:
    """Sums of numbers of one or more words, lowest first."""
    if len(a) == 1:
        return [a[0] + b[0]]
    out, carry = [], np.uint64(0)
    for x, y in zip(a, b, strict=True):
        part = x + y
        whole = part + carry
        carry = ((part < x) | (whole < part)).astype(np.uint64)
        out.append(whole)
    return out


def _shift(a: Words, low: int) -> Words:
    """Numbers shifted up by one bit, with a new lowest one."""
    if len(a) == 1:
        up = a[0] << a[0].dtype.type(1)
        return [up | a[0].dtype.type(1)] if low else [up]
    out, carry = [], np.uint64(low)
    for x in a:
        out.append((x << np.uint64(1)) | carry)
        carry = x >> np.uint64(63)
    return out


def _count(a: Words, size: int) -> np.ndarray:
    """Ones among the lowest ``size`` bits."""
    total, word = np.zeros(a[0].shape, np.int64), a[0].dtype
    for i, x in enumerate(a):
        beyond = max(0, 8 * word.itemsize - (size - i * _WORD))
        total += np.bitwise_count(x & (~word.type(0) >> word.type(beyond)))
    return total

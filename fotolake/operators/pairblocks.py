"""All pairs of the paths of a hash, scored in blocks.

A block has up to ``SIDE`` old and ``SIDE`` new paths of a hash, by their places, and is
scored at once; only the best of it, or a number per pair, leaves the task. So a hash of any
number of paths is spread over all tasks, and its pairs are never rows. Paths stand by their
places, whose order is that of the paths.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fotolake.operators.ranking import BROADCAST_KEYS
from fotolake.session import cut_lineage

_OLD, _NEW = 0, 1
# Paths of either side in a block, and blocks of a task: some seconds of work.
SIDE = 512
TASK_BLOCKS = 16
# Pairs of a hash that are gone through at a time.
PAIRS = 1 << 19
# Gaps that are counted together.
GAPS = 64

# Scores of all pairs of two lists of paths.
Kernel = Callable[[list[str], list[str]], np.ndarray]


def _block_of(place: Column) -> Column:
    return F.floor((place - 1) / SIDE).cast("long")


def _blocks(ranked: DataFrame) -> DataFrame:
    """A row per block: md5hash, new_block, old_block, news, olds."""
    lists = cut_lineage(
        ranked.groupBy("md5hash", "side", _block_of(F.col("place")).alias("block")).agg(
            F.array_sort(F.collect_list(F.struct("place", "path"))).alias("paths")
        )
    )
    old = lists.where(F.col("side") == _OLD).select(
        "md5hash", F.col("block").alias("old_block"), F.col("paths").alias("olds")
    )
    new = lists.where(F.col("side") == _NEW).select(
        "md5hash", F.col("block").alias("new_block"), F.col("paths").alias("news")
    )
    sides = lists.groupBy("md5hash").agg(
        (F.count_if(F.col("side") == _OLD) * F.count_if(F.col("side") == _NEW)).alias("n")
    )
    total = sides.agg(F.sum("n")).first()[0] or 0
    # Few bytes are much work here: a number of parts by blocks, which are not merged by size.
    parts = int(ranked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(parts, ranked.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_BLOCKS))
    return old.join(new, "md5hash").repartition(parts, "md5hash", "new_block", "old_block")


def _scored(batches: Iterator[pa.RecordBatch], kernel: Kernel) -> Iterator[tuple]:
    """Of each block hash, numbers, new and old paths with their places, and scores (new x old)."""
    for batch in batches:
        for i in range(len(batch)):
            row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
            news, olds = ([p["path"] for p in row[side]] for side in ("news", "olds"))
            places = (np.array([p["place"] for p in row[side]]) for side in ("news", "olds"))
            yield row, news, olds, *places, kernel(news, olds)


def first_in_blocks(ranked: DataFrame, kernel: Kernel) -> DataFrame:
    """Of each new path and block the first old path in the order of pairs.

    Returns md5hash, old_path, new_path, gap, score.
    """
    schema = "md5hash string, old_path string, new_path string, gap long, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, news, olds, new_places, old_places, scores in _scored(batches, kernel):
            gaps = np.abs(new_places[:, None] - old_places)
            least = scores == scores.max(axis=1, keepdims=True)
            # Old paths stand in their order, of which argmin takes the first.
            first = np.where(least, gaps, np.iinfo(np.int64).max).argmin(axis=1)
            every = np.arange(len(news))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row["md5hash"]] * len(news), pa.string()),
                    pa.array([olds[i] for i in first], pa.string()),
                    pa.array(news, pa.string()),
                    pa.array(gaps[every, first], pa.int64()),
                    pa.array(scores[every, first].astype(float), pa.float64()),
                ],
                ["md5hash", "old_path", "new_path", "gap", "score"],
            )

    return _blocks(ranked).mapInArrow(run, schema)


# --- one to one -----------------------------------------------------------------------

_MATRIX = (
    "md5hash string, new_block long, old_block long, news array<long>, olds array<long>, scores binary"
)
_TAKEN = "md5hash string, old_place long, new_place long, score double"


def match_in_blocks(ranked: DataFrame, kernel: Kernel, pairs: int = PAIRS) -> DataFrame:
    """The paths of a hash matched in the order of pairs, each path once.

    All pairs are scored once and kept as numbers. About the first ``pairs`` of a hash whose
    paths are both free are gone through at a time, and what they take leaves the blocks.
    Returns md5hash, old_path, new_path, score.
    """
    matrix = cut_lineage(_blocks(ranked).mapInArrow(_matrix_of(kernel), _MATRIX))
    taken = None
    while not matrix.isEmpty():
        found = _next_pairs(matrix, pairs)
        now = cut_lineage(_in_order(found))
        taken = now if taken is None else taken.unionByName(now)
        matrix = cut_lineage(_without(matrix, now))
    if taken is None:
        taken = ranked.sparkSession.createDataFrame([], _TAKEN)
    old = ranked.where(F.col("side") == _OLD).select(
        "md5hash", F.col("place").alias("old_place"), F.col("path").alias("old_path")
    )
    new = ranked.where(F.col("side") == _NEW).select(
        "md5hash", F.col("place").alias("new_place"), F.col("path").alias("new_path")
    )
    named = taken.join(old, ["md5hash", "old_place"]).join(new, ["md5hash", "new_place"])
    return named.select("md5hash", "old_path", "new_path", "score")


def _matrix_of(kernel: Kernel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, _, _, news, olds, scores in _scored(batches, kernel):
            yield _packed(row["md5hash"], row["new_block"], row["old_block"], news, olds, scores)

    return run


def _packed(md5hash, new_block, old_block, news, olds, scores) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array([md5hash], pa.string()),
            pa.array([new_block], pa.int64()),
            pa.array([old_block], pa.int64()),
            pa.array([news], pa.list_(pa.int64())),
            pa.array([olds], pa.list_(pa.int64())),
            pa.array([scores.tobytes()], pa.binary()),
        ],
        ["md5hash", "new_block", "old_block", "news", "olds", "scores"],
    )


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Of each block its row, places of the new and old paths, and scores (new x old)."""
    for batch in batches:
        for i in range(len(batch)):
            row = {name: batch.column(name)[i] for name in batch.schema.names}
            news, olds = (row.pop(side).values.to_numpy() for side in ("news", "olds"))
            data = row.pop("scores").as_buffer()
            wide = len(data) > len(news) * len(olds)
            scores = np.frombuffer(data, np.float64 if wide else np.uint8)
            row = {name: value.as_py() for name, value in row.items()}
            yield row, news, olds, scores.reshape(len(news), len(olds))


def _small(keys: DataFrame) -> DataFrame:
    """Keys marked for broadcast if there are few."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def _up_to(counts: DataFrame, order: Column, value: str, pairs: int) -> DataFrame:
    """Of each hash the last ``value`` in an order up to which there are ``pairs``, and the first."""
    so_far = F.sum("n").over(Window.partitionBy("md5hash").orderBy(order))
    ranked = counts.withColumn("so_far", so_far)
    fits = F.when(F.col("so_far") <= pairs, F.struct("so_far", value))
    return ranked.groupBy("md5hash").agg(
        F.max(fits)[value].alias("last"), F.min(F.struct("so_far", value))[value].alias("first")
    )


def _next_pairs(matrix: DataFrame, pairs: int) -> DataFrame:
    """The first pairs of every hash: md5hash, score, gap, old_place, new_place.

    They are all pairs down to a score, or of the best score up to a gap: about ``pairs``,
    or, of more at the least gaps, some per path.
    """

    def by_score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, _, _, scores in _unpacked(batches):
            yield _counts(row["md5hash"], *np.unique(scores, return_counts=True))

    def by_gap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, news, olds, scores in _unpacked(batches):
            i, j = np.nonzero(scores == row["least"])
            steps = np.abs(news[i] - olds[j]) // GAPS
            yield _counts(row["md5hash"], *np.unique(steps, return_counts=True))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, news, olds, scores in _unpacked(batches):
            i, j = np.nonzero(scores >= row["least"])
            gaps = np.abs(news[i] - olds[j])
            if row["far"] is not None:
                near = gaps < (row["far"] + 1) * GAPS
                i, j, gaps = i[near], j[near], gaps[near]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.DictionaryArray.from_arrays(
                        np.zeros(len(i), np.int32), pa.array([row["md5hash"]])
                    ).cast(pa.string()),
                    pa.array(scores[i, j].astype(float), pa.float64()),
                    pa.array(gaps, pa.int64()),
                    pa.array(olds[j], pa.int64()),
                    pa.array(news[i], pa.int64()),
                ],
                ["md5hash", "score", "gap", "old_place", "new_place"],
            )

    counted = "md5hash string, value double, n long"
    scores = matrix.mapInArrow(by_score, counted).groupBy("md5hash", "value").agg(F.sum("n").alias("n"))
    least = cut_lineage(_up_to(scores, F.col("value").desc(), "value", pairs)).select(
        "md5hash",
        F.coalesce("last", "first").alias("least"),
        F.col("last").isNull().alias("many"),
    )
    # Where the best score alone has too many pairs they are taken by their gaps.
    many = least.where("many").select("md5hash", "least")
    bounds = least.select("md5hash", "least").withColumn("far", F.lit(None).cast("double"))
    if not many.isEmpty():
        steps = matrix.join(_small(many), "md5hash").mapInArrow(by_gap, counted)
        steps = steps.groupBy("md5hash", "value").agg(F.sum("n").alias("n"))
        far = _up_to(steps, F.col("value").asc(), "value", pairs)
        far = far.select("md5hash", F.coalesce("last", "first").alias("far"))
        bounds = cut_lineage(bounds.drop("far").join(far, "md5hash", "left"))
    found = "md5hash string, score double, gap long, old_place long, new_place long"
    return matrix.join(_small(bounds), "md5hash").mapInArrow(pick, found)


def _counts(md5hash: str, values: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array([md5hash] * len(values), pa.string()),
            pa.array(values.astype(float), pa.float64()),
            pa.array(n, pa.int64()),
        ],
        ["md5hash", "value", "n"],
    )


def _reaching(used: np.ndarray, place: int) -> np.ndarray:
    """Marks by place, up to ``place`` at least."""
    return used if place < len(used) else np.pad(used, (0, 2 * place + 1 - len(used)))


def _in_order(found: DataFrame) -> DataFrame:
    """Pairs gone through hash by hash; only the taken places of one hash are remembered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, used_old, used_new = None, np.zeros(0, bool), np.zeros(0, bool)
        for batch in batches:
            keep, start = [], 0
            runs = pc.run_end_encode(batch.column(0))
            ends = zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True)
            old, new = (batch.column(i).to_numpy() for i in (1, 2))
            for md5hash, end in ends:
                if md5hash != current:
                    current, used_old, used_new = md5hash, np.zeros(0, bool), np.zeros(0, bool)
                used_old = _reaching(used_old, old[start:end].max())
                used_new = _reaching(used_new, new[start:end].max())
                # Most pairs have a taken path already when the batch begins.
                free = ~(used_old[old[start:end]] | used_new[new[start:end]])
                for i in (np.flatnonzero(free) + start).tolist():
                    if not (used_old[old[i]] or used_new[new[i]]):
                        used_old[old[i]] = used_new[new[i]] = True
                        keep.append(i)
                start = end
            yield batch.take(pa.array(keep, pa.int64()))

    order = [F.col("score").desc(), "gap", "new_place", "old_place"]
    dealt = found.repartition("md5hash").sortWithinPartitions("md5hash", *order)
    return dealt.select("md5hash", "old_place", "new_place", "score").mapInArrow(run, _TAKEN)


def _without(matrix: DataFrame, taken: DataFrame) -> DataFrame:
    """The blocks without taken paths; those that have none left on a side go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, news, olds, scores in _unpacked(batches):
            new, old = (
                ~np.isin(places, row[used] or [])
                for places, used in ((news, "used_news"), (olds, "used_olds"))
            )
            if new.any() and old.any():
                left = scores[np.ix_(new, old)]
                key = row["md5hash"], row["new_block"], row["old_block"]
                yield _packed(*key, news[new], olds[old], left)

    for side in ("new", "old"):
        place, block = F.col(f"{side}_place"), f"{side}_block"
        used = taken.groupBy("md5hash", _block_of(place).alias(block)).agg(
            F.collect_list(place).alias(f"used_{side}s")
        )
        matrix = matrix.join(used, ["md5hash", block], "left")
    return matrix.mapInArrow(run, _MATRIX)

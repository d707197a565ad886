"""Most similar paths: moved files matched to the catalog rows of their hash.

All functions take ``free``: md5hash, side (0 old, 1 new), path, with distinct paths. The
order of the pairs of a hash is total: by score, highest first, then by the gap between the
places of the two paths among their side's paths, then by new and by old path. So of
equally similar paths the k-th takes the k-th.

A hash of few pairs is scored in full. One of many is searched by falling thresholds
(``LEVELS``), as long as that is less work than all pairs in blocks (``pairblocks``): a pair at a threshold leaves at most e characters of the shorter path and e of
the window unmatched, and these break at most 5 e of its trigrams; so of any 5 e + 1
trigrams, and the rarest are taken, one also stands in the longer path. Pairs that share
such a trigram are scored; paths for which the bound tells nothing are compared with all,
block by block. What is matched at a threshold leaves the next one. Rows are dealt by hash
and trigram or block, so a hash of any share of the rows spreads over all tasks, and no
pair is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fotolake.functions.similarity import (
    levenshtein_block,
    partial_levenshtein,
    partial_ratio,
    ratio_block,
)
from fotolake.operators.pairblocks import Kernel, first_in_blocks, match_in_blocks
from fotolake.operators.ranking import HOT_GROUP_ROWS, number_rows
from fotolake.session import cut_lineage

_OLD, _NEW = 0, 1
# Pairs of a hash that are scored without a search: about a second of work.
FULL_PAIRS = 1 << 15
# Thresholds of the search, from 0 to 100.
LEVELS = (100, 98, 96, 93, 90, 85, 80, 70, 0)
# Paths that are compared with all others of their hash at a time.
BLOCK = 64
# Pairs scored in blocks for each one that is met as a row, at which a search is cheap.
MEETING = 256

Score = Callable[[Column, Column], Column]


def ratio_score(one: Column, two: Column) -> Column:
    """``partial_ratio``, from 0 to 100."""
    return partial_ratio(one, two).cast("double")


def levenshtein_score(one: Column, two: Column) -> Column:
    """``partial_levenshtein``, from 0 to 100."""
    return 100 * partial_levenshtein(one, two)


# The same scores for all pairs of two lists.
KERNELS: dict[Score, Kernel] = {ratio_score: ratio_block, levenshtein_score: levenshtein_block}


def _order() -> Column:
    """The total order of pairs, least first."""
    return F.struct((-F.col("score")).alias("far"), "gap", "new_path", "old_path")


def _ranked(free: DataFrame, hot_rows: int) -> DataFrame:
    """``free`` with the place of every path among the paths of its hash and side."""
    return cut_lineage(number_rows(free, ["md5hash", "side"], ["path"], "place", hot_rows))


def _sides(ranked: DataFrame) -> tuple[DataFrame, DataFrame]:
    old = ranked.where(F.col("side") == _OLD)
    new = ranked.where(F.col("side") == _NEW)
    return (
        old.select("md5hash", F.col("path").alias("old_path"), F.col("place").alias("old_place")),
        new.select("md5hash", F.col("path").alias("new_path"), F.col("place").alias("new_place")),
    )


def _by_size(ranked: DataFrame, full_pairs: int) -> tuple[DataFrame, DataFrame | None]:
    """Paths of hashes with few pairs, and of those with many (None if there are none)."""
    old = F.count_if(F.col("side") == _OLD)
    new = F.count_if(F.col("side") == _NEW)
    many = ranked.groupBy("md5hash").agg((old * new).alias("n")).where(F.col("n") > full_pairs)
    many = cut_lineage(many.select("md5hash"))
    if many.isEmpty():
        return ranked, None
    return (
        ranked.join(many, "md5hash", "left_anti"),
        cut_lineage(ranked.join(many, "md5hash", "left_semi")),
    )


def _scored(pairs: DataFrame, score: Score) -> DataFrame:
    """Pairs with score and gap."""
    return pairs.select(
        "md5hash",
        "old_path",
        "new_path",
        F.abs(F.col("old_place") - F.col("new_place")).alias("gap"),
        score(F.col("new_path"), F.col("old_path")).alias("score"),
    )


def _all_pairs(ranked: DataFrame, score: Score) -> DataFrame:
    old, new = _sides(ranked)
    return _scored(old.join(new, "md5hash"), score)


# --- pairs at a threshold ------------------------------------------------------


def _trigrams(path: Column) -> Column:
    starts = F.sequence(F.lit(1), F.greatest(F.length(path) - 2, F.lit(1)))
    return F.transform(starts, lambda i: F.substring(path, i, 3))


def _needed(level: int) -> Column:
    """Trigrams of a path of which one must stand in the longer path of a pair at ``level``."""
    size = F.length("path")
    return 5 * (F.floor((1 - (level - 0.5) / 100) * size).cast("int") if level else size) + 1


def _tells(level: int) -> Column:
    """Whether trigrams rule out any pair of a path as the shorter one."""
    size = F.length("path")
    return (size >= 3) & (_needed(level) <= size - 2)


def _trigram_rows(ranked: DataFrame, level: int) -> tuple[DataFrame, DataFrame]:
    """The rarest trigrams of every path for which the bound tells something; all of all paths."""
    rows = ranked.withColumn("size", F.length("path")).withColumn("needed", _needed(level))
    grams = rows.withColumn("gram", F.explode(_trigrams(F.col("path"))))
    often = cut_lineage(grams.groupBy("md5hash", "gram").agg(F.count("*").alias("often")))
    rare = (
        grams.where(_tells(level))
        .join(often, ["md5hash", "gram"])
        .groupBy("md5hash", "side", "path", "place", "size", "needed")
        .agg(F.array_sort(F.collect_list(F.struct("often", "gram"))).alias("own"))
        .select(
            "md5hash", "side", "path", "place", "size",
            F.explode(F.array_distinct(F.slice("own", F.lit(1), F.col("needed")))).alias("g"),
        )
        .select("md5hash", "side", "path", "place", "size", "g.gram", "g.often")
    )
    return rare, grams.select("md5hash", "side", "path", "place", "size", "gram").distinct()


def search_pays(ranked: DataFrame, level: int) -> bool:
    """Whether a search by trigrams is less work than all pairs in blocks.

    It meets paths by trigrams, and those that trigrams tell nothing of with all.
    """
    own = ranked.groupBy("md5hash").agg(F.count("*").alias("n"), F.count_if(_tells(level)).alias("t"))
    n, told = F.col("n"), F.col("t")
    every, others = own.agg(F.sum(n * n), F.sum(n * (n - told))).first()
    if not every or others * MEETING >= every:
        return False
    rare, _ = _trigram_rows(ranked, level)
    return ((rare.agg(F.sum("often")).first()[0] or 0) + others) * MEETING < every


def similar_pairs(
    ranked: DataFrame, score: Score, level: int, by_trigram: bool = True, firsts: bool = False
) -> DataFrame:
    """All pairs of a hash whose score rounds to ``level`` at least.

    ``ranked`` has the places of the paths. Without ``by_trigram`` all pairs are scored; with
    ``firsts`` those that are not the first of their new path may then be left out.
    Returns md5hash, old_path, new_path, gap, score.
    """
    if firsts and not by_trigram and level == 0 and score in KERNELS:
        return first_in_blocks(ranked, KERNELS[score])
    rows = ranked.withColumn("size", F.length("path"))
    tells = _tells(level) if by_trigram else F.lit(False)
    # The others against all, in blocks of the longer paths.
    blocks = F.ceil(F.col("count") / BLOCK).cast("int")
    counts = cut_lineage(rows.groupBy("md5hash").count())
    numbered = rows.join(counts, "md5hash").select(
        "md5hash", "side", "path", "place", "size", blocks.alias("blocks")
    )
    open_ones = numbered.where(~tells).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    )
    dealt = numbered.withColumn("block", F.pmod(F.xxhash64("path", "side"), F.col("blocks")).cast("int"))
    # The longer path is in one block, so these pairs come once, and no more with a trigram.
    keys = ["md5hash", "block"]
    # Few bytes are much work here: a fixed number of parts, which are not merged by size.
    parts = int(ranked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = _met(open_ones.repartition(parts, *keys), dealt.repartition(parts, *keys), keys)
    if by_trigram:
        rare, every = _trigram_rows(ranked, level)
        found = found.unionByName(_met(rare, every, ["md5hash", "gram"]).distinct())
    found = _scored(found, score)
    return found.where(F.col("score") >= level - 0.5) if level else found


def _met(short: DataFrame, long: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of a shorter path of one side and one of the other that is no shorter.

    Of two paths of equal length the old one is taken as the shorter.
    """
    own = short.select(
        *keys, F.col("side").alias("_side"), F.col("path").alias("_path"),
        F.col("place").alias("_place"), F.col("size").alias("_size"),
    )
    fits = (F.col("_side") != F.col("side")) & (
        (F.col("_size") < F.col("size"))
        | ((F.col("_size") == F.col("size")) & (F.col("_side") == _OLD))
    )
    old = F.col("_side") == _OLD
    return (
        own.join(long, keys)
        .where(fits)
        .select(
            "md5hash",
            F.when(old, F.col("_path")).otherwise(F.col("path")).alias("old_path"),
            F.when(old, F.col("_place")).otherwise(F.col("place")).alias("old_place"),
            F.when(old, F.col("path")).otherwise(F.col("_path")).alias("new_path"),
            F.when(old, F.col("place")).otherwise(F.col("_place")).alias("new_place"),
        )
    )


# --- the best old path of every new one ------------------------------------------


def best_match(
    free: DataFrame,
    score: Score = ratio_score,
    full_pairs: int = FULL_PAIRS,
    hot_rows: int = HOT_GROUP_ROWS,
) -> DataFrame:
    """For each new path the first old path in the order of pairs.

    Returns md5hash, old_path, new_path, score. New paths of a hash without old paths have
    no row; null hashes never match.
    """
    ranked = _ranked(free.where(F.col("md5hash").isNotNull()), hot_rows)
    few, many = _by_size(ranked, full_pairs)
    found = _first_old(_all_pairs(few, score))
    if many is not None:
        for level in LEVELS:
            # Where trigrams tell too little all pairs are scored, and once: no threshold is left.
            level = level if search_pays(many, level) else 0
            best = cut_lineage(_first_old(similar_pairs(many, score, level, level > 0, True)))
            found = found.unionByName(best)
            done = best.select("md5hash", F.lit(_NEW).alias("side"), F.col("new_path").alias("path"))
            many = cut_lineage(many.join(done, ["md5hash", "side", "path"], "left_anti"))
            if level == 0 or many.where(F.col("side") == _NEW).isEmpty():
                break
    return found


def _first_old(pairs: DataFrame) -> DataFrame:
    return (
        pairs.groupBy("md5hash", "new_path")
        .agg(F.min(_order()).alias("best"))
        .select("md5hash", "best.old_path", "new_path", (-F.col("best.far")).alias("score"))
    )


# --- one to one --------------------------------------------------------------------


def match_one_to_one(
    free: DataFrame,
    score: Score = ratio_score,
    full_pairs: int = FULL_PAIRS,
    hot_rows: int = HOT_GROUP_ROWS,
) -> DataFrame:
    """Old and new paths of a hash matched in the order of pairs, each path once.

    A pair is taken when both its paths are free. Hashes with few pairs are gone through in
    that order; those with many by rounds in which all pairs that are the first for both
    their paths are taken at once, which gives the same matching; where the search stops to
    pay, all pairs still free are scored once and gone through in blocks. Returns md5hash,
    old_path, new_path, score; the fewer of the old and new paths of a hash are all matched.
    """
    ranked = _ranked(free.where(F.col("md5hash").isNotNull()), hot_rows)
    few, many = _by_size(ranked, full_pairs)
    found = _in_order(_all_pairs(few, score))
    if many is not None:
        for level in LEVELS:
            by_trigram = search_pays(many, level)
            if not by_trigram and score in KERNELS:
                found = found.unionByName(match_in_blocks(many, KERNELS[score]))
                break
            pairs = similar_pairs(many, score, level, by_trigram)
            taken = _mutual_rounds(cut_lineage(pairs))
            found = found.unionByName(taken)
            many = cut_lineage(_without(many, taken))
            sides = many.groupBy("md5hash").agg(F.countDistinct("side").alias("n"))
            if sides.where("n = 2").isEmpty():
                break
    return found


def _without(ranked: DataFrame, taken: DataFrame) -> DataFrame:
    done = taken.select("md5hash", F.lit(_OLD).alias("side"), F.col("old_path").alias("path"))
    done = done.unionByName(
        taken.select("md5hash", F.lit(_NEW).alias("side"), F.col("new_path").alias("path"))
    )
    return ranked.join(done, ["md5hash", "side", "path"], "left_anti")


def _mutual_rounds(pairs: DataFrame) -> DataFrame:
    """Rounds over scored pairs, until no pair has two free paths."""
    taken = None
    while True:
        first_old = pairs.groupBy("md5hash", "new_path").agg(F.min(_order()).alias("best"))
        first_new = pairs.groupBy("md5hash", "old_path").agg(F.min(_order()).alias("best"))
        mutual = first_old.join(first_new.select("md5hash", "best"), ["md5hash", "best"])
        mutual = cut_lineage(
            mutual.select(
                "md5hash", "best.old_path", "best.new_path", (-F.col("best.far")).alias("score")
            )
        )
        taken = mutual if taken is None else taken.unionByName(mutual)
        if mutual.isEmpty():
            return taken
        pairs = cut_lineage(
            pairs.join(mutual.select("md5hash", "old_path"), ["md5hash", "old_path"], "left_anti").join(
                mutual.select("md5hash", "new_path"), ["md5hash", "new_path"], "left_anti"
            )
        )


_MATCH = "md5hash string, old_path string, new_path string, score double"


def _in_order(pairs: DataFrame) -> DataFrame:
    """Pairs gone through hash by hash; only the taken paths of one hash are remembered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, used_old, used_new = None, set(), set()
        for batch in batches:
            keep = []
            rows = zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)
            for i, (md5hash, old, new) in enumerate(rows):
                if md5hash != current:
                    current, used_old, used_new = md5hash, set(), set()
                if old not in used_old and new not in used_new:
                    used_old.add(old)
                    used_new.add(new)
                    keep.append(i)
            yield batch.take(pa.array(keep, pa.int64()))

    dealt = pairs.repartition("md5hash").sortWithinPartitions("md5hash", _order())
    rows = dealt.select("md5hash", "old_path", "new_path", "score")
    return rows.mapInArrow(run, _MATCH)

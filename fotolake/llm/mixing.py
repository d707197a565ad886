"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame operations.

A source's target is its share of all words by weight, at most ``max_repeats`` times its
own size; what is cut off there is shared again by weight. The mix is dealt in blocks of
equal words: blocks go to sources, and a source's blocks to its shards, by the highest
quotients target / (2 * seats + 1). A shard is a fixed hash part of the source's
documents, so no source, however large, is ordered in one task. In a shard the documents
stand in an order given by the seed, are laid end to end, repeated if need be, and the
shard's blocks are taken from the start.

Defined results: a null text has size 0; a null source is a source of its own and comes
last; repeated rows are separate documents; a source without words has target 0; columns
besides doc_id, text and source are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fotolake.llm.common import stored

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEATS = 3
BLOCK_WORDS = 64
SHARD_WORDS = 1 << 22
SHARD_ROWS = 1_000_000
SEED = 20240229


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    max_repeats: int = MAX_REPEATS,
    block_words: int = BLOCK_WORDS,
    shard_words: int = SHARD_WORDS,
    seed: int = SEED,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """doc_id, size, source_size, target (of the source), taken (words, repeats counted)."""
    sized = stored(_sizes(docs, seed), "sizes")
    sources = targets(sized, weights, max_repeats).withColumn(
        "n_shards",
        (F.greatest(F.col("source_size") / shard_words, F.col("n_rows") / shard_rows) + 1).cast("long"),
    )
    # Sizes below are of tables with a row per source or per shard, not per document.
    sources = _apportion(sources, "target", block_words, [])
    shards = (
        sized.join(sources.select("source_key", "n_shards"), "source_key")
        .groupBy("source_key", F.pmod("order", F.col("n_shards")).alias("shard"))
        .agg(F.sum("size").alias("shard_size"))
        .join(sources, "source_key")
        .withColumn("share", F.col("target") * _part_of("shard_size", "source_size"))
        .withColumn("n_blocks", F.col("seats"))
    )
    cells = stored(_apportion_shards(shards, block_words, max_repeats), "cells")
    start = F.sum("size").over(
        Window.partitionBy("source_key", "shard")
        .orderBy("order", F.col("doc_id").asc_nulls_last(), "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    rest = F.col("words") % F.col("shard_size")
    taken = F.expr("words div shard_size") * F.col("size") + F.least(
        F.greatest(rest - F.coalesce(F.col("start"), F.lit(0)), F.lit(0)), F.col("size")
    )
    placed = (
        sized.join(sources.select("source_key", "n_shards"), "source_key")
        .withColumn("shard", F.pmod("order", F.col("n_shards")))
        .withColumn("start", start)
    )
    return placed.join(cells, ["source_key", "shard"]).select(
        "doc_id",
        "size",
        "source_size",
        "target",
        F.when(F.col("shard_size") > 0, taken).otherwise(F.lit(0)).cast("long").alias("taken"),
    )


def _part_of(one: str, whole: str) -> Column:
    """A share, 0 of nothing."""
    return F.when(F.col(whole) > 0, F.col(one) / F.col(whole)).otherwise(F.lit(0.0))


def _sizes(docs: DataFrame, seed: int) -> DataFrame:
    # A hash that other engines have too.
    digest = F.md5(
        F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    )
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("")).alias(
            "source_key"
        ),
        F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))
        .cast("long")
        .alias("size"),
        F.conv(F.substr(digest, F.lit(1), F.lit(15)), 16, 10).cast("long").alias("order"),
    )


def targets(sized: DataFrame, weights: tuple[float, ...], max_repeats: int) -> DataFrame:
    """Per source: source_size, n_rows, target.

    Filling by weight with caps ends at one level L, where target = min(cap, weight * L).
    In the order of cap / weight, a source is capped if its ratio is below the level that
    the sources from it on would share.
    """
    sources = sized.groupBy("source_key").agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows")
    )
    by_name = Window.orderBy(F.col("source_key") == "", "source_key")
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int"))
    by_ratio = Window.orderBy("ratio", "source_key")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0)).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum(
        "weight"
    ).over(onward)
    return (
        sources.withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * max_repeats)
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("own_level", level)
        # The level is that of the first source which is not capped.
        .withColumn(
            "level",
            F.min_by(
                F.when(F.col("ratio") > F.col("own_level"), F.col("own_level")),
                F.when(F.col("ratio") > F.col("own_level"), F.col("ratio")),
            ).over(everything),
        )
        .select(
            "source_key",
            "source_size",
            "n_rows",
            F.when(F.col("ratio") > F.col("own_level"), F.col("weight") * F.col("level"))
            .otherwise(F.col("cap"))
            .cast("double")
            .alias("target"),
        )
    )


def _divisor_seats(share: Column, divisor: Column) -> Column:
    """Seats whose quotient share / (2 k + 1) is at least divisor / 2."""
    return F.when(divisor > 0, F.floor(share / divisor + 0.5)).otherwise(F.lit(0)).cast("long")


def _quotients(rows: DataFrame, share: str, n_blocks: Column, group: list[str]) -> DataFrame:
    """``rows`` with ``seats``: blocks by highest quotients, ``n_blocks`` in each group.

    All quotients above a divisor are a head of the sorted list, so counting down starts
    from a divisor that certainly gives too few seats, and sorts only the quotients between
    it and one that certainly gives enough: about two per row, whatever the block count.
    """
    if group:
        every = Window.partitionBy(*group)
    else:
        every = Window.partitionBy(F.lit(0))
    every = every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    n, total = F.count(F.lit(1)).over(every), F.sum(share).over(every)
    blocks = n_blocks.cast("double")
    few = F.when(blocks - n / 2 > 0, total / (blocks - n / 2)).otherwise(F.lit(0.0))
    many = F.when(blocks + n / 2 > 0, total / (blocks + n / 2)).otherwise(F.lit(0.0))
    keys = [*group, "_row"]
    based = (
        rows.withColumn("_blocks", n_blocks)
        .withColumn("_base", _divisor_seats(F.col(share), few))
        .withColumn("_most", _divisor_seats(F.col(share), many) + 1)
        .withColumn("_left", F.col("_blocks") - F.sum("_base").over(every))
    )
    ranked = based.select(
        *keys, "_left", share, F.explode(F.sequence("_base", "_most")).alias("_k")
    ).withColumn("_quotient", F.col(share) / (2 * F.col("_k") + 1))
    order = (Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))).orderBy(
        F.col("_quotient").desc(), "_row", "_k"
    )
    won = (
        ranked.withColumn("_place", F.row_number().over(order))
        .where((F.col("_place") <= F.col("_left")) & (F.col(share) > 0))
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_won"))
    )
    return (
        based.join(won, keys, "left")
        .withColumn("seats", F.col("_base") + F.coalesce("_won", F.lit(0)))
        .drop("_base", "_most", "_left", "_won", "_blocks", "_row")
    )


def _apportion(sources: DataFrame, share: str, block_words: int, group: list[str]) -> DataFrame:
    every = Window.partitionBy(F.lit(0)).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    n_blocks = F.round(F.sum(share).over(every) / block_words).cast("long")
    return stored(
        _quotients(sources.withColumn("_row", F.col("source_key")), share, n_blocks, group),
        "sources",
    )


def _apportion_shards(shards: DataFrame, block_words: int, max_repeats: int) -> DataFrame:
    dealt = _quotients(
        shards.withColumn("_row", F.col("shard")), "share", F.col("n_blocks"), ["source_key"]
    )
    words = F.least(F.col("seats") * block_words, F.col("shard_size") * max_repeats)
    return dealt.select(
        "source_key", "shard", "shard_size", "source_size", "target", words.alias("words")
    )

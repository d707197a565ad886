"""Row numbers within groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fotolake.session import cut_lineage

# A group above this many rows is numbered by a distributed sort instead of in
# one task. About 10**6 narrow catalog rows sort comfortably in one task.
HOT_GROUP_ROWS = 1_000_000

# Keys sent to every task at most, some tens of megabytes.
BROADCAST_KEYS = 100_000

# monotonically_increasing_id() keeps the row within its partition in the low
# 33 bits and the partition above them.
_PARTITION_BITS = 33


def number_rows(
    df: DataFrame, keys: list[str], order: list[str], out: str, hot_rows: int = HOT_GROUP_ROWS
) -> DataFrame:
    """``row_number() over (partition by keys order by order)``.

    Keys must not be NULL and ``order`` must be unique within a group. Groups
    of more than ``hot_rows`` rows are found by a count (one narrow pass) and
    spread over many tasks; the result is the same.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    hot = hot_groups(df, keys, hot_rows)
    if hot is None:
        return df.withColumn(out, F.row_number().over(window).cast("bigint"))
    cold = df.join(hot, keys, "left_anti").withColumn(
        out, F.row_number().over(window).cast("bigint")
    )
    spread = _number_by_sort(df.join(hot, keys, "left_semi"), keys, order, out)
    return cold.unionByName(spread)


def hot_groups(df: DataFrame, keys: list[str], hot_rows: int) -> DataFrame | None:
    """Keys of the groups over ``hot_rows`` rows; None when there are none.

    There is at most one per ``hot_rows`` rows. Up to ``BROADCAST_KEYS`` of
    them are marked for broadcast; Spark chooses the join for more.
    """
    hot = df.groupBy(*keys).count().where(F.col("count") > hot_rows).select(*keys)
    if hot.isEmpty():
        return None
    hot = cut_lineage(hot)
    return F.broadcast(hot) if hot.count() <= BROADCAST_KEYS else hot


def _number_by_sort(df: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    """Range-sort the rows, then number them by their place in the sort.

    The sorted rows are written once, so the places cannot change when a task
    is run again. Only one small row per group and partition is regrouped.
    """
    placed = cut_lineage(
        df.orderBy(*keys, *order).withColumn("_place", F.monotonically_increasing_id())
    ).withColumn("_part", F.shiftright("_place", _PARTITION_BITS))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (
        placed.groupBy(*keys, "_part")
        .agg(F.min("_place").alias("_first"), F.count("*").alias("_rows"))
        .withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
    )
    return (
        placed.join(parts, [*keys, "_part"])
        .withColumn(out, F.col("_place") - F.col("_first") + F.col("_before") + 1)
        .drop("_place", "_part", "_first", "_rows", "_before")
    )

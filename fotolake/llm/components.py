"""Connected components of edges between long ids, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fotolake.llm.common import drop_stored, stored


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``a, b``: root is the smallest node of its component.

    A large star ties each node's larger neighbours to its smallest one, a small star its
    smaller ones; after about log n rounds every node hangs on its root. The smallest
    neighbour is an aggregate combined before its shuffle and written; the join that brings
    it back is one of two plain shuffles, in which Spark splits a hub. Each round is a
    written table; that before it is deleted.
    """
    edges = _ordered(edges.select(F.col("a").cast("long"), F.col("b").cast("long")))
    edges = stored(edges, "edges")
    state = _state(edges)
    while state[0]:
        large = stored(_large_star(edges), "edges")
        after = stored(_small_star(large), "edges")
        drop_stored(large)
        new = _state(after)
        drop_stored(edges)
        edges = after
        if new == state:
            break
        state = new
    roots = edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return roots.unionByName(
        edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    )


def _ordered(edges: DataFrame) -> DataFrame:
    """Distinct edges with a < b."""
    return (
        edges.where("a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("s")
    ).first()
    return row["n"], row["s"]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
    return _ordered(both.join(least, "a").where("b > a").select("b", F.col("m").alias("a")))


def _small_star(edges: DataFrame) -> DataFrame:
    least = stored(edges.groupBy("b").agg(F.min("a").alias("m")), "least")
    pulled = edges.join(least, "b").select(F.col("m").alias("a"), F.col("a").alias("b"))
    own = least.select(F.col("m").alias("a"), "b")
    return _ordered(pulled.unionByName(own))

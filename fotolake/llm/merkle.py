"""A Merkle manifest of documents, with proofs found by pointer jumping.

Every row is a leaf. The leaves of a source, in the order of doc_id, are hashed upwards in
runs of ``FAN_OUT`` until one node, the subroot, is left; the subroots, in the order of
their sources, are hashed to the root in the same way. H of a list is the lowercase hex
SHA-256 of its items' concatenation, digests taken as hex text.

The proof of a node is the list of sibling digests on the way to the root: per level those
to the left and those to the right of the path. Every inner node starts with the segment
towards its parent and a pointer to it. In each round a self-join replaces the pointer by
the parent's own and appends the parent's segment, so that the distance doubles; a node
whose pointer is the root leaves the joins. About log2(depth) rounds serve any size. Leaves,
15 of 16 nodes, do not jump: a run of leaves takes the finished segments of its parent in
one last join, made once per run, and only then becomes rows.

Sizes: leaves are two or three digests wide; they are ordered by one range sort, numbered
by their place in it, and grouped in runs of at most 16, so that a source of any share of
the rows is spread like all others. Nothing goes to the driver but row counts per
partition of the sort, the largest source's size, and the root.

Defined results: a null column is hashed as ``-``; null sources are a source of their own
and come first, null ids come first in their source; rows with equal source and id stand in
the order of their digests, equal rows are leaves of their own; of an empty table the
manifest has no root and no rows; text of any length is hashed in the row's own task;
columns besides the named ones are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fotolake.llm.common import drop_stored, stored

FAN_OUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
# The tree over the subroots.
_TOP = -1
# monotonically_increasing_id() has the row within its partition in the low 33 bits.
_PART_BITS = 33

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def hashed(*parts: Column) -> Column:
    """H of text or binary parts, as lowercase hex."""
    return F.sha2(F.concat(*(part.cast("binary") for part in parts)), 256)


def field(column: Column) -> Column:
    """A value with its length, ``-`` for null."""
    data = column.cast("string").cast("binary")
    size = F.octet_length(data).cast("string").cast("binary")
    return F.coalesce(F.concat(size, F.lit(b":"), data), F.lit(b"-"))


def leaf(**changed: Column) -> Column:
    """The leaf digest of a row of documents, with some columns replaced."""
    return hashed(*(field(changed.get(name, F.col(name))) for name in FIELDS))


def tampered_leaf() -> Column:
    """The digest of the row with A-Z of its text lower-cased, where 5 divides the id's crc32."""
    id_text = F.col("doc_id").cast("string").cast("binary")
    text = F.translate(F.col("text").cast("string"), _UPPER, _LOWER)
    return F.when(F.crc32(id_text) % 5 == 0, leaf(text=text))


def _hex(column: Column) -> Column:
    return F.lower(F.hex(column))


@dataclass
class Manifest:
    """``root`` (hex, None without leaves), ``leaf_runs`` with the leaves of each parent
    node, and ``proofs`` with the segments from every inner node to the root."""

    root: str | None
    leaf_runs: DataFrame
    proofs: DataFrame


def build_manifest(leaves: DataFrame, fan_out: int = FAN_OUT) -> Manifest:
    """Manifest of ``doc_id, source, leaf`` (binary digest) and a ``mark`` that goes along."""
    spark = leaves.sparkSession
    placed = _placed(leaves)
    bounds = stored(
        placed.groupBy("source").agg(F.min("place").alias("first"), F.count("place").alias("n")),
        "sources",
    )
    # Sources are numbered by the places of their first leaves, which have the same order.
    sources = stored(
        _numbered(bounds.orderBy("first")).withColumnRenamed("place", "tree"), "sources"
    )
    most, n_sources = sources.agg(F.max("n"), F.count("n")).first()
    height, top_height = _height(most or 0, fan_out), _height(n_sources, fan_out)

    indexed = placed.join(
        sources.select(F.col("source").alias("_source"), "tree", "first", "n"),
        F.col("source").eqNullSafe(F.col("_source")),
    ).select("tree", (F.col("place") - F.col("first")).alias("idx"), "n", "doc_id", "leaf", "mark")
    leaf_runs = stored(_runs(indexed, fan_out), "leaf-runs")

    # What remains of each tree is the child of the same number in the tree of subroots.
    nodes = _parents(leaf_runs, 1, fan_out)
    segments, subroots = [], []
    for level in range(1, max(height, 1) + 1):
        nodes = stored(nodes, "nodes")
        subroots.append(nodes.where("n = 1"))
        if level < height:
            grouped = stored(_grouped(nodes.where("n > 1"), fan_out), "runs")
            segments.append(_segments(grouped, level, fan_out))
            nodes = _parents(grouped, level + 1, fan_out)
    top = subroots[0]
    for more in subroots[1:]:
        top = top.unionByName(more)
    top = stored(
        top.select(
            F.lit(_TOP).cast("long").alias("tree"),
            F.col("tree").alias("idx"),
            F.lit(n_sources).cast("long").alias("n"),
            "digest",
        ),
        "nodes",
    )
    for level in range(top_height):
        grouped = stored(_grouped(top, fan_out), "runs")
        segments.append(_segments(grouped, level, fan_out, height=top_height))
        top = stored(_parents(grouped, level + 1, fan_out), "nodes")
    root = top.first()
    start = spark.createDataFrame([], _POINTERS)
    for more in segments:
        start = start.unionByName(more)
    proofs = _jumped(start, (_TOP, top_height, 0), max(height - 1, 0) + top_height)
    return Manifest(root and bytes(root["digest"]).hex(), leaf_runs, proofs)


_SEGMENTS = "array<struct<left: binary, right: binary>>"
_POINTERS = (
    "tree long, level int, idx long, towards struct<tree: long, level: int, idx: long>, "
    f"segments {_SEGMENTS}"
)


def _height(n: int, fan_out: int) -> int:
    """Levels from n nodes up to one."""
    levels = 0
    while n > 1:
        n, levels = -(-n // fan_out), levels + 1
    return levels


def _placed(leaves: DataFrame) -> DataFrame:
    """``leaves`` with their ``place``, counted from 0 in the order of the manifest."""
    order = [F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), "leaf"]
    return stored(_numbered(leaves.orderBy(*order)), "leaves")


def _numbered(ordered: DataFrame) -> DataFrame:
    """Rows of a sorted frame with ``place``, their position from 0.

    The sorted rows are written once, so that places stay as they are when a task is run
    again; the rows before each partition are as many numbers as the sort has partitions.
    """
    rows = stored(ordered.withColumn("_at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("_at", _PART_BITS)
    counts = dict(rows.groupBy(part.alias("part")).count().collect())
    before, total = {}, 0
    for key in sorted(counts):
        before[key] = total - (key << _PART_BITS)
        total += counts[key]
    spark = rows.sparkSession
    offsets = spark.createDataFrame(list(before.items()), "_part long, _offset long")
    return (
        rows.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn("place", F.col("_at") + F.col("_offset"))
        .drop("_at", "_part", "_offset")
    )


def _runs(indexed: DataFrame, fan_out: int) -> DataFrame:
    """Leaves in runs: tree, n (leaves of the tree), idx (of the run), children."""
    child = F.struct("idx", "doc_id", "leaf", "mark")
    return indexed.groupBy("tree", "n", F.expr(f"idx div {fan_out}").alias("run")).agg(
        F.array_sort(F.collect_list(child)).alias("children")
    ).select(
        "tree", "n", F.col("run").alias("idx"), "children",
        F.transform("children", lambda c: c["leaf"]).alias("digests"),
    )


def _grouped(nodes: DataFrame, fan_out: int) -> DataFrame:
    """Nodes (tree, n, idx, digest) in runs of digests."""
    return nodes.groupBy("tree", "n", F.expr(f"idx div {fan_out}").alias("run")).agg(
        F.array_sort(F.collect_list(F.struct("idx", "digest"))).alias("children")
    ).select(
        "tree", "n", F.col("run").alias("idx"),
        F.transform("children", lambda c: c["digest"]).alias("digests"),
    )


def _joined(digests: Column) -> Column:
    """The concatenation of an array of digests."""
    return F.aggregate(digests, F.lit(b""), lambda a, d: F.concat(a, d))


def _parents(runs: DataFrame, level: int, fan_out: int) -> DataFrame:
    """The node that each run becomes; a lone node is its tree's last and stays as it is."""
    digest = F.when(F.col("n") == 1, F.col("digests")[0]).otherwise(
        F.unhex(hashed(_hex(_joined(F.col("digests")))))
    )
    n = F.expr(f"(n + {fan_out - 1}) div {fan_out}")
    return runs.select("tree", n.alias("n"), "idx", digest.alias("digest"))


def _node(tree: Column, level: Column, idx: Column) -> Column:
    return F.struct(tree.alias("tree"), level.cast("int").alias("level"), idx.alias("idx"))


def _up(level: int, height: int | None = None) -> Column:
    """The node that a run of children at ``level`` becomes.

    The last node of a source's tree is a leaf of the tree of subroots.
    """
    own = _node(F.col("tree"), F.lit(level + 1), F.col("idx"))
    if height is not None:
        return own
    top = _node(F.lit(_TOP).cast("long"), F.lit(0), F.col("tree"))
    return F.when(F.col("size") == 1, top).otherwise(own)


def _beside(digests: Column, at: Column) -> Column:
    """The digests to the left and to the right of a place."""
    return F.struct(
        _joined(F.slice(digests, F.lit(1), at)).alias("left"),
        _joined(F.slice(digests, at + 2, F.size(digests))).alias("right"),
    )


def _segments(runs: DataFrame, level: int, fan_out: int, height: int | None = None) -> DataFrame:
    """For every node of the runs: its parent as ``towards`` and one segment."""
    size = F.expr(f"(n + {fan_out - 1}) div {fan_out}")
    return (
        runs.withColumn("size", size)
        .withColumn("towards", _up(level, height))
        .select("tree", "idx", "digests", "towards", F.posexplode("digests").alias("at", "_"))
        .select(
            "tree",
            F.lit(level).cast("int").alias("level"),
            (F.col("idx") * fan_out + F.col("at")).alias("idx"),
            "towards",
            F.array(_beside(F.col("digests"), F.col("at"))).alias("segments"),
        )
    )


def _jumped(start: DataFrame, root: tuple, depth: int) -> DataFrame:
    """Segments of every node up to the root, by rounds that double the distance.

    Both sides of a join are written tables, so that Spark may split a node that very many
    others point to, or send the few nodes near the root to all tasks by their size.
    """
    at_root = (
        (F.col("towards.tree") == root[0])
        & (F.col("towards.level") == root[1])
        & (F.col("towards.idx") == root[2])
    )
    table = stored(start, "proofs")
    distance = 1
    while distance < depth:
        there = table.select(
            F.struct("tree", "level", "idx").alias("towards"),
            F.col("towards").alias("_next"),
            F.col("segments").alias("_more"),
        )
        moved = table.where(~at_root).join(there, "towards").select(
            "tree", "level", "idx",
            F.col("_next").alias("towards"),
            F.concat("segments", "_more").alias("segments"),
        )
        after = stored(table.where(at_root).unionByName(moved.select(*table.columns)), "proofs")
        drop_stored(table)
        table, distance = after, distance * 2
    return table.drop("towards")


def leaf_proofs(manifest: Manifest, fan_out: int = FAN_OUT) -> DataFrame:
    """n (leaves of its source), doc_id, leaf (binary), mark and segments of every leaf."""
    runs = manifest.leaf_runs.withColumn("size", F.expr(f"(n + {fan_out - 1}) div {fan_out}"))
    parent = _up(0)
    proofs = manifest.proofs.select(
        F.struct("tree", "level", "idx").alias("parent"), F.col("segments").alias("above")
    )
    rows = runs.withColumn("parent", parent).join(proofs, "parent", "left")
    above = F.coalesce("above", F.array().cast(_SEGMENTS))
    own = F.when(F.col("n") == 1, F.array().cast(_SEGMENTS)).otherwise(
        F.array(_beside(F.col("digests"), F.col("at")))
    )
    leaves = rows.select(
        "n", "digests", above.alias("above"), F.posexplode("children").alias("at", "c")
    )
    return leaves.select("n", "c.doc_id", "c.leaf", "c.mark", F.concat(own, "above").alias("segments"))


def fold(digest: Column, segments: Column) -> Column:
    """The hex digest that a hex digest and its siblings lead to."""
    return F.aggregate(
        segments,
        digest,
        lambda d, s: F.sha2(F.concat(_hex(s["left"]), d, _hex(s["right"])), 256),
    )


def proof_digest(segments: Column) -> Column:
    """H of all siblings, level by level, left to right."""
    all_of = F.aggregate(
        segments, F.lit(b""), lambda a, s: F.concat(a, s["left"], s["right"])
    )
    return F.sha2(_hex(all_of), 256)


def source_height(n: Column, fan_out: int = FAN_OUT) -> Column:
    """Levels of a source's tree of ``n`` leaves."""
    return F.aggregate(
        F.array(*(F.lit(fan_out**k) for k in range(1 + 60 // (fan_out.bit_length() - 1)))),
        F.lit(0),
        lambda levels, size: levels + (n > size).cast("int"),
    )


def verify(docs: DataFrame, fan_out: int = FAN_OUT) -> tuple[DataFrame, Manifest]:
    """Leaves, proofs and roots of ``docs``, folded again from partly tampered rows."""
    leaves = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.unhex(leaf()).alias("leaf"),
        F.unhex(tampered_leaf()).alias("mark"),
    )
    manifest = build_manifest(leaves, fan_out)
    segments = F.col("segments")
    digest = _hex(F.col("leaf"))
    below = F.slice(segments, F.lit(1), source_height(F.col("n"), fan_out))
    folded = fold(_hex(F.coalesce("mark", "leaf")), segments)
    rows = leaf_proofs(manifest, fan_out).select(
        "doc_id",
        digest.alias("leaf"),
        fold(digest, below).alias("subroot"),
        F.lit(manifest.root).cast("string").alias("root"),
        proof_digest(segments).alias("proof_sha256"),
        folded.alias("folded_root"),
    )
    return rows.withColumn("verified", F.col("folded_root") == F.col("root")), manifest


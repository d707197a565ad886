"""Similarity join of texts by Jaccard similarity of word shingles, with chosen paths.

Texts with equal shingle sets are one set. Each set is embedded as ``COORDINATES`` minimum
hashes; two sets agree in a coordinate with the probability of their similarity. A run of the
join splits all sets recursively: in a node, a set follows each of its tokens (coordinate and
value) that a hash of node and token picks, on average 1 / similarity of them, so that similar
sets meet in a child about once. A node with at most ``SMALL`` sets is compared by brute
force; larger ones are split again, ``DEPTH`` times at most, and what is still large then is
compared in blocks. Runs are repeated until a pair at the bound is met with probability
``recall`` on the longest path.

Met pairs whose embeddings look similar tie sets into candidate groups. Within each group
the shingle sets themselves are compared, all pairs, in blocks of bounded size: this gives
the exact links, their number per set, and the final classes. A pair that no run has met is
still linked if its sets are in one group by way of others. No pair is ever a row: a
comparison returns one row per set, with the number of its links and one link that ties it
to the others.

Defined results: null, empty and word-free texts have no shingles, no links and a class of
their own row; fewer words than a shingle are one shingle; a class is named by its smallest
doc_id, null only if all its ids are null; rows equal in doc_id and text count as several
copies; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fotolake.llm.common import (
    WordHashes,
    bytes_of,
    drop_stored,
    mix,
    packed,
    row_key,
    shingle_hashes,
    signed,
    stored,
    text_bytes,
    unpack,
    whole_keys,
    words,
)
from fotolake.llm.components import components

SIMILARITY = 0.8
SHINGLE = 5
RECALL = 0.999
COORDINATES = 128
SMALL = 256
DEPTH = 3
# Sets of one block when a group is compared exactly.
BLOCK = 512
# Shingles of one block on average: 64 MB of hashes.
BLOCK_SHINGLES = 1 << 23
# Met pairs go on from this estimated similarity: four standard deviations below the bound.
_MARGIN = 0.14

_U = np.uint64
_RNG = np.random.default_rng(8)
_FACTOR = _RNG.integers(1 << 31, size=COORDINATES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFT = _RNG.integers(1 << 32, size=COORDINATES, dtype=np.uint32)


def runs_needed(recall: float = RECALL, depth: int = DEPTH) -> int:
    """Runs after which a pair at the bound has shared a node at ``depth`` with ``recall``.

    Two such sets share a Poisson number of children with mean 1 in each node they share.
    """
    reached = 1.0
    for _ in range(depth):
        reached = 1 - math.exp(-reached)
    return math.ceil(math.log(1 - recall) / math.log(1 - reached))


def _embed(shingles: np.ndarray) -> np.ndarray:
    low = (shingles >> _U(32)).astype(np.uint32)
    least = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 2048):
        part = low[i : i + 2048, None] * _FACTOR + _SHIFT
        np.minimum(least, part.min(axis=0), out=least)
    return least


_SETS = "doc_id long, row long, set long, n int, minima binary"


def shingle_sets(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """One row per document: name of its shingle set (null if none), its size and embedding."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            names, sizes, minima = [], [], []
            for text in bytes_of(batch.column(2)):
                own = shingle_hashes(hashes.of(words(bytes(text))), size)
                sizes.append(len(own))
                names.append(xxhash.xxh3_64_intdigest(own.tobytes()) if len(own) else None)
                minima.append(_embed(own).tobytes() if len(own) else None)
            yield pa.record_batch(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([None if v is None else v - (1 << 63) for v in names], pa.int64()),
                    pa.array(sizes, pa.int32()),
                    pa.array(minima, pa.binary()),
                ],
                names=["doc_id", "row", "set", "n", "minima"],
            )

    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row"), text_bytes().alias("text")
    ).mapInArrow(run, _SETS)


def _children(node: np.ndarray, minima: np.ndarray, similarity: float):
    """Row and key of every child that the sets of the nodes choose."""
    coordinate = np.arange(COORDINATES, dtype=np.uint64) << _U(32)
    token = mix(node[:, None] ^ mix(minima.astype(np.uint64) | coordinate))
    bound = _U(int((1 << 64) / (similarity * COORDINATES)))
    row, column = np.nonzero(token < bound)
    return row, mix(token[row, column] ^ node[row])


def split(nodes: DataFrame, similarity: float) -> DataFrame:
    """The children (``run, node, set``) of ``run, node, set, minima``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                node = np.asarray(part.column(1)).view(np.uint64)
                minima = np.frombuffer(b"".join(bytes_of(part.column(3))), np.uint32)
                row, child = _children(node, minima.reshape(-1, COORDINATES), similarity)
                at = pa.array(row)
                yield pa.record_batch(
                    [part.column(0).take(at), pa.array(signed(child)), part.column(2).take(at)],
                    names=["run", "node", "set"],
                )

    rows = nodes.select("run", "node", "set", "minima")
    return rows.mapInArrow(run, "run int, node long, set long")


def meet(buckets: DataFrame, similarity: float) -> DataFrame:
    """Ties (``bucket, a, b``) between sets of one bucket whose embeddings look similar.

    ``buckets`` has bucket, set, group and codes. All pairs of a bucket are looked at, by
    their distance in the order of rows, but for those of groups already joined. Each group
    but the first of those joined gives one tie, from its first set b to the first set a of
    all, so a bucket has fewer ties than groups.
    """
    least = round((similarity - _MARGIN) * COORDINATES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_keys(batches, ["bucket"]):
            rows = table.to_batches()[0]
            bucket = np.asarray(rows.column(0))
            name = np.asarray(rows.column(1))
            codes = np.frombuffer(b"".join(bytes_of(rows.column(3))), np.uint8)
            codes = codes.reshape(-1, COORDINATES)
            group = _first_of_group(bucket, np.asarray(rows.column(2)))
            heads = np.flatnonzero(group == np.arange(len(group)))
            for distance in range(1, len(bucket)):
                near = np.flatnonzero(bucket[distance:] == bucket[:-distance])
                if not len(near):
                    break
                near = near[group[near] != group[near + distance]]
                for i in range(0, len(near), 1 << 14):
                    a = near[i : i + (1 << 14)]
                    b = a + distance
                    alike = (codes[a] == codes[b]).sum(axis=1) >= least
                    for x, y in zip(a[alike].tolist(), b[alike].tolist(), strict=True):
                        x, y = _top(group, x), _top(group, y)
                        if x != y:
                            group[max(x, y)] = min(x, y)
                # Flat again, so that the next distance skips what is joined.
                while (group[group] != group).any():
                    group = group[group]
            joined = heads[group[heads] != heads]
            if len(joined):
                columns = (bucket[joined], name[group[joined]], name[joined])
                yield pa.record_batch(list(map(pa.array, columns)), names=["bucket", "a", "b"])

    dealt = buckets.select("bucket", "set", "group", "codes").repartition("bucket")
    return dealt.sortWithinPartitions("bucket", "set").mapInArrow(run, "bucket long, a long, b long")


def _first_of_group(bucket: np.ndarray, group: np.ndarray) -> np.ndarray:
    """For every row the first row of its bucket that has the same group."""
    order = np.lexsort((np.arange(len(bucket)), group, bucket))
    sorted_bucket, sorted_group = bucket[order], group[order]
    fresh = np.append(
        True,
        (sorted_bucket[1:] != sorted_bucket[:-1]) | (sorted_group[1:] != sorted_group[:-1]),
    )
    starts = np.flatnonzero(fresh)
    out = np.empty(len(bucket), np.int64)
    out[order] = order[starts][np.cumsum(fresh) - 1]
    return out


def _top(group: np.ndarray, x: int) -> int:
    while group[x] != x:
        x = int(group[x])
    return x


def candidate_groups(
    sets: DataFrame, similarity: float, recall: float, small: int, depth: int
) -> DataFrame:
    """``node, root`` of the sets of ``set, minima, codes`` tied by meetings in some run.

    The nodes are met in three steps, with the sets contracted to groups after each, so
    that what is already joined is neither compared nor tied again: the small nodes and
    blocks of the first run; the first set of each group of these blocks, so that the
    blocks of one group of near copies become one; and all that is left, of all runs, where
    a bucket holds sets of several groups.
    """
    n_runs = runs_needed(recall, depth)
    names = mix(np.arange(1, n_runs + 1, dtype=np.uint64)).tolist()
    starts = F.posexplode(F.array(*(F.lit(name - (1 << 63)) for name in names)))
    nodes = split(sets.select(starts.alias("run", "node"), "set", "minima"), similarity)
    own = None
    for level in range(1, depth + 1):
        nodes = stored(nodes, "nodes")
        # Written, so that the join is one of two plain shuffles, in which Spark splits hot nodes.
        full = nodes.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        full = stored(full, "full")
        shared = stored(nodes.join(full, "node"), "shared")
        drop_stored(nodes)
        met = shared.where(F.col("size") <= small).select(
            "run", F.col("node").alias("bucket"), "set"
        )
        own = met if own is None else own.unionByName(met)
        large = shared.where(F.col("size") > small)
        if level == depth or large.isEmpty():
            break
        nodes = split(large.join(sets.select("set", "minima"), "set"), similarity)
    codes = sets.select("set", F.col("set").alias("group"), "codes")
    own_first = own.where("run = 0").select("bucket", "set")
    if large.isEmpty():
        ties = stored(meet(own_first.join(codes, "set"), similarity), "ties")
        groups = components(ties)
        rest = own.where("run > 0").select("bucket", "set")
    else:
        block = F.pmod(F.xxhash64("set", F.lit(1)), F.ceil(F.col("size") / small))
        within = large.where("run = 0").select(
            "node", F.xxhash64("node", block).alias("bucket"), "set"
        )
        first = own_first.unionByName(within.select("bucket", "set"))
        ties = stored(meet(first.join(codes, "set"), similarity), "ties")
        heads = within.join(ties.select("bucket", F.col("b").alias("set")), ["bucket", "set"], "left_anti")
        heads = stored(heads.select("node", "set"), "heads")
        numbers = stored(heads.groupBy("node").agg(F.count(F.lit(1)).alias("n")), "numbers")
        block = F.pmod(F.xxhash64("set", F.lit(1)), F.ceil(F.col("n") / small))
        heads = heads.join(numbers, "node").select(
            "node", "set", F.lit(None).cast("long").alias("only"), block.alias("block")
        )
        more = meet(_pairs_of_blocks(heads).join(codes, "set"), similarity)
        ties = ties.unionByName(stored(more, "ties"))
        groups = components(ties)
        # Members in the blocks of their group; blocks of one group only meet others.
        placed = stored(_blocks(_grouped(large.select("node", "set"), groups), small), "placed")
        rest = own.where("run > 0").select("bucket", "set").unionByName(_pairs_of_blocks(placed))
    more = stored(meet(_several(rest, sets, groups), similarity), "ties")
    return components(ties.unionByName(more))


def _grouped(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``rows`` with the ``group`` of their set: itself where nothing is tied to it."""
    roots = groups.select(F.col("node").alias("set"), F.col("root").alias("_root"))
    return (
        rows.join(roots, "set", "left").withColumn("group", F.coalesce("_root", "set")).drop("_root")
    )


def _several(buckets: DataFrame, sets: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of buckets that hold sets of several groups, with group and codes."""
    rows = stored(_grouped(buckets, groups).select("bucket", "set", "group"), "buckets")
    many = (
        rows.groupBy("bucket")
        .agg((F.min("group") != F.max("group")).alias("many"))
        .where("many")
        .select("bucket")
    )
    many = stored(many, "many")
    return rows.join(many, "bucket").join(sets.select("set", "codes"), "set")


def _blocks(rows: DataFrame, small: int) -> DataFrame:
    """``node, set, group`` with a ``block``: about ``small`` members each, of one group where
    that is large enough, else of several small groups (``only`` is null)."""
    sizes = rows.groupBy("node", "group").agg(F.count(F.lit(1)).alias("_own"))
    sizes = stored(sizes, "sizes")
    nodes = stored(
        sizes.groupBy("node").agg(
            F.sum(F.when(F.col("_own") < small, F.col("_own")).otherwise(F.lit(0))).alias("_mixed")
        ),
        "mixed",
    )
    big = F.col("_own") >= small
    count = F.ceil(F.when(big, F.col("_own")).otherwise(F.col("_mixed")) / small)
    at = F.pmod(
        F.when(big, F.xxhash64("set", F.lit(3))).otherwise(F.xxhash64("group", F.lit(3))), count
    )
    only = F.when(big, F.col("group"))
    return rows.join(sizes, ["node", "group"]).join(nodes, "node").select(
        "node", "set", "group", only.alias("only"), F.xxhash64(only, at).alias("block")
    )


def _pairs_of_blocks(placed: DataFrame) -> DataFrame:
    """Buckets that bring any two members of a node together that are of different groups.

    Only blocks are paired, never members; two blocks of one group are left out.
    """
    blocks = stored(placed.select("node", "block", "only").distinct(), "blocks")
    one = blocks.select("node", "block", F.col("only"))
    two = blocks.select("node", F.col("block").alias("_block"), F.col("only").alias("_only"))
    pairs = (
        one.join(two, "node")
        .where("block <= _block and (only is null or _only is null or only <> _only)")
        .select("node", "block", "_block", F.xxhash64("node", "block", "_block").alias("bucket"))
    )
    sides = pairs.select("node", "block", "bucket").unionByName(
        pairs.where("block < _block").select("node", F.col("_block").alias("block"), "bucket")
    )
    sides = stored(sides, "block-pairs")
    return placed.select("node", "block", "set").join(sides, ["node", "block"]).select("bucket", "set")


_MEMBERS = "bucket long, cross boolean, side int, set long, copies long, shingles binary"
_LINKS = "a long, b long, links long"


def exact_links(
    docs: DataFrame, members: DataFrame, similarity: float, size: int, block: int, block_shingles: int
):
    """Links by the shingle sets themselves, within the groups of ``group, set, row, copies, n``.

    Returns rows ``a, b, links``: parts of the number of documents that a's set is linked to,
    and b, a linked set that leads to all others of its class in this comparison, or a itself.
    """
    sizes = members.groupBy("group").agg(
        F.count(F.lit(1)).alias("size"), F.sum("n").alias("shingles")
    )
    sizes = stored(sizes, "sizes")
    # Blocks are bounded by their sets and by the bytes of these.
    blocks = F.greatest(F.ceil(F.col("size") / block), F.ceil(F.col("shingles") / block_shingles))
    dealt = (
        members.join(sizes, "group")
        .withColumn("_n", F.least(blocks, F.col("size")).cast("int"))
        .withColumn("_block", F.pmod(F.xxhash64("set", F.lit(2)), F.col("_n")).cast("int"))
        .select("row", "set", "copies", "group", "_n", "_block")
    )
    texts = docs.select(row_key().alias("row"), packed(text_bytes()).alias("packed"))
    # The members grow with the documents, so they are never broadcast.
    joined = texts.join(dealt.hint("merge"), "row").select("packed", "set", "copies", "group", "_n", "_block")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            rows, length = [], 0
            for text, *key in zip(*(batch.column(k) for k in range(6)), strict=True):
                own = shingle_hashes(hashes.of(words(unpack(text.as_py()))), size)
                name, copies, group, n, mine = (value.as_py() for value in key)
                if xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63) != name:
                    continue
                data = own.tobytes()
                for other in range(n):
                    low, high = min(mine, other), max(mine, other)
                    pair = xxhash.xxh3_64_intdigest(f"{group} {low} {high}".encode())
                    rows.append((pair - (1 << 63), low != high, int(mine == high), name, copies, data))
                    length += len(data)
                    if length > 1 << 24:
                        yield _member_batch(rows)
                        rows, length = [], 0
            if rows:
                yield _member_batch(rows)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from compared_buckets(whole_keys(batches, ["bucket"]), similarity)

    cut_rows = joined.mapInArrow(cut, _MEMBERS).repartition("bucket")
    return cut_rows.sortWithinPartitions("bucket", "set").mapInArrow(compare, _LINKS)


def compared_buckets(tables: Iterator[pa.Table], similarity: float) -> Iterator[pa.RecordBatch]:
    """Links of all buckets of tables that hold whole buckets, in any number of chunks."""
    for table in tables:
        bucket = table.column("bucket").to_numpy()
        ends = np.append(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, len(bucket))
        first, out = 0, []
        for end in ends.tolist():
            if end - first > 1:
                out.append(_compared(table.slice(first, end - first), similarity))
            first = end
        if out:
            a, b, links = (np.concatenate([part[k] for part in out]) for k in range(3))
            yield pa.record_batch(
                [pa.array(a), pa.array(b), pa.array(links, pa.int64())], names=["a", "b", "links"]
            )


def _member_batch(rows: list) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    kinds = (pa.int64(), pa.bool_(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
    return pa.record_batch(
        [pa.array(column, kind) for column, kind in zip(columns, kinds, strict=True)],
        names=["bucket", "cross", "side", "set", "copies", "shingles"],
    )


def _compared(rows: pa.Table, similarity: float):
    """Exact links among the members of one bucket, as (set, tie, number of linked documents)."""
    names = rows.column(3).to_numpy()
    # A document that is there twice brings its set twice.
    keep = np.flatnonzero(np.append(True, names[1:] != names[:-1]))
    names, side = names[keep], rows.column(2).to_numpy()[keep]
    copies = rows.column(4).to_numpy()[keep]
    # More than 2 GiB of shingles are several chunks.
    data = [value for chunk in rows.column(5).chunks for value in bytes_of(chunk)]
    sets = [np.frombuffer(data[i], np.uint64) for i in keep.tolist()]
    sizes = np.array([len(own) for own in sets])
    m = len(sets)
    shared = np.zeros((m, m), np.float32)
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(m), sizes)
    # Shingles of one member only link nothing.
    often = np.bincount(column)[column] > 1
    owner, column = owner[often], column[often]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    fresh = np.append(True, column[1:] != column[:-1]) if len(column) else np.zeros(0, bool)
    number = np.cumsum(fresh) - 1
    for start in range(0, int(number[-1]) + 1 if len(number) else 0, 4096):
        a, b = np.searchsorted(number, [start, start + 4096])
        incidence = np.zeros((m, int(number[b - 1]) - start + 1), np.float32)
        incidence[owner[a:b], number[a:b] - start] = 1
        shared += incidence @ incidence.T
    union = sizes[:, None] + sizes[None, :] - shared
    linked = shared * 1000 >= round(similarity * 1000) * union.astype(np.float64)
    np.fill_diagonal(linked, False)
    if rows.column(1)[0].as_py():
        linked &= side[:, None] != side[None, :]
    label = np.arange(m)
    while True:
        least = np.where(linked, label[None, :], m).min(axis=1)
        new = np.minimum(label, least)
        if (new == label).all():
            break
        label = new
    return names, names[label], linked @ copies


def near_duplicates(
    docs: DataFrame,
    similarity: float = SIMILARITY,
    size: int = SHINGLE,
    recall: float = RECALL,
    small: int = SMALL,
    depth: int = DEPTH,
    block: int = BLOCK,
    block_shingles: int = BLOCK_SHINGLES,
) -> DataFrame:
    """One row per document: doc_id, row (``row_key``), class_id, class_row, n_links.

    n_links counts the other documents whose shingle set has at least ``similarity`` with
    this one's, copies included. class_row is the row key of the class's first document.
    """
    found = stored(shingle_sets(docs, size), "sets")
    first = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")
    sets = (
        found.where("set is not null")
        .groupBy("set")
        .agg(
            F.min(first).alias("first"),
            F.count(F.lit(1)).alias("copies"),
            F.first("n").alias("n"),
            F.first("minima").alias("minima"),
        )
    )
    sets = stored(sets.withColumn("codes", _low_bytes(F.col("minima"))), "distinct")
    groups = candidate_groups(sets, similarity, recall, small, depth)
    members = stored(
        groups.join(sets.select("set", "first", "copies", "n"), groups["node"] == sets["set"]).select(
            F.col("root").alias("group"), "set", F.col("first.row").alias("row"), "copies", "n"
        ),
        "members",
    )
    links = stored(exact_links(docs, members, similarity, size, block, block_shingles), "links")
    roots = components(links.select("a", "b"))
    numbers = links.groupBy(F.col("a").alias("set")).agg(F.sum("links").alias("links"))
    named = (
        sets.select("set", "first", "copies")
        .join(roots, F.col("set") == F.col("node"), "left")
        .withColumn("root", F.coalesce("root", "set"))
    )
    classes = stored(named.groupBy("root").agg(F.min("first").alias("head")), "classes")
    by_set = (
        named.join(classes, "root")
        .join(numbers, "set", "left")
        .select("set", "head", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    )
    by_set = stored(by_set, "by_set")
    return found.drop("minima").join(by_set, "set", "left").select(
        "doc_id",
        "row",
        F.when(F.col("head").isNull(), F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("class_id"),
        F.coalesce("head.row", "row").alias("class_row"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


@F.arrow_udf(T.BinaryType())
def _low_bytes(minima: pa.Array) -> pa.Array:
    """The low byte of every coordinate: enough to estimate how many agree."""
    return pa.array([bytes(value[::4]) for value in bytes_of(minima)], pa.binary())

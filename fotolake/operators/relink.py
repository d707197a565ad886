"""Re-linking: catalog rows whose files have moved, found again by content hash.

``photo`` is the photo table. ``scan`` has one row per file found, with at
least md5hash and path. Results are changes: md5hash, old_path, new_path.
A NULL hash never matches.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fotolake.functions import paths
from fotolake.operators.changes import hash_multiplicity
from fotolake.operators.lookups import attach_batch, known_hashes
from fotolake.operators.pathmatch import match_one_to_one
from fotolake.operators.ranking import HOT_GROUP_ROWS, hot_groups, number_rows
from fotolake.session import cut_lineage

_OLD, _NEW = 0, 1


def _hashed(df: DataFrame) -> DataFrame:
    return df.where(F.col("md5hash").isNotNull())


# --- one catalog row per hash ------------------------------------------------


def relink_unique(photo: DataFrame, scan: DataFrame) -> DataFrame:
    """Hashes with exactly one photo take the scan's path; the last path wins."""
    single = (
        _hashed(photo)
        .groupBy("md5hash")
        .agg(F.count("path").alias("n"), F.max("path").alias("old_path"))
        .where(F.col("n") == 1)
        .select("md5hash", "old_path")
    )
    last = _hashed(scan).groupBy("md5hash").agg(F.max("path").alias("new_path"))
    return single.join(last, "md5hash")


def ambiguous_hashes(photo: DataFrame, scan: DataFrame) -> DataFrame:
    """Hashes of the scan that more than one photo has."""
    return hash_multiplicity(known_hashes(photo, scan)).where(F.col("n") > 1)


# --- k-th old path to k-th new path ------------------------------------------


def relink_ranked(
    photo: DataFrame, imports: DataFrame, scan: DataFrame, hot_rows: int = HOT_GROUP_ROWS
) -> DataFrame:
    """The k-th photo of a hash (by base, path) takes its k-th file (by path).

    Each file is used once; what is left over on either side stays unmatched.
    """
    base = F.coalesce("base_path", F.lit(""))
    sides = _hashed(attach_batch(photo, imports)).select(
        "md5hash", F.lit(_OLD).alias("side"), base.alias("base"), "path"
    )
    sides = sides.unionByName(
        _hashed(scan).select("md5hash", F.lit(_NEW).alias("side"), F.lit("").alias("base"), "path")
    )
    hot = hot_groups(sides, ["md5hash"], hot_rows)
    if hot is None:
        return _pair_by_rank(sides)
    cold = _pair_by_rank(sides.join(hot, "md5hash", "left_anti"))
    numbered = number_rows(
        sides.join(hot, "md5hash", "left_semi"), ["md5hash", "side"], ["base", "path"], "rank",
        hot_rows,
    )
    return cold.unionByName(_pairs(numbered, ["md5hash", "rank"]))


def _pair_by_rank(sides: DataFrame) -> DataFrame:
    """One shuffle by hash serves the numbering of both sides and their pairing."""
    window = Window.partitionBy("md5hash", "side").orderBy("base", "path")
    numbered = sides.repartition("md5hash").withColumn("rank", F.row_number().over(window))
    return _pairs(numbered, ["md5hash", "rank"])


def _side_path(side: int) -> Column:
    return F.max(F.when(F.col("side") == side, F.col("path")))


def _pairs(numbered: DataFrame, keys: list[str]) -> DataFrame:
    return (
        numbered.groupBy(*keys)
        .agg(_side_path(_OLD).alias("old_path"), _side_path(_NEW).alias("new_path"))
        .where(F.col("old_path").isNotNull() & F.col("new_path").isNotNull())
        .select("md5hash", "old_path", "new_path")
    )


# --- most similar old path ---------------------------------------------------


def moved_paths(photo: DataFrame, scan: DataFrame) -> DataFrame:
    """Paths (md5hash, side, path) to re-link, of hashes that several photos have.

    They are those in the catalog only (side 0) and in the scan only (side 1); a file
    still at its path is no change. Hashes without paths on both sides are left out. The
    rows are written to the checkpoint folder, as they are used more than once.
    """
    sides = photo.select("md5hash", "path", F.lit(_OLD).alias("side")).unionByName(
        scan.select("md5hash", "path", F.lit(_NEW).alias("side"))
    )
    paths_seen = (
        _hashed(sides)
        .groupBy("md5hash", "path")
        .agg(F.min("side").alias("side"), (F.min("side") != F.max("side")).alias("stays"))
    )
    old, stays = F.col("side") == _OLD, F.col("stays")
    hashes = (
        paths_seen.groupBy("md5hash")
        .agg(
            F.count_if(old).alias("photos"),
            F.count_if(old & ~stays).alias("gone"),
            F.count_if(~old).alias("found"),
        )
        .where((F.col("photos") > 1) & (F.col("gone") > 0) & (F.col("found") > 0))
        .select("md5hash")
    )
    moved = paths_seen.where(~stays).select("md5hash", "side", "path")
    return cut_lineage(moved.join(hashes, "md5hash", "left_semi"))


def _steps(path: Column) -> Column:
    return F.split(F.lower(paths.normalize_separators(path)), "/")


def relink_ambiguous(
    photo: DataFrame, scan: DataFrame, hot_rows: int = HOT_GROUP_ROWS
) -> DataFrame:
    """Each file of a hash with several photos takes the free old path most like its own.

    Paths are matched one to one by ``partial_ratio``, the most similar first (see
    :func:`fotolake.operators.pathmatch.match_one_to_one`). ``ratio`` is that similarity.
    """
    matched = match_one_to_one(moved_paths(photo, scan), hot_rows=hot_rows)
    return matched.select("md5hash", "old_path", "new_path", F.col("score").cast("int").alias("ratio"))


def match_trailing_path(
    free: DataFrame, hot_rows: int = HOT_GROUP_ROWS
) -> DataFrame:
    """Match the paths (md5hash, side, path) of a hash by the steps they share at the end.

    Paths that agree in all steps of the deepest path are matched first, in path order,
    then those that agree in one step less, and so on; what is left is matched in path
    order. Letter case does not count. The number of passes is the depth of the tree.
    """
    free = _hashed(free)
    depth = free.agg(F.max(F.size(_steps(F.col("path"))))).first()[0] or 0
    hot = hot_groups(free, ["md5hash"], hot_rows)
    if hot is None:
        return _match_in_place(free, depth)
    cold = _match_in_place(free.join(hot, "md5hash", "left_anti"), depth)
    spread = _match_by_passes(free.join(hot, "md5hash", "left_semi"), depth, hot_rows)
    return cold.unionByName(spread)


def _tail(steps: int) -> Column:
    return paths.trailing_path(F.col("path"), steps) if steps else F.lit("")


def _match_in_place(free: DataFrame, depth: int) -> DataFrame:
    """All levels after one shuffle by hash; a matched path leaves the next levels."""
    state = free.repartition("md5hash").withColumn("mate", F.lit(None).cast("string"))
    for steps in range(depth, -1, -1):
        alone = F.concat(F.lit("\0"), "path")
        level = Window.partitionBy("md5hash", "tail", "side").orderBy("path")
        place = Window.partitionBy("md5hash", "tail", "rank")
        other = F.when(F.col("side") == _OLD, _side_path(_NEW).over(place)).otherwise(
            _side_path(_OLD).over(place)
        )
        state = (
            state.withColumn("tail", F.when(F.col("mate").isNull(), _tail(steps)).otherwise(alone))
            .withColumn("rank", F.row_number().over(level))
            .withColumn("mate", F.coalesce("mate", other))
        )
    matched = state.where((F.col("side") == _OLD) & F.col("mate").isNotNull())
    return matched.select(
        "md5hash", F.col("path").alias("old_path"), F.col("mate").alias("new_path")
    )


def _match_by_passes(free: DataFrame, depth: int, hot_rows: int) -> DataFrame:
    """One numbering and one grouping of the paths still free per level."""
    matched = []
    for steps in range(depth, -1, -1):
        numbered = number_rows(
            free.withColumn("tail", _tail(steps)),
            ["md5hash", "tail", "side"],
            ["path"],
            "rank",
            hot_rows,
        )
        met = cut_lineage(
            numbered.groupBy("md5hash", "tail", "rank")
            .agg(_side_path(_OLD).alias("old_path"), _side_path(_NEW).alias("new_path"))
            .select("md5hash", "old_path", "new_path")
        )
        both = F.col("old_path").isNotNull() & F.col("new_path").isNotNull()
        matched.append(met.where(both))
        free = met.where(~both).select(
            "md5hash",
            F.when(F.col("old_path").isNull(), _NEW).otherwise(_OLD).alias("side"),
            F.coalesce("old_path", "new_path").alias("path"),
        )
    return reduce(DataFrame.unionByName, matched)


# --- writing the new paths ---------------------------------------------------


def stored_path(new_path: Column, base: str, local: bool) -> Column:
    """Path as the catalog keeps it: relative to the scanned base, or in full."""
    path = paths.relative_path(new_path, F.lit(base)) if local else new_path
    return paths.normalize_separators(path)


def apply_changes(
    photo: DataFrame,
    changes: DataFrame,
    dt_import: str,
    ftypes: DataFrame | None = None,
    base: str | None = None,
    local: bool = False,
) -> DataFrame:
    """Photos with the paths and names of ``changes``; others stay as they are.

    ``ftypes`` (new_path, ftype) also renews the type. With ``base``, the new paths are kept
    as the catalog keeps those of a batch scanned there.
    """
    if ftypes is not None:
        changes = changes.join(ftypes.select("new_path", "ftype"), "new_path", "left")
    else:
        changes = changes.withColumn("ftype", F.lit(None).cast("string"))
    moves = changes.select(
        F.col("old_path").alias("path"), "new_path", F.col("ftype").alias("new_ftype")
    )
    moved = F.col("new_path").isNotNull()
    kept = F.col("new_path") if base is None else stored_path(F.col("new_path"), base, local)
    return photo.join(moves, "path", "left").select(
        F.when(moved, kept).otherwise(F.col("path")).alias("path"),
        F.when(moved, paths.basename(F.col("new_path"))).otherwise(F.col("fname")).alias("fname"),
        F.coalesce("new_ftype", "ftype").alias("ftype"),
        "md5hash",
        "dt_orig",
        "dt_mod",
        F.when(moved, F.lit(dt_import)).otherwise(F.col("dt_import")).alias("dt_import"),
    )

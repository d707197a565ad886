"""Renaming: new paths from dates, captures and templates, numbered where they clash."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fotolake.functions import paths, templates, times
from fotolake.functions.hashes import plain_hash
from fotolake.operators.changes import register_bases
from fotolake.operators.lookups import attach_batch
from fotolake.operators.ranking import BROADCAST_KEYS, HOT_GROUP_ROWS, hot_groups, number_rows
from fotolake.schemas import Catalog
from fotolake.session import cut_lineage

PLAN_COLUMNS = (
    "md5hash", "dt", "new_base", "year", "month", "old_base", "old_path", "old_local", "old_dir",
    "old_name", "old_dt_orig", "timestamp", "isoyear", "isoweek", "isoday", "regex", "new_name",
    "new_dir", "new_path", "new_full_path", "status",
)


def plan_rename(
    photo: DataFrame,
    imports: DataFrame,
    new_base: str | None = None,
    template: str | None = None,
    whitespace: str | None = None,
    level: int | None = None,
    match: str | None = None,
    expand: str | None = None,
    date_format: str = "%Y%m%d_%H%M%S",
    split_dirs: str | None = None,
) -> DataFrame:
    """One row per photo with its old and new place.

    ``status`` is ``ok``, ``missing_date`` when the new place needs a date the
    photo lacks (its new path is then NULL), or ``no_match`` when ``match``
    hits nothing.
    """
    when = F.col("dt_orig")
    rows = attach_batch(photo, imports).select(
        plain_hash(F.col("md5hash")).alias("md5hash"),
        when.alias("dt"),
        (F.col("base_path") if new_base is None else paths.normalize_base(F.lit(new_base))).alias(
            "new_base"
        ),
        F.col("base_path").alias("old_base"),
        F.col("path").alias("old_path"),
        F.coalesce("local", F.lit(False)).alias("old_local"),
        F.col("fname").alias("old_name"),
        when.alias("old_dt_orig"),
        *[column.alias(name) for name, column in times.date_tokens(when, date_format).items()],
        (F.lit(None).cast("string") if match is None
         else templates.capture(F.col("path"), match, expand)).alias("regex"),
    )
    # One select per step: each names its inputs more than once.
    rows = rows.withColumn("_folder", paths.dirname(F.col("old_path")))
    folder = F.col("_folder")
    below = F.coalesce(paths.relative_path(folder, F.col("old_base")), folder)
    rows = rows.withColumn(
        "old_dir",
        F.when(F.col("old_local"), folder).otherwise(F.regexp_replace(below, "^/", "")),
    )
    if template is None:
        name = F.col("old_name")
    else:
        tokens = (
            "regex", *templates.DATE_TOKENS, "old_name", "md5hash", "old_dir", "old_base",
            "old_path", "new_base", "old_local", "old_dt_orig",
        )
        name = templates.render_name(
            template, {t: F.col(t) for t in tokens}, paths.extension(F.col("old_name"))
        )
    directory = paths.date_subdir(
        paths.flatten_dir(F.col("old_dir"), level), F.col("dt"), split_dirs
    )
    rows = rows.select("*", name.alias("new_name"), directory.alias("new_dir"))
    rows = rows.select(
        "*",
        F.regexp_replace(F.concat("new_dir", F.lit("/"), "new_name"), "^/", "").alias("_new"),
    )
    dated = split_dirs is not None or bool(
        templates.template_tokens(template) & {*templates.DATE_TOKENS, "old_dt_orig"}
    )
    status = F.when(F.col("dt").isNull(), "missing_date") if dated else F.when(F.lit(False), "")
    if match is not None:
        status = status.when(F.col("regex").isNull(), "no_match")
    rows = rows.withColumn(
        "new_path", paths.replace_whitespace(paths.normalize_path(F.col("_new")), whitespace)
    )
    return rows.select(
        "*",
        new_full_path(F.col("new_path")).alias("new_full_path"),
        status.otherwise("ok").alias("status"),
    ).select(*PLAN_COLUMNS)


def new_full_path(new_path: Column) -> Column:
    """Where a file goes: its new path below the base, which keeps its own spelling."""
    return paths.normalize_path(F.concat("new_base", F.lit("/"), new_path))


def duplicate_targets(plan: DataFrame) -> DataFrame:
    """New paths that more than one photo would get."""
    return (
        plan.where(F.col("new_path").isNotNull())
        .groupBy("new_path")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") > 1)
    )


def colliding_rows(plan: DataFrame) -> DataFrame:
    """Plan rows that share their new path."""
    duplicates = duplicate_targets(plan).select("new_path")
    return plan.join(duplicates, "new_path", "left_semi").select(*plan.columns)


def pad_width(plan: DataFrame) -> DataFrame:
    """One row: digits of the highest number a clash needs (NULL without clashes)."""
    sizes = (
        plan.where(F.col("new_path").isNotNull())
        .groupBy("new_path")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") > 1)
    )
    return sizes.agg(F.length(F.max("n").cast("string")).alias("width"))


def numbered_path(path: Column, number: Column, width: Column) -> Column:
    text = number.cast("string")
    padded = F.lpad(text, F.greatest(width, F.length(text)), F.lit("0"))
    return F.concat(paths.without_extension(path), F.lit("-"), padded, paths.extension(path))


def dedupe_targets(plan: DataFrame, hot_rows: int = HOT_GROUP_ROWS) -> DataFrame:
    """Number the photos of a shared new path by old path: ``x-01.jpg``, ``x-02.jpg``.

    All numbers have the width of the highest. Should a numbered name meet
    another target, the numbered side is numbered once more until every target
    is unique. ``new_full_path`` follows.
    """
    # Rows without a target never clash; a key of their own spreads them.
    key = F.coalesce("new_path", F.concat(F.lit("\0"), "old_path"))
    state = plan.select("*", key.alias("_key"), F.lit(False).alias("_numbered"))
    largest, recheck = _clashes(state)
    while largest is not None:
        state = _number_clashes(state, largest, hot_rows)
        if not recheck:
            break
        state = cut_lineage(state)
        largest, _ = _clashes(state)
    return state.select(*plan.columns)


def _clashes(plan: DataFrame) -> tuple[int | None, bool]:
    """Rows of the largest clash, and whether numbered names may meet other targets.

    They can only meet a target that ends like a numbered one, or each other
    when they have no extension.
    """
    numbered_look = F.col("_key").rlike(r"-\d+(\.[^./]*)?$")
    sizes = (
        plan.groupBy("_key")
        .agg(F.count("*").alias("n"))
        .select(
            F.when(F.col("n") > 1, F.col("n")).alias("clash"),
            F.when(F.col("n") > 1, paths.extension(F.col("_key")) == "")
            .otherwise(numbered_look)
            .alias("risk"),
        )
    )
    largest, risk = sizes.agg(F.max("clash"), F.max("risk")).first()
    return largest, bool(risk)


def _number_clashes(plan: DataFrame, largest: int, hot_rows: int) -> DataFrame:
    """Number every clash once; a row never numbered keeps its name against numbered ones."""
    clashes = (F.col("_n") > 1) & (F.col("_numbered") | ~F.col("_any_numbered"))
    sizes = [F.count("*").alias("_n"), F.max("_numbered").alias("_any_numbered")]
    hot = None
    if largest > hot_rows:
        plan = cut_lineage(plan)  # a hot clash takes several passes
        hot = hot_groups(plan, ["_key"], hot_rows)
    cold = plan if hot is None else plan.join(hot, "_key", "left_anti")
    group = Window.partitionBy("_key")
    ranked = (
        cold.withColumn("_n", F.count("*").over(group))
        .withColumn("_any_numbered", F.max("_numbered").over(group))
        .withColumn("_moves", clashes)
        .withColumn(
            "_rank", F.row_number().over(group.orderBy(F.desc("_moves"), "old_path")).cast("bigint")
        )
    )
    if hot is not None:
        spread = plan.join(hot, "_key", "left_semi")
        totals = cut_lineage(spread.groupBy("_key").agg(*sizes))
        totals = F.broadcast(totals) if totals.count() <= BROADCAST_KEYS else totals
        spread = spread.join(totals, "_key").withColumn("_moves", clashes)
        spread = number_rows(spread, ["_key", "_moves"], ["old_path"], "_rank", hot_rows)
        ranked = ranked.unionByName(spread)
    target = numbered_path(F.col("new_path"), F.col("_rank"), F.lit(len(str(largest))))
    full = new_full_path(target)
    renamed = {"new_path": target, "new_full_path": full, "_key": target, "_numbered": F.lit(True)}
    return ranked.select(
        *[
            F.when(F.col("_moves"), renamed[c]).otherwise(F.col(c)).alias(c) if c in renamed else c
            for c in plan.columns
        ]
    )


def move_plan(plan: DataFrame) -> DataFrame:
    """Old and new full path of every file that has a new place."""
    old = paths.full_path(F.col("old_local"), F.col("old_base"), F.col("old_path"))
    rows = plan.where(F.col("new_path").isNotNull() & F.col("new_base").isNotNull()).select(
        "md5hash", "old_path", "new_base", "new_path", "new_full_path", old.alias("_old")
    )
    return rows.select(
        "md5hash",
        "old_path",
        "new_base",
        "new_path",
        paths.normalize_path(F.col("_old")).alias("old_full"),
        F.col("new_full_path").alias("new_full"),
    )


def apply_rename(
    catalog: Catalog, moved: DataFrame, moment: datetime, local: bool = False
) -> Catalog:
    """Catalog after the files of ``moved`` (rows of a move plan) were moved.

    Each new base becomes a ``rename`` batch; bases no photo went to get none.
    """
    keys = ["_hash", "path"]
    hashed = catalog.photo.withColumn("_hash", plain_hash(F.col("md5hash")))
    moved = moved.select(
        F.col("md5hash").alias("_hash"), F.col("old_path").alias("path"), "new_base", "new_path"
    )
    moved = cut_lineage(moved.join(hashed.select(*keys), keys, "left_semi"))
    bases = moved.select(F.col("new_base").alias("base_path"))
    batches = cut_lineage(register_bases(catalog.imports, bases, local, "rename", moment))
    stored = F.col("new_path") if local else F.concat("new_base", F.lit("/"), "new_path")
    changes = moved.join(
        batches.select(F.col("base_path").alias("new_base"), "import_date"), "new_base"
    ).select(*keys, stored.alias("stored"), F.col("import_date").alias("renamed"))
    is_moved = F.col("stored").isNotNull()
    photo = hashed.join(changes, keys, "left").select(
        F.coalesce("stored", "path").alias("path"),
        F.when(is_moved, paths.basename(F.col("stored"))).otherwise(F.col("fname")).alias("fname"),
        "ftype",
        "md5hash",
        "dt_orig",
        "dt_mod",
        F.coalesce("renamed", "dt_import").alias("dt_import"),
    )
    new = batches.select(*catalog.imports.columns)
    return catalog.replace(imports=catalog.imports.unionByName(new), photo=photo)


def vacated_dirs(files: DataFrame, moved: DataFrame, base: str) -> DataFrame:
    """Folders below ``base`` that hold nothing once the files have moved.

    ``files`` (path) lists the files before the move. A folder that keeps only
    one thumbnail database counts as vacated and is flagged; a folder goes with
    its parents as far as these are vacated too.
    """
    inside = F.lit(paths_prefix(base))
    path = F.col("path")
    places = F.array(
        F.struct(F.col("old_full").alias("path"), F.lit(True).alias("left")),
        F.struct(F.col("new_full").alias("path"), F.lit(False).alias("left")),
    )
    # A path is in use when something moved in, or it was there and did not move out.
    in_use = ~F.bool_or("left") | F.bool_or("came")
    moves = moved.select(F.inline(places)).withColumn("came", ~F.col("left"))
    seen = files.select("path", F.lit(False).alias("left"), F.lit(False).alias("came"))
    kept = (
        seen.unionByName(moves)
        .where(F.startswith(path, inside))
        .groupBy("path")
        .agg(in_use.alias("kept"))
    )
    name = F.when(F.col("kept"), F.lower(paths.basename(path)))
    states = (
        kept.groupBy(paths.dirname(path).alias("dir"))
        .agg(F.count(name).alias("n"), F.max(name).alias("last"))
        .withColumn("only_thumbs", (F.col("n") == 1) & (F.col("last") == "thumbs.db"))
        .withColumn("in_use", (F.col("n") > 0) & ~F.col("only_thumbs"))
    )
    steps = F.split(F.substring(F.col("dir"), F.length(inside) + 1, F.length("dir")), "/")
    upward = F.transform(
        F.sequence(F.lit(1), F.size(steps)),
        lambda n: F.concat(inside, F.array_join(F.slice(steps, F.lit(1), n), "/")),
    )
    below_base = F.length("dir") > F.length(inside)
    return (
        states.where(below_base)
        .select(F.col("dir").alias("leaf"), "only_thumbs", "in_use", F.explode(upward).alias("dir"))
        .groupBy("dir")
        .agg(
            F.max("in_use").alias("in_use"),
            F.max(F.col("only_thumbs") & (F.col("leaf") == F.col("dir"))).alias("only_thumbs"),
        )
        .where(~F.col("in_use"))
        .select("dir", "only_thumbs")
    )


def paths_prefix(base: str) -> str:
    return base.replace("\\", "/").rstrip("/") + "/"


def sample_plan(plan: DataFrame, n: int = 5, seed: int | None = None) -> DataFrame:
    """``n`` rows to look over, in the order of a hash of seed and path: the same ones each time."""
    key = F.md5(F.concat(F.lit(f"{seed or 0}:"), "old_path"))
    return plan.orderBy(key, "old_path", "new_path").limit(n)

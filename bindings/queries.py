"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindings.views import query, table, view
from fotolake.functions import gps, hashes, images, paths, similarity, stamps, tags, templates, times
from fotolake.operators import changes, lookups, pathmatch, records, relink
from fotolake.plans import reconnect, rename
from fotolake.schemas import Catalog
from fotolake.sources import catalogs, files, sinks
from fotolake.streaming.ingest import empty_catalog, ingest_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

MOMENT = datetime(2024, 3, 1, 12, 0, 0)
BATCH = changes.batch_key(MOMENT)


def register(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    tag = view(spark, sf_dir, "fx_tag")
    photo = view(spark, sf_dir, "fx_photo")
    return Catalog(
        imports=view(spark, sf_dir, "fx_import"),
        hash=view(spark, sf_dir, "fx_hash"),
        photo=photo,
        tag=tag,
        location=lookups.gps_location(tag, photo),
    )


# --- re-linking --------------------------------------------------------------


@register
def relink_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relink.relink_ranked(
        view(spark, sf_dir, "fx_photo"),
        view(spark, sf_dir, "fx_import"),
        view(spark, sf_dir, "fx_scan"),
    )


@register
def relink_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relink.relink_unique(view(spark, sf_dir, "fx_photo"), view(spark, sf_dir, "fx_scan"))


@register
def relink_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    photo = view(spark, sf_dir, "fx_photo")
    changed = relink.relink_unique(photo, view(spark, sf_dir, "fx_scan"))
    return relink.apply_changes(photo, changed, BATCH)


@register
def reconnect_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photo table after the ranked re-link, with paths relative to the scanned folder."""
    after = reconnect.reconnect(
        _catalog(spark, sf_dir), view(spark, sf_dir, "fx_scan"), "/new", MOMENT, local=True
    )
    return after.photo.select("path", "fname", "md5hash", "dt_import")


@register
def duplicate_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths that clash once renaming has dropped the folders."""
    plan = _plan(spark, sf_dir, level=0, split_dirs="year")
    return changes.duplicate_paths(plan.select(F.col("new_path").alias("path")).dropna())


@register
def relink_ambiguous_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relink.ambiguous_hashes(
        view(spark, sf_dir, "fx_photo"), view(spark, sf_dir, "fx_scan")
    )


def _best(spark: SparkSession, sf_dir: str, score: pathmatch.Score) -> DataFrame:
    free = relink.moved_paths(view(spark, sf_dir, "fx_photo"), view(spark, sf_dir, "fx_scan"))
    return pathmatch.best_match(free, score)


@register
def relink_best_levenshtein(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = _best(spark, sf_dir, pathmatch.levenshtein_score)
    ratio = F.round(F.col("score") / 100, 6).alias("ratio")
    return best.select("md5hash", "old_path", "new_path", ratio)


@register
def relink_best_partial_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = _best(spark, sf_dir, pathmatch.ratio_score)
    return best.select("md5hash", "old_path", "new_path", F.col("score").cast("int").alias("ratio"))


@register
def relink_ambiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relink.relink_ambiguous(view(spark, sf_dir, "fx_photo"), view(spark, sf_dir, "fx_scan"))


@register
def relink_trailing_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relink.match_trailing_path(
        relink.moved_paths(view(spark, sf_dir, "fx_photo"), view(spark, sf_dir, "fx_scan"))
    )


@register
def reconnect_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photo table after hashes with one photo and with several were re-linked, types renewed."""
    scan = view(spark, sf_dir, "fx_scan").withColumn("ftype", F.lit("png"))
    after = reconnect.reconnect(
        _catalog(spark, sf_dir), scan, "/new", MOMENT, local=True, how="similar"
    )
    return after.photo.select("path", "fname", "ftype", "md5hash", "dt_import")


@register
def reconnect_same_second(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches and photos per batch when the second of the run is taken by another batch."""
    catalog = _catalog(spark, sf_dir)
    taken, _ = changes.register_batch(catalog.imports, "/other", True, "import", MOMENT)
    after = reconnect.reconnect(
        catalog.replace(imports=taken), view(spark, sf_dir, "fx_scan"), "/new", MOMENT
    )
    counts = changes.batch_is_empty(after.imports, after.photo)
    return after.imports.join(counts, "import_date").drop("is_empty")


# --- look-ups ----------------------------------------------------------------


@register
def existing_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.existing_paths(
        view(spark, sf_dir, "fx_photo"), view(spark, sf_dir, "fx_import")
    )


@register
def new_files_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.new_files_only(
        view(spark, sf_dir, "fx_scan"),
        view(spark, sf_dir, "fx_photo"),
        view(spark, sf_dir, "fx_import"),
    )


@register
def known_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.known_hashes(
        view(spark, sf_dir, "fx_photo"), view(spark, sf_dir, "fx_scan")
    ).select("path", "md5hash")


@register
def attach_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.attach_batch(
        view(spark, sf_dir, "fx_photo"), view(spark, sf_dir, "fx_import")
    ).select("path", "dt_import", "base_path", "local")


@register
def attach_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.attach_tags(view(spark, sf_dir, "fx_photo"), view(spark, sf_dir, "fx_tag"))


@register
def ordered_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.ordered_catalog(
        view(spark, sf_dir, "fx_photo"), view(spark, sf_dir, "fx_import"), by="base_path"
    ).select("base_path", "path")


# --- catalog changes ---------------------------------------------------------


def _scanned_photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("path")
    return view(spark, sf_dir, "fx_scan").select(
        "path",
        paths.basename(path).alias("fname"),
        F.lower(F.substring(paths.extension(path), 2, 10)).alias("ftype"),
        "md5hash",
        F.lit(None).cast("timestamp_ntz").alias("dt_orig"),
        F.lit(None).cast("timestamp_ntz").alias("dt_mod"),
        F.lit(BATCH).alias("dt_import"),
    )


@register
def register_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    imports = view(spark, sf_dir, "fx_import")
    return changes.register_batch(imports, "/new/", False, "update", MOMENT)[0]


@register
def register_batch_taken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches in one second: the later one takes the next."""
    imports = view(spark, sf_dir, "fx_import")
    imports, _ = changes.register_batch(imports, "/new", False, "update", MOMENT)
    return changes.register_batch(imports, "/next", True, "import", MOMENT)[0]


@register
def insert_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.upsert_hashes(view(spark, sf_dir, "fx_hash"), view(spark, sf_dir, "fx_scan"))


@register
def insert_photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.upsert_photos(
        view(spark, sf_dir, "fx_photo"), _scanned_photos(spark, sf_dir)
    ).select("path", "fname", "ftype", "md5hash", "dt_import")


@register
def insert_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = view(spark, sf_dir, "fx_scan").select(
        "md5hash",
        "path",
        F.concat(F.lit('{"path":"'), "path", F.lit('"}')).alias("meta"),
        F.length("path").alias("width"),
        F.lit(1).alias("height"),
    )
    return changes.upsert_tags(view(spark, sf_dir, "fx_tag"), new)


@register
def insert_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Locations of the labelled photos come first, then those of all photos.
    tag, photo = view(spark, sf_dir, "fx_tag"), view(spark, sf_dir, "fx_photo")
    backup = photo.where(F.startswith(F.col("path"), F.lit("q/")))
    return changes.upsert_locations(
        lookups.gps_location(tag, backup), lookups.gps_location(tag, photo, keep_zero=True)
    ).select("md5hash", *[F.round(c, 9).alias(c) for c in ("lat", "long", "elev_m")])


@register
def drop_empty_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.drop_empty_batches(
        view(spark, sf_dir, "fx_import"), view(spark, sf_dir, "fx_photo")
    )


@register
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.orphans(_catalog(spark, sf_dir))


def _rows(catalog: Catalog, *names: str) -> DataFrame:
    """Table name and key of every row of the named tables."""
    keys = {"import": "import_date", "photo": "path"}
    rows = [
        catalog.tables()[name].select(
            F.lit(name).alias("name"), F.col(keys.get(name, "md5hash")).alias("key")
        )
        for name in names
    ]
    return reduce(DataFrame.unionByName, rows)


@register
def prune_orphan_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = changes.prune_orphan_hashes(_catalog(spark, sf_dir))
    return _rows(left, "hash", "tag", "location")


@register
def cascade_delete_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left when the local batches are deleted."""
    local = view(spark, sf_dir, "fx_import").where("local")
    left = changes.cascade_delete_batches(_catalog(spark, sf_dir), local)
    return _rows(left, "import", "photo", "hash", "tag", "location")


@register
def cascade_delete_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left when all hashes of toxic documents are deleted."""
    gone = query(
        spark,
        sf_dir,
        "select md5(text) as md5hash from {documents} d join {labels} l "
        "on l.doc_id = d.doc_id and l.toxic = 1",
    )
    left = changes.cascade_delete_hashes(_catalog(spark, sf_dir), gone)
    return _rows(left, "photo", "hash", "tag", "location")


@register
def batch_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.batch_counts(view(spark, sf_dir, "fx_photo"))


@register
def batch_is_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.batch_is_empty(
        view(spark, sf_dir, "fx_import"), view(spark, sf_dir, "fx_photo")
    )


@register
def hash_multiplicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.hash_multiplicity(view(spark, sf_dir, "fx_photo"))


# --- renaming ----------------------------------------------------------------


def _plan(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return rename.plan_rename(
        view(spark, sf_dir, "fx_photo"), view(spark, sf_dir, "fx_import"), **options
    )


@register
def rename_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(
        spark,
        sf_dir,
        new_base="/sorted/",
        template="{regex}_{timestamp}_{month:02d}",
        whitespace="-",
        level=1,
        match=r"(?P<kind>[A-Z]+) (?P<number>\d+)",
        expand=r"\g<number>_\1",
        split_dirs="month",
    ).drop("dt", "old_dt_orig")


def _weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir, new_base="/sorted", template="{isoyear}_{isoweek}", level=1)


@register
def rename_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rename.dedupe_targets(_weekly(spark, sf_dir)).select(
        "old_base", "old_path", "new_path", "new_full_path"
    )


@register
def duplicate_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rename.duplicate_targets(_weekly(spark, sf_dir))


@register
def colliding_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rename.colliding_rows(_weekly(spark, sf_dir)).select("old_path", "new_path")


@register
def pad_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rename.pad_width(_weekly(spark, sf_dir)).select(F.col("width").cast("bigint").alias("width"))


@register
def distinct_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.distinct_bases(_plan(spark, sf_dir))


def _moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rename.move_plan(_plan(spark, sf_dir, level=1, whitespace="_"))


@register
def move_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _moves(spark, sf_dir).select("old_full", "new_full")


@register
def apply_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = _moves(spark, sf_dir)
    after = rename.apply_rename(_catalog(spark, sf_dir), moved, MOMENT)
    return after.photo.select("path", "fname", "md5hash", "dt_import")


@register
def apply_rename_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rename.apply_rename(_catalog(spark, sf_dir), _moves(spark, sf_dir), MOMENT).imports


@register
def vacated_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = _moves(spark, sf_dir)
    return rename.vacated_dirs(moved.select(F.col("old_full").alias("path")), moved, "/old")


@register
def sample_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rename.sample_plan(_plan(spark, sf_dir), 5, seed=7).select("old_path", "new_path")


# --- scalar functions --------------------------------------------------------


@register
def date_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = times.date_tokens(F.col("ts"), "%Y%m%d_%H%M%S %a %j %V %y%%")
    return table(spark, sf_dir, "events").select(
        "event_id", *[column.alias(name) for name, column in tokens.items()]
    )


@register
def date_subdir(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        paths.date_subdir(F.col("o_orderpriority"), F.col("o_orderdate"), "month").alias("dir"),
    )


@register
def exif_datetime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event times as metadata text, with unset and malformed ones among them."""
    text = (
        F.when(F.col("event_type") == "error", "0000:00:00 00:00:00")
        .when(F.col("event_type") == "view", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
        .otherwise(F.date_format("ts", "yyyy:MM:dd HH:mm:ss"))
    )
    return table(spark, sf_dir, "events").select(
        "event_id", times.parse_exif_datetime(text).alias("dt_orig")
    )


@register
def localize_utc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", times.localize(F.col("ts"), "America/Los_Angeles").alias("dt_utc")
    )


@register
def localize_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates with a summer time; hours are spread by the order key."""
    hour = F.make_dt_interval(F.lit(0), F.pmod("o_orderkey", F.lit(24)).cast("int"))
    when = F.col("o_orderdate") + hour
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", times.localize(when, "Europe/Berlin").alias("dt_utc")
    )


@register
def url_path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", paths.path_parts(F.col("url")).alias("p")).select(
        "page_id", "p.*"
    )


@register
def url_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id",
        templates.capture(url, r"(\w+)\.example\.(?P<tld>[a-z]+)/").alias("joined"),
        templates.capture(url, r"/(?P<n>\d+)\?page=(\d+)", r"\2_of_\g<n>").alias("expanded"),
    )


@register
def path_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows-style, dotted and blank-filled variants of the page addresses."""
    untidy = F.concat(F.lit("x/./y//../"), "url", F.lit("/a b/../c  d"))
    return table(spark, sf_dir, "pages").select(
        "page_id",
        paths.normalize_path(untidy).alias("normal"),
        paths.flatten_dir(F.col("url"), 4).alias("flat"),
        paths.replace_whitespace(untidy, "$_").alias("filled"),
        paths.normalize_separators(F.translate("url", "/", "\\")).alias("slashed"),
        paths.relative_path(F.col("url"), F.lit("https:/")).alias("relative"),
    )


@register
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", hashes.content_hash(F.encode("text", "UTF-8")).alias("md5hash")
    )


_MAGIC = "case lang when 'en' then 'GIF89a' when 'fr' then 'BM' when 'de' then 'P5 ' else '' end"


@register
def sniff_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type of each document's bytes, led by a mark that depends on its language."""
    content = F.encode(F.concat(F.expr(_MAGIC), "text"), "UTF-8")
    return table(spark, sf_dir, "documents").select(
        "doc_id", images.sniff_type(content).alias("ftype")
    )


@register
def json_tag_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", tags.json_tag(F.col("props"), "k").alias("k")
    )


@register
def tags_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.tags_long(view(spark, sf_dir, "fx_tag"))


@register
def tags_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = records.tags_long(view(spark, sf_dir, "fx_tag"))
    wide = records.select_tags(long, "Image Model, GPS GPSAltitude", by="md5hash")
    return wide.select(
        "md5hash", F.col("Image Model").alias("model"), F.col("GPS GPSAltitude").alias("altitude")
    )


@register
def tags_to_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata objects from the event columns."""
    pairs = {
        "value": ("F64", F.col("value").cast("string")),
        "user": ("S", F.col("user_id").cast("string")),
        "kind": ("S", F.col("event_type")),
        "note": ("A", F.col("props")),
    }
    array = F.array(
        *[
            F.struct(F.lit(k).alias("key"), F.lit(t).alias("field_type"), v.alias("value"))
            for k, (t, v) in pairs.items()
        ]
    )
    objects = table(spark, sf_dir, "events").select(
        "event_id", tags.tags_to_json(array).alias("meta")
    )
    fields = F.from_json("meta", "user string, kind string, note string, value double")
    return objects.select("event_id", fields.alias("fields")).select("event_id", "fields.*")


@register
def gps_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.gps_location(
        view(spark, sf_dir, "fx_tag"), view(spark, sf_dir, "fx_photo")
    ).select("md5hash", *[F.round(c, 9).alias(c) for c in ("lat", "long", "elev_m")])


@register
def rational_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rational arrays made of order line columns; some divisors are zero."""
    text = F.concat(
        F.lit("["), F.col("l_linenumber").cast("string"), F.lit(", "),
        F.col("l_partkey").cast("string"), F.lit("/"),
        F.floor(F.col("l_tax") * 100).cast("string"), F.lit("]"),
    )
    parsed = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_returnflag",
        gps.parse_rational_array(text).alias("parts"),
    )
    return parsed.select(
        "l_orderkey",
        "l_linenumber",
        F.get("parts", F.lit(0)).alias("first"),
        F.round(F.get("parts", F.lit(1)), 6).alias("second"),
        F.round(gps.dms_to_decimal(F.col("parts"), F.col("l_returnflag")), 6).alias("degrees"),
    )


@register
def stamp_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.stamp_records(view(spark, sf_dir, "fx_stamp"), base="/cams").drop("ocr")


@register
def stamp_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stamp times of all events, each in one of a dozen zones."""
    names = F.split(F.lit(ZONES), " ")
    zone = F.get(names, (F.col("event_id") % F.size(names)).cast("int"))
    stamp = F.concat(F.date_format("ts", "EEE MMM dd yyyy HH:mm:ss"), F.lit(" "), zone)
    read = stamps.parse_stamp_datetime(stamp).alias("t")
    events = table(spark, sf_dir, "events").select("event_id", read)
    return events.select("event_id", "t.dt_iso", F.date_format("t.dt_utc", "yyyy-MM-dd HH:mm:ss").alias("dt_utc"))


ZONES = "MST CEST UTC EDT EST JST AEDT PDT HST IST CST NZDT XYZ"


@register
def typed_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number, a text that holds a fraction, a text, and tags that are absent or of another kind."""
    return records.typed_tags(
        view(spark, sf_dir, "fx_tag"),
        {
            "iso": ("EXIF ISOSpeedRatings", "bigint"),
            "iso_real": ("EXIF ISOSpeedRatings", "double"),
            "model": ("Image Model", "string"),
            "model_number": ("Image Model", "bigint"),
            "altitude": ("GPS GPSAltitude", "string"),
            "lens": ("EXIF LensModel", "string"),
        },
    )


@register
def wipe_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of all five tables before and after a wipe."""
    before = _catalog(spark, sf_dir)
    after = changes.wipe(before).tables()
    n, none = F.count(F.lit(1)), F.lit(0).cast("long")
    counts = [
        own.agg(now.alias("rows_before"), later.alias("rows_after")).withColumn("name", F.lit(name))
        for tables, now, later in ((before.tables(), n, none), (after, none, n))
        for name, own in tables.items()
    ]
    every = reduce(DataFrame.unionByName, counts)
    sums = (F.sum(c).alias(c) for c in ("rows_before", "rows_after"))
    return every.groupBy("name").agg(*sums)


@register
def stamp_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "fx_stamp").select(
        "event_id", stamps.parse_exposure(F.col("ocr")).alias("exposure")
    )


@register
def union_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer").select(
        F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), "c_mktsegment"
    )
    supplier = table(spark, sf_dir, "supplier").select(
        F.col("s_name").alias("name"), "s_nationkey", F.col("s_acctbal").alias("balance")
    )
    return records.union_records(customer, supplier)


@register
def distinct_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.distinct_files(view(spark, sf_dir, "fx_scan"), existing_paths(spark, sf_dir))


@register
def filter_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.filter_name(view(spark, sf_dir, "fx_photo").select("path"), ".JPG|[13]\\d.jpg")


@register
def filter_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.filter_extension(
        view(spark, sf_dir, "fx_scan").select("path"), [".jpg", ".jpeg"], ignore_case=True
    )


# --- files -------------------------------------------------------------------


def _contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: English ones are GIF pictures, the others are text."""
    documents = table(spark, sf_dir, "documents")
    number = F.col("doc_id").cast("int")
    head = F.concat(
        F.lit("GIF89a"), F.char(number % 100 + 1), F.lit("\x01"), F.char(number % 90 + 2), F.lit("\x02")
    )
    text = F.when(F.col("lang") == "en", F.concat(head, "text")).otherwise(F.concat(F.lit("#"), "text"))
    return documents.select(
        F.concat(F.lit("/d/"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"),
        F.timestamp_seconds(F.col("doc_id") * 4000 + 1_700_000_000).alias("modificationTime"),
        F.octet_length("text").cast("long").alias("length"),
        F.encode(text, "UTF-8").alias("content"),
    )


@register
def scan_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the picture files, file times kept in a zone nine hours ahead."""
    return files.scan_records(_contents(spark, sf_dir), zone="Asia/Tokyo").drop("tags")


@register
def scan_contents_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of all files, whatever their type."""
    records = files.scan_records(_contents(spark, sf_dir), update=True)
    return records.select("path", "ftype", "md5hash", "width")


@register
def scan_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of every file of a scan."""
    contents = _contents(spark, sf_dir)
    return files.read_status(contents, files.scan_records(contents))


@register
def event_wall_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File times of the events, west of Greenwich."""
    instant = F.to_utc_timestamp("ts", "UTC")
    return table(spark, sf_dir, "events").select(
        "event_id", files.modified_at(instant, "Etc/GMT+5").alias("dt_mod")
    )


@register
def csv_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stamps written as a delimited file and read back."""
    out = f"{_scratch(spark)}/stamps"
    sinks.write_stamps_csv(records.stamp_records(view(spark, sf_dir, "fx_stamp"), "/cams"), out)
    return _read_csv(spark, out).select("path", "camera_name", "dt_iso", "exposure", "ocr")


@register
def csv_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rename plan written as a delimited file and read back."""
    out = f"{_scratch(spark)}/plan"
    sinks.write_plan_csv(_plan(spark, sf_dir), out)
    return _read_csv(spark, out).select("md5hash", "old_path", "new_path", "status")


@register
def pipe_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide metadata written as a pipe-separated file and read back."""
    out = f"{_scratch(spark)}/wide"
    sinks.write_wide_pipe(tags_wide(spark, sf_dir), out)
    return _read_csv(spark, out, "|")


@register
def parquet_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide metadata written as a table folder and read back."""
    out = f"{_scratch(spark)}/wide"
    sinks.write_wide_parquet(tags_wide(spark, sf_dir), out)
    return spark.read.parquet(out)


def _read_csv(spark: SparkSession, folder: str, sep: str = ",") -> DataFrame:
    reader = spark.read.option("header", True).option("multiLine", True).option("sep", sep)
    return reader.option("escape", '"').csv(folder)


@register
def incremental_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written out one file each, scanned in batches into a catalog, in two runs."""
    work = _scratch(spark)
    pages = table(spark, sf_dir, "pages")
    text = F.concat(F.lit("GIF89a"), F.regexp_replace("html", "[\r\n]", " "))
    marked = pages.select(text.alias("value"))
    empty_catalog(spark, f"{work}/catalog")
    for part in ("first", "second"):
        own = marked if part == "first" else marked.where(F.length("value") % 2 == 0)
        sinks.write_line_files(own, f"{work}/files/{part}")
        ingest_stream(
            spark, f"{work}/files", f"{work}/catalog", f"{work}/state", MOMENT,
            files_per_batch=2_000, local=True,
        ).awaitTermination()
    photo = catalogs.read_catalog(spark, f"{work}/catalog").photo
    return photo.select("ftype", "md5hash", "dt_import", paths.dirname(F.col("path")).alias("dir"))


def _scratch(spark: SparkSession) -> str:
    """A new folder below the shared checkpoint folder, or a local one in local mode."""
    shared = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        return tempfile.mkdtemp(prefix="fotolake-")
    return f"{shared}/query-{uuid.uuid4().hex}"

"""Catalog operators against small tables and plain Python."""

import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from fotolake import schemas
from fotolake.operators import changes, lookups, records, relink
from fotolake.operators.ranking import number_rows
from fotolake.plans import ingest, reconnect
from fotolake.schemas import Catalog

from tests.test_pathmatch import plain_greedy

MOMENT = datetime(2024, 3, 1, 12, 0, 0)


def photo_table(spark, rows):
    """Rows of (path, md5hash, dt_import)."""
    full = [(p, p.split("/")[-1], "jpeg", h, None, None, d) for p, h, d in rows]
    return spark.createDataFrame(full, schemas.PHOTO)


def scan_table(spark, rows):
    return spark.createDataFrame(rows, "md5hash string, path string")


def import_table(spark, rows):
    return spark.createDataFrame([(*row, "import") for row in rows], schemas.IMPORT)


def tuples(df, *columns):
    return sorted(tuple(row) for row in df.select(*columns).collect())


@pytest.fixture
def catalog(spark):
    return Catalog(
        imports=import_table(spark, [("d1", "/a", True), ("d2", "/b", False), ("d3", "/c", True)]),
        hash=spark.createDataFrame([("h1",), ("h2",), ("h3",), ("lost",)], schemas.HASH),
        photo=photo_table(
            spark,
            [("x/1.jpg", "h1", "d1"), ("x/2.jpg", "h1", "d1"), ("/b/3.jpg", "h2", "d2"), ("/b/4.jpg", "h3", "d2"), ("5.jpg", None, "d1")],
        ),
        tag=spark.createDataFrame([("h1", "{}", 1, 2), ("lost", "{}", 1, 2)], schemas.TAG),
        location=spark.createDataFrame([("h2", 1.0, 2.0, 0.0, None)], schemas.LOCATION),
    )


# --- numbering ---------------------------------------------------------------


@pytest.mark.parametrize("hot_rows", [10**6, 20, 1])
def test_number_rows_is_the_same_for_hot_groups(spark, hot_rows):
    rng = random.Random(5)
    groups = [("big" if rng.random() < 0.4 else f"k{rng.randrange(40)}", f"o{i:05d}") for i in range(3000)]
    rng.shuffle(groups)
    df = spark.createDataFrame(groups, "k string, o string").repartition(7)
    got = tuples(number_rows(df, ["k"], ["o"], "n", hot_rows), "k", "o", "n")
    members = defaultdict(list)
    for k, o in sorted(groups):
        members[k].append(o)
    assert got == sorted((k, o, i + 1) for k, os in members.items() for i, o in enumerate(os))


# --- changes -----------------------------------------------------------------


def test_register_batch(catalog):
    once, key = changes.register_batch(catalog.imports, "C:\\x\\", False, "update", MOMENT)
    row = once.where("import_date = '2024-03-01T12:00:00Z'").first()
    assert (row.base_path, row.local, row.type) == ("C:/x", False, "update")
    again, second = changes.register_batch(once, "/other", True, "import", MOMENT)
    assert (key, second) == ("2024-03-01T12:00:00Z", "2024-03-01T12:00:01Z")
    assert again.where(F.col("import_date") == second).first().base_path == "/other"
    third = changes.free_key(again.where(F.col("import_date") != key), MOMENT)
    assert third == key and changes.free_key(again, MOMENT) == "2024-03-01T12:00:02Z"
    with pytest.raises(ValueError):
        changes.register_batch(once, "/x", True, "copy", MOMENT)


def test_register_bases_takes_free_seconds(spark):
    taken = import_table(spark, [("2024-03-01T12:00:01Z", "/a", True), ("2024-03-01T11:59:59Z", "/a", True)])
    bases = spark.createDataFrame([("/z",), ("/y",), ("/y",), ("/x",), (None,)], "base_path string")
    got = changes.register_bases(taken, bases, True, "rename", MOMENT)
    east = MOMENT.replace(tzinfo=timezone(timedelta(hours=2)))
    assert changes.batch_key(east) == "2024-03-01T10:00:00Z"
    shifted = changes.register_bases(taken, bases, True, "rename", east)
    assert shifted.agg(F.min("import_date")).first()[0] == "2024-03-01T10:00:00Z"
    assert tuples(got, "import_date", "base_path", "local", "type") == [
        ("2024-03-01T12:00:00Z", "/x", True, "rename"),
        ("2024-03-01T12:00:02Z", "/y", True, "rename"),
        ("2024-03-01T12:00:03Z", "/z", True, "rename"),
    ]


def test_many_bases_take_linear_time(spark):
    bases = spark.range(100_000).selectExpr("concat('/b', id) as base_path")
    taken = import_table(spark, [("2024-03-01T12:00:01Z", "/a", True)])
    got = changes.register_bases(taken, bases, True, "rename", MOMENT)
    low, high, n = got.agg(
        F.min("import_date"), F.max("import_date"), F.countDistinct("import_date")
    ).first()
    assert (low, high, n) == ("2024-03-01T12:00:00Z", "2024-03-02T15:46:40Z", 100_000)


def test_upserts_are_idempotent_and_keep_what_is_known(spark, catalog):
    new = photo_table(
        spark, [("x/1.jpg", "changed", "d9"), ("n/1.jpg", "h9", "d9"), ("n/0.jpg", "h9", "d9")]
    )
    photo = changes.upsert_photos(catalog.photo, new)
    assert photo.count() == 7 and photo.where("md5hash = 'changed'").isEmpty()
    assert tuples(changes.upsert_photos(photo, new), "path") == tuples(photo, "path")
    hashes = changes.upsert_hashes(catalog.hash, new)
    assert hashes.count() == 6
    assert changes.upsert_hashes(hashes, new).count() == 6
    records_ = spark.createDataFrame(
        [("h9", "n/1.jpg", "late", 1, 1), ("h9", "n/0.jpg", "first", 2, 2), ("h1", "a", "no", 3, 3), (None, "b", "no", 4, 4)],
        "md5hash string, path string, meta string, width int, height int",
    )
    tag = changes.upsert_tags(catalog.tag, records_)
    assert tuples(tag, "md5hash", "meta") == [("h1", "{}"), ("h9", "first"), ("lost", "{}")]
    places = spark.createDataFrame([("h2", 9.0, 9.0, 9.0, None), ("h3", 3.0, 3.0, 0.0, None)], schemas.LOCATION)
    assert tuples(changes.upsert_locations(catalog.location, places), "md5hash", "lat") == [("h2", 1.0), ("h3", 3.0)]


def test_deletes_take_what_depends_on_them(spark, catalog):
    assert tuples(changes.drop_empty_batches(catalog.imports, catalog.photo), "import_date") == [("d1",), ("d2",)]
    only = changes.drop_empty_batches(catalog.imports, catalog.photo, F.col("import_date") == "d1")
    assert only.count() == 3
    assert tuples(changes.orphans(catalog), "md5hash") == [("lost",)]
    pruned = changes.prune_orphan_hashes(catalog)
    assert tuples(pruned.hash, "md5hash") == [("h1",), ("h2",), ("h3",)]
    assert tuples(pruned.tag, "md5hash") == [("h1",)]
    assert changes.orphans(pruned).isEmpty()

    batch = spark.createDataFrame([("d2",)], "import_date string")
    left = changes.cascade_delete_batches(catalog, batch)
    assert tuples(left.imports, "import_date") == [("d1",), ("d3",)]
    assert tuples(left.photo, "path") == [("5.jpg",), ("x/1.jpg",), ("x/2.jpg",)]
    assert tuples(left.hash, "md5hash") == [("h1",)]
    assert left.location.isEmpty()

    gone = changes.cascade_delete_hashes(catalog, spark.createDataFrame([("h1",), (None,)], "md5hash string"))
    assert tuples(gone.photo, "path") == [("/b/3.jpg",), ("/b/4.jpg",), ("5.jpg",)]
    assert tuples(gone.tag, "md5hash") == [("lost",)]

    some = changes.delete_photos(catalog, spark.createDataFrame([("/b/3.jpg",), ("x/1.jpg",)], "path string"))
    assert tuples(some.hash, "md5hash") == [("h1",), ("h3",)]
    assert some.location.isEmpty()

    empty = changes.wipe(catalog)
    assert all(t.isEmpty() for t in empty.tables().values())
    assert empty.photo.schema == catalog.photo.schema


def test_counts(catalog):
    assert tuples(changes.batch_counts(catalog.photo), "dt_import", "photo_rows") == [("d1", 3), ("d2", 2)]
    assert tuples(changes.batch_is_empty(catalog.imports, catalog.photo), "import_date", "is_empty") == [
        ("d1", False), ("d2", False), ("d3", True),
    ]
    assert tuples(changes.hash_multiplicity(catalog.photo), "md5hash", "n") == [("h1", 2), ("h2", 1), ("h3", 1)]


# --- look-ups ----------------------------------------------------------------


def test_known_and_new_files(spark, catalog):
    assert tuples(lookups.existing_paths(catalog.photo, catalog.imports), "path") == [
        ("/a/5.jpg",), ("/a/x/1.jpg",), ("/a/x/2.jpg",), ("/b/3.jpg",), ("/b/4.jpg",),
    ]
    files = spark.createDataFrame([("/a/x/1.jpg", 1), ("/a/new.jpg", 2)], "path string, length int")
    new = lookups.new_files_only(files, catalog.photo, catalog.imports)
    assert tuples(new, "path", "length") == [("/a/new.jpg", 2)]
    assert lookups.new_files_only(files, catalog.photo, catalog.imports, skip_check=True).count() == 2
    ordered = lookups.ordered_catalog(catalog.photo, catalog.imports, "base_path").collect()
    assert [r.path for r in ordered] == ["5.jpg", "x/1.jpg", "x/2.jpg", "/b/3.jpg", "/b/4.jpg"]


def test_gps_location(spark):
    def meta(lon, lat, alt=None, ref="0"):
        text = f'{{"GPS GPSLongitude":"{lon}","GPS GPSLongitudeRef":"W","GPS GPSLatitude":"{lat}","GPS GPSLatitudeRef":"N"'
        return text + (f',"GPS GPSAltitude":"{alt}","GPS GPSAltitudeRef":"{ref}"}}' if alt else "}")

    rows = {
        "a": meta("[120, 30, 0]", "[45, 0, 0]"), "b": meta("[0, 0, 0]", "[45, 0, 0]"),
        "c": meta("[1, 1/2/3]", "[45]"), "d": meta("[10]", "[20]", "100", "1"), "e": "{}",
        "nophoto": meta("[1]", "[1]"),
    }
    tag = spark.createDataFrame([(h, m, None, None) for h, m in rows.items()], schemas.TAG)
    photo = photo_table(spark, [(f"{h}{i}", h, "d") for h in "abcde" for i in range(2)])
    got = lookups.gps_location(tag, photo)
    assert tuples(got, "md5hash", "lat", "long", "elev_m", "wkt") == [
        ("a", 45.0, -120.5, 0.0, "POINT Z (-120.5 45.0 0.0)"),
        ("d", 20.0, -10.0, -100.0, "POINT Z (-10.0 20.0 -100.0)"),
    ]
    assert lookups.gps_location(tag, photo, keep_zero=True).count() == 3
    assert lookups.attach_tags(photo, tag).count() == 10


# --- re-linking --------------------------------------------------------------


def test_relink_unique(spark):
    photo = photo_table(spark, [("a", "h1", "d"), ("b", "h2", "d"), ("c", "h2", "d"), ("n", None, "d")])
    scan = scan_table(spark, [("h1", "new/1"), ("h1", "new/2"), ("h2", "new/3"), (None, "new/4")])
    moved = relink.relink_unique(photo, scan)
    assert tuples(moved, "md5hash", "old_path", "new_path") == [("h1", "a", "new/2")]
    after = relink.apply_changes(photo, moved, "now")
    assert tuples(after, "path", "fname", "dt_import") == [
        ("b", "b", "d"), ("c", "c", "d"), ("n", "n", "d"), ("new/2", "2", "now"),
    ]
    types = spark.createDataFrame([("new/2", "png")], "new_path string, ftype string")
    typed = relink.apply_changes(photo, moved, "now", types).where("path = 'new/2'")
    assert typed.first().ftype == "png"


@pytest.mark.parametrize("hot_rows", [10**6, 5])
def test_relink_ranked(spark, hot_rows):
    rng = random.Random(9)
    keys = ["hot"] * 60 + [f"h{i % 12}" for i in range(50)] + [None] * 5
    imports = import_table(spark, [(f"d{i}", f"/{9 - i}", i % 2 == 0) for i in range(4)])
    old = [(f"p{i:03d}", k, f"d{rng.randrange(5)}") for i, k in enumerate(keys)]
    new = [(rng.choice(keys), f"/n{i:03d}") for i in range(90)]
    got = relink.relink_ranked(photo_table(spark, old), imports, scan_table(spark, new), hot_rows)

    base = {f"d{i}": f"/{9 - i}" for i in range(4)}
    want = []
    for key in set(keys) - {None}:
        olds = sorted((base.get(d, ""), p) for p, k, d in old if k == key)
        news = sorted(p for k, p in new if k == key)
        want += [(key, o[1], n) for o, n in zip(olds, news)]
    assert tuples(got, "md5hash", "old_path", "new_path") == sorted(want)
    uses = Counter(row.new_path for row in got.collect())
    assert max(uses.values()) == 1


@pytest.mark.parametrize("local", [True, False])
def test_reconnect(spark, catalog, local):
    scan = scan_table(spark, [("h1", "/m/new/1.jpg"), ("h2", "/m/3.jpg"), ("other", "/m/9.jpg")])
    after = reconnect.reconnect(catalog, scan, "/m", MOMENT, local)
    key = "2024-03-01T12:00:00Z"
    root = "" if local else "/m/"
    assert tuples(after.photo.where(F.col("dt_import") == key), "path", "fname", "md5hash") == [
        (f"{root}3.jpg", "3.jpg", "h2"), (f"{root}new/1.jpg", "1.jpg", "h1"),
    ]
    assert after.photo.count() == 5 and changes.duplicate_paths(after.photo).isEmpty()
    assert tuples(after.imports.where("type = 'update'"), "import_date", "base_path", "local") == [(key, "/m", local)]
    nothing = reconnect.reconnect(catalog, scan.where("md5hash = 'other'"), "/m", MOMENT)
    assert nothing.imports.where("type = 'update'").isEmpty()
    twice = catalog.photo.unionByName(catalog.photo.where("md5hash = 'h2'"))
    assert tuples(changes.duplicate_paths(twice), "path", "n") == [("/b/3.jpg", 2)]


def _random_paths(rng, n, prefix):
    names = ["IMG 1.jpg", "img 1.JPG", "cover.png", "x.jpg"]
    return [f"{prefix}{rng.choice('abc')}/{rng.choice('de')}{i}/{rng.choice(names)}" for i in range(n)]


def _ambiguous_case():
    rng = random.Random(3)
    old, new = [], []
    for group in range(8):
        key = f"h{group}"
        old += [(p, key) for p in _random_paths(rng, rng.randrange(1, 8), "")]
        new += [(key, p) for p in _random_paths(rng, rng.randrange(0, 8), "/new/")]
    old.append(("stay.jpg", "h0"))
    new.append(("h0", "stay.jpg"))
    old = sorted(dict(old).items())
    return old, sorted(set(new))


def _free_paths(old, new):
    groups = defaultdict(lambda: ([], []))
    for path, key in old:
        groups[key][0].append(path)
    for key, path in new:
        groups[key][1].append(path)
    for key, (olds, news) in groups.items():
        if len(olds) > 1 and news:
            stay = set(olds) & set(news)
            yield key, [o for o in olds if o not in stay], [n for n in news if n not in stay]


def _steps(path):
    return path.lower().split("/")


def _by_trailing_path(olds, news):
    pairs = []
    depth = max((len(_steps(p)) for p in [*olds, *news]), default=0)
    for n in range(depth, -1, -1):
        def tail(path, n=n):
            return "/".join(_steps(path)[-n:]) if n else ""

        for key in {tail(p) for p in olds}:
            pairs += zip(
                sorted(p for p in olds if tail(p) == key), sorted(p for p in news if tail(p) == key)
            )
        olds = [p for p in olds if p not in {o for o, _ in pairs}]
        news = [p for p in news if p not in {n for _, n in pairs}]
    return pairs


@pytest.mark.parametrize("hot_rows", [10**6, 8, 2])
def test_trailing_path_as_defined(spark, hot_rows):
    old, new = _ambiguous_case()
    photo = photo_table(spark, [(p, k, "d") for p, k in old])
    free = relink.moved_paths(photo, scan_table(spark, new))
    got = relink.match_trailing_path(free, hot_rows=hot_rows)
    want = [
        (key, *pair) for key, olds, news in _free_paths(old, new) for pair in _by_trailing_path(olds, news)
    ]
    assert tuples(got, "md5hash", "old_path", "new_path") == sorted(want)


@pytest.mark.parametrize("hot_rows", [10**6, 2])
def test_relink_ambiguous_takes_the_most_similar_pairs_first(spark, hot_rows):
    old, new = _ambiguous_case()
    photo = photo_table(spark, [(p, k, "d") for p, k in old])
    got = relink.relink_ambiguous(photo, scan_table(spark, new), hot_rows=hot_rows)
    rows = [
        (key, side, path)
        for key, olds, news in _free_paths(old, new)
        for side, own in enumerate((olds, news))
        for path in own
    ]
    want = [(h, o, n, int(score)) for h, o, n, score in plain_greedy(rows)]
    assert tuples(got, "md5hash", "old_path", "new_path", "ratio") == sorted(want)


def test_a_renamed_file_in_a_renamed_folder_is_found(spark):
    photo = photo_table(spark, [("card/IMG_0012.jpg", "h", "d"), ("card/scan 9.jpg", "h", "d")])
    scan = scan_table(spark, [("h", "archive/IMG_0012 copy.jpg"), ("h", "archive/a scan 9.jpg")])
    got = relink.relink_ambiguous(photo, scan)
    assert tuples(got, "old_path", "new_path") == [
        ("card/IMG_0012.jpg", "archive/IMG_0012 copy.jpg"),
        ("card/scan 9.jpg", "archive/a scan 9.jpg"),
    ]


def test_reconnect_leaves_other_photos_alone(spark, catalog):
    """A photo of another batch in the same second keeps its path."""
    key = "2024-03-01T12:00:00Z"
    photo = catalog.photo.unionByName(photo_table(spark, [("/m/keep.jpg", "hk", key)]))
    imports = catalog.imports.unionByName(import_table(spark, [(key, "/m", False)]))
    scan = scan_table(spark, [("h1", "/m/new/1.jpg")])
    after = reconnect.reconnect(
        catalog.replace(photo=photo, imports=imports), scan, "/m", MOMENT, local=True
    )
    assert tuples(after.photo.where("md5hash = 'hk'"), "path", "dt_import") == [("/m/keep.jpg", key)]
    moved = after.photo.where("fname = '1.jpg' and dt_import = '2024-03-01T12:00:01Z'")
    assert tuples(moved, "path") == [("new/1.jpg",)]


def test_stored_path(values):
    p = F.col("p")
    assert values(relink.stored_path(p, "/new", True), ["/new/a\\b"], "p string") == ["a/b"]
    assert values(relink.stored_path(p, "/new", False), ["/new/a\\b"], "p string") == ["/new/a/b"]


# --- records and ingest ------------------------------------------------------


def test_long_wide_and_union(spark):
    tag = spark.createDataFrame([("h", '{"A b":"1","C":2}', None, None)], schemas.TAG)
    long = records.tags_long(tag)
    assert tuples(long, "key", "value") == [("A b", "1"), ("C", "2")]
    wide = records.select_tags(long, " A b,Z", by="md5hash")
    assert wide.columns == ["md5hash", "A b", "Z"] and wide.first()["A b"] == "1" and wide.first()["Z"] is None
    both = records.union_records(long, spark.createDataFrame([("k",)], "other string"))
    assert both.columns == ["md5hash", "key", "value", "other"] and both.count() == 3


def _record(path, md5hash, taken=None):
    tags = [("EXIF DateTimeOriginal", "A", taken), ("Image Model", "A", "M")] if taken else None
    root, fname = path.rsplit("/", 1)
    return (path, root, fname, "jpeg", md5hash, MOMENT, "ok", tags, 4, 3)


def test_new_rows_fill_all_tables_once(spark):
    catalog = Catalog.empty(spark)
    scan = spark.createDataFrame(
        [_record("/r/a/1.jpg", "h1", "2020:07:01 12:00:00"), _record("/r/b.jpg", "h1"), _record("/r/c.jpg", "h2")],
        schemas.SCAN_RECORD,
    )
    rows = ingest.new_rows(catalog, scan, "/r", MOMENT, local=True, zone="America/Los_Angeles")
    first = ingest.add_rows(catalog, rows)
    assert tuples(first.photo, "path", "md5hash") == [("a/1.jpg", "h1"), ("b.jpg", "h1"), ("c.jpg", "h2")]
    assert first.photo.where("path = 'a/1.jpg'").first().dt_orig == datetime(2020, 7, 1, 19, 0)
    assert tuples(first.hash, "md5hash") == [("h1",), ("h2",)]
    assert first.tag.where("md5hash = 'h1'").first().meta == (
        '{"EXIF DateTimeOriginal":"2020:07:01 12:00:00","Image Model":"M"}'
    )
    assert tuples(first.imports, "import_date", "base_path", "local") == [("2024-03-01T12:00:00Z", "/r", True)]
    again = ingest.add_rows(first, ingest.new_rows(first, scan, "/r", datetime(2024, 3, 2), local=True))
    for name, table in again.tables().items():
        assert table.count() == first.tables()[name].count(), name

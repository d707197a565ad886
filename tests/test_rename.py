from datetime import datetime

import pytest
from pyspark.sql import functions as F

from fotolake import schemas
from fotolake.plans import rename
from fotolake.schemas import Catalog

WHEN = datetime(2021, 3, 4, 5, 6, 7)
MOMENT = datetime(2024, 3, 1, 12, 0, 0)


@pytest.fixture
def tables(spark):
    photo = spark.createDataFrame(
        [
            ("a/b/IMG 1.jpg", "IMG 1.jpg", "jpeg", "AB-cd", WHEN, None, "d1"),
            ("/far/c/IMG 2.JPG", "IMG 2.JPG", "jpeg", "h2", WHEN, None, "d2"),
            ("top.jpg", "top.jpg", "jpeg", "h3", None, None, "d1"),
            ("lone.jpg", "lone.jpg", "jpeg", "h4", WHEN, None, "unknown"),
        ],
        schemas.PHOTO,
    )
    imports = spark.createDataFrame(
        [("d1", "/near", True, "import"), ("d2", "/far", False, "import")], schemas.IMPORT
    )
    return photo, imports


def by_path(plan):
    return {row.old_path: row for row in plan.collect()}


def test_plan_without_options_keeps_places(tables):
    plan = by_path(rename.plan_rename(*tables))
    row = plan["a/b/IMG 1.jpg"]
    assert (row.md5hash, row.old_dir, row.new_path, row.new_full_path, row.status) == (
        "abcd", "a/b", "a/b/IMG 1.jpg", "/near/a/b/IMG 1.jpg", "ok",
    )
    far = plan["/far/c/IMG 2.JPG"]
    assert (far.old_dir, far.new_path, far.new_full_path) == ("c", "c/IMG 2.JPG", "/far/c/IMG 2.JPG")
    assert plan["top.jpg"].new_path == "top.jpg" and plan["top.jpg"].status == "ok"
    assert plan["lone.jpg"].new_full_path is None
    assert list(plan["top.jpg"].asDict()) == list(rename.PLAN_COLUMNS)


def test_plan_with_all_options(tables):
    plan = by_path(
        rename.plan_rename(
            *tables, new_base="D:\\out\\", template="{regex} {timestamp}_{month:02d}", whitespace="_",
            level=1, match=r"IMG (\d)", expand=r"no\1", date_format="%Y-%j", split_dirs="month",
        )
    )
    row = plan["a/b/IMG 1.jpg"]
    assert row.new_path == "a/2021/Mar/no1_2021-063_03.jpg"
    assert row.new_full_path == "D:/out/a/2021/Mar/no1_2021-063_03.jpg"
    assert row.new_name == "no1 2021-063_03.jpg"
    assert plan["top.jpg"].new_path is None and plan["top.jpg"].status == "missing_date"
    assert plan["lone.jpg"].status == "no_match"
    assert plan["lone.jpg"].new_path == "2021/Mar/_2021-063_03.jpg"


def test_all_fields_can_be_tags(tables):
    template = "{old_path}|{new_base}|{old_local}|{old_dt_orig:%Y}|{old_dt_orig}"
    row = by_path(rename.plan_rename(*tables, template=template))["a/b/IMG 1.jpg"]
    assert row.new_name == "a/b/IMG 1.jpg|/near|True|2021|2021-03-04 05:06:07.jpg"


def plan_of(spark, rows):
    full = [(f"h{i}", old, "/n", new, f"/n/{new}" if new else None) for i, (old, new) in enumerate(rows)]
    return spark.createDataFrame(
        full, "md5hash string, old_path string, new_base string, new_path string, new_full_path string"
    )


@pytest.mark.parametrize("hot_rows", [10**6, 3])
def test_clashes_are_numbered_with_equal_width(spark, hot_rows):
    rows = [(f"o{i:02d}", "x.jpg") for i in range(10)] + [("a", "y.tar.gz"), ("b", "y.tar.gz"), ("c", "z")]
    rows += [(f"n{i}", None) for i in range(6)]
    got = {r.old_path: r for r in rename.dedupe_targets(plan_of(spark, rows), hot_rows).collect()}
    assert [got[f"o{i:02d}"].new_path for i in range(10)] == [f"x-{i + 1:02d}.jpg" for i in range(10)]
    assert got["o03"].new_full_path == "/n/x-04.jpg"
    assert (got["a"].new_path, got["b"].new_path, got["c"].new_path) == ("y.tar-01.gz", "y.tar-02.gz", "z")
    assert all(got[f"n{i}"].new_path is None for i in range(6)) and len(got) == len(rows)


@pytest.mark.parametrize("hot_rows", [10**6, 1])
def test_numbered_names_never_meet_other_targets(spark, hot_rows):
    rows = [("a", "x.jpg"), ("b", "x.jpg"), ("c", "x-1.jpg"), ("d", "x-1-1.jpg"), ("e", ".h"), ("f", ".h"), ("g", ".h-1")]
    got = {r.old_path: r.new_path for r in rename.dedupe_targets(plan_of(spark, rows), hot_rows).collect()}
    assert len(set(got.values())) == len(rows)
    assert (got["c"], got["d"], got["g"]) == ("x-1.jpg", "x-1-1.jpg", ".h-1")
    assert got["b"] == "x-2.jpg" and got["a"].startswith("x-1-")


def test_identical_files_get_different_names(spark):
    plan = plan_of(spark, [("a", "x.jpg"), ("b", "x.jpg")]).withColumn("md5hash", F.lit("same"))
    got = sorted(r.new_path for r in rename.dedupe_targets(plan).collect())
    assert got == ["x-1.jpg", "x-2.jpg"]


def test_files_without_hash_clash_too(spark):
    rows = [("a", "1.jpg"), ("b", "1.jpg"), ("c", "2.jpg")]
    plan = plan_of(spark, rows).withColumn("md5hash", F.lit(None).cast("string"))
    assert sorted(r.new_path for r in rename.dedupe_targets(plan).collect()) == ["1-1.jpg", "1-2.jpg", "2.jpg"]
    assert [tuple(r) for r in rename.duplicate_targets(plan).collect()] == [("1.jpg", 2)]
    assert rename.pad_width(plan).first().width == 1 and rename.colliding_rows(plan).count() == 2


def test_full_path_has_one_spelling(spark, tables):
    plan = rename.plan_rename(*tables, new_base="/my base", whitespace="_", level=0, template="x y")
    for step in (plan, rename.dedupe_targets(plan)):
        got = {r.old_path: r.new_full_path for r in step.collect()}
        moves = {r.old_path: r.new_full for r in rename.move_plan(step).collect()}
        assert got == moves and all(p.startswith("/my base/x_y") for p in got.values())


def test_clash_reports(spark):
    plan = plan_of(spark, [("a", "x"), ("b", "x"), ("c", "y"), ("d", None), ("e", None)])
    assert [tuple(r) for r in rename.duplicate_targets(plan).collect()] == [("x", 2)]
    assert sorted(r.old_path for r in rename.colliding_rows(plan).collect()) == ["a", "b"]
    assert rename.pad_width(plan).first().width == 1
    first = rename.sample_plan(plan, 3, seed=1).collect()
    assert len(first) == 3 and first == rename.sample_plan(plan.repartition(7), 3, seed=1).collect()


@pytest.mark.parametrize("local", [True, False])
def test_apply_rename(spark, tables, local):
    photo, imports = tables
    catalog = Catalog.empty(spark).replace(photo=photo, imports=imports)
    plan = rename.plan_rename(photo, imports, whitespace="_", level=0)
    moves = rename.move_plan(plan)
    assert {(r.old_full, r.new_full) for r in moves.collect()} == {
        ("/near/a/b/IMG 1.jpg", "/near/IMG_1.jpg"), ("/far/c/IMG 2.JPG", "/far/IMG_2.JPG"),
        ("/near/top.jpg", "/near/top.jpg"),
    }
    moved = moves.where("old_path <> 'top.jpg'")
    after = rename.apply_rename(catalog, moved, MOMENT, local)
    got = {r.md5hash: (r.path, r.fname, r.dt_import) for r in after.photo.collect()}
    near, far = ("", "") if local else ("/near/", "/far/")
    assert got == {
        "AB-cd": (f"{near}IMG_1.jpg", "IMG_1.jpg", "2024-03-01T12:00:01Z"),
        "h2": (f"{far}IMG_2.JPG", "IMG_2.JPG", "2024-03-01T12:00:00Z"),
        "h3": ("top.jpg", "top.jpg", "d1"),
        "h4": ("lone.jpg", "lone.jpg", "unknown"),
    }
    batches = after.imports.where("type = 'rename'").collect()
    assert {(r.base_path, r.local) for r in batches} == {("/near", local), ("/far", local)}


def test_batches_without_photos_are_not_added(spark, tables):
    photo, imports = tables
    catalog = Catalog.empty(spark).replace(photo=photo, imports=imports)
    moved = rename.move_plan(rename.plan_rename(photo, imports)).withColumn("old_path", F.lit("gone"))
    assert rename.apply_rename(catalog, moved, MOMENT).imports.count() == 2


def test_vacated_dirs(spark):
    files = ["/b/x/1.jpg", "/b/x/Thumbs.db", "/b/x/deep/2.jpg", "/b/y/3.jpg", "/b/y/4.jpg", "/b/5.jpg", "/b/z/q/6.jpg", "/c/7.jpg", "/b/k/8.jpg"]
    moves = [("/b/x/1.jpg", "/b/y/1.jpg"), ("/b/x/deep/2.jpg", "/n/2.jpg"), ("/b/y/3.jpg", "/n/3.jpg"),
             ("/b/5.jpg", "/n/5.jpg"), ("/b/z/q/6.jpg", "/b/z/6.jpg"), ("/c/7.jpg", "/n/7.jpg"), ("/b/k/8.jpg", "/b/k/8.jpg")]
    got = rename.vacated_dirs(
        spark.createDataFrame([(f,) for f in files], "path string"),
        spark.createDataFrame(moves, "old_full string, new_full string"),
        "/b",
    )
    assert sorted(tuple(r) for r in got.select("dir", "only_thumbs").collect()) == [
        ("/b/x", True), ("/b/x/deep", False), ("/b/z/q", False),
    ]

"""The views on driver tables."""

import re
from datetime import datetime

import pytest
from bindings import queries as registered
from bindings.views import VIEWS, view

T = datetime(2024, 1, 1)


@pytest.fixture
def tables(spark, work):
    rows = {
        "documents": (
            [(1, "one", "en", "src0", 3), (2, "one", "fr", "src1", 3), (3, None, "de", "src2", 0)],
            "doc_id long, text string, lang string, source string, n_chars long",
        ),
        "labels": ([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int"),
        "events": (
            [(1, T, 7, "click", 1.0, "{}")],
            "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
        ),
        "pages": ([(1, "http://a/", "<p>x</p>")], "page_id long, url string, html string"),
        "conversations": ([(1, 0, "user", "hi")], "conv_id long, turn int, role string, text string"),
        "benchmark": ([(1, "mark")], "item_id long, text string"),
    }
    for name, (data, schema) in rows.items():
        spark.createDataFrame(data, schema).write.parquet(f"{work}/{name}.parquet")
    return work


def _moved_columns(spark, df) -> set[str]:
    """Names of the columns that the exchanges of a plan take in."""
    plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    inputs = re.findall(r"\(\d+\) \w*Exchange\s*\nInput \[\d+\]: \[(.*)\]", plan)
    assert inputs
    return {column.split("#")[0].strip() for line in inputs for column in line.split(",")}


@pytest.mark.parametrize("threshold", ["-1", "10m"])
@pytest.mark.parametrize("name", ["fx_photo", "fx_scan", "fx_hash", "fx_tag", "cascade_delete_hashes"])
def test_contents_are_hashed_before_joins(spark, tables, name, threshold):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        df = view(spark, tables, name) if name in VIEWS else registered.QUERIES[name](spark, tables)
        assert not _moved_columns(spark, df) & {"text", "html"}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_photo_rows(spark, tables):
    rows = sorted(view(spark, tables, "fx_photo").select("path", "md5hash").collect())
    one = "f97c5d29941bfb1b2fdab0874906ab82"
    assert [row.path for row in rows] == [
        "/old/src1/fr/none/IMG 2.jpg", "/old/web/1.png", "de/none/IMG 3.jpg", "en/click/IMG 1.jpg",
        "q/en/IMG 1.jpg",
    ]
    assert rows[0].md5hash == one and rows[2].md5hash is None
    assert len(rows[1].md5hash) == 32


@pytest.mark.parametrize(
    "name",
    ["relink_ranked", "prune_orphan_hashes", "wipe_counts", "insert_hashes", "orphans", "insert_locations"],
)
def test_queries_move_no_contents(spark, tables, name):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert not _moved_columns(spark, registered.QUERIES[name](spark, tables)) & {"text", "html"}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)

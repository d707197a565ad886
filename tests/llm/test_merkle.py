"""The Merkle manifest against a plain version that climbs the trees one by one."""

import pytest
from fotolake.llm import merkle
from pyspark.sql import functions as F

from tests.llm import brute

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def same(df):
    rows = [tuple(r) for r in df.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = sorted(map(tuple, merkle.verify(df)[0].collect()), key=repr)
    assert got == sorted(brute.op11(rows), key=repr)
    return got


@pytest.mark.parametrize(
    "rows",
    [
        [],
        [(1, "a", None, 1, "X")],
        [(None, None, None, None, None), (None, None, None, None, "")],
        [(i, "a", "en", 1, f"Text {i}") for i in range(17)],
    ],
)
def test_small_tables(spark, rows):
    same(spark.createDataFrame(rows, SCHEMA))


def test_uneven_sources_nulls_ties_and_repeats(spark):
    rows = [(1, "a", None, 1, "X"), (1, "a", None, 1, "X"), (1, "a", None, 1, "Y")]
    rows += [(None, "b", None, None, ""), (None, "b", "x", None, None), (7, None, "de", 0, "Ü\n")]
    rows += [(i, "é", None, 1, f"A{i}") for i in range(300)]
    rows += [(i, f"s{i}", "x", 1, f"A{i}") for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = same(df.withColumn("leaf", F.lit(1)).withColumn("idx", F.lit("x")))
    assert {r[-1] for r in got} == {True, False}


def test_a_long_text(spark):
    same(spark.createDataFrame([(5, "a", None, 1, "Ab" * 2_000_000), (6, "a", None, 1, "")], SCHEMA))


def test_small_fan_out_gives_valid_proofs(spark):
    rows = [(i, f"s{i % 3}", None, 1, "low") for i in range(50)]
    found, manifest = merkle.verify(spark.createDataFrame(rows, SCHEMA), fan_out=2)
    assert found.where("verified").count() == 50
    assert manifest.proofs.agg(F.max(F.size("segments"))).first()[0] == 4 + 2

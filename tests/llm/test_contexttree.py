"""Context-tree scores against mixtures computed anew for every decision."""

import random

import pytest
from fotolake.llm import contexttree
from pyspark.sql import functions as F

from tests.llm import brute

SCHEMA = "doc_id long, text string"


def scored(df, **options):
    return [r.asDict() for r in contexttree.score_texts(df, **options).collect()]


def same(df, depth=2, **options):
    docs = [tuple(r) for r in df.select("doc_id", "text").collect()]
    train = [text for doc_id, text in docs if not brute.op13_held_out(doc_id)]
    want = [
        (*base, brute.op13_score(train, text, depth))
        for base, (_, text) in zip(brute.op13_base(docs), docs, strict=True)
    ]
    got = [
        (r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"],
         r["base_score"], r["score"])
        for r in scored(df, depth=depth, **options)
    ]
    order = lambda r: (r[0] is None, r[0] or 0, round(r[6], 6))
    got, want = sorted(got, key=order), sorted(want, key=order)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for one, other in zip(got, want, strict=True):
        assert one[5:] == pytest.approx(other[5:], rel=1e-9, abs=1e-9)
    return got


def test_words_and_bytes(spark):
    rng = random.Random(13)
    words = ["the", "The", "cat", "é", "x", "on\n", "\tmat"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(6)))) for i in range(30)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r[1] for r in same(df)} == {True, False}
    same(df.repartition(3), shard_bytes=20)


@pytest.mark.parametrize(
    "rows", [[(4, "ab"), (None, "ab"), (4, "ab"), (4, None), (5, "")], [(None, "held out only")]]
)
def test_nulls_repeats_and_no_training(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    same(df.withColumn("n", F.lit(1)).withColumn("word", F.lit("x")))


def test_empty_table(spark):
    assert scored(spark.createDataFrame([], SCHEMA)) == []


def test_long_text_in_parts(spark, monkeypatch):
    df = spark.createDataFrame([(1, "abc abd " * 60), (4, "abc"), (None, "abd")], SCHEMA)
    whole = scored(df, depth=3)
    monkeypatch.setattr(contexttree, "_PART", 50)
    monkeypatch.setattr(contexttree, "_MERGE", 10)
    parts = scored(df, depth=3)
    key = lambda r: (r["doc_id"] or 0, r["n_bytes"])
    for one, other in zip(sorted(whole, key=key), sorted(parts, key=key), strict=True):
        assert one.pop("doc_id") == other.pop("doc_id")
        assert one == pytest.approx(other, rel=1e-12)


def test_log_gamma(spark):
    import math

    df = spark.createDataFrame([(x,) for x in (0.5, 1.0, 2.5, 30.0, 1e6 + 0.5, 1e12)], "x double")
    for x, value in df.select("x", contexttree.log_gamma(F.col("x"))).collect():
        assert value == pytest.approx(math.lgamma(x), rel=1e-12, abs=1e-9)


def test_deeper_contexts_tell_more(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    bits = [
        contexttree.score_texts(docs, depth=d)
        .where("held_out")
        .agg(F.sum(contexttree.bits_per_byte() * F.col("n_bytes")) / F.sum("n_bytes"))
        .first()[0]
        for d in (0, 2, 5)
    ]
    assert bits[0] > bits[1] > bits[2]

"""Collocations against plain counting of all phrases."""

import random

import pytest
from fotolake.llm import collocations
from pyspark.sql import functions as F

from tests.llm import brute

SCHEMA = "lang string, text string"


def same(df, **options):
    rows = [tuple(r) for r in df.select("lang", "text").collect()]
    got = sorted(map(tuple, collocations.collocations(df, **options).collect()))
    plain = {k: v for k, v in options.items() if k in ("support", "top")}
    assert got == sorted(brute.op12(rows, **plain))
    return got


def texts(seed, n=60):
    rng = random.Random(seed)
    words = ["a", "b", "Ab", "é", "x y", "the", "of", "-", "\x1c"]
    glue = [" ", " ", " ", "\t", ". ", ",", "\n", "  "]
    out = []
    for _ in range(n):
        text = "".join(rng.choice(words) + rng.choice(glue) for _ in range(rng.randrange(80)))
        out.append((rng.choice(["en", "en", "en", "de", None, "und"]), text))
    return out


@pytest.mark.parametrize("shard_words", [1, 300, 1 << 22])
def test_any_shards_give_all_phrases(spark, shard_words):
    df = spark.createDataFrame(texts(shard_words), SCHEMA)
    assert same(df, support=12, shard_words=shard_words)


def test_order_ties_and_limit(spark):
    df = spark.createDataFrame(texts(7, 90), SCHEMA).repartition(3)
    assert same(df, support=6, top=5, shard_words=500)


def test_empty_null_and_repeated_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert same(none) == []
    rows = [("en", None), (None, ""), ("en", " .,\n")] + [("en", "one two three")] * 120
    df = spark.createDataFrame(rows, SCHEMA).withColumn("phrase", F.lit(1)).withColumn("n", F.lit(2))
    assert [r[2] for r in same(df)] == ["one two three"]


def test_a_long_text_is_cut_at_separators(spark):
    text = "red green blue, " * 400_000
    df = spark.createDataFrame([("en", text), ("en", "red green " * 150)], SCHEMA)
    assert same(df, shard_words=10_000)


def test_saturated_bits_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(collocations.bit_set, "__defaults__", (1 << 10,))
    df = spark.createDataFrame(texts(3, 80), SCHEMA).repartition(5)
    assert same(df, support=5, shard_words=200)


def test_rows_of_the_shards_keep_pace_with_the_texts(spark, monkeypatch):
    rows = spark.sparkContext.accumulator(0)
    plain = type(spark.range(1)).mapInArrow

    def counting(self, function, schema):
        def run(batches):
            for batch in function(batches):
                rows.add(batch.num_rows)
                yield batch

        return plain(self, run, schema)

    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", counting)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(2_000)]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [("en", " ".join(rng.choices(words, weights, k=100))) for _ in range(1_000)]
    made = []
    for n in (200, 1_000):
        before = rows.value
        df = spark.createDataFrame(docs[:n], SCHEMA).coalesce(1)
        assert collocations.collocations(df, shard_words=2_000).count()
        made.append(rows.value - before)
    assert 0 < made[1] <= 8 * made[0], made

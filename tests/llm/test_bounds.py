"""What reaches the driver or one task stays bounded on repeated rows and empty texts."""

import numpy as np
from fotolake.llm import chosenpath, mincut, mixing, quality
from pyspark.sql import functions as F


def test_labelled_rows_are_one_per_document(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "fit_rules", lambda x, bad, names: seen.append(len(x)) or [])
    docs = spark.range(5_000).select(
        (F.col("id") % 2).alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text")
    )
    labels = spark.range(300).select((F.col("id") % 2).alias("doc_id"), (F.col("id") % 2).alias("quality"))
    assert quality.learn_rules(docs, labels, fit_rows=100) == []
    assert seen == [100]


def test_equal_pages_are_one(spark, monkeypatch):
    seen = []

    def fit(x, content):
        seen.append(len(x))
        return np.zeros(mincut.FEATURES)

    monkeypatch.setattr(mincut, "fit_classifier", fit)
    page = "<article><p>One sentence here.</p></article><nav><p>Home</p></nav>"
    pages = spark.range(3_000).select(F.lit(1).alias("page_id"), F.lit("u").alias("url"), F.lit(page).alias("html"))
    mincut.learn_costs(pages, fit_pages=10)
    assert seen == [2]


def test_empty_texts_are_dealt_to_shards_too(spark):
    docs = spark.range(300).select(
        F.col("id").alias("doc_id"), F.lit("a").alias("source"), F.lit(None).cast("string").alias("text")
    )
    sized = mixing._sizes(docs, 1)
    assert mixing.targets(sized, (5.0,), 3).first()["n_rows"] == 300
    assert mixing.mix(docs, shard_rows=10).where("taken = 0 and size = 0").count() == 300
    full = docs.withColumn("text", F.lit("one two three four"))
    taken = mixing.mix(full, shard_rows=10, block_words=4).agg(F.sum("taken")).first()[0]
    assert abs(taken - 1200) <= 4


def test_ties_of_a_bucket_are_fewer_than_its_groups(spark):
    codes = bytes(range(chosenpath.COORDINATES))
    rows = [(b, s, s // 10, codes) for b in (1, 2) for s in range(60)]
    buckets = spark.createDataFrame(rows, "bucket long, set long, group long, codes binary")
    ties = chosenpath.meet(buckets, 0.8).collect()
    assert sorted((t["bucket"], t["a"], t["b"]) for t in ties) == [
        (b, 0, s) for b in (1, 2) for s in (10, 20, 30, 40, 50)
    ]

"""From raw documents to a mixed corpus: five stages, each by one operator of ``fotolake.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next one's ``docs``. All but the last return the columns of documents.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fotolake.llm import chosenpath, decontaminate, linededup, mixing, quality
from fotolake.llm.common import row_key, scratch, stored

# The rules of the first stage are learned, and its verdicts have no SQL.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rule nor the learned decision list rejects."""
    rules = quality.learn_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    # Whole rows travel as one column, so that no name of theirs clashes.
    rows = docs.select("text", F.struct("*").alias("doc"))
    return quality.judge(rows, rules).where("kept").select("doc.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later repeated runs of lines; those with no line left go."""
    rows = docs.select("doc_id", "text", F.struct("*").alias("doc"))
    done = linededup.dedup_lines(rows)
    left = F.col("line_dedup.n_removed") < F.col("line_dedup.n_lines")
    new = {"text": F.col("text"), "n_chars": F.char_length("text").cast("long")}

    def column(name: str):
        own = F.col("doc")[name]
        changed = F.col("line_dedup.n_removed") > 0
        return (F.when(changed, new[name]).otherwise(own) if name in new else own).alias(name)

    kept = done.where(left | (F.col("line_dedup.n_lines") == 0))
    return kept.select(*map(column, docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of similar texts. Rows equal in id and text are one."""
    found = chosenpath.near_duplicates(docs.select("doc_id", "text"))
    first = found.where(F.col("row") == F.col("class_row")).select(F.col("row").alias("_row"))
    return (
        docs.withColumn("_row", row_key())
        .join(first, "_row", "left_semi")
        .dropDuplicates(["_row"])
        .select(*docs.columns)
    )


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    named = docs.select(row_key().alias("doc_id"), "text")
    index = stored(decontaminate.build_index(named), "index")
    phrases = decontaminate.item_phrases(spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = decontaminate.overlap_report(index, phrases).where("contaminated")
    return (
        docs.withColumn("_row", row_key())
        .join(hit.select(F.col("doc_id").alias("_row")), "_row", "left_anti")
        .select(*docs.columns)
    )


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of every document."""
    return mixing.mix(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing_weights),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        if path is None:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
            path = f"{tempfile.mkdtemp(prefix='llm-')}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

"""Registered queries of the operators; their SQL is in ``oracle``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fotolake.llm import (
    chat,
    chosenpath,
    collocations,
    contexttree,
    decontaminate,
    linededup,
    merkle,
    mincut,
    mixing,
    quality,
    redirects,
    substrings,
    warc,
)
from fotolake.llm.common import scratch, stored
from fotolake.llm.oracle import ORACLE

__all__ = ["ORACLE", "QUERIES"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

RULES = [
    redirects.UrlRule("com", "/", "allow"),
    redirects.UrlRule("example.com", "/en/", "block"),
    redirects.UrlRule("www.example.com", "/en/", "allow"),
    redirects.UrlRule("net", "/es/", "block"),
    redirects.UrlRule("net", "/fr/", "block"),
]


def register(query: Callable[[SparkSession, str], DataFrame]):
    QUERIES[query.__name__] = query
    return query


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register
def op1_redirect_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return redirects.judge_urls(pages, redirects.redirect_edges(pages), RULES)


@register
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = stored(decontaminate.build_index(_table(spark, sf_dir, "documents")), "index")
    phrases = decontaminate.item_phrases(_table(spark, sf_dir, "benchmark"))
    names = F.array_sort(F.transform("items", lambda item: item.cast("string")))
    return decontaminate.overlap_report(index, phrases).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        "contaminated",
    )


@register
def op3_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    rules = quality.learn_rules(docs, _table(spark, sf_dir, "labels"))
    own = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return quality.judge(docs.select("doc_id", "text"), rules).select(
        "doc_id", *(f"quality_counts.{name}" for name in own), "base_failed", "kept"
    )


@register
def op4_min_cut_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    texts = mincut.main_texts(pages, mincut.learn_costs(pages))
    return texts.withColumn("n_chars", F.char_length("text").cast("long"))


@register
def op5_chunked_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc") or _local_scratch(spark)
    warc.write_archives(warc.mark_revisits(_table(spark, sf_dir, "pages")), path)
    return warc.read_records(spark, path).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@register
def op6_winnow_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.dedup_lines(docs).select(
        "doc_id",
        "line_dedup.n_lines",
        "line_dedup.n_removed",
        F.sha2(F.coalesce(F.col("text").cast("binary"), F.lit(b"")), 256).alias("kept_sha256"),
    )


@register
def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


@register
def op8_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return chosenpath.near_duplicates(docs).select("doc_id", "class_id", "n_links")


@register
def op9_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.preference_rows(*chat.swapped_answers(_table(spark, sf_dir, "conversations")))


@register
def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return substrings.dedup_substrings(docs, with_text=False).drop("kept")


@register
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify(_table(spark, sf_dir, "documents"))[0]


@register
def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


@register
def op13_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contexttree.score_texts(_table(spark, sf_dir, "documents"))
    return found.withColumn("bits_per_byte", contexttree.bits_per_byte())


def _local_scratch(spark: SparkSession) -> str:
    """A temporary folder where no shared folder is named: local mode only."""
    import tempfile

    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    return f"{tempfile.mkdtemp(prefix='llm-')}/warc"

"""Registered queries against their SQL, and the plain versions where there is none."""

import os

import corpus_pipeline
import duckdb
import pytest
from fotolake.llm.queries import ORACLE, QUERIES

from tests.compare import compare, duckdb_session
from tests.llm import brute

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return duckdb_session(SF_DIR)


def rows(sql):
    return duckdb.connect().execute(sql.format(SF_DIR)).fetchall()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_as_sql(spark, duck, name):
    equal, message = compare(QUERIES[name](spark, SF_DIR), duck, ORACLE[name])
    assert equal, message


def test_linked_pages_as_sql(spark, work):
    """The given pages name no other pages: here each leads to another, in chains and to hubs."""
    pages = rows("select page_id, url from '{}/pages.parquet' order by page_id")
    links = [
        '<link rel="canonical" href="{}">', "<LINK href='{}' rel=canonical>", '<link rel="stylesheet" href="{}">',
        '<meta http-equiv="refresh" content="3; url={}">', "<meta content={} property=og:url>",
        '<meta name="description" content="canonical {}">',
    ]
    linked = []
    for i, (page_id, url) in enumerate(pages):
        other = pages[i // 12 * 12 if i % 3 else max(i - 1, i // 12 * 12)][1].replace("&", "&amp;")
        linked.append((page_id, url, links[i % len(links)].format(other)))
    path = os.path.join(work, "linked")
    spark.createDataFrame(linked, "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{path}/pages.parquet/*.parquet'")
    df = QUERIES["op1_redirect_filter"](spark, path)
    equal, message = compare(df, con, ORACLE["op1_redirect_filter"])
    assert equal, message
    alone = {r["page_id"]: r["verdict"] for r in QUERIES["op1_redirect_filter"](spark, SF_DIR).collect()}
    assert any(r["verdict"] != alone[r["page_id"]] for r in df.collect())


def test_all_operators():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))


def test_quality_counts_and_verdicts(spark):
    found = QUERIES["op3_decision_list"](spark, SF_DIR).collect()
    docs = rows("select doc_id, text from '{}/documents.parquet'")
    assert sorted(tuple(r)[:7] for r in found) == sorted(brute.op3_base(docs))
    assert not any(r["kept"] for r in found if r["base_failed"])


def test_main_text_is_the_article(spark):
    import html
    import re

    found = {r["page_id"]: r for r in QUERIES["op4_min_cut_text"](spark, SF_DIR).collect()}
    for page_id, page in rows("select page_id, html from '{}/pages.parquet'"):
        article = re.search(r"<article>(.*?)(</article>|\Z)", page, re.S)[1]
        parts = re.split(r"</?p>|</?h1>|<br>", article)
        parts = [re.sub(r"</?b>|</?[a-z0-9]*\Z", "", part) for part in parts]
        lines = [" ".join(html.unescape(part).split()) for part in parts]
        assert found[page_id]["text"] == "\n".join(line for line in lines if line)
        assert found[page_id]["n_chars"] == len(found[page_id]["text"])


def test_pipeline_stage_by_stage(spark, work):
    """Every stage against a plain version of its own input."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    names = docs.columns
    seen = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        path = os.path.join(work, f"{i}-{name}")
        stage(spark, docs, SF_DIR).write.parquet(path)
        docs = spark.read.parquet(path)
        after = {r["doc_id"]: r for r in docs.collect()}
        seen.append(name)
        if name != "mixing":
            assert docs.columns == names
        if name == "quality_rules":
            failed = {r[0] for r in brute.op3_base(before) if r[6]}
            assert not failed & set(after)
        if name == "line_dedup":
            plain = {r[0]: r for r in brute.op6(before)}
            gone = {d for d, r in plain.items() if r[1] and r[1] == r[2]}
            assert set(after) == set(plain) - gone
        if name == "near_duplicates":
            classes = brute.op8(before)
            assert set(after) == {d for d, (c, _) in classes.items() if c == d}
        if name == "decontamination":
            items = rows("select item_id, text from '{}/benchmark.parquet'")
            assert set(after) == {r[0] for r in brute.op2(before, items) if not r[5]}
        if name == "mixing":
            assert set(after) == {d for d, _ in before}
            assert all(r["taken"] <= 3 * r["size"] for r in after.values())
    assert seen == "quality_rules line_dedup near_duplicates decontamination mixing".split()


def test_mixing_comes_near_its_targets_and_repeats_itself(spark):
    query = QUERIES["op7_mix"]
    first = sorted(map(tuple, query(spark, SF_DIR).collect()))
    assert first == sorted(map(tuple, query(spark, SF_DIR).collect()))
    docs = rows("select doc_id, source, text from '{}/documents.parquet'")
    sizes, targets = brute.op7_targets(docs)
    source = {d: s for d, s, _ in docs}
    taken = dict.fromkeys(sizes, 0)
    for doc_id, size, source_size, target, words in first:
        own = source[doc_id]
        assert source_size == sizes[own] and abs(target - targets[own]) < 1e-6
        assert 0 <= words <= 3 * size
        taken[own] += words
    assert all(abs(taken[s] - targets[s]) <= 64 for s in sizes)

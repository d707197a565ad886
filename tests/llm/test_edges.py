"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import time

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from fotolake.llm import (
    chat,
    chosenpath,
    components,
    decontaminate,
    linededup,
    mincut,
    mixing,
    quality,
    redirects,
    substrings,
    warc,
)
from fotolake.llm.common import stored

from pyspark.sql import functions as F
from tests.llm import brute

LONG = " ".join(f"w{i % 977}x{i // 977}" for i in range(60_000))
LINES = "\n".join(f"line number {i} of a long passage that repeats here" for i in range(6))
# (doc_id, text): ids without text, texts without id, repeated rows, one word without end.
TEXTS = [
    (1, None),
    (2, ""),
    (3, "   \n\t \n"),
    (4, LINES),
    (5, "intro\n" + LINES + "\nouttro"),
    (6, LONG),
    (7, LONG + " tail"),
    (8, "ab" * 400),
    (9, "short text"),
    (10, "short text"),
    (11, "ein \u00fcberlanges W\u00f6rt \U0001f600 " * 30),
    (-5, "Short, TEXT!"),
]
DOCS_DDL = "doc_id long, text string, source string, size long, window long, row string, key string"


def docs_of(spark, texts, repeat=False):
    found = [(d, t, f"s{(d or 0) % 3}" if d != 9 else None, 7, 8, "r", "k") for d, t in texts]
    return spark.createDataFrame(found + found[3:5] * repeat, DOCS_DDL)


@pytest.fixture(scope="module")
def docs(spark):
    return docs_of(spark, TEXTS)


@pytest.fixture(scope="module")
def none(spark):
    return docs_of(spark, [])


def tuples(df):
    return sorted(map(tuple, df.collect()), key=repr)


def same(found, want):
    assert sorted(map(tuple, found), key=repr) == sorted(map(tuple, want), key=repr)


# --- byte strings ------------------------------------------------------------


def substrings_of(df, **kw):
    return substrings.dedup_substrings(df, **kw).drop("kept").collect()


def test_substrings_as_brute_force(docs, none):
    same(substrings_of(docs), brute.op10(TEXTS))
    assert substrings_of(none) == []


@pytest.mark.parametrize("length", [40, 61, 100])
def test_substrings_on_random_texts(spark, length):
    rng = np.random.default_rng(length)
    parts = ["".join(rng.choice(list("abcde "), 150)) for _ in range(12)]
    texts = [(i, "".join(rng.choice(parts, 5)) + str(i)) for i in range(60)]
    texts += [(100 + i, texts[i][1]) for i in range(10)] + [(200, "x" * 900), (201, "xy" * 300)]
    found = substrings_of(docs_of(spark, texts), length=length)
    same(found, brute.op10(texts, length))
    # The way for anchors with very many pieces gives the same.
    same(substrings_of(docs_of(spark, texts), length=length, hot_pieces=1), found)


def test_substrings_without_id_and_repeated(spark):
    texts = [(None, LINES), (3, "x" + LINES), (4, "y" + LINES)]
    found = {r["doc_id"]: r["n_removed"] for r in substrings_of(docs_of(spark, texts))}
    assert found == {3: 0, 4: len(LINES), None: len(LINES)}
    again = substrings_of(docs_of(spark, [(3, LINES), (3, LINES), (4, LINES)]))
    assert sorted((r["doc_id"], r["n_removed"] > 0) for r in again) == [
        (3, False), (3, False), (4, True),
    ]


def texts_of_one_short_key(bits=31):
    """Two texts of one size that share their end only, whose hashes agree in their low bits."""
    seen = {}
    for i in range(1 << 20):
        text = hashlib.sha512(str(i).encode()).hexdigest() + LINES
        key = xxhash.xxh64_intdigest(text.encode(), seed=42) & ((1 << bits) - 1)
        if key in seen:
            return seen[key], text
        seen[key] = text


@pytest.mark.parametrize("hot_pieces", [substrings.HOT_PIECES, 1])
def test_substrings_of_texts_without_id_whose_short_keys_agree(spark, hot_pieces):
    one, other = texts_of_one_short_key()

    def removed(texts):
        found = substrings_of(docs_of(spark, texts), hot_pieces=hot_pieces)
        return sorted((r["doc_id"] or 0, r["n_removed"]) for r in found)

    # The shared end starts at the same place of both, and goes from one of them.
    n = len(LINES)
    assert removed([(None, one), (None, other)]) == [(0, 0), (0, n)]
    assert removed([(7, one), (7, other)]) == [(7, 0), (7, n)]
    # What only one of them repeats goes from this one.
    head, ends = one[:120] + "!", "?" + LINES
    assert removed([(1, head), (2, ends), (None, one), (None, other)]) == [(0, n), (0, n + 120), (1, 0), (2, 0)]
    assert removed([(1, one), (None, one), (None, other)]) == [(0, n), (0, len(one)), (1, 0)]


def test_last_intervals_name_equal_windows():
    data = np.frombuffer(b"abcabcabcxabcabc", np.uint8)
    windows = np.arange(len(data) - 5)
    found = substrings.last_intervals(data, windows, 6)
    named = {}
    for start, group in zip(windows.tolist(), found.tolist(), strict=True):
        named.setdefault(bytes(data[start : start + 6]), set()).add(group)
    several = [g for w, g in named.items() if data.tobytes().count(w) > 1 or w == b"abcabc"]
    assert all(len(g) == 1 and -1 not in g for g in several)


# --- similarity --------------------------------------------------------------


def test_chosen_path_as_brute_force(docs, none):
    found = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in chosenpath.near_duplicates(docs).collect()}
    assert found == brute.op8(TEXTS)
    assert chosenpath.near_duplicates(none).collect() == []


def test_chosen_path_in_crowded_nodes_and_blocks(spark):
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(90):
        own = list(base)
        own[int(rng.integers(120))] = f"z{i}"
        texts.append((i, " ".join(own)))
    texts += [(100 + i, " ".join(rng.choice(base, 60)) + " " + " ".join(base[:30])) for i in range(40)]
    found = chosenpath.near_duplicates(docs_of(spark, texts), small=8, block=16).collect()
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in found} == brute.op8(texts)


def test_chosen_path_compares_all_chunks_of_a_bucket(spark):
    """Sets of over 2 GiB come in several chunks; blocks are bounded by bytes as well."""
    shingles = np.arange(100, dtype=np.uint64)
    rows = [(bucket, False, 0, name, 1, shingles.tobytes()) for bucket in (7, 8) for name in range(6)]
    parts = [chosenpath._member_batch(rows[i : i + 4]) for i in (0, 4, 8)]
    found = list(chosenpath.compared_buckets(iter([pa.Table.from_batches(parts)]), 0.8))
    assert [r for part in found for r in part.to_pylist()] == [
        {"a": name, "b": 0, "links": 5} for _ in (7, 8) for name in range(6)
    ]
    texts = [(i, " ".join(f"w{k}" for k in range(200)) + f" end{i}") for i in range(40)]
    found = chosenpath.near_duplicates(docs_of(spark, texts), block_shingles=1000).collect()
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in found}
    assert got == brute.op8(texts)


def test_chosen_path_copies_and_missing_ids(spark):
    texts = [(None, LINES), (3, LINES), (3, LINES), (4, LINES.upper()), (None, None)]
    found = chosenpath.near_duplicates(docs_of(spark, texts)).collect()
    assert sorted((r["doc_id"] or -1, r["class_id"] or -1, r["n_links"]) for r in found) == [
        (-1, -1, 0), (-1, 3, 3), (3, 3, 3), (3, 3, 3), (4, 3, 3),
    ]


def test_runs_reach_the_recall():
    assert chosenpath.runs_needed(0.999, 1) == 7
    assert chosenpath.runs_needed(0.999, 3) == 15


def test_components_of_a_path_a_star_and_a_loop(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    edges += [(-3, -2), (-2, -1), (-1, -3)]
    found = dict(tuples(components.components(spark.createDataFrame(edges, "a long, b long"))))
    assert found == {
        **dict.fromkeys(range(21), 0), **dict.fromkeys(range(100, 130), 100),
        **dict.fromkeys((-3, -2, -1), -3),
    }
    assert tuples(components.components(spark.createDataFrame([], "a long, b long"))) == []


# --- decontamination ---------------------------------------------------------


def items_of(spark, items):
    found = [(i, t, "x", 1) for i, t in items]
    return spark.createDataFrame(found, "item_id long, text string, words string, doc_id long")


def report(docs, items):
    index = stored(decontaminate.build_index(docs), "index")
    return decontaminate.overlap_report(index, decontaminate.item_phrases(items)).collect()


def test_phrases_as_brute_force(spark, docs, none, monkeypatch):
    items = [(1, LONG[4000:4200]), (2, "SHORT text"), (3, None), (4, "..."), (5, LINES), (6, "absent word")]
    items += [(2, "short text"), (None, "short")]
    want = [(r[0], r[1], r[2], r[3], r[5]) for r in brute.op2(TEXTS, items)]

    def found():
        rows = report(docs, items_of(spark, items))
        return [(r["doc_id"], r["n_words"], r["n_hit"], len(r["items"]), r["contaminated"]) for r in rows]

    same(found(), want)
    assert report(none, items_of(spark, items)) == []
    assert not any(r["contaminated"] for r in report(docs, items_of(spark, [])))
    # Several passes over the index give the same.
    monkeypatch.setattr(decontaminate, "PASS_PHRASES", 9)
    same(found(), want)


def test_proximity(spark):
    docs = docs_of(spark, [(1, "a b c d e f g"), (2, "a x x x x x x b"), (3, "b"), (4, "a")])
    index = stored(decontaminate.build_index(docs), "index")
    groups = spark.createDataFrame([([b"b", b"a"], [7])], "words array<binary>, items array<long>")
    found = decontaminate.proximity_matches(index, groups, 3).collect()
    assert [(r["doc_id"], r["items"]) for r in found] == [(1, [7])]
    assert len(decontaminate.proximity_matches(index, groups, 7).collect()) == 2


# --- lines -------------------------------------------------------------------


def test_lines_as_brute_force(docs, none):
    found = linededup.dedup_lines(docs).collect()
    plain = {r[0]: r for r in brute.op6(TEXTS)}
    for r in found:
        assert (r["line_dedup"]["n_lines"], r["line_dedup"]["n_removed"]) == plain[r["doc_id"]][1:3]
        assert (r["size"], r["row"], r["key"]) == (7, "r", "k")
    assert {r["doc_id"]: r["text"] for r in found}[5] == "intro\nouttro"
    assert {r["doc_id"]: r["text"] for r in found}[1] is None
    assert linededup.dedup_lines(none).collect() == []


def test_lines_of_repeated_rows_stay(spark):
    found = linededup.dedup_lines(docs_of(spark, [(3, LINES), (3, LINES), (None, LINES)])).collect()
    assert sorted((r["doc_id"] or 0, r["line_dedup"]["n_removed"]) for r in found) == [(0, 6), (3, 0), (3, 0)]


def test_lines_on_random_texts(spark):
    rng = np.random.default_rng(3)
    lines = [" ".join(rng.choice(list("abcdefg"), int(rng.integers(1, 30)))) for _ in range(9)] + [""]
    texts = [(i, "\n".join(rng.choice(lines, 8))) for i in range(80)]
    found = linededup.dedup_lines(docs_of(spark, texts)).collect()
    want = {r[0]: r[2] for r in brute.op6(texts)}
    assert {r["doc_id"]: r["line_dedup"]["n_removed"] for r in found} == want


# --- quality -----------------------------------------------------------------


def test_quality_of_odd_texts(docs, none):
    found = quality.judge(docs, []).collect()
    plain = {r[0]: r for r in brute.op3_base(TEXTS)}
    for r in found:
        own = r["quality_counts"]
        names = "n_words word_chars n_symbols n_dup_lines n_repeat_words".split()
        assert tuple(own[n] for n in names) == plain[r["doc_id"]][1:6]
        assert r["base_failed"] == plain[r["doc_id"]][6] and r["kept"] != r["base_failed"]
    assert quality.judge(none, []).collect() == []


def test_rules_from_no_or_unusable_labels(spark, docs):
    ddl = "doc_id long, quality int, text string"
    assert quality.learn_rules(docs, spark.createDataFrame([], ddl)) == []
    odd = [(1, None, "x"), (None, 0, "x"), (999, 0, "x")]
    assert quality.learn_rules(docs, spark.createDataFrame(odd, ddl)) == []


def test_fit_finds_two_conjunctions():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    bad = ((x[:, 0] > 0.7) & (x[:, 1] <= 0.4)) | (x[:, 2] > 0.9)
    rules = quality.fit_rules(x[:3000], bad[:3000], ["a", "b", "c"])
    verdict = np.zeros(1000, bool)
    for rule in rules:
        verdict |= quality._covered(rule, x[3000:], ["a", "b", "c"])
    assert (verdict == bad[3000:]).mean() > 0.98
    assert 2 <= len(rules) <= 6


def test_held_out_labels(spark):
    """Rules from one half of the labels, judged on the other."""
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rules = quality.learn_rules(docs, labels.where("doc_id % 2 = 0"))
    rows = quality.judge(docs, rules).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    good = [r["kept"] for r in rows if r["quality"] == 1 and not r["base_failed"]]
    junk = [r["kept"] for r in rows if r["quality"] == 0]
    assert sum(good) / len(good) > 0.98 and sum(junk) / len(junk) < 0.15


# --- mixing ------------------------------------------------------------------


def test_mixing_of_odd_texts(spark, docs, none):
    for table in (docs, docs_of(spark, TEXTS, repeat=True)):
        sizes, targets = brute.op7_targets([(r["doc_id"], r["source"], r["text"]) for r in table.collect()])
        source = {r["doc_id"]: r["source"] for r in table.collect()}
        found = mixing.mix(table, block_words=8, shard_words=1000).collect()
        assert len(found) == table.count()
        taken = dict.fromkeys(sizes, 0)
        for r in found:
            own = source[r["doc_id"]]
            assert r["source_size"] == sizes[own] and abs(r["target"] - targets[own]) < 1e-6
            assert 0 <= r["taken"] <= 3 * r["size"]
            taken[own] += r["taken"]
        n_shards = max(sizes.values()) // 1000 + 1
        assert all(abs(taken[s] - targets[s]) <= 8 * n_shards + 8 for s in sizes)
    assert mixing.mix(none).collect() == []


def test_seats_are_those_of_the_highest_quotients(spark):
    rng = np.random.default_rng(5)
    shares = (rng.random(40) ** 4 * 1e4).tolist() + [0.0]
    for n in (0, 3, 41, 5000):
        df = spark.createDataFrame([(i, s) for i, s in enumerate(shares)], "_row long, share double")
        keyed = df.withColumn("name", F.col("_row"))
        found = {r["name"]: r["seats"] for r in mixing._quotients(keyed, "share", F.lit(n), []).collect()}
        seats = [0] * len(shares)
        for _ in range(n):
            i = max(range(len(shares)), key=lambda i: (shares[i] / (2 * seats[i] + 1), -i))
            seats[i] += 1
        assert found == dict(enumerate(seats))


# --- urls, archives, pages, chats -------------------------------------------

RULES = [redirects.UrlRule("com", "/", "allow"), redirects.UrlRule("bad.com", "/x/", "block")]


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://Sub.BAD.com/x/1?q#f", "http://notbad.com/x/", "a://b.net"]
    pages = spark.createDataFrame(
        [(i, u, None, "n") for i, u in enumerate(urls)] + [(4, urls[4], None, "n")],
        "page_id long, url string, html string, node string",
    )
    found = redirects.judge_urls(pages, redirects.redirect_edges(pages), RULES).collect()
    want = brute.op1([(r["page_id"], r["url"]) for r in pages.collect()], RULES)
    same([tuple(r)[:4] for r in found], [w[:4] for w in want])
    expected = {w[0]: w[4] or "allow" for w in want}
    assert all(r["verdict"] == expected[r["page_id"]] for r in found)
    empty = pages.limit(0)
    assert redirects.judge_urls(empty, redirects.redirect_edges(empty), RULES).collect() == []


def test_aliases_take_block_and_allow(spark):
    def page(link):
        return f'<head><link rel="canonical" href="{link}"></head>'

    rows = [
        (1, "http://one.net/a", page("https://bad.com/x/1")),
        (2, "http://two.net/a", '<meta http-equiv="refresh" content="0; url=http://one.net/a/">'),
        (3, "http://three.net/a", page("http://three.net/a")),
        (4, "http://four.net/a", page("//bad.com/x/2")),
        (5, "http://five.net/b", page("http://four.net/a?utm_source=x")),
        (6, "http://six.net/c/d", page("/c/e")),
        (7, "http://six.net/c/e#top", page("http://bad.com/x/9")),
        (8, "http://good.com/", page("http://four.net/a")),
        (9, "http://bad.com/x/1", None),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = redirects.judge_urls(pages, redirects.redirect_edges(pages), RULES).collect()
    assert {r["page_id"]: r["verdict"] for r in found} == {
        1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "block", 7: "block",
        8: "allow", 9: "block",
    }


def test_links_are_attributes(spark):
    tags = {
        '<link rel="stylesheet" href="/canonical.css">': [],
        '<meta name="description" content="refreshing drinks">': [],
        "<link rel=alternate href='http://b.net/es/refresh'>": [],
        '<link title=" rel=canonical " href="/x">': [],
        '<meta http-equiv="refresh" content="5">': [],
        "<LINK HREF=/a REL='nofollow Canonical'>": ["http://h.net/a"],
        '<link rel=canonical href="http://b.net/?a=1&amp;b=2"/>': ["http://b.net/?a=1&b=2"],
        "<meta http-equiv=Refresh content=\"0; URL='//c.net/'\">": ["http://c.net/"],
        '<meta content="d" property="og:url"><meta name=og:url content=/e>': ["http://h.net/p/d", "http://h.net/e"],
        '<link rel="canonical" <p>': [],
    }
    rows = [("http://H.net/p/q", tag, want) for tag, want in tags.items()]
    pages = spark.createDataFrame(rows, "url string, html string, want array<string>")
    found = pages.withColumn("found", redirects.link_targets(F.col("url"), F.col("html"))).collect()
    for row in found:
        assert row["found"] == row["want"], row["html"]


def test_links_of_a_very_long_page(spark):
    units = ["<link canonical ", "<meta refresh x=", "<link rel='", "<link " + "a" * 1000, "<link" + " " * 1000]
    rows = [(unit,) for unit in units]
    pages = spark.createDataFrame(rows, "unit string").select(
        F.lit("http://h.net/").alias("url"), F.expr("repeat(unit, 1000000 div length(unit))").alias("html")
    )
    start = time.monotonic()
    assert redirects.redirect_edges(pages).count() == 0
    assert time.monotonic() - start < 60


def test_archives_round_trip(spark, work):
    rows = [
        (3, "http://a/\r\nx", "same", 1), (1, None, "same", 1), (None, "u", "same", 1), (4, "u", None, 1),
        (5, "u", "", 1), (6, "u", "\r\n\r\nWARC/1.1\r\n\r\n\u00e4" * 3000, 1), (7, "u", LONG, 1),
        (-8, "u", LONG, 1), (9, "u", "twice", 1), (9, "u", "twice", 1),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload int")
    marked = warc.mark_revisits(pages)
    warc.write_archives(marked, f"{work}/warc", chunk_bytes=4096)
    found = warc.read_records(spark, f"{work}/warc").collect()
    assert all(r["intact"] for r in found)
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    same([tuple(r[n] for n in names) for r in found], brute.op5([(r[0], r[2]) for r in rows]))
    chunks = warc.read_chunks(spark, f"{work}/warc").where("page_id in (6, -8)").orderBy("page_id", "chunk").collect()
    assert max(r["chunk_bytes"] for r in chunks) == 4096
    for page_id, text in ((6, rows[5][2]), (-8, LONG)):
        assert b"".join(bytes(r["data"]) for r in chunks if r["page_id"] == page_id) == text.encode()
    assert [r["last"] for r in chunks if r["page_id"] == 6][-1]
    empty = warc.mark_revisits(pages.limit(0))
    warc.write_archives(empty, f"{work}/none")
    assert warc.read_records(spark, f"{work}/none").collect() == []


def test_main_text_of_odd_pages(spark):
    weights = np.zeros(mincut.FEATURES)
    cases = {
        "": "",
        "<article><h1>T &amp; U</h1><p>One\n two&nbsp;x<br>y</p></article>": "T & U\nOne two x y",
        "<nav><a>m</a></nav><main><p>text</p><div class='comments'><article><p>me too</p></article></div></main>": "text",
        "<article><header><h1>head</h1></header><p>a<b>b</b>c<script>x='<p>no</p>'</script></p>": "head\nabc",
        "<article><p>in</p><aside>side</aside><form>f<input></form><p class=advert>buy</p></article><footer>z": "in",
    }
    for page, text in cases.items():
        assert mincut.extract(page, weights) == text
    rows = [(1, None, None, "t"), (None, "u", "<article>x</article>", "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    assert tuples(mincut.main_texts(pages, mincut.learn_costs(pages))) == [(1, None, ""), (None, "u", "x")]
    empty = pages.limit(0)
    assert mincut.main_texts(empty, mincut.learn_costs(empty)).collect() == []


def test_main_text_of_very_long_pages():
    """A megabyte of any markup takes seconds, and what follows it is still read."""
    weights = np.zeros(mincut.FEATURES)
    units = ["<a ", "<p", "<!", "<a \"", "=\"<a \"", "<a ='\"", "</ul", "<svg/>", "<div></ul>", "</ul>", "<"]
    for unit in units:
        start = time.monotonic()
        page = "<nav>" + unit * (1_000_000 // len(unit)) + "</nav><article><p>text</p></article>"
        assert mincut.extract(page, weights).endswith("text"), unit
        assert time.monotonic() - start < 20, unit
    for cut_off, text in {"<p>a <b c": "a", "<p class='x<p>y": "y", "<p x=>z</p>": "z", "a < b <i>c": "a < b c"}.items():
        assert [b.text for b in mincut.read_blocks(cut_off)[0]] == text.split("\n"), cut_off


def test_main_text_below_wrappers():
    weights = np.zeros(mincut.FEATURES)
    article = "<h1>head</h1><p>one two three</p>"
    cases = {
        f"<body><form action='./'><div><nav>m</nav><main>{article}</main></div></form></body>": "head\none two three",
        f"<form><nav>m</nav><div class='content'>{article}</div><footer>z</footer></form>": "head\none two three",
        f"<div class='search'><article>{article}</article></div>": "head\none two three",
        f"<div class='page has-sidebar with-header'><div id='main'>{article}</div></div>": "head\none two three",
        f"<article class='share-enabled'>{article}</article><form><p>send</p></form>": "head\none two three",
        # Comments and teasers are not the article.
        f"<main>{article}</main><div class='comments'><article>me too</article></div>": "head\none two three",
        f"<main>{article}</main><div id='sidebar-2'><article>teaser</article></div>": "head\none two three",
    }
    for page, text in cases.items():
        assert mincut.extract(page, weights) == text


def test_looks_outvote_a_name():
    """A list of links in an article goes, prose in a named wrapper stays."""
    # Links speak against content, marks for it.
    weights = np.zeros(mincut.FEATURES)
    weights[3], weights[4] = -9.0, 9.0
    links = "".join(f"<li><a href='{i}'>link {i}</a></li>" for i in range(4))
    prose = "<p>" + "Words, and more words; " * 9 + "end.</p>"
    page = f"<article><p>in</p>{prose}<ul>{links}</ul></article>"
    text = mincut.extract(page, weights)
    assert "link" not in text and text.startswith("in\nWords")
    assert mincut.extract(f"<div class='banner'>{prose}</div>", weights).startswith("Words")


def test_cut_is_the_cheapest_labelling():
    """Against all labellings of small pages."""
    import itertools

    rng = np.random.default_rng(4)
    for _ in range(40):
        n = int(rng.integers(2, 6))
        spare = rng.normal(size=n) * 2
        flow = mincut._Flow(n + 2)
        ties = [(i, i + 1, float(rng.random())) for i in range(n - 1)] + [(0, n - 1, 0.3)]
        for i, value in enumerate(spare.tolist()):
            flow.tie(n, i, max(value, 0.0), 0.0)
            flow.tie(i, n + 1, max(-value, 0.0), 0.0)
        for a, b, cost in ties:
            flow.tie(a, b, cost, cost)
        level = flow.run(n, n + 1)
        got = tuple(level[i] >= 0 for i in range(n))

        def cost(labels, spare=spare, ties=ties):
            own = sum(max(v, 0) if not on else max(-v, 0) for v, on in zip(spare, labels, strict=True))
            return own + sum(c for a, b, c in ties if labels[a] != labels[b])

        best = min(itertools.product([False, True], repeat=n), key=cost)
        assert abs(cost(got) - cost(best)) < 1e-9


def test_preferences(spark):
    ddl = "pair_id long, turn long, role string, text string, part string"
    common = [(1, 0, "system", "s", "p"), (1, 1, "user", "hi", "p"), (1, 1, "user", "hi", "p")]
    chosen = common + [(1, 2, "assistant", "yes", "p"), (2, 0, None, None, "p"), (3, None, "user", "x", "p")]
    rejected = common + [(1, 2, "assistant", "no", "p"), (1, 3, "user", "?", "p"), (3, None, "user", "x", "p")]
    found = chat.preference_rows(spark.createDataFrame(chosen, ddl), spark.createDataFrame(rejected, ddl)).collect()
    got = {(r["pair_id"], r["part"], r["turn"]): r for r in found}
    twice = [(r["message"], r["copy"]) for r in found if (r["part"], r["turn"]) == ("prompt", 1)]
    assert sorted(twice) == [(1, 1), (1, 2)] and len(found) == len(got) + 1
    assert set(got) == {
        (1, "prompt", 0), (1, "prompt", 1), (1, "chosen", 2), (1, "rejected", 2), (1, "rejected", 3),
        (2, "chosen", 0), (3, "prompt", None),
    }
    yes = got[1, "chosen", 2]
    assert yes["text"] == "<|assistant|>\nyes<|end|>\n"
    assert yes["text"][yes["loss_start"] : yes["loss_end"]] == "yes<|end|>\n"
    assert all(r["loss_start"] == r["loss_end"] for k, r in got.items() if k[1] == "prompt" or k[2] == 3)
    assert not got[2, "chosen", 0]["complete"] and got[1, "prompt", 0]["complete"]
    empty = spark.createDataFrame([], ddl)
    assert chat.preference_rows(empty, empty).collect() == []


def test_preferences_of_rows_without_id(spark):
    """Each is a pair of its own, also where all of them have one turn or none."""
    ddl = "pair_id long, turn long, role string, text string"
    both = [(None, 0, "user", "a"), (None, 0, "assistant", "b"), (None, 0, "user", "a"), (None, None, None, None)]
    chosen = both + [(None, 0, "assistant", "c")]
    rejected = both + [(None, 0, "user", "a")]
    found = chat.preference_rows(spark.createDataFrame(chosen, ddl), spark.createDataFrame(rejected, ddl))
    a, b, c = ("<|user|>\na<|end|>\n", "<|assistant|>\nb<|end|>\n", "<|assistant|>\nc<|end|>\n")
    none = "<||>\n<|end|>\n"
    same(
        found.collect(),
        [(None, "prompt", 0, 1, 1, a, len(a), len(a), len(a), True)] * 2
        + [(None, "prompt", 0, 1, 1, b, len(b), len(b), len(b), True)]
        + [(None, "prompt", None, 1, 1, none, len(none), len(none), len(none), True)]
        + [(None, "chosen", 0, 1, 1, c, len(c), len("<|assistant|>\n"), len(c), False)]
        + [(None, "rejected", 0, 1, 1, a, len(a), len(a), len(a), False)],
    )


def test_preferences_of_turns_of_any_size(spark):
    """A row per message, with a loss by its own role, however many and long they are."""
    ddl = "pair_id long, turn long, role string, text string"
    start = [(1, 0, "user", f"u{i:02}") for i in range(30)]
    chosen = start + [(1, 1, r, f"{t}{i:02}") for r, t in (("user", "q"), ("assistant", "y")) for i in range(30)]
    rejected = start + start[:5] + [(1, 1, "assistant", "n" * 5_000_000)]
    tables = [spark.createDataFrame(rows, ddl) for rows in (chosen, rejected)]
    found = chat.preference_rows(*tables).collect()
    # The sides part in turn 0, where five messages are there once more.
    counts = {}
    for r in found:
        key = r["part"], r["turn"]
        counts[key] = counts.get(key, 0) + 1
        assert (r["loss_start"] == len("<|assistant|>\n")) == r["text"].startswith("<|assistant|>")
    assert counts == {("chosen", 0): 30, ("rejected", 0): 35, ("chosen", 1): 60, ("rejected", 1): 1}
    order = [r["text"] for r in sorted(found, key=lambda r: (r["turn"], r["message"])) if r["part"] == "chosen"]
    assert order == sorted(order[:30]) + sorted(order[30:])


def test_swapped_answers(spark):
    rows = [(0, 0, "user", "a"), (0, 1, "assistant", "b"), (1, 0, "user", "c"), (1, 1, "assistant", "d"),
            (4, 0, "user", "e"), (None, 0, "user", "n")]
    own, other = chat.swapped_answers(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert own.count() == 6
    assert tuples(other) == sorted(
        [(0, 0, "user", "a"), (0, 1, "assistant", "d"), (1, 0, "user", "c"), (1, 1, "assistant", "b"),
         (None, 0, "user", "n")], key=repr
    )


def test_pipeline_keeps_columns_of_any_name(spark, work):
    import corpus_pipeline

    clash = "kept string, quality_counts string, line_dedup string, doc string, _c string, `set` string, lang string"
    schema = f"doc_id long, text string, source string, n_chars long, {clash}"
    rows = [(d, t, "s", 1, *"abcdefg") for d, t in [*TEXTS, (None, LONG), (None, None), (6, LONG)]]
    for table in (rows, []):
        docs = spark.createDataFrame(table, schema)
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            path = f"{work}/{len(table)}-{i}"
            stage(spark, docs, "/root/testdata/sf0.001").write.parquet(path)
            after = spark.read.parquet(path)
            if name != "mixing":
                assert after.columns == docs.columns
                assert after.where("kept <> 'a' or line_dedup <> 'c' or doc <> 'd'").isEmpty()
            docs = after
        assert docs.columns == ["doc_id", "size", "source_size", "target", "taken"]
        assert (docs.count() > 0) == bool(table)


@pytest.mark.parametrize("rows", [1, 3, 11])
def test_results_do_not_depend_on_batches(spark, docs, rows):
    """Groups that run across Arrow batches."""
    rng = np.random.default_rng(rows)
    parts = ["".join(rng.choice(list("abcde "), 150)) for _ in range(8)]
    texts = [(i, "".join(rng.choice(parts, 4))) for i in range(40)]
    texts += [(i + 50, texts[i][1][:-3] + "xyz") for i in range(20)] + [(80, "xy" * 300), (None, texts[0][1])]
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        table = docs_of(spark, texts)
        same(substrings_of(table), brute.op10(texts))
        found = chosenpath.near_duplicates(table, small=4, block=8).collect()
        assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in found if r["doc_id"] is not None} == {
            d: v for d, v in brute.op8(texts[:-1] + [(99, texts[0][1])]).items() if d != 99
        }
        found = linededup.dedup_lines(docs).collect()
        assert {r["doc_id"]: r["line_dedup"]["n_removed"] for r in found} == {r[0]: r[2] for r in brute.op6(TEXTS)}
    finally:
        spark.conf.set(name, before)

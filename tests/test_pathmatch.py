"""Path matching against plain all-pairs versions."""

import random

import pytest
from fotolake.functions import similarity
from fotolake.operators import pairblocks, pathmatch
from pyspark.sql import functions as F

SCHEMA = "md5hash string, side int, path string"


def plain_ratio(a, b):
    if not a or not b:
        return 0
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    best = 0
    for start in range(len(long) - len(short) + 1):
        window = long[start : start + len(short)]
        row = [0] * (len(short) + 1)
        for c in window:
            last = 0
            for j, d in enumerate(short, 1):
                last, row[j] = row[j], (last + 1 if c == d else max(row[j], row[j - 1]))
        best = max(best, row[-1])
    return (200 * best + len(short)) // (2 * len(short))


def pairs_of(rows, score=plain_ratio):
    """All pairs in the order of the module: (far, gap, new, old) per hash."""
    out = {}
    for h in {r[0] for r in rows if r[0] is not None}:
        old = sorted(p for g, s, p in rows if g == h and s == 0)
        new = sorted(p for g, s, p in rows if g == h and s == 1)
        out[h] = sorted(
            (-float(score(n, o)), abs(i - j), n, o)
            for i, o in enumerate(old)
            for j, n in enumerate(new)
        )
    return out


def plain_best(rows):
    out = set()
    for h, pairs in pairs_of(rows).items():
        seen = set()
        for far, _, new, old in pairs:
            if new not in seen:
                seen.add(new)
                out.add((h, old, new, -far))
    return out


def plain_greedy(rows):
    out = set()
    for h, pairs in pairs_of(rows).items():
        used = set()
        for far, _, new, old in pairs:
            if (0, old) not in used and (1, new) not in used:
                used |= {(0, old), (1, new)}
                out.add((h, old, new, -far))
    return out


def paths(rng, n, hashes):
    rows = set()
    folders = ["a", "photos/2021", "photos/2021/May", "Backup of photos/2021", "ü/x"]
    for _ in range(n):
        name = rng.choice(["IMG_", "DSC", "é", ""]) + str(rng.randrange(40)).zfill(rng.choice([1, 4]))
        name += rng.choice([".jpg", ".JPG", " copy.jpg", ""])
        rows.add((rng.choice(hashes), rng.randrange(2), f"{rng.choice(folders)}/{name}"))
    return sorted(rows, key=repr)


def test_partial_ratio_equals_a_plain_version(values):
    rng = random.Random(1)
    pairs = [("", ""), ("", "a"), ("abc", "xabcx"), ("a" * 70, "b" + "a" * 80), ("ab", "ba")]
    for _ in range(300):
        alphabet = rng.choice(["ab", "abc/.", "aé😀0123456789/"])
        pairs.append(tuple("".join(rng.choices(alphabet, k=rng.randrange(25))) for _ in "ab"))
    for size in (63, 64, 65, 130):
        text = "".join(rng.choices("abcd/", k=size))
        pairs += [(text, text[5:] + "x/y" * 4), (text, "z" + text), (text[:-1], text)]
    got = values(similarity.partial_ratio(F.col("s"), F.col("t")), pairs, "s string, t string")
    assert got == [plain_ratio(a, b) for a, b in pairs]
    assert values(similarity.partial_ratio(F.col("s"), F.col("t")), [(None, "a")], "s string, t string") == [None]


@pytest.mark.parametrize("full_pairs", [pathmatch.FULL_PAIRS, 0])
def test_best_and_greedy_equal_all_pairs(spark, full_pairs):
    rows = paths(random.Random(5), 120, ["h1", "h2", "h2", "h2", None])
    free = spark.createDataFrame(rows, SCHEMA)
    best = pathmatch.best_match(free, full_pairs=full_pairs)
    assert {tuple(r) for r in best.collect()} == plain_best(rows)
    greedy = pathmatch.match_one_to_one(free, full_pairs=full_pairs)
    got = [tuple(r) for r in greedy.collect()]
    assert len(got) == len(set(got)) and set(got) == plain_greedy(rows)


@pytest.mark.parametrize("level", [100, 96, 85, 0])
def test_no_pair_at_a_threshold_is_lost(spark, level):
    rows = paths(random.Random(level), 150, ["h"])
    ranked = pathmatch._ranked(spark.createDataFrame(rows, SCHEMA), 1 << 20)
    got = pathmatch.similar_pairs(ranked, pathmatch.ratio_score, level)
    want = {(o, n, g, -f) for f, g, n, o in pairs_of(rows)["h"] if -f >= level}
    assert {(r[1], r[2], r[3], r[4]) for r in got.collect()} == want


def test_one_path_and_empty_sides(spark):
    rows = [("a", 0, "x/1"), ("a", 1, "y/1"), ("b", 0, "x/2"), ("c", 1, "y/3"), (None, 0, "p"), (None, 1, "p2")]
    for full_pairs in (1 << 10, 0):
        free = spark.createDataFrame(rows, SCHEMA)
        assert {tuple(r) for r in pathmatch.match_one_to_one(free, full_pairs=full_pairs).collect()} == {
            ("a", "x/1", "y/1", 67.0)
        }
    empty = spark.createDataFrame([], SCHEMA)
    assert pathmatch.match_one_to_one(empty).collect() == []
    assert pathmatch.best_match(empty).collect() == []


def test_equally_similar_paths_go_by_place(spark):
    rows = [("h", 0, f"old/{c}") for c in "abcdef"] + [("h", 1, f"new/{c}") for c in "uvwxyz"]
    for full_pairs in (1 << 10, 0):
        got = pathmatch.match_one_to_one(spark.createDataFrame(rows, SCHEMA), full_pairs=full_pairs)
        assert {(r["old_path"][-1], r["new_path"][-1]) for r in got.collect()} == set(
            zip("abcdef", "uvwxyz", strict=True)
        )


def test_ten_thousand_paths_of_one_hash(spark):
    """Renamed folder, names kept or with a suffix: found by the search, spread over tasks."""
    n = 5000
    rows = [("h", 0, f"cards/2021/DCIM/{i * 7919 % 100003:06d}-{i:04d}.jpg") for i in range(n)]
    rows += [("h", 1, f"moved/{path}") for _, _, path in rows]
    best = pathmatch.best_match(spark.createDataFrame(rows, SCHEMA))
    assert best.count() == n
    assert best.where("new_path <> concat('moved/', old_path) or score <> 100").isEmpty()


def test_all_pairs_are_scored_once(spark, monkeypatch):
    """Thresholds at which the bound tells nothing are left out, and pairs are not regrouped."""
    rng = random.Random(5)
    names = sorted({"".join(rng.choices("abcdefgh", k=5)) for _ in range(60)})
    rows = [("h", i % 2, name) for i, name in enumerate(names)]
    levels = []
    search = pathmatch.similar_pairs
    monkeypatch.setattr(
        pathmatch, "similar_pairs", lambda *args: levels.append(args[2]) or search(*args)
    )
    found = pathmatch.best_match(spark.createDataFrame(rows, SCHEMA), full_pairs=10)
    assert {tuple(r) for r in found.collect()} == plain_best(rows)
    assert levels[-1] == 0 and not {80, 70} & set(levels)


def plain_levenshtein(a, b):
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    least = len(short)
    for start in range(len(long) - len(short) + 1 if short else 0):
        window, row = long[start : start + len(short)], list(range(len(short) + 1))
        for i, c in enumerate(window, 1):
            last, row[0] = row[0], i
            for j, d in enumerate(short, 1):
                last, row[j] = row[j], min(last + (c != d), row[j] + 1, row[j - 1] + 1)
        least = min(least, row[-1])
    return 100 * (1 - least / len(short)) if short else 0.0


def test_block_scores_equal_plain_versions(values):
    rng = random.Random(2)
    for n in range(12):
        alphabet = rng.choice(["ab", "abc/.", "aé😀0123/"])
        sides = [
            ["".join(rng.choices(alphabet, k=rng.randrange((8, 40, 140)[n % 3]))) for _ in range(8)]
            for _ in "ab"
        ]
        sides[0] += ["", "a" * 64 + "b"]
        sides[1] += ["b" + "a" * 64, "ab" * 32, "ab" * 16]
        want = [[plain_ratio(a, b) for b in sides[1]] for a in sides[0]]
        assert similarity.ratio_block(*sides).tolist() == want
        want = [[plain_levenshtein(a, b) for b in sides[1]] for a in sides[0]]
        assert similarity.levenshtein_block(*sides).tolist() == want
    pairs = [(a, b) for a in sides[0] for b in sides[1]]
    got = values(100 * similarity.partial_levenshtein(F.col("s"), F.col("t")), pairs, "s string, t string")
    assert got == [score for row in want for score in row]
    assert similarity.ratio_block([], ["a"]).shape == (0, 1)


@pytest.mark.parametrize("pairs", [2_000, pairblocks.PAIRS])
def test_blocks_match_as_the_plain_order(spark, monkeypatch, pairs):
    """Several blocks and hashes, paths of equal similarity beyond one step of gaps, few pairs at a time."""
    monkeypatch.setattr(pairblocks, "SIDE", 50)
    rows = paths(random.Random(8), 150, ["h1", "h1", "h2"])
    rows += [("h3", 0, f"old/{chr(0x4E00 + i)}") for i in range(90)]
    rows += [("h3", 1, f"new/{chr(0x6E00 + i)}") for i in range(170)]
    rows += [("h4", 0, "only/old"), ("h5", 1, "only/new")]
    ranked = pathmatch._ranked(spark.createDataFrame(rows, SCHEMA), 1 << 20)
    got = pairblocks.match_in_blocks(ranked, similarity.ratio_block, pairs)
    assert sorted(map(tuple, got.collect())) == sorted(plain_greedy(rows))
    best = pathmatch._first_old(pairblocks.first_in_blocks(ranked, similarity.ratio_block))
    assert sorted(map(tuple, best.collect())) == sorted(plain_best(rows))


@pytest.mark.parametrize("match", [pathmatch.best_match, pathmatch.match_one_to_one])
def test_pairs_of_large_hashes_are_no_rows(spark, monkeypatch, match):
    """All pairs of a hash are scored in blocks, and once, not row by row at every threshold."""
    rng = random.Random(6)
    names = sorted({"".join(rng.choices("abcdefgh", k=5)) for _ in range(60)})
    rows = [("h", i % 2, name) for i, name in enumerate(names)]
    scored = []
    for name in ("first_in_blocks", "match_in_blocks"):
        run = getattr(pairblocks, name)
        monkeypatch.setattr(pathmatch, name, lambda *a, run=run: scored.append(1) or run(*a))
    monkeypatch.setattr(pathmatch, "_met", lambda *a: pytest.fail("pairs as rows"))
    found = match(spark.createDataFrame(rows, SCHEMA), pathmatch.ratio_score, 10)
    plain = plain_best if match is pathmatch.best_match else plain_greedy
    assert {tuple(r) for r in found.collect()} == plain(rows)
    assert len(scored) == 1

import posixpath

import pytest
from pyspark.sql import functions as F

from fotolake.functions import paths

P = F.col("p")
SAMPLES = [
    "a//b/./c/../d", "/a/../../b", "../x", "", "/", "a/b/", "//", "///x", "//x/y", "a", "/a", "//a",
    "a//b", "./a", "a/.", "..", "../..", "../../a/..", "/..", "a/../..", "/a/b/c.d/e", "a b/c  d",
    "a.b", "a.", "..a", ".h", "a.tar.gz", "noext", "x.y/z", "x.y/.z", "...", "a/...b.c", "/./a",
]


@pytest.mark.parametrize(
    "ours, theirs",
    [
        (paths.normalize_path, posixpath.normpath),
        (paths.dirname, posixpath.dirname),
        (paths.basename, posixpath.basename),
        (paths.extension, lambda p: posixpath.splitext(p)[1]),
        (paths.without_extension, lambda p: posixpath.splitext(p)[0]),
    ],
)
def test_as_posixpath(values, ours, theirs):
    got = dict(zip(SAMPLES, values(ours(P), SAMPLES, "p string")))
    assert got == {sample: theirs(sample) for sample in SAMPLES}


def test_relative_path_is_anchored_at_a_folder(values):
    rows = [
        ("/old/b1/x.jpg", "/old/b1"), ("/old/b10/x.jpg", "/old/b1"), ("/z/old/b1/x", "/old/b1"),
        ("/old/b1", "/old/b1"), ("/old/x", "/old/"), ("C:\\a\\b", "C:\\a"), ("x", None),
    ]
    got = values(paths.relative_path(P, F.col("b")), rows, "p string, b string")
    assert got == ["x.jpg", "old/b10/x.jpg", "z/old/b1/x", "", "x", "b", "x"]


def test_flatten_dir(values):
    levels = {0: "", 2: "a/b", None: "a/b/c", 9: "a/b/c", -1: "a/b"}
    for level, want in levels.items():
        assert values(paths.flatten_dir(P, level), ["a/b/c"], "p string") == [want]


def test_date_subdir(values):
    when = F.lit("2021-03-04 05:06:07").cast("timestamp_ntz")
    assert values(paths.date_subdir(P, when, "month"), ["", "a"], "p string") == ["2021/Mar", "a/2021/Mar"]
    assert values(paths.date_subdir(P, when, "year"), ["a"], "p string") == ["a/2021"]
    with pytest.raises(ValueError):
        paths.date_subdir(P, when, "day")


def test_separators_bases_and_blanks(values):
    assert values(paths.normalize_base(P), ["C:\\a\\", "/b/", "/c"], "p string") == ["C:/a", "/b", "/c"]
    filled = values(paths.replace_whitespace(P, "$1\\"), ["a \t b\u00a0c"], "p string")
    assert filled == ["a$1\\b$1\\c"]
    rows = [(True, "/b", "x"), (False, "/b", "/x"), (None, None, "y")]
    got = values(
        paths.full_path(F.col("l"), F.col("b"), P), rows, "l boolean, b string, p string"
    )
    assert got == ["/b/x", "/x", "y"]


def test_trailing_path(values):
    got = values(paths.trailing_path(P, 2), ["/A/B/c.JPG", "c.jpg", "x\\Y\\z"], "p string")
    assert got == ["b/c.jpg", "c.jpg", "y/z"]

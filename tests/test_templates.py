import re

import pytest
from pyspark.sql import functions as F

from fotolake.functions import templates

P = F.col("p")
PATHS = ["a/IMG_0012 x.jpg", "b/dsc-7.JPG", "[x]&&y", "", "é9", "aa/aa"]


@pytest.mark.parametrize(
    "pattern, expand",
    [
        (r"([A-Z]+)_(\d+)", None),
        (r"(?P<word_x>[a-z]+)-(?P<n>\d)", r"\g<n>_\g<word_x>_\2\\"),
        (r"[[x]+(\])", None),
        (r"[]x]", None),
        (r"(y)?[a&&b]", None),
        (r"(?P<h>\w)(?P=h)/", r"<\1>"),
        (r"(?i)img", None),
        (r"(\w)9\Z", r"\1$1"),
        (r"(a)|(b)", r"\1-\2"),
    ],
)
def test_capture_as_python(values, pattern, expand):
    def python(path):
        hit = re.search(pattern, path)
        if hit is None:
            return None
        return hit.expand(expand) if expand else "_".join(g or "" for g in hit.groups())

    got = values(templates.capture(P, pattern, expand), PATHS, "p string")
    assert got == [python(p) for p in PATHS]


def test_unsupported_patterns_are_rejected():
    with pytest.raises(ValueError):
        templates.java_regex(r"(a)?(?(1)b|c)")
    with pytest.raises(ValueError):
        templates.capture(P, "a", r"\1")
    with pytest.raises(re.error):
        templates.java_regex("(")


def test_render_name(values):
    row = ("20210304_050607", 2021, 3, 2021, 9, 4, None, "old.JPG", "ff")
    schema = (
        "timestamp string, year int, month int, isoyear int, isoweek int, isoday int, "
        "regex string, old_name string, md5hash string"
    )
    tokens = {name.split()[0]: F.col(name.split()[0]) for name in schema.split(", ")}

    def render(template):
        return values(templates.render_name(template, tokens, F.lit(".JPG")), [row], schema)[0]

    assert render("{timestamp}") == "20210304_050607.JPG"
    assert render("{regex}_{year}-{month:02d}.jpg") == "_2021-03.jpg"
    assert render("{{x}}{isoyear}_{isoweek:3d}_{isoday:d}") == "{x}2021_  9_4.JPG"
    assert render("{old_name}|{md5hash:>4}|{md5hash:4}|.x") == "old.JPG|  ff|ff  |.x"
    assert render("{year:02d}.a") == "2021.a"
    for bad in ("{nope}", "{year:x}", "{old_name!r}", "{old_name:^5}"):
        with pytest.raises(ValueError):
            render(bad)
    assert templates.template_tokens("{a}{b:02d}c") == {"a", "b"}
    assert templates.template_tokens(None) == set()

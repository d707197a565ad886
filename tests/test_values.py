"""Tags, positions, stamps, similarity and image headers."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from fotolake.functions import gps, images, similarity, stamps, tags

S = F.col("s")


def test_rational_arrays(values):
    rows = [
        "[37, 25, 438923/10000]", "[1, 2/0, 3]", "[1/2/3]", "[5.5]", "x", "100", None, "[-1/2, 3]", "[]",
    ]
    got = values(gps.parse_rational_array(S), rows, "s string")
    assert got == [
        [37, 25, 43.8923], [1, 2, 3], [None], [5.5], [None], [100], None, [-0.5, 3], [None],
    ]


def test_degrees(values):
    rows = [
        ("[37, 25, 438923/10000]", "W"), ("[37, 25, 438923/10000]", "E"), ("[100]", "1"), ("[100]", None),
        ("[1, x]", "N"),
    ]
    got = values(gps.coordinate(S, F.col("r")), rows, "s string, r string")
    assert got == [pytest.approx(-37.42885897222222), pytest.approx(37.42885897222222), -100, 100, None]


def test_tags_to_json(values):
    rows = [
        [("EXIF FNumber", "R", "28/10"), ("EXIF ISO", "S", "0100"), ("Image Make", "A", 'a"b'),
         ("EXIF Bias", "SR", "+3"), ("x", "F64", "1.5"), ("y", "F32", "nan"), ("z", "A", "7"),
         ("EXIF MakerNote", "U", "12"), ("big", "L", "9" * 40), ("n", "S", "[1, 2]"),
         ("t", "A", "old"), ("t", "A", "new"), ("bare", "A", None)],
        [],
        None,
    ]
    schema = "s array<struct<key: string, field_type: string, value: string>>"
    texts = values(tags.tags_to_json(S), rows, schema)
    assert texts[1:] == [None, None]
    got = json.loads(texts[0])
    assert got == {
        "EXIF FNumber": "28/10", "EXIF ISO": 100, "Image Make": 'a"b', "EXIF Bias": 3, "x": 1.5, "y": "nan",
        "z": "7", "EXIF MakerNote": "12", "big": int("9" * 40), "n": "[1, 2]", "t": "new", "bare": None,
    }
    assert list(got) == sorted(got)
    assert values(tags.json_tag(S, "EXIF ISO"), texts[:1], "s string") == ["100"]
    assert values(tags.exif_tag(S, "t"), rows, schema) == ["new", None, None]
    assert values(tags.tag_map(S), texts[:1], "s string")[0]["EXIF ISO"] == "100"


def test_bytes_are_base64_on_one_line(values):
    data = bytes(range(256)) * 2
    text = values(tags.encode_bytes(S), [data], "s binary")[0]
    import base64

    assert base64.b64decode(text) == data and "\n" not in text


def test_stamps(values):
    ocr = [
        "[cam 1]] - RGB - Mon Jan 05 2024 01:02:03 MST - x\nExposure: 42",
        "Wed Jan 05 2024 010203 UTC",
        "a - b - c\nTue Feb 30 2024 01:02:03 UTC EXPosure; 9",
        "a-b-c-Sun Jul 07 1999 23:59:59 XYZ",
        "[] - b - c - Fri Mar 01 2024 00:00:00 CEST",
        None,
    ]
    got = values(stamps.parse_stamp(S), ocr, "s string")
    assert got[0].camera_name == "cam 1" and got[0].camera_type == "RGB" and got[0].exposure == 42
    assert got[0].dt_iso == "2024-01-05 01:02:03-07:00"
    assert str(got[0].dt_utc) == "2024-01-05 08:02:03"
    assert tuple(got[1]) == (None,) * 5
    assert (got[2].camera_name, got[2].dt_iso, got[2].exposure) == ("a", None, 9)
    assert (got[3].camera_name, got[3].dt_iso, got[3].dt_utc) == ("a", None, None)
    assert got[4].camera_name == "]" and got[4].dt_iso == "2024-03-01 00:00:00+02:00"
    assert tuple(got[5]) == (None,) * 5
    iso = values(stamps.parse_stamp_datetime(S)["dt_iso"], ocr[1:2], "s string")
    assert iso == ["2024-01-05 01:02:03+00:00"]
    assert values(stamps.parse_exposure(S), ["EXPosure; 42", "exp 3"], "s string") == [42, None]


PAIRS = [
    ("a/b/IMG 1.jpg", "/root/a/b/IMG 1.jpg"), ("abc", "xyz"), ("", "a"), ("same", "same"),
    ("IMG_12.jpg", "/new/12.JPG"), ("kitten", "sitting on"), ("aab", "aba"),
]


def _windows(one, two):
    short, long = sorted((one, two), key=len)
    return short, [long[i : i + len(short)] for i in range(len(long) - len(short) + 1)]


def test_partial_ratio(values):
    got = values(similarity.partial_ratio(S, F.col("t")), PAIRS, "s string, t string")
    assert got == [100, 0, 0, 100, 30, 67, 67]
    assert values(similarity.partial_ratio(S, F.col("t")), [(None, "a")], "s string, t string") == [None]


def test_partial_levenshtein(values):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    def brute(one, two):
        short, windows = _windows(one, two)
        return max(1 - distance(w, short) / len(short) for w in windows) if short else 0.0

    got = values(similarity.partial_levenshtein(S, F.col("t")), PAIRS, "s string, t string")
    assert got == [pytest.approx(brute(*pair)) for pair in PAIRS]


def test_sniff_type(values):
    heads = {
        b"\xff\xd8\xff\xdb": "jpeg", b"abcdefJFIF": "jpeg", b"abcdefExif": "jpeg",
        b"x" * 19 + b"JFIF": "jpeg", b"x" * 20 + b"JFIF": None, b"\x89PNG\r\n\x1a\n": "png", b"GIF87a": "gif",
        b"GIF89a": "gif", b"MM\0*": "tiff", b"II*\0": "tiff", b"\x01\xda": "rgb", b"P1\n": "pbm",
        b"P4 ": "pbm", b"P2\t": "pgm", b"P5\r": "pgm", b"P3\n": "ppm", b"P6 ": "ppm", b"P7 ": None,
        b"P1x": None, b"\x59\xa6\x6a\x95": "rast", b"#define x": "xbm", b"BM": "bmp",
        b"RIFF\0\0\0\0WEBP": "webp", b"RIFF\0\0\0\0WAVE": None, b"\x76\x2f\x31\x01": "exr", b"": None,
        b"plain text": None,
    }
    assert dict(zip(heads, values(images.sniff_type(S), list(heads), "s binary"))) == heads


def test_header_dimensions(values):
    png = b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">II", 640, 70000)
    gif = b"GIF89a" + struct.pack("<HH", 320, 200)
    bmp = b"BM" + bytes(16) + struct.pack("<ii", 100, -50)
    rows = [(png, "png"), (gif, "gif"), (bmp, "bmp"), (png[:20], "png"), (b"\xff\xd8", "jpeg"), (None, None)]
    got = values(images.header_dimensions(S, F.col("t")), rows, "s binary, t string")
    none = (None, None)
    assert [tuple(size) for size in got] == [(640, 70000), (320, 200), (100, 50), none, none, none]

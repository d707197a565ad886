"""Image type and size from the first bytes of a file."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Leading bytes, in hex, of each type.
_MAGIC = {
    "png": ("89504E470D0A1A0A",),
    "gif": ("474946383761", "474946383961"),
    "tiff": ("4D4D", "4949"),
    "rgb": ("01DA",),
    "rast": ("59A66A95",),
    "xbm": (b"#define ".hex().upper(),),
    "bmp": ("424D",),
    "exr": ("762F3101",),
}
_JFIF, _EXIF = "4A464946", "45786966"
_HEADER_BYTES = 32


def sniff_type(content: Column) -> Column:
    """Image type by content; NULL when the bytes are of no known type."""
    head = F.hex(F.substring(content, 1, _HEADER_BYTES))
    starts_jpeg = F.substring(head, 13, 8).isin(_JFIF, _EXIF) | F.startswith(head, F.lit("FFD8"))
    kind = F.when(starts_jpeg, "jpeg")
    for name, marks in _MAGIC.items():
        kind = kind.when(head.rlike("^(" + "|".join(marks) + ")"), name)
    for name, digits in {"pbm": "14", "pgm": "25", "ppm": "36"}.items():
        kind = kind.when(head.rlike(f"^503[{digits}](20|09|0A|0D)"), name)
    webp = F.startswith(head, F.lit("52494646")) & (F.substring(head, 17, 8) == "57454250")
    kind = kind.when(webp, "webp")
    # JFIF at any byte of the first 23.
    late = head.rlike(f"^(..){{0,19}}{_JFIF}")
    return kind.when(late, "jpeg")


def _number(content: Column, start: int, size: int, little: bool = False) -> Column:
    digits = F.hex(F.substring(content, start, size))
    if little:
        digits = F.concat(*[F.substring(digits, 2 * i - 1, 2) for i in range(size, 0, -1)])
    return F.conv(digits, 16, 10).cast("bigint")


def _signed(number: Column) -> Column:
    return F.when(number >= 2**31, number - 2**32).otherwise(number)


def header_dimensions(content: Column, ftype: Column) -> Column:
    """Width and height of PNG, GIF and BMP; NULL for other types or a cut header."""
    png = (ftype == "png") & (F.length(content) >= 24)
    gif = (ftype == "gif") & (F.length(content) >= 10)
    bmp = (ftype == "bmp") & (F.length(content) >= 26)
    return F.struct(
        F.when(png, _number(content, 17, 4))
        .when(gif, _number(content, 7, 2, little=True))
        .when(bmp, F.abs(_signed(_number(content, 19, 4, little=True))))
        .cast("int")
        .alias("width"),
        F.when(png, _number(content, 21, 4))
        .when(gif, _number(content, 9, 2, little=True))
        # A negative height marks rows stored from the top.
        .when(bmp, F.abs(_signed(_number(content, 23, 4, little=True))))
        .cast("int")
        .alias("height"),
    )

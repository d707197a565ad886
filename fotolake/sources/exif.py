"""Reader of embedded metadata: TIFF directories in JPEG, TIFF, PNG and WebP files.

A small helper called on one file's bytes inside a Spark task.
"""

from __future__ import annotations

import base64
import struct
from math import gcd

# Field type number -> (code, struct letter, bytes).
FIELD_TYPES = {
    1: ("B", "B", 1),
    2: ("A", "s", 1),
    3: ("S", "H", 2),
    4: ("L", "I", 4),
    5: ("R", "II", 8),
    6: ("SB", "b", 1),
    7: ("U", "B", 1),
    8: ("SS", "h", 2),
    9: ("SL", "i", 4),
    10: ("SR", "ii", 8),
    11: ("F32", "f", 4),
    12: ("F64", "d", 8),
    13: ("L", "I", 4),
}

# Tag numbers of the Exif standard and their names.
IMAGE_TAGS = {
    0x0100: "ImageWidth",
    0x0101: "ImageLength",
    0x0102: "BitsPerSample",
    0x0103: "Compression",
    0x0106: "PhotometricInterpretation",
    0x010E: "ImageDescription",
    0x010F: "Make",
    0x0110: "Model",
    0x0111: "StripOffsets",
    0x0112: "Orientation",
    0x0115: "SamplesPerPixel",
    0x0116: "RowsPerStrip",
    0x0117: "StripByteCounts",
    0x011A: "XResolution",
    0x011B: "YResolution",
    0x011C: "PlanarConfiguration",
    0x0128: "ResolutionUnit",
    0x0131: "Software",
    0x0132: "DateTime",
    0x013B: "Artist",
    0x013E: "WhitePoint",
    0x013F: "PrimaryChromaticities",
    0x0201: "JPEGInterchangeFormat",
    0x0202: "JPEGInterchangeFormatLength",
    0x0211: "YCbCrCoefficients",
    0x0212: "YCbCrSubSampling",
    0x0213: "YCbCrPositioning",
    0x0214: "ReferenceBlackWhite",
    0x8298: "Copyright",
    0x8769: "ExifOffset",
    0x8825: "GPSInfo",
}
EXIF_TAGS = {
    0x829A: "ExposureTime",
    0x829D: "FNumber",
    0x8822: "ExposureProgram",
    0x8827: "ISOSpeedRatings",
    0x9000: "ExifVersion",
    0x9003: "DateTimeOriginal",
    0x9004: "DateTimeDigitized",
    0x9101: "ComponentsConfiguration",
    0x9102: "CompressedBitsPerPixel",
    0x9201: "ShutterSpeedValue",
    0x9202: "ApertureValue",
    0x9203: "BrightnessValue",
    0x9204: "ExposureBiasValue",
    0x9205: "MaxApertureValue",
    0x9206: "SubjectDistance",
    0x9207: "MeteringMode",
    0x9208: "LightSource",
    0x9209: "Flash",
    0x920A: "FocalLength",
    0x927C: "MakerNote",
    0x9286: "UserComment",
    0x9290: "SubSecTime",
    0x9291: "SubSecTimeOriginal",
    0x9292: "SubSecTimeDigitized",
    0xA000: "FlashPixVersion",
    0xA001: "ColorSpace",
    0xA002: "ExifImageWidth",
    0xA003: "ExifImageLength",
    0xA005: "InteroperabilityOffset",
    0xA20E: "FocalPlaneXResolution",
    0xA20F: "FocalPlaneYResolution",
    0xA210: "FocalPlaneResolutionUnit",
    0xA217: "SensingMethod",
    0xA300: "FileSource",
    0xA301: "SceneType",
    0xA401: "CustomRendered",
    0xA402: "ExposureMode",
    0xA403: "WhiteBalance",
    0xA404: "DigitalZoomRatio",
    0xA405: "FocalLengthIn35mmFilm",
    0xA406: "SceneCaptureType",
    0xA407: "GainControl",
    0xA408: "Contrast",
    0xA409: "Saturation",
    0xA40A: "Sharpness",
    0xA40C: "SubjectDistanceRange",
    0xA420: "ImageUniqueID",
}
GPS_TAGS = {
    0x00: "GPSVersionID",
    0x01: "GPSLatitudeRef",
    0x02: "GPSLatitude",
    0x03: "GPSLongitudeRef",
    0x04: "GPSLongitude",
    0x05: "GPSAltitudeRef",
    0x06: "GPSAltitude",
    0x07: "GPSTimeStamp",
    0x08: "GPSSatellites",
    0x09: "GPSStatus",
    0x0A: "GPSMeasureMode",
    0x0B: "GPSDOP",
    0x0C: "GPSSpeedRef",
    0x0D: "GPSSpeed",
    0x0E: "GPSTrackRef",
    0x0F: "GPSTrack",
    0x10: "GPSImgDirectionRef",
    0x11: "GPSImgDirection",
    0x12: "GPSMapDatum",
    0x1D: "GPSDate",
}
_LINKS = {0x8769: ("EXIF", EXIF_TAGS), 0x8825: ("GPS", GPS_TAGS), 0xA005: ("Interoperability", {})}
_MAKER_NOTE, _USER_COMMENT = 0x927C, 0x9286
_THUMBNAIL_AT, _THUMBNAIL_SIZE = 0x0201, 0x0202


def jpeg_segments(data: bytes):
    """Yield (marker, payload) of the segments before the picture data."""
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xDA:
            return
        if marker == 0x01 or 0xD0 <= marker <= 0xD8:
            at += 2
            continue
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        yield marker, data[at + 4 : at + 2 + size]
        at += 2 + size


def chunks(data: bytes, at: int, order: str, name_first: bool, tail: int):
    """Yield (name, place of the payload) of PNG or RIFF chunks; most hold picture data."""
    while at + 8 <= len(data):
        name, size = data[at : at + 4], data[at + 4 : at + 8]
        if not name_first:
            name, size = size, name
        length = int.from_bytes(size, order)
        yield name, slice(at + 8, at + 8 + length)
        at += 8 + length + tail + (length % 2 if name_first else 0)


def tiff_block(data: bytes) -> bytes | None:
    """The metadata block of a file, or None when it has none."""
    if data[:2] in (b"II", b"MM"):
        return data
    if data[:2] == b"\xff\xd8":
        blocks = (p[6:] for m, p in jpeg_segments(data) if m == 0xE1 and p[:6] == b"Exif\0\0")
    elif data[:4] == b"\x89PNG":
        blocks = (data[p] for n, p in chunks(data, 8, "big", False, 4) if n == b"eXIf")
    elif data[:4] == b"RIFF":
        blocks = (
            data[p].removeprefix(b"Exif\0\0")
            for n, p in chunks(data, 12, "little", True, 0)
            if n == b"EXIF"
        )
    else:
        return None
    return next(blocks, None)


def jpeg_dimensions(data: bytes) -> tuple[int, int] | None:
    """Width and height from the frame header."""
    for marker, payload in jpeg_segments(data):
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC) and len(payload) >= 5:
            height, width = struct.unpack(">HH", payload[1:5])
            return width, height
    return None


def _ratio(top: int, bottom: int) -> str:
    common = gcd(top, bottom) or 1
    top, bottom = top // common, bottom // common
    return str(top) if bottom == 1 else f"{top}/{bottom}"


def _printable(order: str, kind: int, count: int, raw: bytes) -> str:
    code, letters, size = FIELD_TYPES[kind]
    if code == "A":
        return raw.split(b"\0", 1)[0].decode("utf-8", "replace").strip()
    values = struct.unpack(f"{order}{letters * count}", raw[: size * count])
    if len(letters) == 2:
        texts = [_ratio(*pair) for pair in zip(values[::2], values[1::2])]
    else:
        texts = [str(value) for value in values]
    return texts[0] if len(texts) == 1 else "[" + ", ".join(texts) + "]"


def read_tags(data: bytes, thumb: bool = False, maker: bool = False) -> list[tuple[str, str, str]]:
    """All tags of a file as (key, field type code, text); empty when it has none.

    ``data`` is only sliced, so it may be an object that reads slices of an open file.
    """
    block = tiff_block(data)
    if block is None:
        return []
    order = {b"II": "<", b"MM": ">"}[block[:2]]

    def numbers(letters: str, at: int) -> tuple[int, ...]:
        return struct.unpack(order + letters, block[at : at + struct.calcsize(order + letters)])

    found: list[tuple[str, str, str]] = []
    seen: set[int] = set()

    def directory(at: int, group: str, names: dict[int, str]) -> int:
        """Read one directory; returns the offset of the next one."""
        if at == 0 or at in seen:
            return 0
        seen.add(at)
        (entries,) = numbers("H", at)
        thumbnail: dict[int, int] = {}
        for index in range(entries):
            start = at + 2 + 12 * index
            tag, kind, count = numbers("HHI", start)
            if kind not in FIELD_TYPES:
                continue
            size = FIELD_TYPES[kind][2] * count
            place = start + 8
            if size > 4:
                (place,) = numbers("I", place)
            if place + size > len(block) or count == 0:
                continue
            raw = block[place : place + size]
            if tag in _LINKS:
                (target,) = numbers("I", start + 8)
                directory(target, *_LINKS[tag])
            if tag in (_MAKER_NOTE, _USER_COMMENT) and group == "EXIF" and not maker:
                continue
            name = names.get(tag, f"Tag 0x{tag:04X}")
            text = _printable(order, kind, count, raw)
            found.append((f"{group} {name}", FIELD_TYPES[kind][0], text))
            if tag in (_THUMBNAIL_AT, _THUMBNAIL_SIZE):
                thumbnail[tag] = int(text)
        if thumb and group == "Thumbnail" and len(thumbnail) == 2:
            first = thumbnail[_THUMBNAIL_AT]
            picture = block[first : first + thumbnail[_THUMBNAIL_SIZE]]
            found.append(("JPEGThumbnail", "bytes", base64.b64encode(picture).decode()))
        (following,) = numbers("I", at + 2 + 12 * entries)
        return following

    (first,) = numbers("I", 4)
    second = directory(first, "Image", IMAGE_TAGS)
    directory(second, "Thumbnail", IMAGE_TAGS)
    return found

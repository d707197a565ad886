"""Scans, metadata, sinks and streams on files made by hand."""

import base64
import csv
import glob
import hashlib
import json
import os
import random
import struct
import tracemalloc
import zlib
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from fotolake import schemas
from fotolake.plans.ingest import scan_into
from fotolake.schemas import Catalog
from fotolake.sources import catalogs, exif, files, sinks
from fotolake.streaming import ingest as stream

MOMENT = datetime(2024, 3, 1, 12, 0, 0)


def tiff_block(order, directories):
    """A metadata block; directories are lists of (tag, kind, count, bytes or directory number)."""
    mark = {"<": b"II", ">": b"MM"}[order]
    sizes = [2 + 12 * len(d) + 4 for d in directories]
    starts = [8 + sum(sizes[:i]) for i in range(len(directories))]
    body, tail, tail_at = b"", b"", 8 + sum(sizes)
    for number, entries in enumerate(directories):
        body += struct.pack(f"{order}H", len(entries))
        for tag, kind, count, data in entries:
            if isinstance(data, int):
                data = struct.pack(f"{order}I", starts[data])
            if len(data) > 4:
                place = struct.pack(f"{order}I", tail_at + len(tail))
                tail += data
            else:
                place = data.ljust(4, b"\0")
            body += struct.pack(f"{order}HHI", tag, kind, count) + place
        body += struct.pack(f"{order}I", 0)
    return mark + struct.pack(f"{order}HI", 42, 8) + body + tail


def sample_block(order="<"):
    def pack(letters, *numbers):
        return struct.pack(order + letters, *numbers)

    return tiff_block(
        order,
        [
            [(0x010F, 2, 5, b"Make\0"), (0x0112, 3, 1, pack("H", 6)), (0x8769, 4, 1, 1), (0x8825, 4, 1, 2)],
            [(0x9003, 2, 20, b"2020:07:01 12:00:00\0"), (0x829D, 5, 1, pack("II", 28, 10)),
             (0x927C, 7, 3, b"\1\2\3"), (0xABCD, 8, 2, pack("hh", -1, 2)), (0x9204, 10, 1, pack("ii", -1, 3)),
             (0x9000, 11, 1, pack("f", 0.5))],
            [(1, 2, 2, b"N\0"), (2, 5, 3, pack("6I", 37, 1, 25, 1, 438923, 10000)), (3, 2, 2, b"W\0"),
             (4, 5, 3, pack("6I", 120, 1, 30, 1, 0, 1))],
        ],
    )


def jpeg(block=b"", size=(40, 30), tail=b""):
    app1 = b"Exif\0\0" + block
    segments = b"\xff\xe1" + struct.pack(">H", len(app1) + 2) + app1 if block else b""
    frame = b"\x08" + struct.pack(">HH", size[1], size[0]) + b"\x01\x01\x11\x00"
    segments += b"\xff\xc0" + struct.pack(">H", len(frame) + 2) + frame
    return b"\xff\xd8" + segments + b"\xff\xda\0\2" + tail + b"\xff\xd9"


def png(width=3, height=2, block=b""):
    def chunk(name, data):
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    rows = b"".join(b"\0" + bytes(3 * width) for _ in range(height))
    parts = chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0))
    if block:
        parts += chunk(b"eXIf", block)
    return b"\x89PNG\r\n\x1a\n" + parts + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


WANT_TAGS = [
    ("Image Make", "A", "Make"), ("Image Orientation", "S", "6"), ("EXIF DateTimeOriginal", "A", "2020:07:01 12:00:00"),
    ("EXIF FNumber", "R", "14/5"), ("EXIF Tag 0xABCD", "SS", "[-1, 2]"), ("EXIF ExposureBiasValue", "SR", "-1/3"),
    ("EXIF ExifVersion", "F32", "0.5"), ("GPS GPSLatitudeRef", "A", "N"),
    ("GPS GPSLatitude", "R", "[37, 25, 438923/10000]"), ("GPS GPSLongitudeRef", "A", "W"),
    ("GPS GPSLongitude", "R", "[120, 30, 0]"),
]


@pytest.mark.parametrize("order", ["<", ">"])
def test_metadata_of_all_containers(order):
    block = sample_block(order)
    webp = b"RIFF\0\0\0\0WEBP" + b"VP8 \3\0\0\0abc\0" + b"EXIF" + struct.pack("<I", len(block)) + block
    for data in (block, jpeg(block), png(block=block), webp):
        found = exif.read_tags(data)
        plain = [t for t in found if t[0] not in ("Image ExifOffset", "Image GPSInfo")]
        assert sorted(plain) == sorted(WANT_TAGS)
    assert ("EXIF MakerNote", "U", "[1, 2, 3]") in exif.read_tags(jpeg(block), maker=True)
    assert exif.read_tags(b"GIF89a") == [] and exif.read_tags(jpeg()) == []


def _big_files(work):
    """Files mostly of holes, with metadata at both ends."""
    size, block = 300 << 20, bytearray(sample_block())
    struct.pack_into("<I", block, 8 + 2 + 8, size - 5)  # the maker's name stands last
    chunk = struct.pack(">I", len(sample_block())) + b"eXIf" + sample_block() + b"\0\0\0\0"
    picture = png()[:33] + struct.pack(">I", size) + b"IDAT"
    for name, head, at, tail in (
        ("big.tif", bytes(block), size - 5, b"Make\0"),
        ("big.png", picture, len(picture) + size + 4, chunk),
        ("big.jpg", jpeg(sample_block()), size, b"\xff\xd9"),
    ):
        with open(f"{work}/{name}", "wb") as file:
            file.write(head)
            file.seek(at)
            file.write(tail)
        yield f"{work}/{name}"


def test_large_files_are_never_in_memory(work):
    os.makedirs(work, exist_ok=True)
    for path in _big_files(work):
        tracemalloc.start()
        digest, _, (tags, _, _, failed) = files._read_file(path, lambda f: files._header(files._Slices(f), False, False))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        with open(path, "rb") as file:
            assert digest == hashlib.file_digest(file, "md5").hexdigest()
        plain = [t for t in tags if t[0] not in ("Image ExifOffset", "Image GPSInfo")]
        assert sorted(plain) == sorted(WANT_TAGS) and not failed
        assert peak < 8 * files.BLOCK_BYTES, path


def test_slices_are_those_of_the_bytes(work):
    os.makedirs(work, exist_ok=True)
    data = random.Random(3).randbytes(5 * files.SLICE_BYTES + 77)
    with open(f"{work}/data", "wb") as file:
        file.write(data)
    with files._open(f"{work}/data") as file:
        slices, n = files._Slices(file), len(data)
        assert len(slices) == n and slices[n - 1] == data[n - 1]
        edges = [0, 1, files.SLICE_BYTES - 1, files.SLICE_BYTES, 2 * files.SLICE_BYTES + 1, n - 1, n, n + 9]
        for a in edges:
            for b in edges:
                assert slices[a:b] == data[a:b]
    assert files._content(f"{work}/none") is None


def test_thumbnail_only_when_asked():
    inner = [(0x0201, 4, 1, struct.pack("<I", 200)), (0x0202, 4, 1, struct.pack("<I", 4))]
    block = bytearray(tiff_block("<", [[(0x0112, 3, 1, b"\1\0")], inner]))
    struct.pack_into("<I", block, 8 + 2 + 12, 8 + 2 + 12 + 4)  # the second directory follows the first
    block = bytes(block).ljust(200, b"\0") + b"pict"
    found = dict((k, v) for k, _, v in exif.read_tags(block, thumb=True))
    assert base64.b64decode(found["JPEGThumbnail"]) == b"pict"
    assert "JPEGThumbnail" not in dict((k, v) for k, _, v in exif.read_tags(block))


@pytest.fixture
def tree(work):
    content = {
        "a/one.jpg": jpeg(sample_block()),
        "a/two x+y%20.txt": jpeg(sample_block(">"), (7, 5)),
        "a/deep/copy.jpg": jpeg(sample_block()),
        "three.png": png(),
        "four.gif": b"GIF89a" + struct.pack("<HH", 11, 12) + b"rest",
        "bad.jpg": jpeg(b"II*\0\xff\xff\xff\xff"),
        "text.jpg": b"no picture",
        "db.sqlite-journal": b"GIF89a",
    }
    for name, data in content.items():
        os.makedirs(os.path.dirname(f"{work}/t/{name}"), exist_ok=True)
        with open(f"{work}/t/{name}", "wb") as file:
            file.write(data)
    return f"{work}/t", content


def names(df):
    return sorted(row.path.split("/t/", 1)[1] for row in df.select("path").collect())


def test_listing(spark, tree):
    root, content = tree
    listed = files.list_files(spark, root)
    assert names(listed) == sorted(set(content) - {"db.sqlite-journal"})
    assert names(files.list_files(spark, root, recursive=False)) == ["bad.jpg", "four.gif", "text.jpg", "three.png"]
    assert files.list_files(spark, root, modified_after="2099-01-01T00:00:00").isEmpty()
    assert names(files.filter_extension(listed, [".PNG"], ignore_case=True)) == ["three.png"]
    assert files.filter_extension(listed, [".PNG"]).isEmpty()
    assert names(files.filter_name(listed, "t.p|.gif")) == ["four.gif"]
    assert files.distinct_files(listed, listed).count() == 7
    sizes = {r.path.split("/t/", 1)[1]: r.length for r in listed.collect()}
    assert sizes == {n: len(content[n]) for n in sizes}
    assert files.list_files(spark, f"{root}/none").isEmpty()
    assert names(files.list_files(spark, [f"{root}/a", f"file://{root}"], recursive=False)) == sorted(
        ["a/one.jpg", "a/two x+y%20.txt", "bad.jpg", "four.gif", "text.jpg", "three.png"]
    )


def test_no_name_is_skipped_and_links_are_not_entered(spark, work):
    found = ["_DSC0001.JPG", "ok/_MG_2.JPG", "_raw/a.jpg", ".hid.jpg", ".cam/b.jpg", "c.jpg", "ok/d.jpg"]
    for name in found:
        os.makedirs(os.path.dirname(f"{work}/t/{name}") or work, exist_ok=True)
        with open(f"{work}/t/{name}", "wb") as file:
            file.write(b"GIF89a" + name.encode())
    os.symlink(f"{work}/t", f"{work}/t/ok/loop")
    assert names(files.list_files(spark, f"{work}/t")) == sorted(found)
    records = files.scan_listed(files.list_files(spark, f"{work}/t"))
    assert names(records) == sorted(found) and records.where("md5hash is null").isEmpty()


def test_many_small_files_use_many_tasks(spark, work):
    listing = spark.createDataFrame([(f"/x/{i}", None, 10) for i in range(400)], schemas.FILE[:3])
    assert files.spread_by_bytes(listing).rdd.getNumPartitions() > 1
    huge = spark.createDataFrame([(f"/x/{i}", None, 1 << 30) for i in range(9)], schemas.FILE[:3])
    assert files.spread_by_bytes(huge).rdd.getNumPartitions() == 36
    assert files.spread_by_bytes(huge.limit(0)).count() == 0


def test_scan_records(spark, tree):
    root, content = tree
    records = files.scan_records(files.scan_files(spark, root), zone="Europe/Berlin")
    rows = {row.path.split("/t/", 1)[1]: row for row in records.collect()}
    assert set(rows) == set(content) - {"text.jpg", "db.sqlite-journal"}
    for name, row in rows.items():
        assert row.md5hash == hashlib.md5(content[name]).hexdigest()
        assert (row.root + "/" + row.fname) == row.path
    one = rows["a/one.jpg"]
    assert (one.ftype, one.width, one.height) == ("jpeg", 40, 30)
    assert one.msg == f"{one.path}|read success"
    assert {t.key: t.value for t in one.tags}["EXIF FNumber"] == "14/5"
    assert rows["bad.jpg"].msg.endswith("|tag failure") and rows["bad.jpg"].tags is None
    assert (rows["three.png"].width, rows["three.png"].height, rows["three.png"].tags) == (3, 2, None)
    assert (rows["four.gif"].width, rows["four.gif"].height) == (11, 12)
    assert rows["a/two x+y%20.txt"].ftype == "jpeg"
    stamp = os.path.getmtime(one.path)
    assert abs((one.dt_mod - datetime.fromtimestamp(stamp, __import__("zoneinfo").ZoneInfo("Europe/Berlin")).replace(tzinfo=None)).total_seconds()) < 1

    update = files.scan_records(files.scan_files(spark, root), update=True)
    assert update.schema == records.schema
    assert update.where("tags is not null or width is not null").isEmpty() and update.count() == 7
    for flag in (False, True):
        one_way = files.scan_records(files.scan_files(spark, root), update=flag)
        other = files.scan_listed(files.list_files(spark, root), update=flag)
        assert one_way.schema == other.schema
        assert sorted(map(str, one_way.collect())) == sorted(map(str, other.collect()))
    status = files.read_status(files.list_files(spark, root), records)
    assert {row.msg.split("|")[1] for row in status.collect()} == {"read success", "tag failure", "type failure"}
    assert status.count() == 7

    counted, watch = files.observe_scan(records)
    counted.write.format("noop").mode("overwrite").save()
    assert watch.get == {"files": 6, "unread": 0, "tagged": 3}

    tags = files.extract_tags(files.scan_files(spark, root))
    assert tags.where("key = 'Image Make'").count() == 3
    assert tags.where("key = 'EXIF MakerNote'").isEmpty()
    assert files.extract_tags(files.scan_files(spark, root), maker=True).where("key = 'EXIF MakerNote'").count() == 3


def test_decoded_dimensions(spark, tree):
    root, _ = tree
    with open(f"{root}/a/b c+d%20.png", "wb") as file:
        file.write(png(9, 4))
    got = {r.path.split("/t/", 1)[1]: (r.width, r.height) for r in files.image_dimensions(spark, root).collect()}
    assert got["a/b c+d%20.png"] == (9, 4) and got["text.jpg"] == (None, None)
    joined = files.scan_files(spark, root).select("path").join(files.image_dimensions(spark, root), "path")
    assert joined.count() == 8


def test_read_listed_keeps_rows_it_cannot_read(spark, tree):
    root, content = tree
    listing = files.list_files(spark, root)
    gone = listing.withColumn("path", F.regexp_replace("path", "four", "five"))
    read = {r.path.split("/t/", 1)[1]: r.content for r in files.read_listed(gone).collect()}
    assert read["five.gif"] is None and bytes(read["three.png"]) == content["three.png"]
    records = files.scan_records(files.read_listed(gone)).where("ftype is null").collect()
    assert [r.msg.split("|")[1] for r in records] == ["read failure"]


def test_scan_into_a_catalog(spark, tree):
    root, content = tree
    first = scan_into(spark, Catalog.empty(spark), root, MOMENT, local=True, zone="America/Los_Angeles")
    assert sorted(r.path for r in first.photo.collect()) == sorted(set(content) - {"text.jpg", "db.sqlite-journal"})
    assert first.hash.count() == 5 and first.tag.count() == 5
    taken = first.photo.where("path = 'a/one.jpg'").first().dt_orig
    assert taken == datetime(2020, 7, 1, 19, 0)
    place = first.location.where("wkt is not null").collect()
    assert len(place) == 2 and {(round(p.lat, 6), p.long) for p in place} == {(37.428859, -120.5)}
    meta = json.loads(first.tag.where("width = 40").first().meta)
    assert meta["Image Orientation"] == 6 and meta["EXIF ExifVersion"] == 0.5
    with open(f"{root}/new.gif", "wb") as file:
        file.write(b"GIF89aXXXX")
    again = scan_into(spark, first, root, datetime(2024, 3, 2), local=True)
    assert again.photo.count() == 7 and again.imports.count() == 2
    nothing = scan_into(spark, again, f"file://{root}", datetime(2024, 3, 3), local=True)
    assert nothing.imports.count() == 2


def test_catalog_round_trip(spark, work, tree):
    root, _ = tree
    catalog = scan_into(spark, Catalog.empty(spark), root, MOMENT)
    catalogs.write_catalog(catalog, f"{work}/c")
    back = catalogs.read_catalog(spark, f"{work}/c")
    for name, table in catalog.tables().items():
        assert back.tables()[name].schema == table.schema or name
        assert sorted(map(str, back.tables()[name].collect())) == sorted(map(str, table.collect()))
    with pytest.raises(Exception, match="(?i)exists"):
        catalogs.write_catalog(catalog, f"{work}/c")


def test_stream_equals_batch_and_runs_once(spark, work, tree):
    root, _ = tree
    stream.empty_catalog(spark, f"{work}/c")

    def run():
        query = stream.ingest_stream(
            spark, root, f"{work}/c", f"{work}/state", MOMENT, files_per_batch=3, local=True
        )
        query.awaitTermination()
        return catalogs.read_catalog(spark, f"{work}/c")

    got = run()
    want = scan_into(spark, Catalog.empty(spark), root, MOMENT, local=True)

    def keys(catalog):
        return (
            sorted(tuple(r) for r in catalog.photo.select("path", "md5hash", "ftype", "dt_mod").collect()),
            sorted(tuple(r) for r in catalog.tag.collect()),
            sorted(tuple(r) for r in catalog.location.select("md5hash", "lat").collect()),
            sorted(r.md5hash for r in catalog.hash.collect()),
        )

    assert keys(got) == keys(want)
    assert got.imports.count() == 1
    assert keys(run()) == keys(want)
    # A batch run again after its commit changes nothing; another stream's is a conflict.
    batch = files.list_files(spark, root)
    key = got.imports.first().import_date
    again = stream.batch_upsert(
        spark, f"{work}/c", root, key, MOMENT, local=True, writer=f"{work}/state"
    )
    again(batch, 0)
    assert keys(catalogs.read_catalog(spark, f"{work}/c")) == keys(want)
    other = stream.batch_upsert(spark, f"{work}/c", root, key, MOMENT, local=True, writer="b")
    with pytest.raises(catalogs.CommitConflict):
        other(batch, 0)
    # A file that arrives late with an old date, and one Spark's own sources would skip.
    for name in ("late.gif", "_under.gif"):
        with open(f"{root}/{name}", "wb") as file:
            file.write(b"GIF89a" + name.encode())
    os.utime(f"{root}/late.gif", (10**9, 10**9))
    after = run()
    new = after.photo.where("path in ('late.gif', '_under.gif')").collect()
    assert {r.dt_import for r in new} == {"2024-03-01T12:00:01Z"} and len(new) == 2


def test_half_written_batches_are_not_seen(spark, work, tree, monkeypatch):
    root, _ = tree
    folder = f"{work}/c"
    stream.empty_catalog(spark, folder)
    rows = scan_into(spark, Catalog.empty(spark), root, MOMENT).tables()

    broken = dict(rows)
    broken["location"] = rows["location"].select(F.raise_error(F.lit("stop")).alias("x"))
    with pytest.raises(Exception):
        catalogs.append_batch(broken, folder, 1, "w")
    assert catalogs.read_catalog(spark, folder).photo.count() == 0
    assert catalogs.append_batch(rows, folder, 1, "w")
    assert not catalogs.append_batch(rows, folder, 1, "w")
    n = rows["photo"].count()
    assert catalogs.read_catalog(spark, folder).photo.count() == n > 0
    # A manifest that is not whole is not there yet.
    with open(f"{folder}/{catalogs.MANIFESTS}/000000000002.json", "w") as file:
        file.write('{"batch": 2')
    assert len(catalogs.manifests(spark, folder)) == 2
    # Two writers of one batch: the later manifest fails.
    monkeypatch.setattr(catalogs, "is_committed", lambda *_: False)
    with pytest.raises(catalogs.CommitConflict):
        catalogs.append_batch(rows, folder, 1, "v")
    assert catalogs.read_catalog(spark, folder).photo.count() == n


def test_vanished_and_closed_entries_cost_only_themselves(spark, work, monkeypatch):
    for i in range(8):
        with open(f"{work}/{i}.gif", "wb") as file:
            file.write(b"GIF89a")
    os.symlink(f"{work}/gone", f"{work}/link.gif")
    rows = [(f"{work}/{i}.gif", None, None) for i in range(8)] + [(f"{work}/gone.gif", None, None)]
    names = spark.createDataFrame(rows, files._FILES)
    left = names.mapInPandas(files._with_state, files._FILES)
    assert left.count() == 8 and left.where("length = 6").count() == 8
    assert files.list_files(spark, work).count() == 8


def test_files_of_one_folder_are_spread_over_tasks(spark, work):
    for i in range(2_000):
        open(f"{work}/{i}.gif", "wb").close()
    found = files.list_files(spark, work)
    assert found.count() == 2_000
    assert found.select(F.spark_partition_id()).distinct().count() > 1


def read_parts(folder):
    parts = sorted(glob.glob(f"{folder}/part-*.csv"))
    return "".join(open(part, newline="").read() for part in parts)


def test_delimited_sinks(spark, work):
    rows = [("p", "cam", None, "2024", 5, ' a "q", b\nnext'), ("p2", None, None, None, None, None)]
    schema = "path string, camera_name string, camera_type string, dt_iso string, exposure int, ocr string"
    sinks.write_stamps_csv(spark.createDataFrame(rows, schema).coalesce(1), f"{work}/s")
    read = list(csv.reader(read_parts(f"{work}/s").splitlines(keepends=True)))
    assert read[0] == list(sinks.STAMP_COLUMNS)
    assert ["p", "cam", "", "2024", "5", ' a "q", b\nnext'] in read and ["p2", "", "", "", "", ""] in read
    wide = spark.createDataFrame([("h", "1|2", None)], "`md5 hash` string, a string, b string").coalesce(1)
    sinks.write_wide_pipe(wide, f"{work}/w")
    assert read_parts(f"{work}/w").splitlines() == ["md5 hash|a|b", 'h|"1|2"|']
    sinks.write_plan_csv(wide, f"{work}/plan")
    assert read_parts(f"{work}/plan").splitlines()[0] == "md5 hash,a,b"
    sinks.write_wide_parquet(wide, f"{work}/pq")
    assert spark.read.parquet(f"{work}/pq").columns == ["md5 hash", "a", "b"]
    sinks.write_wide_table(wide, "photos_wide")
    assert spark.table("photos_wide").columns == ["md5_hash", "a", "b"]


def test_a_commit_is_looked_up_by_its_own_manifest(spark, work, monkeypatch):
    """Not by all manifests, of which a long stream has very many."""
    from fotolake import Catalog
    from fotolake.sources import catalogs

    empty = Catalog.empty(spark)
    catalogs.write_catalog(empty, f"{work}/c")
    for batch in (1, 2, 3):
        assert catalogs.append_batch(empty.tables(), f"{work}/c", batch, "me")
    read = []
    parse = catalogs.json.loads
    monkeypatch.setattr(catalogs.json, "loads", lambda text: read.append(text) or parse(text))
    assert catalogs.is_committed(spark, f"{work}/c", 2, "me")
    assert not catalogs.is_committed(spark, f"{work}/c", 4, "me")
    assert len(read) == 1
    with pytest.raises(catalogs.CommitConflict):
        catalogs.is_committed(spark, f"{work}/c", 3, "you")


def test_a_file_for_every_row(spark, work):
    """Equal and missing values too; written by the tasks, so the driver commits nothing."""
    values = [f"{i % 40} é" for i in range(100)] + [None, ""]
    lines = spark.createDataFrame([(v,) for v in values], "value string")
    for folder in (f"{work}/a/b", f"file:{work}/c"):
        sinks.write_line_files(lines, folder, files_per_task=10)
        found = os.listdir(files.plain_root(folder))
        assert len({name.split("-")[1] for name in found}) > 1
        texts = []
        for name in found:
            with open(f"{files.plain_root(folder)}/{name}", encoding="utf-8") as file:
                texts.append(file.read())
        assert sorted(texts) == sorted(f"{v or ''}\n" for v in values)
    sinks.write_line_files(lines.limit(0), f"{work}/none")
    assert not os.path.exists(f"{work}/none") or os.listdir(f"{work}/none") == []


def test_a_stream_reads_each_manifest_once(spark, work, monkeypatch):
    empty = Catalog.empty(spark)
    catalogs.write_catalog(empty, f"{work}/c")
    read, known = [], {}
    parse = catalogs.json.loads
    monkeypatch.setattr(catalogs.json, "loads", lambda text: read.append(text) or parse(text))
    for batch in range(1, 5):
        catalogs.append_batch(empty.tables(), f"{work}/c", batch, "me")
        catalogs.read_catalog(spark, f"{work}/c", before=batch, known=known)
    assert len(read) == 4
    assert catalogs.manifests(spark, f"{work}/c", known=known) == catalogs.manifests(spark, f"{work}/c")

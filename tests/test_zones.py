"""Offsets of abbreviations against the zone database."""

import random
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo, available_timezones

import pytest
from fotolake.functions import stamps, zones
from pyspark.sql import functions as F


def test_equal_to_the_database_where_all_zones_agree(values):
    rng = random.Random(2)
    names = sorted(available_timezones())
    rows, want = [], []
    for _ in range(600):
        zone = ZoneInfo(rng.choice(names))
        at = datetime(1975, 1, 1, tzinfo=timezone.utc) + timedelta(hours=rng.randrange(60 * 8766))
        local = at.astimezone(zone)
        abbr = local.tzname()
        if not (abbr.isalpha() and abbr.isupper()) or abbr in zones.PREFERRED:
            continue
        naive = local.replace(tzinfo=None)
        used = {
            local.utcoffset()
            for name in names
            for local in [naive.replace(tzinfo=ZoneInfo(name))]
            if local.tzname() == abbr
        }
        if len(used) == 1:
            rows.append((abbr, naive))
            want.append(local.utcoffset() // timedelta(minutes=1))
    assert len(rows) > 50
    got = values(zones.zone_minutes(F.col("z"), F.col("t")), rows, "z string, t timestamp_ntz")
    assert got == want
    assert got == [zones.offset_of(*row) for row in rows]


@pytest.mark.parametrize(
    ("abbr", "at", "minutes"),
    [
        ("CST", datetime(2024, 1, 1), -360),
        ("IST", datetime(2024, 7, 1), 330),
        ("EDT", datetime(2024, 1, 1), -240),  # not in force: its only meaning
        ("MSK", datetime(2012, 6, 1), 240),
        ("MSK", datetime(2020, 6, 1), 180),
        ("CEST", datetime(1900, 6, 1), 120),  # before the table: as its first year
        ("SGT", datetime(2024, 1, 1), 480),
        ("QQQ", datetime(2024, 1, 1), None),
    ],
)
def test_defined_cases(values, abbr, at, minutes):
    assert zones.offset_of(abbr, at) == minutes
    got = values(zones.zone_minutes(F.col("z"), F.col("t")), [(abbr, at)], "z string, t timestamp_ntz")
    assert got == [minutes]


def test_stamps_use_the_offset_of_their_date(values):
    rows = [("Fri Jun 01 2012 12:00:00 MSK",), ("Mon Jun 01 2020 12:00:00 MSK",), ("Mon Jun 01 2020 12:00:00 QQQ",)]
    got = values(stamps.parse_stamp_datetime(F.col("s")), rows, "s string")
    assert [r["dt_iso"] for r in got] == ["2012-06-01 12:00:00+04:00", "2020-06-01 12:00:00+03:00", None]


def test_typed_tags(spark):
    from fotolake.operators import records

    meta = '{"a b":3,"c":2.5,"d":"x","big":123456789012345678901234567890}'
    df = spark.createDataFrame([("h", meta), ("n", None), ("bad", "{")], "md5hash string, meta string")
    wanted = {"i": ("a b", "bigint"), "r": ("c", "double"), "s": ("d", "string"), "no": ("z", "string"),
              "wrong": ("d", "bigint"), "big": ("big", "bigint")}
    found = records.typed_tags(df, wanted)
    rows = {r["md5hash"]: tuple(r)[1:] for r in found.collect()}
    assert rows == {"h": (3, 2.5, "x", None, None, None), "n": (None,) * 6, "bad": (None,) * 6}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("parse_json") <= 2  # one column, by its name in two lines of the plan

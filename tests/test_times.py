from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from fotolake.functions import times

T = F.col("t")


def test_exif_datetime(values):
    rows = [
        "2020:01:02 03:04:05", "0000:00:00 00:00:00", "2020:13:02 03:04:05", None, "", "2020:1:2 3:4:5",
        "2020-01-02 03:04:05", "2020:02:30 00:00:00", "2020:01:02 03:04:05.5", "2020:01:02 24:00:00",
    ]
    good = datetime(2020, 1, 2, 3, 4, 5)
    got = values(times.parse_exif_datetime(T), rows, "t string")
    assert got == [good, None, None, None, None, good, None, None, None, None]


def test_localize_as_standard_time(values):
    zone = "America/Los_Angeles"
    start = datetime(2020, 3, 7, 22, 0)
    hours = [start + timedelta(minutes=30 * i) for i in range(24)]
    hours += [datetime(2020, 10, 31, 22, 0) + timedelta(minutes=30 * i) for i in range(24)]
    got = values(times.localize(T, zone), hours, "t timestamp_ntz")

    def standard(naive):
        # The reading with the smaller offset, as for a repeated hour or a gap.
        both = [naive.replace(tzinfo=ZoneInfo(zone), fold=fold) for fold in (0, 1)]
        offset = min(each.utcoffset() for each in both)
        return naive - offset

    assert got == [standard(hour) for hour in hours]
    assert times.localize(T, None) is T


def test_unknown_zone_is_rejected():
    with pytest.raises(ValueError):
        times.check_zone("Mars/Base")


def test_wall_clock_does_not_depend_on_the_session(spark, values):
    moments = [datetime(2020, 7, 1, 12, 0, 0, 999999, timezone.utc), datetime(1969, 12, 31, 23, 59, 58, tzinfo=timezone.utc)]
    want = [datetime(2020, 7, 1, 14, 0), datetime(1970, 1, 1, 0, 59, 58)]
    for zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            assert values(times.wall_clock(T, "Europe/Berlin"), moments, "t timestamp") == want
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize(
    "fmt",
    [
        "%Y%m%d_%H%M%S", "it's %d o'clock", "%y%Y %j %b %B %a %A", "%I:%M %p.%f", "%G-W%V-%u", "%U %W %w",
        "%F %T %D %R", "100%% %C %e", "%m%b", "", "plain", "%x %X %c",
    ],
)
def test_strftime_as_python(values, fmt):
    rows = [datetime(2021, 1, 3, 4, 5, 6, 7000), datetime(2020, 12, 31, 13, 0, 0), datetime(1999, 2, 1)]
    assert values(times.strftime(T, fmt), rows, "t timestamp_ntz") == [r.strftime(fmt) for r in rows]


def test_strftime_rejects_what_it_cannot_print():
    for fmt in ("%Q", "%", "%-d"):
        with pytest.raises(ValueError):
            times.strftime(T, fmt)


def test_date_tokens(values):
    tokens = times.date_tokens(T)
    when = [datetime(2021, 1, 3)]
    got = [values(tokens[k], when, "t timestamp_ntz")[0] for k in ("isoyear", "isoweek", "isoday", "year", "month")]
    assert got == [2020, 53, 7, 2021, 1]
    assert values(tokens["timestamp"], [None], "t timestamp_ntz") == [None]

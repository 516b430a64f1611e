"""The readings against a plain reader built on datetime and zoneinfo, and every defined case."""

import re
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import functions as F

from tidewright.functions.ticks import iso_day, iso_instant
from tidewright.operators.timestamps import offset_intervals, read_days, read_times

EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
ABBR = {"EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "GMT": 0, "BST": 1, "CET": 1, "CEST": 2, "JST": 9, "IST": 5.5, "UTC": 0}


def plain(text, order, zone):
    """(instant or None, day or None) by the words of the statement."""
    text = (text or "").strip()
    if re.fullmatch(r"\d+", text):
        for fmt, n in (("%Y%m%d", 8), ("%Y%m%d%H%M", 12), ("%Y%m%d%H%M%S", 14)):
            if len(text) == n and 2000 <= int(text[:4]) <= 2025:
                try:
                    wall = datetime.strptime(text, fmt)
                except ValueError:
                    return None, None
                return wall.replace(tzinfo=ZoneInfo(zone)).astimezone(timezone.utc), wall.date()
        for unit in (1, 1000, 1_000_000):
            if 946_684_800 <= int(text) // unit < 1_767_225_600:
                at = EPOCH + timedelta(microseconds=int(text) * (1_000_000 // unit))
                return at, at.date()
        return None, None
    m = re.fullmatch(r"(.*?)(?:(?:T|\s+)(\d{1,2}:\d\d(?::\d\d(?:\.\d+)?)?(?:\s*[AP]M)?)\s*(Z|[+-]\d\d:?\d\d|[A-Z]{3,4})?(\[.*\])?)?", text)
    day_text, clock, off = re.sub(r"^\w{3}, ", "", m[1]), m[2], m[3]
    numeric = "%d/%m/%Y" if order == "dmy" else "%m/%d/%Y"
    day = None
    for fmt, t in (("%Y-%m-%d", day_text.replace("/", "-")), (numeric, day_text.replace(".", "/")), ("%d %b %Y", day_text.replace("-", " ")), ("%b %d, %Y", day_text)):
        try:
            day = datetime.strptime(t, fmt)
            break
        except ValueError:
            pass
    if day is None:
        return None, None
    wall = day
    if clock:
        clock = re.sub(r"(\.\d{6})\d+", r"\1", clock)
        for fmt in ("%H:%M", "%H:%M:%S", "%H:%M:%S.%f", "%I:%M %p", "%I:%M:%S %p"):
            try:
                c = datetime.strptime(clock, fmt)
                wall = day + timedelta(hours=c.hour, minutes=c.minute, seconds=c.second, microseconds=c.microsecond)
                break
            except ValueError:
                pass
        else:
            return None, day.date()
    if off is None:
        return wall.replace(tzinfo=ZoneInfo(zone)).astimezone(timezone.utc), day.date()
    if off == "Z":
        hours = 0
    elif off[0] in "+-":
        hours = int(off[0] + "1") * (int(off[1:3]) + int(off[-2:]) / 60)
    else:
        hours = ABBR[off]
    return wall.replace(tzinfo=timezone.utc) - timedelta(hours=hours), day.date()


def readings(spark, rows):
    """rows of (id, text, order, zone) -> id -> (instant, day, how)"""
    df = spark.createDataFrame(rows, "id long, text string, o string, z string")
    zones = df.select(F.col("z").alias("tz_name"))
    got = read_times(df, "text", F.col("o"), F.col("z"), offset_intervals(zones))
    got = got.select("id", iso_instant(F.col("utc")).alias("at"), iso_day(F.col("day")).alias("day"), "how")
    return {r.id: (r["at"], r.day, r.how) for r in got.collect()}


CASES = [
    ("2016-03-13 02:30:00", "mdy", "America/New_York", "2016-03-13T07:30:00.000000Z", "2016-03-13", "nonexistent"),
    ("2016-11-06 01:30:00", "mdy", "America/New_York", "2016-11-06T05:30:00.000000Z", "2016-11-06", "ambiguous"),
    ("2016-11-06 01:30:00 EST", "mdy", "America/New_York", "2016-11-06T06:30:00.000000Z", "2016-11-06", "abbreviation"),
    ("2016-07-01 12:00:00 EST", "mdy", "America/New_York", "2016-07-01T17:00:00.000000Z", "2016-07-01", "abbreviation"),
    ("2016-03-27 02:30", "dmy", "Europe/Paris", "2016-03-27T01:30:00.000000Z", "2016-03-27", "nonexistent"),
    ("30.10.2016 02:53", "dmy", "Europe/Paris", "2016-10-30T00:53:00.000000Z", "2016-10-30", "ambiguous"),
    ("2016-07-12T00:07:53.773771763Z", "ymd", "UTC", "2016-07-12T00:07:53.773771Z", "2016-07-12", "written"),
    ("2016-11-28 00:00:00+05:30", "dmy", "Asia/Kolkata", "2016-11-27T18:30:00.000000Z", "2016-11-28", "written"),
    ("12/25/2016 12:05 AM", "mdy", "America/Chicago", "2016-12-25T06:05:00.000000Z", "2016-12-25", "zone"),
    ("12/25/2016 12:05 PM", "mdy", "America/Chicago", "2016-12-25T18:05:00.000000Z", "2016-12-25", "zone"),
    ("12/25/2016 13:05 PM", "mdy", "America/Chicago", None, "2016-12-25", "unreadable"),
    ("25/12/2016", "mdy", "America/Chicago", None, None, "unreadable"),
    ("25/12/2016", "dmy", "Europe/London", "2016-12-25T00:00:00.000000Z", "2016-12-25", "zone"),
    ("25/12/2016", None, "Europe/London", None, None, "unreadable"),
    ("2016-06-31T12:00:00Z", "ymd", "UTC", None, None, "unreadable"),
    ("1480037525065", "ymd", "UTC", "2016-11-25T01:32:05.065000Z", "2016-11-25", "count"),
    ("1456070245999373", "ymd", "UTC", "2016-02-21T15:57:25.999373Z", "2016-02-21", "count"),
    ("20161003143156", "ymd", "Asia/Tokyo", "2016-10-03T05:31:56.000000Z", "2016-10-03", "zone"),
    ("20161341", "ymd", "UTC", None, None, "unreadable"),
    ("pending", "ymd", "UTC", None, None, "unreadable"),
    ("", "ymd", "UTC", None, None, "unreadable"),
    ("\x01a", "ymd", "UTC", None, None, "unreadable"),
    ("x" * 200_000, "ymd", "UTC", None, None, "unreadable"),
    (None, "ymd", "UTC", None, None, None),
    ("2016-10-03 12:00", "ymd", None, None, "2016-10-03", "no_zone"),
    ("2016-10-03 12:00", "ymd", "Nowhere/Land", None, "2016-10-03", "no_zone"),
    ("2016-10-03 12:00Z", "ymd", None, "2016-10-03T12:00:00.000000Z", "2016-10-03", "written"),
    ("\t Mon, 03 May 2021 07:24:06 +0100\n", "dmy", "Europe/London", "2021-05-03T06:24:06.000000Z", "2021-05-03", "written"),
    ("Nov 18, 2016 3:34:37 AM -0600", "mdy", "America/Chicago", "2016-11-18T09:34:37.000000Z", "2016-11-18", "written"),
    ("1950-07-01 12:00", "ymd", "America/New_York", "1950-07-01T17:00:00.000000Z", "1950-07-01", "zone"),
    ("2100-07-01 12:00", "ymd", "America/New_York", "2100-07-01T17:00:00.000000Z", "2100-07-01", "zone"),
]


def test_defined_cases(spark):
    got = readings(spark, [(i, *c[:3]) for i, c in enumerate(CASES)])
    assert {i: got[i] for i in got} == {i: tuple(c[3:]) for i, c in enumerate(CASES)}


def test_all_test_texts_against_plain_reader(spark, data):
    from tidewright.plans.problems import days, instants
    from tidewright.sources.tables import table as load

    feeds = {r.feed: (r.day_order, r.tz_name) for r in load(spark, data, "feeds").collect()}
    for r in instants(spark, data).withColumn("at", iso_instant(F.col("utc"))).collect():
        at, _ = plain(r["date"], *feeds[r.feed])
        assert r["at"] == (at and at.strftime("%Y-%m-%dT%H:%M:%S.%fZ")), (r["date"], r.feed)
    for name in ("news", "prices"):
        for r in days(spark, data, name).withColumn("iso", iso_day(F.col("day"))).collect():
            _, day = plain(r.date_only, *feeds[r.feed])
            assert r.iso == (day and str(day)), (r.date_only, r.feed)


def test_days_agree_with_readings(spark):
    df = spark.createDataFrame([(i, c[0], c[1]) for i, c in enumerate(CASES)], "id long, text string, o string")
    got = {r.id: r.iso for r in read_days(df, "text", F.col("o")).withColumn("iso", iso_day(F.col("day"))).collect()}
    assert got == {i: c[4] for i, c in enumerate(CASES)}


def test_empty_table_and_clashing_names(spark):
    df = spark.createDataFrame([], "text string, zone string, month int, spans string, o string")
    got = read_times(df, "text", F.col("o"), F.col("zone"), offset_intervals(spark.createDataFrame([], "tz_name string")))
    assert got.columns == [*df.columns, "day", "utc", "how"] and got.count() == 0
    one = spark.createDataFrame([("2016-01-01", "UTC", 3, "kept", "ymd")], df.schema)
    row = read_times(one, "text", F.col("o"), F.col("zone"), offset_intervals(one, "zone")).first()
    assert (row.month, row.spans, row.how) == (3, "kept", "zone")

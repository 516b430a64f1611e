"""One UTC instant, or one calendar day, for timestamps written in many habits.

A single pattern takes a text apart into year, month, day, clock, zone.  Texts with an offset, ``Z`` or
a count since 1970 are instants at once.  Wall-clock times without one are joined as of their local
time to the zone's offset intervals: each interval holds in local time from its change plus its own
offset to the next change plus its own offset, so a repeated hour lies in two intervals, a skipped
hour in none and any other time in one.  The intervals are exploded by local month, which makes the
as-of join an equi-join on (zone, month) followed by a look at one or two candidates.

Scale: every row is a projection plus two broadcast joins: no shuffle.  Broadcast are the feeds and the
exploded intervals: at most zones x months of the stated years rows (600 x 840 for all zones there are).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tidewright.functions.text import strip
from tidewright.functions.ticks import DAY_MICROS
from tidewright.runtime import require_columns

#: Years whose changes of offset are listed; outside them the nearest listed offset holds.
YEARS = (1970, 2039)
#: Counts since 1970 and calendar digits are told apart by the years that they fall into.
COUNT_YEARS = (2000, 2025)

_CLOCK = (
    r"(?:(?:T|\s+)(?<hh>\d{1,2}):(?<mi>\d{2})(?::(?<ss>\d{2})(?:[.,](?<fr>\d+))?)?(?:\s*(?<ap>[AaPp][Mm]))?)?"
    r"(?:\s*(?<zo>[Zz]|[+-]\d{2}(?::?\d{2})?|[A-Za-z]{2,5}))?(?:\[[^\]]*\])?"
)
_PATTERN = (
    r"(?s)^(?:(?<ya>\d{4})(?<sa>[-/.])(?<ma>\d{1,2})\k<sa>(?<da>\d{1,2})"
    r"|(?<n1>\d{1,2})(?<sb>[-/.])(?<n2>\d{1,2})\k<sb>(?<yb>\d{4})"
    r"|(?:[A-Za-z]{3,9},\s*)?(?<dc>\d{1,2})[-\s]+(?<nc>[A-Za-z]{3,9})\.?[-,\s]+(?<yc>\d{4})"
    r"|(?:[A-Za-z]{3,9},\s*)?(?<nd>[A-Za-z]{3,9})\.?\s+(?<dd>\d{1,2}),?\s+(?<yd>\d{4}))" + _CLOCK + "$"
)
#: What a text is taken apart into; of groups that stand together at most one is not empty.  (M) and (D) are the
#: numbers that the order of day and month makes month and day.
_FIELDS = {
    "year": "${ya}${yb}${yc}${yd}", "month": "${ma}(M)", "day": "${da}${dc}${dd}(D)",
    "name": "${nc}${nd}", "hour": "${hh}", "minute": "${mi}", "sec": "${ss}", "fraction": "${fr}", "half": "${ap}",
    "zone": "${zo}",
}
_MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october",
           "november", "december")
_INTERVALS = "zone string, month int, spans array<struct<since bigint, until bigint, offset bigint>>, abbr map<string, bigint>"


def _changes(name: str, years: tuple[int, int]) -> tuple[list[tuple[int, int]], dict[str, int]]:
    """(UTC second, offset from then on) of a zone in order, the first from the beginning; offset by abbreviation."""
    zone, epoch = ZoneInfo(name), datetime(1970, 1, 1, tzinfo=timezone.utc)
    at = lambda s: (epoch + timedelta(seconds=s)).astimezone(zone)
    offset = lambda s: int(at(s).utcoffset().total_seconds())
    begin, end = (int((datetime(y, 1, 1, tzinfo=timezone.utc) - epoch).total_seconds()) for y in (years[0], years[1] + 1))
    out, abbr = [(begin, offset(begin))], {at(begin).tzname(): offset(begin)}
    for day in range(begin, end, 86_400):
        if offset(day + 86_400) != out[-1][1]:
            low, high = day, day + 86_400
            while high - low > 1:
                middle = (low + high) // 2
                low, high = (middle, high) if offset(middle) == out[-1][1] else (low, middle)
            out.append((high, offset(high)))
            abbr[at(high).tzname()] = offset(high)
    return out, abbr


def _exploded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    first_month, far = YEARS[0] * 12, 1 << 60
    for frame in frames:
        for name in frame["zone"]:
            try:
                changes, abbr = _changes(name, YEARS)
            except (ZoneInfoNotFoundError, ValueError, OSError):
                continue
            spans = []
            for i, (since, offset) in enumerate(changes):
                until = changes[i + 1][0] + offset if i + 1 < len(changes) else far
                spans.append(((since + offset) if i else -far, until, offset))
            months = range(first_month, (YEARS[1] + 1) * 12)
            starts = [int((datetime(m // 12, m % 12 + 1, 1, tzinfo=timezone.utc)).timestamp()) for m in months] + [far]
            # two days of margin keep the interval before a skipped hour at the turn of a month
            held = [[s for s in spans if s[1] > starts[i] - 172_800 and s[0] < starts[i + 1] + 172_800] for i in range(len(months))]
            held[0] = [s for s in spans if s[0] < starts[1]]
            held[-1] = [s for s in spans if s[1] > starts[-2] - 172_800]
            yield pd.DataFrame({
                "zone": name, "month": list(months),
                "spans": [[{"since": a * 10**6 if abs(a) < far else a, "until": b * 10**6 if abs(b) < far else b,
                            "offset": o * 10**6} for a, b, o in h] for h in held],
                "abbr": [{k: v * 10**6 for k, v in abbr.items()}] * len(months),
            })


def offset_intervals(zones: DataFrame, column: str = "tz_name") -> DataFrame:
    """The local offset intervals of each named zone by local month: (zone, month, spans, abbr), in microseconds.

    ``month`` counts from year 0; names that are null or no IANA zone give no row.
    """
    require_columns(zones, column)
    return zones.select(F.col(column).alias("zone")).where("zone is not null").distinct().mapInPandas(_exploded, _INTERVALS)


def _day(year: Column, month: Column, day: Column) -> Column:
    """Days since 1970-01-01; null for a day that doesn't exist."""
    zero = F.lit(0)
    return F.unix_date(F.try_make_timestamp_ntz(years=year, months=month, days=day, hours=zero, mins=zero, secs=zero)
                       .cast("date")).cast("long")


def _month(name: Column) -> Column:
    """1 to 12 of an English month name or its first letters in lower case, else null."""
    place = F.instr(F.lit("".join(m[:3] for m in _MONTHS)), F.substring(name, 1, 3))
    return F.when(name.isin(*_MONTHS, *[m[:3] for m in _MONTHS], "sept"), ((place + 2) / 3).cast("int"))


def _count(digits: Column) -> Column:
    """Microseconds of a count since 1970 in seconds, milliseconds or microseconds within COUNT_YEARS, else null."""
    since, until = (int(datetime(y, 1, 1, tzinfo=timezone.utc).timestamp()) * 10**6 for y in (COUNT_YEARS[0], COUNT_YEARS[1] + 1))
    n = digits.cast("bigint")
    return F.coalesce(*[F.when((n >= since // unit) & (n < until // unit), n * F.lit(unit)) for unit in (1_000_000, 1000, 1)])


def _spelled_out(text: Column) -> Column:
    """Calendar digits with the year first as yyyy-MM-dd HH:mm:ss, any other text as it is."""
    calendar = text.rlike("^[0-9]{8}([0-9]{2}){0,3}$") & F.substring(text, 1, 4).between(*map(str, COUNT_YEARS))
    return F.when(calendar, F.regexp_replace(F.rpad(text, 14, "0"), r"^(\d{4})(\d\d)(\d\d)(\d\d)(\d\d)(\d\d)$", "$1-$2-$3 $4:$5:$6")).otherwise(text)


def _taken(between: str, fields: Sequence[str]) -> Column:
    """\x01 and the fields of _ts, by the order in _to; texts that don't fit stay as they are."""
    form = "\x01" + between.join(_FIELDS[f] for f in fields)
    by = lambda month, day: F.lit(form.replace("(M)", month).replace("(D)", day))
    return F.regexp_replace("_ts", F.lit(_PATTERN), F.when(F.col("_to") == "dmy", by("${n2}", "${n1}"))
                            .when(F.col("_to").isin("mdy", "ymd"), by("${n1}", "${n2}")).otherwise(by("", "")))


def read_days(df: DataFrame, text: str, day_order: Column, out: str = "day") -> DataFrame:
    """The table with the calendar day as written, as ``read_times`` gives it, in days since 1970.

    It needs no zone and no join.  Null texts and texts that name no day that exists give null; a numeric day
    and month behind which the year stands need a known order.  The result replaces a column of its name;
    columns starting with ``_t`` are reserved.
    """
    require_columns(df, text)
    given = [c for c in df.columns if c != out]
    df = df.withColumns({"_tr": strip(F.col(text)), "_to": day_order})
    df = df.withColumns({"_ts": _spelled_out(F.col("_tr")), "_tn": F.when(F.col("_tr").rlike("^[0-9]{8,17}$"), _count(F.col("_tr")))})
    df = df.withColumn("_tx", _taken("-", ("year", "month", "day", "name")))
    x = F.substring(F.col("_tx"), F.lit(2), F.length("_tx"))
    df = df.withColumn("_tx", F.when(F.col("_tx").startswith("\x01") & ~F.col("_ts").contains("\x01"), x))
    name = F.lower(F.substring_index("_tx", "-", -1))
    written = F.when(F.col("_tx").endswith("-"), F.substring_index("_tx", "-", 3)).otherwise(F.concat_ws(
        "-", F.substring_index("_tx", "-", 1), _month(name).cast("string"), F.substring_index(F.substring_index("_tx", "-", -2), "-", 1)))
    df = df.withColumn("_tw", written)
    counted = ((F.col("_tn") - F.pmod(F.col("_tn"), F.lit(DAY_MICROS))) / F.lit(DAY_MICROS)).cast("long")
    return df.withColumn(out, F.coalesce(counted, F.unix_date(F.col("_tw").try_cast("date")).cast("long"))).select(*given, out)


def read_times(df: DataFrame, text: str, day_order: Column, zone: Column, intervals: DataFrame, out: str = "") -> DataFrame:
    """The table with columns ``day`` (days since 1970), ``utc`` (microseconds) and ``how``, named with ``out``.

    ``day`` is the calendar day as written, for a count since 1970 the UTC day; null where the text names
    no day that exists.  ``utc`` is also null where the clock is impossible or no zone is known.  ``how``
    says where the offset came from: ``count``, ``written``, ``abbreviation``, ``zone``, or for a time that
    a clock change repeats or skips ``ambiguous`` or ``nonexistent`` (both read with the offset before the
    change); ``unreadable`` or ``no_zone`` without an instant.  A null text gives nulls in all three.

    Digits finer than microseconds are dropped.  A date without a clock means 00:00.  An abbreviation is
    looked up among those of the row's zone (UTC and GMT are always known).  Texts of any length and
    repeated rows are fine; an empty table gives an empty one; columns starting with ``_t`` or ``_i``
    are reserved, and the three results replace columns of their names.
    """
    require_columns(df, text)
    given = [c for c in df.columns if c not in (f"{out}day", f"{out}utc", f"{out}how")]
    get = lambda f: F.get(F.col("_tp"), F.lit(list(_FIELDS).index(f) + 1))
    # these fields are digits or empty by the pattern; try_cast would build an exception for every empty one
    num = lambda f: F.nullif(get(f), F.lit("")).cast("int")
    df = df.withColumns({"_to": day_order, "_tz": zone, "_tr": strip(F.col(text))})
    df = df.withColumns({"_ts": _spelled_out(F.col("_tr")), "_tn": F.when(F.col("_tr").rlike("^[0-9]{8,17}$"), _count(F.col("_tr")))})
    df = df.withColumn("_tx", _taken("\x01", list(_FIELDS)))
    fits_pattern = F.col("_tx").startswith("\x01") & ~F.col("_ts").contains("\x01")
    df = df.withColumn("_tp", F.when(fits_pattern, F.split("_tx", "\x01")))

    # a day and a clock in words and separators
    name = F.lower(get("name"))
    df = df.withColumns({
        "_tmonth": F.coalesce(num("month"), _month(name)), "_tdate": num("day"),
        "_thour": num("hour"), "_thalf": F.lower(get("half")), "_tminute": F.coalesce(num("minute"), F.lit(0)),
        "_tsec": F.coalesce(num("sec"), F.lit(0)),
        "_tfraction": F.coalesce(F.rpad(F.substring(get("fraction"), 1, 6), 6, "0").cast("long"), F.lit(0)),
        "_tzone": F.nullif(F.upper(get("zone")), F.lit("")),
    })
    hour = F.col("_thour")
    hour = (F.when(hour.isNull(), 0).when(F.col("_thalf") == "", F.when(hour < 24, hour))
            .when((hour >= 1) & (hour <= 12), hour % 12 + F.when(F.col("_thalf") == "pm", 12).otherwise(0)))

    df = df.withColumn("_tday", _day(num("year"), F.col("_tmonth"), F.col("_tdate")))
    df = df.withColumn("_thour", hour).withColumn("_tclock", F.when(
        (F.col("_thour") < 24) & (F.col("_tminute") < 60) & (F.col("_tsec") < 60),
        (F.col("_thour") * 3600 + F.col("_tminute") * 60 + F.col("_tsec")).cast("long") * 1_000_000 + F.col("_tfraction")))
    df = df.withColumn("_tl", F.col("_tday") * F.lit(DAY_MICROS) + F.col("_tclock"))
    date = F.date_from_unix_date(F.col("_tday").cast("int"))
    df = df.withColumn("_tm", F.greatest(F.lit(YEARS[0] * 12), F.least(F.lit(YEARS[1] * 12 + 11),
                                                                     F.year(date) * 12 + F.month(date) - 1)))
    spans = F.broadcast(intervals.select(F.col("zone").alias("_iz"), F.col("month").alias("_im"),
                                         F.col("spans").alias("_tspans"), F.col("abbr").alias("_tabbr")))
    df = df.join(spans, (F.col("_tz") == F.col("_iz")) & (F.col("_tm") == F.col("_im")), "left")

    local, zo = F.col("_tl"), F.col("_tzone")
    offset_digits = F.rpad(F.regexp_replace(F.substring(zo, 2, 5), ":", ""), 4, "0")
    written = F.when(zo == "Z", F.lit(0)).when(zo.startswith("+") | zo.startswith("-"), (
        F.substring(offset_digits, 1, 2).cast("long") * 3600 + F.substring(offset_digits, 3, 2).cast("long") * 60
    ) * F.when(zo.startswith("-"), -1_000_000).otherwise(1_000_000))
    df = df.withColumns({
        "_tw": written,
        "_ta": F.coalesce(F.try_element_at("_tabbr", zo), F.when(zo.isin("UTC", "GMT"), F.lit(0))),
        "_th": F.when(zo.isNull(), F.filter("_tspans", lambda x: (x["since"] <= local) & (local < x["until"]))),
        "_tb": F.when(zo.isNull(), F.try_element_at(F.filter("_tspans", lambda x: x["until"] <= local), F.lit(-1))),
    })
    held, written, by_name = F.size("_th"), F.col("_tw"), F.col("_ta")
    by_zone = F.when(held > 0, F.get("_th", F.lit(0))["offset"]).when(held == 0, F.col("_tb")["offset"])
    offset = F.when(zo.isNull(), by_zone).otherwise(F.coalesce(written, by_name))
    readable = local.isNotNull()
    utc = F.coalesce(F.col("_tn"), local - offset)
    how = (F.when(F.col("_ts").isNull(), None).when(F.col("_tn").isNotNull(), "count").when(~readable, "unreadable")
           .when(written.isNotNull(), "written")
           .when(zo.isNotNull(), F.when(by_name.isNotNull(), "abbreviation").otherwise("unreadable"))
           .when(held > 1, "ambiguous").when(held == 1, "zone").when(held == 0, "nonexistent").otherwise("no_zone"))
    result = {f"{out}day": F.when(F.col("_tn").isNotNull(), ((F.col("_tn") - F.pmod(F.col("_tn"), F.lit(DAY_MICROS))) / F.lit(DAY_MICROS)).cast("long"))
              .otherwise(F.col("_tday")), f"{out}utc": utc, f"{out}how": how}
    return df.withColumns(result).select(*given, *result)

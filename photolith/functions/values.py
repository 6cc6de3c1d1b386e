"""Numbers, coordinates, hashes and JSON details."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_MATCH = 999
DOWNLOAD_MBPS = 25.0
#: The reach of an inferred location, in minutes: its confidence falls to nothing there, whatever the search window.
CONFIDENCE_MINUTES = 360
HIGH_MINUTES = 60


def positive_int(value: Column) -> Column:
    number = value.try_cast("int")
    return F.when(number > 0, number)


def coordinates(latitude: Column, longitude: Column) -> tuple[Column, Column]:
    """Both, or neither: out of range, one missing, or exactly (0, 0) is unknown."""
    lat, lon = latitude.try_cast("double"), longitude.try_cast("double")
    fine = F.coalesce(lat.between(-90.0, 90.0) & lon.between(-180.0, 180.0) & ~((lat == 0.0) & (lon == 0.0)), F.lit(False))
    return F.when(fine, lat), F.when(fine, lon)


def pixels(width: Column, height: Column) -> Column:
    return F.when((width > 0) & (height > 0), width.cast("bigint") * height)


def strictly_smaller(width, height, size, master_width, master_height, master_size) -> Column:
    """Smaller in both dimensions and in bytes; anything unknown: no."""
    known = (width != 0) & (height != 0) & (master_width != 0) & (master_height != 0)
    return F.coalesce(known & (width < master_width) & (height < master_height) & (size < master_size), F.lit(False))


def hash_words(value: Column) -> Column:
    """A hexadecimal hash as an array: the number of its digits, then its 64-bit words; null if it isn't one."""
    starts = F.sequence(F.lit(0), F.floor((F.length(value) - 1) / 16).cast("int"))
    words = F.transform(starts, lambda i: F.conv(F.substring(value, i * 16 + 1, F.lit(16)), 16, -10).cast("bigint"))
    return F.when(value.rlike("^[0-9A-Fa-f]+$"), F.concat(F.array(F.length(value).cast("bigint")), words))


def hamming(left: Column, right: Column) -> Column:
    """Bits that differ between two hexadecimal hashes of equal length; NO_MATCH where they can't be compared."""
    x, y = hash_words(left), hash_words(right)
    total = F.aggregate(F.zip_with(x, y, lambda a, b: F.bit_count(a.bitwiseXOR(b)).cast("int")), F.lit(0), lambda acc, n: acc + n)
    return F.when(F.coalesce(x[0] == y[0], F.lit(False)), total).otherwise(NO_MATCH)


def gap_seconds(a: Column, b: Column) -> Column:
    """The time between two wall-clock times in seconds, exact to the microsecond and whatever the session's time zone."""
    gap = F.abs(a - b)
    part = lambda name: F.extract(F.lit(name), gap).cast("double")
    return part("DAY") * 86400 + part("HOUR") * 3600 + part("MINUTE") * 60 + part("SECOND")


def confidence(gap_s: Column) -> Column:
    """1 at no gap, falling to 0 at CONFIDENCE_MINUTES, to three decimals, half to even."""
    return F.when(gap_s >= CONFIDENCE_MINUTES * 60, F.lit(0.0)).otherwise(F.bround(1.0 - gap_s / (CONFIDENCE_MINUTES * 60.0), 3))


def band(gap_s: Column) -> Column:
    return F.when(gap_s <= HIGH_MINUTES * 60, "high").otherwise("low")


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where there is nothing."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def download_hours(size: Column) -> Column:
    return size * 8 / F.lit(DOWNLOAD_MBPS * 1_000_000) / F.lit(3600.0)


def detail_map(detail: Column) -> Column:
    """A JSON object as a map of texts; anything else, a text that goes on after its object included: empty.

    Spark's parser stops at the end of a value, whatever follows. So the text is put inside an object before a member that holds a
    hash of it: that member is only read if the text is one value, as it can't hold its own hash.
    """
    mark = F.xxhash64(detail)
    wrapped = F.concat(F.lit('{"detail":'), detail, F.lit(',"mark":'), mark.cast("string"), F.lit("}"))
    said = F.from_json(wrapped, "detail map<string,string>, mark bigint", {"allowSingleQuotes": "false"})
    return F.coalesce(F.when(said["mark"] == mark, said["detail"]), F.create_map().cast("map<string,string>"))


def format_size(size: Column) -> Column:
    """Bytes for reading, in steps of 1024 with one decimal, up to TB."""
    value, out = size.cast("double"), None
    for power, unit in ((1, "KB"), (2, "MB"), (3, "GB")):
        shown = F.concat(F.format_number(value / 1024.0**power, 1), F.lit(f" {unit}"))
        limit = F.abs(value) < 1024.0 ** (power + 1)
        out = F.when(F.abs(value) < 1024.0, F.concat(F.format_number(value, 0), F.lit(" B"))).when(limit, shown) if out is None else out.when(limit, shown)
    return out.otherwise(F.concat(F.format_number(value / 1024.0**4, 1), F.lit(" TB")))


def format_duration(hours: Column) -> Column:
    """A number of hours for reading."""
    fixed = lambda c, places: F.regexp_replace(F.format_number(c, places), ",", "")
    return (
        F.when(hours * 60 < 1, "under a minute")
        .when(hours < 1, F.concat(fixed(hours * 60, 0), F.lit(" minutes")))
        .when(hours < 24, F.concat(fixed(hours, 1), F.lit(" hours")))
        .otherwise(F.concat(fixed(hours / 24, 1), F.lit(" days")))
    )


def plural(count: Column, singular: str, ending: str = "s") -> Column:
    """`3 items`, `1 item`."""
    return F.concat(F.format_number(count, 0), F.lit(f" {singular}"), F.when(count == 1, "").otherwise(ending))

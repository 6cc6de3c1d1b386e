"""Capture times: wall-clock timestamps without a zone, never guessed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from photolith.functions import text

_STAMP = r"^(\d{4})[:\-](\d{2})[:\-](\d{2})[ T](\d{2}):(\d{2}):(\d{2})"
_ZONE = r"(?:[Zz]|[+-]\d{2}(?::?\d{2}(?::?\d{2}(?:\.\d+)?)?)?)$"
_ISO = r"^\d{4}-\d{2}-\d{2}(?:.\d{2}(?::\d{2}(?::\d{2}(?:[.,]\d+)?)?)?)?$"


def parse_embedded(value: Column) -> Column:
    """`YYYY:MM:DD HH:MM:SS` (or with hyphens, T) at the start of the text; zeros and impossible times are unknown."""
    stripped = text.strip(value)
    # Where the form fits, every part has its place; one match, not one for each part.
    part = lambda at, n: F.substring(stripped, at, n).try_cast("int")
    year, month, day, hour, minute, second = part(1, 4), *(part(at, 2) for at in (6, 9, 12, 15, 18))
    return F.when(stripped.rlike(_STAMP) & (year > 0) & (second < 60), F.try_make_timestamp_ntz(year, month, day, hour, minute, second))


def parse_iso(value: Column) -> Column:
    """An ISO 8601 date or time; an offset is dropped, not converted. Anything else is null."""
    stripped = text.strip(value)
    basic = F.regexp_replace(stripped, r"^(\d{4})(\d{2})(\d{2})(?:T(\d{2})(\d{2})(\d{2})?)?", "$1-$2-$3T$4:$5:$6")
    dashed = F.regexp_replace(F.regexp_replace(basic, r"T::$", ""), r":$", "")
    spelled = F.when(stripped.rlike(r"^\d{8}(?:T\d{4}|$)"), dashed).otherwise(stripped)
    bare = F.when(F.length(spelled) > 10, F.regexp_replace(spelled, _ZONE, "")).otherwise(spelled)
    spaced = F.concat(F.substring(bare, 1, 10), F.when(F.length(bare) > 10, F.concat(F.lit("T"), F.regexp_replace(F.substring(bare, 12, 40), ",", "."))).otherwise(""))
    spaced = F.when(spaced.rlike(r"T\d{2}$"), F.concat(spaced, F.lit(":00"))).otherwise(spaced)
    return F.when(bare.rlike(_ISO), spaced.try_cast("timestamp_ntz"))


def parse_sidecar(value: Column) -> Column:
    """ISO 8601, or else the embedded form."""
    return F.coalesce(parse_iso(value), parse_embedded(value))


def known_date(value: Column) -> Column:
    """A library's date; its placeholder of 1970 and before is unknown."""
    return F.when(F.year(value) > 1970, value)


def month_directory(taken_at: Column) -> Column:
    """`YYYY/MM`, or `undated`."""
    return F.coalesce(F.date_format(taken_at, "yyyy/MM"), F.lit("undated"))


def taken_at(sidecar: Column, *embedded: Column) -> tuple[Column, Column]:
    """The capture time and where it's from: the sidecar's date first, then the embedded tags in order."""
    own = parse_sidecar(sidecar)
    found = F.coalesce(*[parse_embedded(c) for c in embedded]) if embedded else F.lit(None).cast("timestamp_ntz")
    return F.coalesce(own, found), F.when(own.isNotNull(), "sidecar").when(found.isNotNull(), "exif").otherwise("unknown")

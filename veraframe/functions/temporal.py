"""Dates, datetimes and times as expressions: ISO text, SAS numbers and Spark's own types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Days and seconds count from here.
EPOCH = "1960-01-01"
_WS = " \t\r\n"
_M, _D = "(0[1-9]|1[0-2])", "(0[1-9]|[12][0-9]|3[01])"
_ZONE = r"(Z|[+-][0-9]{2}:?[0-9]{2})?"
_CLOCK = r"(-|[01][0-9]|2[0-3])(:(-|[0-5][0-9])(:(-|[0-5][0-9](\.[0-9]+)?))?)?"
#: A full date, or one cut short on the right, or one with hyphens for unknown parts.
_FULL = rf"[0-9]{{4}}-{_M}-{_D}"
_CUT = rf"[0-9]{{4}}(-{_M})?"
_HOLES = rf"[0-9]{{4}}---?{_D}|--{_M}-{_D}"


def trimmed(c: Column) -> Column:
    """Without the white space at both ends that is space, tab, return or line feed."""
    return F.btrim(c, F.lit(_WS))


def is_blank(c: Column) -> Column:
    return c.isNull() | (trimmed(c.cast("string")) == "")


def _calendar(day: Column) -> Column:
    """Whether a text of the form of a full date is a day that exists."""
    return F.try_to_date(day, "yyyy-MM-dd").isNotNull()


def iso_ok(c: Column, kind: str) -> Column:
    """Whether text is a valid value of a temporal type: complete, cut short, or with placeholders. Null and blank are."""
    t = trimmed(c)
    full = t.rlike(rf"\A{_FULL}\z") & _calendar(t)
    date = full | t.rlike(rf"\A({_CUT}|{_HOLES})\z")
    clock = rf"{_CLOCK}{_ZONE}"
    if kind == "date":
        ok = date
    elif kind == "time":
        ok = t.rlike(rf"\AT?{clock}\z") & ~t.rlike(rf"\AT?-{_ZONE}\z")
    else:
        day = F.substring_index(t, "T", 1)
        dated = (t.rlike(rf"\A{_FULL}T") & _calendar(day)) | t.rlike(rf"\A({_HOLES})T")
        ok = date | (dated & t.rlike(rf"T{clock}\z") & ~t.rlike(rf"T-{_ZONE}\z"))
    return F.coalesce(is_blank(c) | ok, F.lit(False))


def date_from_days(n: Column) -> Column:
    return F.date_add(F.lit(EPOCH).cast("date"), F.floor(n).cast("int"))


def _micros(s: Column) -> Column:
    """Whole microseconds of a number of seconds; whole seconds apart, as their product in double precision is exact up to 285 years only."""
    whole = s.cast("long")
    return whole * 1_000_000 + F.round((s - whole) * 1_000_000).cast("long")


def datetime_from_seconds(s: Column) -> Column:
    """An instant from seconds since the epoch, to the microsecond."""
    return _ntz(_micros(s))


def _ntz(micros: Column) -> Column:
    return F.lit(f"{EPOCH} 00:00:00").cast("timestamp_ntz") + interval(micros)


def interval(micros: Column) -> Column:
    """A day-time interval from whole microseconds, of either sign and any size."""
    day = F.lit(86_400_000_000).cast("long")
    days = F.floor(micros / day)
    rest = micros - days * day
    return F.make_dt_interval(days.cast("int"), F.lit(0), F.lit(0), (rest / F.lit(1_000_000)).cast("decimal(18,6)"))


def time_from_seconds(s: Column) -> Column:
    return interval(_micros(s))


def date_from_iso(c: Column) -> Column:
    """A full ISO date; null for anything else."""
    t = trimmed(c)
    return F.when(t.rlike(rf"\A{_FULL}\z"), F.try_to_date(t, "yyyy-MM-dd"))


_STAMP = rf"\A({_FULL})T([0-9]{{2}}):([0-9]{{2}}):([0-9]{{2}})(\.[0-9]+)?(Z|[+-][0-9]{{2}}:?[0-9]{{2}})?\z"


def _group(t: Column, pattern: str, i: int) -> Column:
    return F.nullif(F.regexp_extract(t, pattern, i), F.lit(""))


def datetime_from_iso(c: Column) -> Column:
    """A full ISO datetime, shifted to UTC where it names a zone; null for anything else."""
    t = trimmed(c)
    zone = F.coalesce(_group(t, _STAMP, 8), F.lit("Z"))
    sign = F.when(zone.startswith("-"), -1).otherwise(1)
    hhmm = F.regexp_replace(zone, "[^0-9]", "")
    shift = F.when(zone == "Z", 0).otherwise(sign * (F.substring(hhmm, 1, 2).try_cast("int") * 60 + F.substring(hhmm, 3, 2).try_cast("int")) * 60)
    day = F.try_to_date(_group(t, _STAMP, 1), "yyyy-MM-dd")
    h, m, s = (_group(t, _STAMP, i).try_cast("int") for i in (4, 5, 6))
    fraction = F.coalesce(F.concat(F.lit("0"), _group(t, _STAMP, 7)).try_cast("double"), F.lit(0.0))
    seconds = F.datediff(day, F.lit(EPOCH).cast("date")).cast("long") * 86400 + h * 3600 + m * 60 + s - shift
    ok = t.rlike(_STAMP) & (h < 24) & (m < 60) & (s < 60)
    return F.when(ok, _ntz(seconds * 1_000_000 + F.round(fraction * 1_000_000).cast("long")))


_HMS = r"\A(-)?([0-9]+):([0-5][0-9]):([0-5][0-9])(\.[0-9]+)?\z"


def time_from_iso(c: Column) -> Column:
    """Hours, minutes and seconds; hours may be negative or more than 24; null for anything else."""
    t = trimmed(c)
    h, m, s = (_group(t, _HMS, i).try_cast("long") for i in (2, 3, 4))
    fraction = F.coalesce(F.concat(F.lit("0"), _group(t, _HMS, 5)).try_cast("double"), F.lit(0.0))
    micros = (h * 3600 + m * 60 + s) * 1_000_000 + F.round(fraction * 1_000_000).cast("long")
    return F.when(t.rlike(_HMS), interval(F.when(t.startswith("-"), -micros).otherwise(micros)))


def realized(c: Column, kind: str, text: bool) -> Column:
    """A temporal value from its stored form: ISO text, or days or seconds since the epoch."""
    if text:
        return {"date": date_from_iso, "datetime": datetime_from_iso, "time": time_from_iso}[kind](c)
    return {"date": date_from_days, "datetime": datetime_from_seconds, "time": time_from_seconds}[kind](c)


def micros_of(c: Column) -> Column:
    """Whole microseconds in an interval, with their sign."""
    zero = F.lit(f"{EPOCH} 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", zero, zero + c)


def deflated(c: Column, kind: str) -> Column:
    """Days (for a date) or seconds since the epoch."""
    if kind == "date":
        return F.datediff(c, F.lit(EPOCH).cast("date")).cast("double")
    if kind == "datetime":
        return F.timestamp_diff("MICROSECOND", F.lit(f"{EPOCH} 00:00:00").cast("timestamp_ntz"), c) / F.lit(1_000_000.0)
    return micros_of(c) / F.lit(1_000_000.0)


def time_text(c: Column) -> Column:
    """``[-]HH:MM:SS[.ffffff]`` of an interval, without trailing zeros; hours may exceed 24."""
    micros = micros_of(c)
    s = F.call_function("div", F.abs(micros), F.lit(1_000_000))
    clock = F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.pmod(F.floor(s / 60), F.lit(60)), F.pmod(s, F.lit(60)))
    rest = F.pmod(F.abs(micros), F.lit(1_000_000))
    fraction = F.when(rest > 0, F.rtrim(F.format_string(".%06d", rest), F.lit("0"))).otherwise("")
    return F.when(c.isNotNull(), F.concat(F.when(micros < 0, "-").otherwise(""), clock, fraction))


def iso_text(c: Column, kind: str) -> Column:
    """ISO text of a value of Spark's type; datetimes to the second."""
    if kind == "date":
        return F.date_format(c, "yyyy-MM-dd")
    if kind == "datetime":
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    return time_text(c)

"""Timestamps of log formats as TIMESTAMP_NTZ.

A text is cut into its parts by one regex (``*_parts``), and the parts are put together in ISO form and cast with
TRY semantics (``*_ts``). A bad time gives null, and the session time zone never plays a part. The two steps are
apart so that a parser can compute the parts once.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from faultline.functions.text import captured, group_columns, lookup

# English month abbreviations.
MONTHS = {
    "jan": "01", "feb": "02", "mar": "03", "apr": "04", "may": "05", "jun": "06",
    "jul": "07", "aug": "08", "sep": "09", "oct": "10", "nov": "11", "dec": "12",
}
_HMS = r"(\d{1,2}:\d{1,2}:\d{1,2})"
_FRACTION = r"(\d{1,2}:\d{1,2}:\d{1,2}(?:\.\d{1,6})?)"


def _iso(year: Column, month_name: Column, day: Column, clock: Column) -> Column:
    month = lookup(MONTHS, F.lower(month_name))
    return F.concat(year, F.lit("-"), month, F.lit("-"), day, F.lit(" "), clock).try_cast("timestamp_ntz")


def access_parts(text: Column) -> Column:
    """22/Jun/2025:10:00:00 +0000 -- the zone is not used."""
    return captured(text, rf"(\d{{1,2}})/([A-Za-z]{{3}})/(\d{{4}}):{_HMS}(?:\s|$)", 4)


def access_ts(parts: Column) -> Column:
    day, month, year, clock = group_columns(parts, 4)
    return _iso(year, month, day, clock)


def plain_ts(text: Column) -> Column:
    """2025-06-22 10:00:00, optionally with a fraction of up to six digits."""
    whole = F.trim(text).rlike(rf"^\d{{4}}-\d{{1,2}}-\d{{1,2}}\s+{_FRACTION}$")
    return F.when(whole, F.regexp_replace(F.trim(text), r"\s+", " ").try_cast("timestamp_ntz"))


def error_parts(text: Column) -> Column:
    """Sat Jun 22 10:00:00[.123456] 2025"""
    return captured(text, rf"\s*[A-Za-z]{{3}}\s+([A-Za-z]{{3}})\s+(\d{{1,2}})\s+{_FRACTION}\s+(\d{{4}})\s*$", 4)


def error_ts(parts: Column) -> Column:
    month, day, clock, year = group_columns(parts, 4)
    return _iso(year, month, day, clock)


def syslog_parts(text: Column) -> Column:
    """Jun 22 10:00:00"""
    return captured(text, rf"\s*([A-Za-z]{{3}})\s+(\d{{1,2}})\s+{_HMS}\s*$", 3)


def syslog_ts(parts: Column, now: Column) -> Column:
    """The year is that of ``now``."""
    month, day, clock = group_columns(parts, 3)
    return _iso(F.year(now).cast("string"), month, day, clock)


def short_parts(text: Column) -> Column:
    """250622 9:00:00"""
    return captured(text, rf"\s*(\d{{2}})(\d{{2}})(\d{{2}})\s+{_HMS}\s*$", 4)


def short_ts(parts: Column) -> Column:
    year, month, day, clock = group_columns(parts, 4)
    # two-digit years follow the usual pivot: 69..99 are 19xx
    century = F.when(year >= "69", F.lit("19")).otherwise(F.lit("20"))
    return F.concat(century, year, F.lit("-"), month, F.lit("-"), day, F.lit(" "), clock).try_cast("timestamp_ntz")


def iso_ts(text: Column) -> Column:
    """2025-06-22T10:00:00[.123456][Z] or with a blank for the T."""
    whole = text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?Z?$")
    return F.when(whole, F.rtrim(text, F.lit("Z")).try_cast("timestamp_ntz"))


def epoch_us(ts: Column) -> Column:
    """Microseconds since 1970 of a TIMESTAMP_NTZ.

    From the parts of the clock time, as timestamp_diff would read it in the session's zone; all in numbers of one word.
    """
    day, second = F.unix_date(F.to_date(ts)).cast("long"), F.date_part(F.lit("SECOND"), ts)
    minutes = (day * 24 + F.hour(ts)) * 60 + F.minute(ts)
    return minutes * 60_000_000 + (second * F.lit(1_000_000).cast("decimal(7,0)")).cast("long")


def from_epoch_us(us: Column) -> Column:
    return F.timestamp_add("MICROSECOND", us, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def clock(value) -> Column:
    """A literal TIMESTAMP_NTZ from text or a naive datetime (F.lit of a datetime would read it in a zone)."""
    return F.lit(str(value)).cast("timestamp_ntz")


def naive(instant: Column) -> Column:
    """The UTC clock time of a TIMESTAMP as TIMESTAMP_NTZ."""
    return from_epoch_us(F.unix_micros(instant))


def cell_of(us: Column, width_us: int) -> Column:
    """Number of the ``width_us`` wide cell (counted from 1970) that holds ``us``; exact integer division."""
    return F.call_function("div", us - F.pmod(us, F.lit(width_us)), F.lit(width_us))


def age_label(ts: Column, as_of: Column) -> Column:
    """Ns ago / Nm ago / Nh ago / Nd ago."""
    s = cell_of(epoch_us(as_of) - epoch_us(ts), 1_000_000)

    def label(width: int, unit: str) -> Column:
        return F.concat(cell_of(s, width).cast("string"), F.lit(f"{unit} ago"))

    return (F.when(ts.isNull(), F.lit("N/A")).when(s < 60, label(1, "s")).when(s < 3600, label(60, "m"))
            .when(s < 86400, label(3600, "h")).otherwise(label(86400, "d")))

"""Date recognition as column expressions; results are ISO text or empty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean, col, text

#: One whole date; an ISO date-time's date; a date inside text; separated and compact forms.  Fixed values.
WHOLE = r"^(20[0-9]{2})[\s]*[-./년][\s]*([0-9]{1,2})[\s]*[-./월][\s]*([0-9]{1,2})[\s]*일?\.?$"
ISO_TIME = r"^([0-9]{4}-[0-9]{2}-[0-9]{2})[T ]"
INSIDE = r"(20[0-9]{2})[^0-9]{0,2}([0-9]{1,2})[^0-9]{0,2}([0-9]{1,2})"
SEPARATED = r"(20[0-9]{2})[.\-/]([0-9]{1,2})[.\-/]([0-9]{1,2})"
COMPACT = r"(20[0-9]{2})([0-9]{2})([0-9]{2})"
LEADING = r"^[\s]*(20[0-9]{2})[.\-/]?([0-9]{1,2})[.\-/]?([0-9]{1,2})"
DAY_MS = 86_400_000


def _iso(c: Column, pattern: str) -> Column:
    """The first match's parts as yyyy-mm-dd, padded; empty without a match."""
    y, m, d = (F.regexp_extract(c, pattern, i) for i in (1, 2, 3))
    return F.when(y != "", F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))).otherwise("")


def whole_date(c: Column | str) -> Column:
    """The value if all of it is one real date, or an ISO date-time's date part."""
    s = clean(c)
    head = F.regexp_extract(s, ISO_TIME, 1)
    s = F.when(head != "", head).otherwise(s)
    iso = _iso(s, WHOLE)
    return F.when(F.try_to_date(iso, "yyyy-MM-dd").isNotNull(), iso).otherwise("")


def date_inside(c: Column | str) -> Column:
    """The first date within text; its month and day are range-checked, not calendar-checked."""
    iso = _iso(text(c), INSIDE)
    fine = F.substring(iso, 6, 2).between("01", "12") & F.substring(iso, 9, 2).between("01", "31")
    return F.when((iso != "") & fine, iso).otherwise("")


def row_date(c: Column | str) -> Column:
    """The first separated date, else the first compact one; no range check."""
    a, b = _iso(text(c), SEPARATED), _iso(text(c), COMPACT)
    return F.when(a != "", a).otherwise(b)


def leads_with_date(c: Column | str) -> Column:
    return text(c).rlike(LEADING)


def strip_label(c: Column | str, labels: list[str]) -> Column:
    """Without a leading label and colon; the longest label is tried first."""
    alt = "|".join(sorted(labels, key=lambda x: (-len(x), x)))
    return F.regexp_replace(text(c), rf"^(?:{alt})[\s]*[:：]?[\s]*", "")


def epoch_ms_iso(c: Column | str) -> Column:
    """UTC whatever the session's zone; a year beyond 9999 has all its digits and no plus sign."""
    c = col(c)
    ms = F.pmod(c, F.lit(DAY_MS))
    day = F.date_from_unix_date(_div(c - ms, DAY_MS).cast("int"))
    year = F.year(day)
    digits = F.when(year.between(0, 9999), _pad(year, 4)).otherwise(year.cast("string"))
    h, m, s = _div(ms, 3_600_000), _div(ms, 60_000) % 60, _div(ms, 1000) % 60
    date = [digits, F.lit("-"), _pad(F.month(day)), F.lit("-"), _pad(F.dayofmonth(day))]
    time = [_pad(h), F.lit(":"), _pad(m), F.lit(":"), _pad(s), F.lit("."), _pad(ms % 1000, 3)]
    return F.concat(*date, F.lit("T"), *time, F.lit("Z"))


def _div(c: Column, n: int) -> Column:
    """The whole quotient, never by way of a double."""
    return F.call_function("div", c, F.lit(n))


def _pad(c: Column, n: int = 2) -> Column:
    return F.lpad(c.cast("string"), n, "0")

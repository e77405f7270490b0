"""Calendar days named in free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# English month names by number.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
_NAME = "(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\\.?"

# A day of the year written as year and three digits, or a week date, counts as ISO.
_YMD = "(?<![0-9])([0-9]{4})([-/.]?)([0-9]{2})\\2([0-9]{2})(?![0-9])"
_ORDINAL = "(?<![0-9])([0-9]{4})-?([0-9]{3})(?![0-9-])"
_WEEK = "(?<![0-9])([0-9]{4})-?w([0-9]{2})-?([1-7])(?![0-9])"
_DMY = "(?<![0-9.])([0-9]{1,2})\\.([0-9]{1,2})\\.([0-9]{4})(?![0-9])"
_D_NAME_Y = "(?<![0-9])(?<![0-9] ?[-–/] ?)([0-9]{1,2})(?:st|nd|rd|th)?[ .,-]{1,3}" + _NAME + "[ ,-]{1,2}([0-9]{4})(?![0-9])"
_NAME_D_Y = "(?<![a-z])" + _NAME + "[ -]([0-9]{1,2})(?:st|nd|rd|th)?(?: |, ?|-)([0-9]{4})(?![0-9])"


def _month(name: Column) -> Column:
    return F.lpad(F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.substring(name, 1, 3))).cast("string"), 2, "0")


def _all(text: Column, pattern: str, build) -> Column:
    """Days of every match of a pattern; build gets a column extractor by group."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.transform(found, lambda m: F.try_to_date(build(lambda k: F.regexp_extract(m, pattern, k)), "yyyy-MM-dd"))


def _week_day(g) -> Column:
    """Monday of ISO week 1 is the Monday of the week that holds January 4th."""
    fourth = F.try_to_date(F.concat(g(1), F.lit("-01-04")), "yyyy-MM-dd")
    monday = F.date_trunc("week", fourth).cast("date")
    return F.date_format(F.date_add(monday, ((g(2).cast("int") - 1) * 7 + g(3).cast("int") - 1)), "yyyy-MM-dd")


def _year_day(g) -> Column:
    first = F.try_to_date(F.concat(g(1), F.lit("-01-01")), "yyyy-MM-dd")
    n = g(2).cast("int")
    day = F.date_add(first, n - 1)
    return F.when((n >= 1) & (F.year(day) == g(1).cast("int")), F.date_format(day, "yyyy-MM-dd"))


def named_day(text: Column) -> Column:
    """The one calendar day that a text names, else null.

    Understands ISO dates (with any or no separator, ordinal and week dates), day.month.year
    and English month names in either order; whatever stands around the day is ignored. A
    text that names two different days (a range), only a month, a week or a tag names none.
    Null and empty texts give null, and so do days that don't exist.
    """
    t = F.lower(text)
    days = F.concat(
        _all(t, _YMD, lambda g: F.concat_ws("-", g(1), g(3), g(4))),
        _all(t, _ORDINAL, _year_day),
        _all(t, _WEEK, _week_day),
        _all(t, _DMY, lambda g: F.concat_ws("-", g(3), F.lpad(g(2), 2, "0"), F.lpad(g(1), 2, "0"))),
        _all(t, _D_NAME_Y, lambda g: F.concat_ws("-", g(3), _month(g(2)), F.lpad(g(1), 2, "0"))),
        _all(t, _NAME_D_Y, lambda g: F.concat_ws("-", g(3), _month(g(1)), F.lpad(g(2), 2, "0"))),
    )
    distinct = F.array_distinct(F.filter(days, lambda d: d.isNotNull()))
    plain = text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$")
    return F.when(plain, F.try_to_date(text, "yyyy-MM-dd")).otherwise(F.when(F.size(distinct) == 1, distinct[0]))

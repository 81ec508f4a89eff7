"""Date columns: eleven printed forms to ISO text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import let, strip

# Accepted forms, day first, tried in this order:
#   2026-06-27   27/06/2026   27-06-2026   27.06.2026   27/06/26   27-06-26
#   27-Jun-2026  27-Jun-26    27 Jun 2026  27 June 2026 2026/06/27
# A two-digit year of 69 or more is in the 1900s.
MONTHS = [
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
]
CENTURY_PIVOT = 69

_SHORT = "|".join(m[:3] for m in MONTHS)
_ANY = "|".join(MONTHS) + "|" + _SHORT
_ISO = r"^(\d{4})([-/])(\d{1,2})\2(\d{1,2}| [1-9])$"
_DAY_FIRST = r"^(\d{1,2})([-/.])(\d{1,2}| [1-9])\2(\d{4})$"
_DAY_FIRST_SHORT = r"^(\d{1,2})([-/])(\d{1,2}| [1-9])\2(\d{2})$"
_NAMED = rf"(?i)^(\d{{1,2}})-({_SHORT})-(\d{{4}}|\d{{2}})$"
_NAMED_SPACED = rf"(?i)^(\d{{1,2}})\s+({_ANY})\s+(\d{{4}})$"


def _month_number(name: Column) -> Column:
    """Month of an English name by its first three letters."""
    track = F.lit("".join(m[:3] for m in MONTHS))
    at = F.instr(track, F.lower(F.substring(name, 1, 3)))
    return F.floor((at + 2) / 3).cast("string")


def _full_year(year: Column) -> Column:
    return (
        F.when(F.length(year) == 4, year)
        .when(year.try_cast("int") >= CENTURY_PIVOT, F.concat(F.lit("19"), year))
        .otherwise(F.concat(F.lit("20"), year))
    )


def iso_date(value: Column) -> Column:
    """ISO ``yyyy-MM-dd`` text of a recognised date, else NULL.

    One regular expression picks the branch and one rewrites it, then a single
    ``try_cast`` checks the calendar: no parser exception is raised per format.
    """
    return let(strip(value), iso_date_of)


def iso_date_of(t: Column) -> Column:
    """``iso_date`` of text that is already trimmed."""
    dmy = F.split(t, "[-/.]")
    named = F.split(t, r"-|\s+")
    ymd = (
        F.when(t.rlike(_ISO), F.replace(F.replace(t, F.lit("/"), F.lit("-")), F.lit(" "), F.lit("")))
        .when(
            t.rlike(_DAY_FIRST) | t.rlike(_DAY_FIRST_SHORT),
            F.concat_ws("-", _full_year(F.get(dmy, 2)), F.ltrim(F.get(dmy, 1)), F.get(dmy, 0)),
        )
        .when(
            t.rlike(_NAMED) | t.rlike(_NAMED_SPACED),
            F.concat_ws(
                "-", _full_year(F.get(named, 2)), _month_number(F.get(named, 1)), F.get(named, 0)
            ),
        )
    )
    # every form begins with a digit, so other text meets no pattern
    return F.when((t >= "0") & (t < ":"), ymd.try_cast("date").cast("string"))


def day_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def month_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")

"""Dates and times as Column expressions. "Today" is always given, never read from the clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "Asia/Seoul"


def local_day(stamp: Column) -> Column:
    """The calendar day in Korea of an instant kept in UTC."""
    return F.to_date(F.from_utc_timestamp(stamp, ZONE))


def parse_day(text: Column) -> Column:
    """A date of exactly eight digits; anything else, and no date of the calendar, is null."""
    return F.when(text.rlike("^[0-9]{8}$"), F.to_date(F.try_to_timestamp(text, F.lit("yyyyMMdd"))))


def parse_marked_day(text: Column) -> Column:
    """The same after dashes and dots are taken out."""
    return parse_day(F.regexp_replace(text, "[-.]", ""))


def status_api(end: Column, announce: Column, source: Column, begin: Column, as_of: Column) -> Column:
    return (
        F.when(end < as_of, "closed").when(announce < as_of, "closed").when(source.contains("amend"), "amended")
        .when(begin <= as_of, "open").otherwise("announced")
    )


def status_portal(state: Column, announce: Column, amended: Column, stopped: Column, as_of: Column) -> Column:
    return (
        F.when((state == "ended") | ((announce < as_of) & ~state.eqNullSafe(F.lit("running"))), "closed")
        .when(amended, "amended").when(state.isNull() & stopped, "closed").when(state == "running", "open")
        .otherwise("announced")
    )


def status_board(start: Column, end: Column, as_of: Column, days: int = 7) -> Column:
    """Without an end a notice is open for some days from its start."""
    last = F.coalesce(end, F.date_add(start, days))
    return F.when(start.isNull() | (as_of < start), "announced").when(as_of <= last, "open").otherwise("closed")


def phase(start: Column, end: Column, as_of: Column) -> Column:
    """before, soon (within 4 days of the start), open, closing (within 7 days of the end) or past."""
    left = F.datediff(end, as_of)
    return (
        F.when(left < 0, "past").when(start > as_of, F.when(F.datediff(start, as_of) <= 4, "soon").otherwise("before"))
        .when(left < 7, "closing").otherwise("open")
    )


def minutes_between(earlier: Column, later: Column) -> Column:
    return F.floor((F.unix_timestamp(later) - F.unix_timestamp(earlier)) / 60).cast("long")

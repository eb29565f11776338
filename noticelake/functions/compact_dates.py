"""Days in texts that lost their separators, such as 26914(월), as Column expressions.

Digits without separators may be read in several ways; which one is meant follows from the day before it, as the steps of a
schedule do not go back. All is worked out with built-in functions, text by text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The days of a week from Monday on, and how days are written.
WEEKDAYS = "월화수목금토일"
SPACED = rf"(?:(\d{{2}}|\d{{4}})\s+)?(\d{{1,2}})\s+(\d{{1,2}})\s*\(([{WEEKDAYS}])\)"
COMPACT = rf"(?<!\d)(\d{{2,8}})\s*\(([{WEEKDAYS}])\)"
BARE = r"^(\d{4,8})$"
#: For each number of digits, the digits of year, month and day that they may be, the first reading first.
SPLITS = {8: [(4, 2, 2)], 7: [(4, 1, 2), (4, 2, 1)], 6: [(2, 2, 2)], 5: [(2, 1, 2), (2, 2, 1)], 4: [(0, 2, 2)], 3: [(0, 1, 2), (0, 2, 1)], 2: [(0, 1, 1)]}


def a_day(year: Column, month: Column, day: Column) -> Column:
    """The day, with years of two digits in this century; null if there is none such."""
    full = F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year)
    return F.try_to_date(F.concat_ws("-", full, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")


def readings(digits: Column, year: Column) -> Column:
    """The days that digits may mean; ``year`` stands in where they have none."""
    out = F.array().cast("array<date>")
    for n, splits in SPLITS.items():
        days = [
            a_day(F.substring(digits, 1, y) if y else year, F.substring(digits, y + 1, m), F.substring(digits, y + m + 1, d)) for y, m, d in splits
        ]
        out = F.when(F.length(digits) == n, F.array_compact(F.array(*days))).otherwise(out)
    return out


def following(days: Column, before: Column) -> Column:
    """The first of the days that is not before the other, else the first reading; null if there is none."""
    after = F.array_min(F.filter(days, lambda d: d >= before))
    return F.coalesce(after, F.get(days, F.lit(0)))


def weekday_sign(day: Column) -> Column:
    return F.substring(F.lit(WEEKDAYS), F.weekday(day) + 1, F.lit(1))


def days_in(text: Column, year: Column, before: Column) -> Column:
    """An array of (day, weekday) of a text, in its order; ``year`` and ``before`` are the year and day to go on from, or null.

    Days with blanks count first, as they can't be misread; without any, digits before a weekday in brackets; without those a text
    that is nothing but digits. Each day goes on from the one before it. Two digits alone count only if the weekday
    is right.
    """
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "[’‘'`]", ""), "[.:~*]", " "), r"\s+", " "))
    found = "array<struct<day: date, sign: string>>"
    state = F.struct(year.cast("string").alias("year"), before.cast("date").alias("day"), F.array().cast(found).alias("found"))

    def step(read):
        def go(acc: Column, x: Column) -> Column:
            day, sign = read(acc, x)
            grown = F.concat(acc["found"], F.array(F.struct(day.alias("day"), sign.alias("sign"))))
            return F.when(day.isNull(), acc).otherwise(F.struct(F.year(day).cast("string").alias("year"), day.alias("day"), grown.alias("found")))

        return go

    def spaced(acc: Column, x: Column):
        own = F.nullif(F.regexp_extract(x, SPACED, 1), F.lit(""))
        return a_day(F.coalesce(own, acc["year"]), F.regexp_extract(x, SPACED, 2), F.regexp_extract(x, SPACED, 3)), F.regexp_extract(x, SPACED, 4)

    def compact(acc: Column, x: Column):
        digits, sign = F.regexp_extract(x, r"(\d+)", 1), F.regexp_extract(x, rf"([{WEEKDAYS}])", 1)
        day = following(readings(digits, acc["year"]), acc["day"])
        return F.when((F.length(digits) > 2) | (weekday_sign(day) == sign), day), sign

    def bare(acc: Column, x: Column):
        day = following(readings(x, acc["year"]), acc["day"])
        return day, weekday_sign(day)

    tries = [F.aggregate(F.regexp_extract_all(plain, F.lit(p), F.lit(0)), state, step(read), lambda acc: acc["found"]) for p, read in ((SPACED, spaced), (COMPACT, compact), (BARE, bare))]
    return F.coalesce(*[F.when(F.size(t) > 0, t) for t in tries], F.when(text.isNotNull(), F.array().cast(found)))

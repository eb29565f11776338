"""Application periods and dates from free text, in Arrow batches."""

from __future__ import annotations

import datetime as dt
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

PERIOD = T.StructType([T.StructField(n, t) for n, t in (
    ("start", T.DateType()), ("end", T.DateType()), ("start_time", T.StringType()), ("end_time", T.StringType()))])
BETWEEN = re.compile(r"\s*(?:[~～∼〜]|(?<=[\s).])[-–—](?=\s|\d|['’‘`]))\s*")
ASIDE = re.compile(r"\([^)]*\)|\[[^\]]*\]")
CLOCK = re.compile(r"(\d{1,2})\s*(?::\s*(\d{2})|시(?:\s*(\d{1,2})\s*분)?)")
NUMBERS = re.compile(r"\d+")


def read_side(text: str) -> tuple[list[int], str | None]:
    """The numbers of a date as they stand, and the time of day, of one side of a period."""
    text = ASIDE.sub(" ", text)
    clock = CLOCK.search(text)
    if clock is None:
        return [int(n) for n in NUMBERS.findall(text)[:3]], None
    hour, minute = int(clock.group(1)), int(clock.group(2) or clock.group(3) or 0)
    time = f"{hour % 24:02d}:{minute:02d}" if hour <= 24 and minute < 60 else None
    return [int(n) for n in NUMBERS.findall(text[: clock.start()])[:3]], time


def day_of(year: int, month: int, day: int) -> dt.date | None:
    try:
        return dt.date(year + 2000 if year < 100 else year, month, day)
    except ValueError:
        return None


def application_window(text: str | None) -> tuple | None:
    """start, end, start_time, end_time of a text such as "'26. 09. 10.(목) 17:00 ~ 09. 14.".

    The end borrows what it leaves out from the start: a year, a month, or the whole day if it has a time alone. An end
    before the start belongs to the next year. An end that can't be read repeats the start; without a
    full first date there is no period.
    """
    if not text:
        return None
    sides = BETWEEN.split(text, maxsplit=1)
    numbers, start_time = read_side(sides[0])
    start = day_of(*numbers) if len(numbers) == 3 else None
    if start is None:
        return None
    if len(sides) == 1:
        return start, start, start_time, None
    numbers, end_time = read_side(sides[1])
    borrowed = [start.year, start.month, start.day][: 3 - len(numbers)]
    end = day_of(*borrowed, *numbers)
    if end is not None and end < start and len(numbers) < 3:
        end = day_of(end.year + 1, end.month, end.day)
    return start, end or start, start_time, end_time


@F.pandas_udf(PERIOD)
def period(texts: pd.Series) -> pd.DataFrame:
    rows = [application_window(t) or (None,) * 4 for t in texts]
    return pd.DataFrame(rows, columns=[f.name for f in PERIOD.fields], dtype=object)


def is_subsequence(short: str, text: str) -> bool:
    """Whether the characters of one string occur in the other in the same order."""
    rest = iter(text)
    return all(c in rest for c in short)

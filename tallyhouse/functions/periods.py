"""Periods and numbers that a question names, as columns."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# What follows the number of a year, month and day, and what joins two dates to a range.
UNITS = "년월일"
JOINERS = ("부터", "~", "～", "〜", "–", "—", "-")
# Native Korean numerals as they stand before a counter.
NUMERALS = {"한": 1, "두": 2, "세": 3, "네": 4, "다섯": 5, "여섯": 6, "일곱": 7, "여덟": 8, "아홉": 9, "열": 10}


@dataclass(frozen=True)
class Mention:
    """A year, month or day as it is written, and where; a month may lack its year."""

    year: int | None
    month: int | None
    day: int | None
    start: int
    end: int

    def first(self, year: int | None) -> dt.date:
        return dt.date(self.year or year, self.month or 1, self.day or 1)

    def last(self, year: int | None) -> dt.date:
        if self.day is not None:
            return self.first(year)
        # The day before the next month or year begins.
        y, m = self.first(year).year, self.month or 12
        return (dt.date(y, m, 28) + dt.timedelta(days=4)).replace(day=1) - dt.timedelta(days=1)


def _digits(text: str, at: int) -> int:
    """Where the digits that begin at a place end."""
    while at < len(text) and text[at].isdecimal():
        at += 1
    return at


def _spaces(text: str, at: int) -> int:
    while at < len(text) and text[at].isspace():
        at += 1
    return at


def _hyphened(text: str, at: int) -> tuple[list[int], int] | None:
    """Year, month and day of four, two and two digits with hyphens between them."""
    parts, end = [], at
    for width in (4, 2, 2):
        if parts:
            if text[end : end + 1] != "-":
                return None
            end += 1
        begin, end = end, _digits(text, end)
        if end - begin != width:
            return None
        parts.append(int(text[begin:end]))
    return parts, end


def _with_units(text: str, at: int) -> tuple[dict[str, int], int]:
    """Numbers with the units behind them, each unit smaller than the one before."""
    found: dict[str, int] = {}
    end, allowed = at, UNITS
    while True:
        begin = _spaces(text, end) if found else end
        stop = _digits(text, begin)
        unit = text[(place := _spaces(text, stop)) : place + 1]
        width = stop - begin
        fits = width == 4 if unit == "년" else 1 <= width <= 2
        if not unit or unit not in allowed or not fits or found and allowed[0] != unit:
            return found, end
        found[unit] = int(text[begin:stop])
        end, allowed = place + 1, allowed[allowed.index(unit) + 1 :]
        if not allowed or len(found) == 1 and unit != "년":
            return found, end


def mentions(text: str) -> Iterator[Mention]:
    """All years, months and days of a text in order. A day without a month and a number without a unit are none."""
    at = 0
    while at < len(text):
        if not text[at].isdecimal():
            at += 1
            continue
        if day := _hyphened(text, at):
            yield Mention(*day[0], at, day[1])
            at = day[1]
            continue
        named, end = _with_units(text, at)
        if "년" in named or "월" in named:
            yield Mention(named.get("년"), named.get("월"), named.get("일"), at, end)
            at = end
        else:
            at = _digits(text, at)


def explicit_period(question: str | None) -> tuple[str | None, str | None, str | None]:
    """First day, last day and error of the one period that a question names; all null if it names none.

    A range has two ends with a joiner between them; a second month may leave out its year. Two
    full dates without a joiner are no period, anything else that is unclear is an error.
    """
    text = question or ""
    found = list(mentions(text))
    if len(found) == 2 and text[found[0].end : found[1].start].strip() not in JOINERS:
        if all(m.day is not None for m in found):
            return None, None, None
        return None, None, "ambiguous_date_range"
    if len(found) > 2:
        return None, None, "ambiguous_date_range"
    if not found:
        return None, None, None
    if found[0].year is None:
        return None, None, "missing_date_year"
    try:
        first, last = found[0].first(None), found[-1].last(found[0].year)
        found[0].last(None), found[-1].first(found[0].year)
    except ValueError:
        return None, None, "invalid_calendar_date"
    return (first.isoformat(), last.isoformat(), None) if first <= last else (None, None, "reversed_date_range")


def period(text: str) -> Column:
    @F.pandas_udf("first_date string, last_date string, error string")
    def find(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([explicit_period(v) for v in values], columns=["first_date", "last_date", "error"])

    return find(F.col(text))


def named_days(text: str | None) -> list[str]:
    """Distinct full dates of a text, hyphened or with units, that the calendar has, in the order they are named."""
    out: dict[str, None] = {}
    for m in mentions(text or ""):
        if m.day is not None:
            try:
                out[m.first(None).isoformat()] = None
            except ValueError:
                continue
    return list(out)


def full_dates(text: str) -> Column:
    @F.pandas_udf("array<string>")
    def find(values: pd.Series) -> pd.Series:
        return values.map(named_days)

    return find(F.col(text))


def session_count(text: str) -> Column:
    """The number of sessions that a text asks for, in digits or native Korean numerals; null if it names none."""
    digits = F.regexp_extract(F.col(text), r"(?i)(\d+)\s*-?\s*(?:sessions?\b|세션|회)", 1)
    word = F.regexp_extract(F.col(text), "(" + "|".join(NUMERALS) + r")\s*(?:세션|번의\s*세션)", 1)
    named = F.element_at(F.create_map(*[F.lit(x) for kv in NUMERALS.items() for x in kv]), F.nullif(word, F.lit("")))
    return F.coalesce(F.nullif(digits, F.lit("")).cast("int"), named)

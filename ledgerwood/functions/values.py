"""Dates, periods, money and bands as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Date formats in the order they are tried.
DATE_FORMATS = ["yyyy-MM-dd", "d MMMM yyyy", "d MMM yyyy", "MMMM d, yyyy", "d/M/yyyy", "d.M.yyyy", "d-M-yyyy"]
# Currency words.
CURRENCIES = {"dollar": "USD", "dollars": "USD", "$": "USD", "euro": "EUR", "euros": "EUR", "€": "EUR", "pound": "GBP", "pounds": "GBP", "£": "GBP", "dirham": "AED", "dirhams": "AED"}
MULTIPLIERS = {"k": 1_000, "thousand": 1_000, "m": 1_000_000, "million": 1_000_000, "bn": 1_000_000_000, "billion": 1_000_000_000}


def parse_date(text: Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """The first format that reads the text, ordinal endings removed; NULL if none does."""
    bare = F.trim(F.regexp_replace(text, r"(\d)(st|nd|rd|th)\b", "$1"))
    # A format is tried only on texts of its shape: a lenient parser takes "1 January 24" for a year.
    return F.coalesce(*[F.to_date(F.try_to_timestamp(bare, F.lit(f))) for f in formats])


def weekday(day: Column) -> Column:
    """0 for Monday to 6 for Sunday."""
    return F.weekday(day)


def is_working(day: Column, holidays: Column, weekend: Sequence[int] = (5, 6)) -> Column:
    return ~weekday(day).isin(list(weekend)) & ~F.array_contains(holidays, day)


def add_days(start: Column, days: int, working: bool = False, holidays: Column | None = None) -> Column:
    """``days`` after a date, which isn't counted itself; working days skip weekends and holidays."""
    if not working:
        return F.date_add(start, days)
    holidays = F.array().cast("array<date>") if holidays is None else holidays
    # Two days in seven are off; holidays can add as many again, so the reach covers both.
    reach = F.sequence(F.date_add(start, 1), F.date_add(start, F.lit(days * 2 + 7) + F.size(holidays)))
    return F.element_at(F.filter(reach, lambda d: is_working(d, holidays)), days)


def _worked(day: Column) -> Column:
    """Weekdays up to a date since a Monday: whole weeks, and the rest up to Friday."""
    n = F.datediff(day, F.lit("1969-12-29").cast("date")) + 1
    rest = F.pmod(n, F.lit(7))
    return ((n - rest) / 7).cast("int") * 5 + F.least(rest, F.lit(5))


def count_days(start: Column, stop: Column, working: bool = False, holidays: Column | None = None) -> Column:
    """Signed days between two dates, the start not counted; NULL where one of them is. No list of days is made."""
    if not working:
        return F.datediff(stop, start)
    weekdays = _worked(stop) - _worked(start)
    if holidays is None:
        return weekdays
    low, high = F.least(start, stop), F.greatest(start, stop)
    free = F.size(F.filter(F.array_distinct(holidays), lambda d: ~weekday(d).isin(5, 6) & (d > low) & (d <= high)))
    return weekdays - F.when(stop >= start, free).otherwise(-free)


def amount(text: Column) -> Column:
    """The one number in a text, with a multiplier attached to it; NULL if there are several or none."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(F.regexp_replace(text, r"(?<=\d),(?=\d{3})", "")), F.lit(r"(\d+(?:\.\d+)?)\s*(?:k|thousand|m|million|bn|billion)?\b"), F.lit(0)))
    one = F.get(found, F.lit(0))
    scale = F.trim(F.regexp_extract(one, r"([a-z]+)$", 1))
    factor = F.coalesce(F.create_map(*[F.lit(x) for kv in MULTIPLIERS.items() for x in kv])[scale], F.lit(1))
    value = F.regexp_extract(one, r"^(\d+(?:\.\d+)?)", 1).try_cast("decimal(18,2)")
    return F.when(F.size(found) == 1, (value * factor).cast("decimal(28,2)"))


def currency(text: Column) -> Column:
    word = F.lower(F.trim(text))
    known = F.create_map(*[F.lit(x) for kv in CURRENCIES.items() for x in kv])[word]
    return F.coalesce(known, F.when(F.upper(word).rlike("^[A-Z]{3}$"), F.upper(word)))


def first_days(text: Column) -> Column:
    """The first whole number over 0."""
    n = F.regexp_extract(text, r"(\d+)", 1).try_cast("int")
    return F.when(n > 0, n)


def size_in_billions(text: Column) -> Column:
    n = F.regexp_extract(F.lower(text), r"([\d.]+)\s*[bm]", 1).try_cast("double")
    return F.when(F.lower(text).rlike(r"[\d.]+\s*m\b"), n / 1000).otherwise(n)


def quality_band(score: Column) -> Column:
    return F.when(score >= 0.85, "good").when(score >= 0.65, "usable").when(score >= 0.35, "poor").otherwise("unusable")


def piecewise(x: Column, points: Sequence[tuple[float, float]]) -> Column:
    """Linear between breakpoints, constant beyond them."""
    out = F.when(x <= points[0][0], F.lit(float(points[0][1])))
    for (a, p), (b, q) in zip(points, points[1:]):
        out = out.when(x <= b, p + (x - a) * ((q - p) / (b - a)))
    return out.otherwise(F.lit(float(points[-1][1])))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))

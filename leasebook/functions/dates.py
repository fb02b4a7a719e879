"""Month arithmetic and year-month text."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Notices shown for unreadable search dates.
DATE_FORM_HINT = ". Please enter dates in the form YYYY-MM or YYYY/MM."


class UserInputError(ValueError):
    """A search argument the user has to correct."""


def month_diff(start: Column, end: Column) -> Column:
    """Number of month boundaries crossed: 1 Jan to 31 Dec is 11."""
    return ((F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)).cast("int")


def parse_year_month(text: Column) -> Column:
    """'YYYY-MM' or 'YYYY/MM' to the first of that month; blank or unreadable text to NULL."""
    return F.try_to_date(
        F.concat(F.substring(text, 1, 4), F.substring(text, 6, 2), F.lit("01")), "yyyyMMdd"
    )


def year_month_error(text: Column) -> Column:
    """True where text is not blank and cannot be read as a year and month."""
    filled = F.length(F.rtrim(text)) > 0
    delimiter = F.substring(text, 5, 1)
    bad = ~delimiter.isin("-", "/") | parse_year_month(text).isNull()
    return F.coalesce(filled & bad, F.lit(False))


def year_month_arg(text: str | None) -> dt.date | None:
    """One search argument; raises ValueError where `year_month_error` would flag it."""
    if text is None or not text.rstrip(" "):
        return None
    year, delimiter, month = text[:4], text[4:5], text[5:7]
    digits = year.isascii() and year.isdigit() and month.isascii() and month.isdigit()
    if delimiter not in ("-", "/") or not digits or len(year) < 4 or len(month) < 2:
        raise ValueError(text)
    return dt.date(int(year), int(month), 1)


def read_date_range(args: list[tuple[str | None, str]]) -> list[dt.date | None]:
    """Read several year-month arguments, reporting every unreadable one in a single notice."""
    dates: list[dt.date | None] = []
    problems = []
    for text, problem in args:
        try:
            dates.append(year_month_arg(text))
        except ValueError:
            problems.append(problem)
    if problems:
        raise UserInputError(", ".join(problems) + DATE_FORM_HINT)
    return dates


def add_years(day: dt.date, years: int) -> dt.date:
    try:
        return day.replace(year=day.year + years)
    except ValueError:  # 29 February
        return day.replace(year=day.year + years, day=28)

"""Date column functions (all JVM-side expressions, codegen friendly)."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_date(c: Column | str) -> Column:
    """Lenient date parse: bad text ('empty', '') becomes null instead of an
    error.  Equal to the non-ANSI ``to_date(c)``; safe with ANSI mode on."""
    return col_(c).try_cast("date")


def as_of_date(as_of: str | date | Column | None) -> Column:
    """The date that closes open spells; ``None`` means ``current_date()``."""
    if as_of is None:
        return F.current_date()
    if isinstance(as_of, Column):
        return as_of
    return F.lit(str(as_of)).cast("date")


def minus_years(c: Column | str, years: int) -> Column:
    """``c - INTERVAL n YEARS`` (Feb 29 clamps to Feb 28)."""
    return F.add_months(col_(c), -12 * years)


def minus_days(c: Column | str, days: int) -> Column:
    return F.date_sub(col_(c), days)


def fallback_start(end: Column | str, fallback: str) -> Column:
    """Start date assumed for a spell that has none: ``years:N`` or ``days:N``
    before its (closed) end."""
    kind, _, n = fallback.partition(":")
    if kind == "years":
        return minus_years(end, int(n))
    if kind == "days":
        return minus_days(end, int(n))
    raise ValueError(f"fallback must be 'years:N' or 'days:N', got {fallback!r}")


def month_floor(c: Column | str) -> Column:
    """First day of the month (the year-month key of a date)."""
    return F.trunc(col_(c), "MM")


def year_span(start_year: Column | str, end_year: Column | str, mode: str = "as_coded") -> Column:
    """Array of years covered by a spell.

    ``as_coded``: ``sequence(start_year, end_year - 1)``; end-exclusive, and
    for a same-year or reversed spell the sequence runs backwards
    (2000-2000 -> [2000, 1999]).  ``forward``: end-exclusive, one year for a
    same-year spell, nothing for a reversed one.  A null bound gives null,
    which ``explode`` drops.
    """
    sy, ey = col_(start_year), col_(end_year)
    if mode == "as_coded":
        return F.sequence(sy, ey - 1)
    if mode == "forward":
        return (F.when(sy < ey, F.sequence(sy, ey - 1))
                 .when(sy == ey, F.array(sy)))
    raise ValueError(f"mode must be 'as_coded' or 'forward', got {mode!r}")


def year_bounds(start_year: Column | str, end_year: Column | str, mode: str = "as_coded") -> tuple[Column, Column]:
    """The first and last of ``year_span``'s years; null where it has none."""
    sy, ey = col_(start_year), col_(end_year)
    if mode == "as_coded":
        both = sy.isNotNull() & ey.isNotNull()
        return F.when(both, F.least(sy, ey - 1)), F.when(both, F.greatest(sy, ey - 1))
    if mode == "forward":
        return F.when(sy <= ey, sy), F.when(sy <= ey, F.greatest(sy, ey - 1))
    raise ValueError(f"mode must be 'as_coded' or 'forward', got {mode!r}")


def month_span(m0: Column | str, m1: Column | str) -> Column:
    """Months from ``m0`` to ``m1`` inclusive (both month floors, m0 <= m1)."""
    return F.sequence(col_(m0), col_(m1), F.expr("INTERVAL 1 MONTH"))

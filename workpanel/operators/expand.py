"""Interval -> panel: one row per spell and year, or per spell and month."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from workpanel.functions.dates import month_floor, month_span, year_span
from workpanel.operators.spells import END, START


def with_years(df: DataFrame, start: str = START, end: str = END) -> DataFrame:
    return df.withColumns({"start_year": F.year(start), "end_year": F.year(end)})


def with_months(df: DataFrame, start: str = START, end: str = END) -> DataFrame:
    return df.withColumns({"start_year_month": month_floor(start),
                           "end_year_month": month_floor(end)})


def expand_years(df: DataFrame, start: str = START, end: str = END, out: str = "year",
                 mode: str = "as_coded", drop_reversed: bool = False) -> DataFrame:
    """One row per year of each spell (see ``year_span`` for ``mode``).

    ``drop_reversed`` removes spells whose end year is before the start year
    (placed before the explode; same rows as filtering after it).
    """
    df = with_years(df, start, end)
    if drop_reversed:
        df = df.filter(F.col("end_year") >= F.col("start_year"))
    return df.withColumn(out, F.explode(year_span("start_year", "end_year", mode)))


def expand_months(df: DataFrame, start: str = START, end: str = END,
                  out: str = "year_month") -> DataFrame:
    """One row per calendar month of each spell, both ends included; spells
    whose end month is before the start month are dropped."""
    df = with_months(df, start, end)
    df = df.filter(F.col("end_year_month") >= F.col("start_year_month"))
    return df.withColumn(out, F.explode(month_span("start_year_month", "end_year_month")))

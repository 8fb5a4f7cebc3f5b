"""Cell statistics: mean value and count per (occupation, place, period).

``cell_means`` aggregates a panel that is already one row per period.
``year_cells`` / ``month_cells`` give the same numbers straight from spells
without materialising the panel: spells are first combined per
(keys, first period, last period) - a map-side-combined aggregate over the
raw rows - and only those combined rows are expanded to periods and summed
again.  Sums and counts are distributive, so the result is identical, and
the expansion runs over a few distinct spans instead of every spell.

Distinct people are not distributive, so they are counted by a sweep over the
periods (``people_events``): a person's spans in a cell are joined to intervals that do
not overlap, each interval adds 1 in its first period and takes it away after its
last, and a running sum over the cell's periods is the number of people.  What is
shuffled are distinct (cell, person, span) rows, never one row a person and period.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from workpanel.functions.dates import month_span, year_bounds, year_span
from workpanel.operators.expand import with_months, with_years
from workpanel.operators.spells import END, START

MEAN, COUNT = "mean_salary", "n_individuals"


def _sums(value: str, exact_scale: int | None) -> tuple[Column, Column]:
    """Two sums that together keep every value: of those that a decimal of
    ``exact_scale`` places holds exactly (so their sum does not depend on the
    order rows are added in), and of all others as doubles (finer fractions,
    large values, NaN, infinities).  Without a scale all are doubles."""
    v = F.col(value)
    if exact_scale is None:
        return F.lit(None).cast("decimal(28,2)"), F.sum(v.cast("double"))
    d = v.try_cast(f"decimal(18,{exact_scale})")
    fits = F.coalesce(d.cast("double") == v, F.lit(False))
    return F.sum(F.when(fits, d)), F.sum(F.when(~fits, v.cast("double")))


def _mean(exact: Column, rest: Column, n: Column) -> Column:
    total = F.coalesce(exact.cast("double") + rest, exact.cast("double"), rest)
    return F.when(n > 0, total / n)


def cell_means(df: DataFrame, keys: list[str], value: str = "salary",
               exact_scale: int | None = 2, distinct_people: bool = False,
               key: str = "user_id", mean: str = MEAN, count: str = COUNT) -> DataFrame:
    """Mean ``value`` and count per cell.

    The count is the number of non-null values (rows of the panel, not
    people), and a cell whose values are all null stays with mean null and
    count 0.  ``distinct_people=True`` counts distinct ``key`` with a value.
    """
    n = (F.count_distinct(F.when(F.col(value).isNotNull(), F.col(key))) if distinct_people
         else F.count(value))
    exact, rest = _sums(value, exact_scale)
    return df.groupBy(*keys).agg(
        _mean(exact, rest, F.count(value)).alias(mean), n.alias(count))


def people_events(df: DataFrame, keys: list[str], key: str, first: str, last: str, period: str,
                  out: str = "_step") -> DataFrame:
    """``keys, period, out``: how many people enter (+) or leave (-) each cell with
    each period.  A row says that person ``key`` is in cell ``keys`` from period
    ``first`` to ``last`` (integers, both included); rows may repeat, overlap or touch, and
    rows without a person or a bound say nothing."""
    spans = df.filter(F.col(key).isNotNull() & (F.col(first) <= F.col(last))).select(*keys, key, first, last).distinct()
    person = Window.partitionBy(*keys, key).orderBy(first, last)
    before = person.rowsBetween(Window.unboundedPreceding, -1)
    so_far = person.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spans = (spans.withColumn("_new", F.coalesce(F.col(first) > F.max(last).over(before) + 1, F.lit(True)))
             .withColumn("_end", F.max(last).over(so_far)))
    spans = spans.withColumn("_last", F.coalesce(F.lead("_new").over(person), F.lit(True)))
    # an interval begins with the first of its spans and ends with the last
    event = F.explode(F.array_compact(F.array(F.when(F.col("_new"), F.struct(F.col(first).alias("p"), F.lit(1).alias("s"))),
                                              F.when(F.col("_last"), F.struct((F.col("_end") + 1).alias("p"), F.lit(-1).alias("s"))))))
    return (spans.select(*keys, event.alias("_e")).groupBy(*keys, F.col("_e.p").alias(period))
            .agg(F.sum("_e.s").alias(out)))


def _cells_with_people(df: DataFrame, keys: list[str], first: Column, last: Column, period: str, value: str,
                       exact_scale: int | None, key: str, mean: str, count: str) -> DataFrame:
    """Cells by integer periods, with the number of distinct people that have a value."""
    df = df.withColumns({"_first": first, "_last": last})
    exact, rest = _sums(value, exact_scale)
    sums = df.groupBy(*keys, "_first", "_last").agg(exact.alias("_s"), rest.alias("_r"), F.count(value).alias("_n"))
    sums = sums.withColumn(period, F.explode(F.sequence("_first", "_last"))).drop("_first", "_last")
    steps = people_events(df.filter(F.col(value).isNotNull()), keys, key, "_first", "_last", period)
    both = sums.withColumn("_step", F.lit(None).cast("long")).withColumn("_here", F.lit(True)).unionByName(
        steps.withColumn("_here", F.lit(False)), allowMissingColumns=True)
    n = F.sum("_n")
    both = both.groupBy(*keys, period).agg(_mean(F.sum("_s"), F.sum("_r"), n).alias(mean), F.sum("_step").alias("_step"),
                                           F.bool_or("_here").alias("_here"))
    # a row for each period of a cell, so no more rows than the calendar has periods
    until = Window.partitionBy(*keys).orderBy(period).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    people = F.coalesce(F.sum("_step").over(until), F.lit(0))
    return both.withColumn(count, people).filter("_here").select(*keys, period, mean, count)


def span_sums(df: DataFrame, keys: list[str], value: str = "salary", exact_scale: int | None = 2) -> DataFrame:
    """``keys, _s, _r, _n``: the sums and count that cells are made of; ``keys`` name the first and
    last period too.  Combined before the shuffle."""
    exact, rest = _sums(value, exact_scale)
    return df.groupBy(*keys).agg(exact.alias("_s"), rest.alias("_r"), F.count(value).alias("_n"))


def cells_of_spans(sums: DataFrame, keys: list[str], span: Column, period: str, mean: str = MEAN, count: str = COUNT) -> DataFrame:
    """Cells by ``period`` from ``span_sums``; ``span`` is the array of a span's periods."""
    panel = sums.withColumn(period, F.explode(span))
    n = F.sum("_n")
    return panel.groupBy(*keys, period).agg(_mean(F.sum("_s"), F.sum("_r"), n).alias(mean), n.alias(count))


def _spans_then_cells(df: DataFrame, keys: list[str], lo: str, hi: str, span: Column,
                      period: str, value: str, exact_scale: int | None, mean: str, count: str) -> DataFrame:
    return cells_of_spans(span_sums(df, [*keys, lo, hi], value, exact_scale), keys, span, period, mean, count)


def year_cells(df: DataFrame, keys: list[str], start: str = START, end: str = END,
               value: str = "salary", mode: str = "as_coded", drop_reversed: bool = False,
               exact_scale: int | None = 2, distinct_people: bool = False,
               key: str = "user_id", out: str = "year",
               mean: str = MEAN, count: str = COUNT) -> DataFrame:
    """``cell_means(expand_years(df, ...), keys + [out])`` without the panel."""
    d = with_years(df, start, end)
    if drop_reversed:
        d = d.filter(F.col("end_year") >= F.col("start_year"))
    if distinct_people:
        first, last = year_bounds("start_year", "end_year", mode)
        return _cells_with_people(d, keys, first, last, out, value, exact_scale, key, mean, count)
    return _spans_then_cells(d, keys, "start_year", "end_year", year_span("start_year", "end_year", mode), out, value,
                             exact_scale, mean, count)


def month_cells(df: DataFrame, keys: list[str], start: str = START, end: str = END,
                value: str = "salary", exact_scale: int | None = 2,
                distinct_people: bool = False, key: str = "user_id", out: str = "year_month",
                mean: str = MEAN, count: str = COUNT) -> DataFrame:
    """``cell_means(expand_months(df, ...), keys + [out])`` with the month
    written ``yyyy-MM``, without the panel."""
    d = with_months(df, start, end)
    d = d.filter(F.col("end_year_month") >= F.col("start_year_month"))
    if distinct_people:
        number = lambda c: 12 * F.year(c) + F.month(c) - 1
        cells = _cells_with_people(d, keys, number("start_year_month"), number("end_year_month"), out, value,
                                   exact_scale, key, mean, count)
        month = F.make_date(F.expr(f"cast(`{out}` div 12 as int)"), F.pmod(out, F.lit(12)) + 1, F.lit(1))
    else:
        cells = _spans_then_cells(d, keys, "start_year_month", "end_year_month",
                                  month_span("start_year_month", "end_year_month"), out, value, exact_scale, mean, count)
        month = F.col(out)
    return cells.withColumn(out, F.date_format(month, "yyyy-MM"))

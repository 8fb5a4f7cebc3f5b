"""Job-spell cleaning: parse dates, fill missing starts, close open ends,
back-fill what is still missing.

The order of the steps matters (a fill reads the raw end, before open ends
are closed) and is kept by ``clean_spells``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from workpanel.functions.dates import as_of_date, fallback_start, parse_date

START, END = "start_date_dt", "end_date_dt"
FLAG = "start_date_flag"


def parse_dates(df: DataFrame, cols: dict[str, str] | None = None) -> DataFrame:
    """Add parsed date columns, ``{out: source}``; unparsable text gives null."""
    cols = cols or {START: "startdate", END: "enddate"}
    return df.withColumns({out: parse_date(src) for out, src in cols.items()})


def fill_start(df: DataFrame, key: str = "user_id", start: str = START, end: str = END,
               tie: str = "position_id", order: str = "start") -> DataFrame:
    """Fill a missing start with the end of the person's previous spell.

    Same result as ``coalesce(start, lag(end).over(w))`` with
    ``w = partitionBy(key).orderBy(start asc nulls first, end asc nulls first, tie)``
    (``order="start"``, what the reference does) or
    ``orderBy(end asc nulls first, tie)`` (``order="end"``: the job that
    ended before donates).

    With ``order="start"`` spells without a start sort first, so only they
    can donate to each other.  The lagged value of a row with end ``e`` is
    ``e`` itself unless the row is the first (by ``tie``) with that end; the
    first one gets the previous *distinct* end of its donors.  So the work is
    a grouped aggregate over distinct (person, end date) pairs, a window
    over those pairs (bounded by the calendar, not by a person's row count),
    and a join back on (person, end date) for the rows that need a start.
    Rows that already have a start are not shuffled.

    ``tie`` must identify rows uniquely (trap T2: without it the order of
    spells sharing dates, and so the donor, is undetermined).
    """
    if order not in ("start", "end"):
        raise ValueError(f"order must be 'start' or 'end', got {order!r}")
    k, s, e, t = F.col(key), F.col(start), F.col(end), F.col(tie)
    missing = df.filter(s.isNull())
    present = df.filter(s.isNotNull())
    donors_src = missing if order == "start" else df
    dk, de, first, prev = "_fill_key", "_fill_end", "_fill_first", "_fill_prev"
    donors = (donors_src.filter(e.isNotNull())
              .groupBy(k.alias(dk), e.alias(de)).agg(F.min(t).alias(first))
              .withColumn(prev, F.lag(de).over(Window.partitionBy(dk).orderBy(de))))
    filled = (missing.join(donors, k.eqNullSafe(F.col(dk)) & (e == F.col(de)), "left")
              .withColumn(start, F.when(t == F.col(first), F.col(prev)).otherwise(e))
              .select(*df.columns))
    return present.unionByName(filled)


def close_open(df: DataFrame, end: str = END, as_of=None) -> DataFrame:
    """An open spell (no end) ends at ``as_of`` (default ``current_date()``)."""
    return df.withColumn(end, F.coalesce(F.col(end), as_of_date(as_of)))


def backfill_start(df: DataFrame, start: str = START, end: str = END,
                   fallback: str = "years:3", prefer: str | Column | None = None,
                   flag: str | None = FLAG) -> DataFrame:
    """Flag spells still missing a start, then assume one: ``prefer`` (for
    example the person's college end date) if given and not null, else
    ``fallback`` before the end (``years:N`` or ``days:N``)."""
    s = F.col(start)
    options = [s]
    if prefer is not None:
        options.append(F.col(prefer) if isinstance(prefer, str) else prefer)
    options.append(fallback_start(end, fallback))
    new = {start: F.coalesce(*options)}
    if flag:
        new = {flag: s.isNull().cast("int"), **new}
    return df.withColumns(new)


def clean_spells(df: DataFrame, fallback: str, prefer: str | None = None, as_of=None,
                 key: str = "user_id", tie: str = "position_id", order: str = "start",
                 start_src: str = "startdate", end_src: str = "enddate") -> DataFrame:
    """parse -> fill start -> close open end -> flag + back-fill."""
    df = parse_dates(df, {START: start_src, END: end_src})
    df = fill_start(df, key=key, tie=tie, order=order)
    df = close_open(df, as_of=as_of)
    return backfill_start(df, fallback=fallback, prefer=prefer)

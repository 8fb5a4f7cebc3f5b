"""Cohorts of people: movers between two countries, their latest home
education, and the last place they held a job at home.

Everything is a grouped aggregate or a semi/left join on the person key;
no key list ever comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from workpanel.functions.dates import parse_date
from workpanel.operators.spells import END
from workpanel.operators.topk import first_by


def movers(df: DataFrame, origin: str, destination: str, key: str = "user_id",
           country: str = "country", ordered: bool = False, start: str | None = None) -> DataFrame:
    """Distinct ``key`` of people with at least one row in each country.

    One grouped pass (map-side combined), instead of the fan-out of a self
    join.  Null keys are never movers.  ``ordered=True`` also requires the
    earliest origin start to be before the latest destination start
    (``start`` must then name a parsed date column).
    """
    c = F.col(country)
    is_o, is_d = c == F.lit(origin), c == F.lit(destination)
    rows = df.filter(F.col(key).isNotNull() & c.isin(origin, destination))
    aggs = [F.bool_or(is_o).alias("_o"), F.bool_or(is_d).alias("_d")]
    if ordered:
        if start is None:
            raise ValueError("ordered=True needs the parsed start column")
        aggs += [F.min(F.when(is_o, F.col(start))).alias("_o0"),
                 F.max(F.when(is_d, F.col(start))).alias("_d1")]
    g = rows.groupBy(key).agg(*aggs)
    cond = F.col("_o") & F.col("_d")
    if ordered:
        cond = cond & (F.col("_o0") < F.col("_d1"))
    return g.filter(cond).select(key)


def person_counts(df: DataFrame, origin: str, destination: str, key: str = "user_id",
                  country: str = "country", ordered: bool = False,
                  start: str | None = None) -> DataFrame:
    """``key, n_rows, mover`` for every person, in one grouped pass: how many
    rows they have (any country) and whether they are a mover (as
    ``movers``).  The counts name the people whose rows must be spread in
    later joins, movers or not."""
    c = F.col(country)
    is_o, is_d = c == F.lit(origin), c == F.lit(destination)
    aggs = [F.bool_or(is_o).alias("_o"), F.bool_or(is_d).alias("_d"),
            F.count(F.lit(1)).alias("n_rows")]
    cond = F.col("_o") & F.col("_d")
    if ordered:
        if start is None:
            raise ValueError("ordered=True needs the parsed start column")
        aggs += [F.min(F.when(is_o, F.col(start))).alias("_o0"),
                 F.max(F.when(is_d, F.col(start))).alias("_d1")]
        cond = cond & (F.col("_o0") < F.col("_d1"))
    g = df.filter(F.col(key).isNotNull()).groupBy(key).agg(*aggs)
    return g.select(key, "n_rows", F.coalesce(cond, F.lit(False)).alias("mover"))


def keep_keys(df: DataFrame, keys: DataFrame, key: str = "user_id") -> DataFrame:
    """Rows of ``df`` whose key is in ``keys`` (left semi join)."""
    return df.join(keys.select(key), on=key, how="left_semi")


def latest_education(education: DataFrame, country: str, before: str | None = None,
                     key: str = "user_id", end: str = "enddate",
                     place: str = "university_location", tie: str = "education_id",
                     country_col: str = "university_country") -> DataFrame:
    """Each person's most recent education in ``country``:
    ``key, college_enddate, <place>``.

    Latest by end date (nulls last), ties by ``tie``; any degree level.  With
    ``before``, the person is kept only if that latest date is before it: a
    later degree disqualifies, and a null date never passes.
    """
    e = (education.filter(F.col(country_col) == F.lit(country))
         .select(key, parse_date(end).alias("college_enddate"), place, tie))
    top = first_by(e, key, [("college_enddate", "desc", "last"), (tie, "asc", "last")],
                   ["college_enddate", place])
    if before is not None:
        top = top.filter(F.col("college_enddate") < F.lit(before).cast("date"))
    return top


def last_place(df: DataFrame, country: str, place: str = "state",
               out: str = "last_origin_state", key: str = "user_id", end: str = END,
               tie: str = "position_id", country_col: str = "country") -> DataFrame:
    """``key, <out>``: the place of each person's latest-ending job in
    ``country`` (ties by ``tie``); the place itself may be null."""
    rows = df.filter(F.col(country_col) == F.lit(country))
    top = first_by(rows, key, [(end, "desc", "last"), (tie, "asc", "last")], [place])
    return top.withColumnRenamed(place, out)


def running_last(df: DataFrame, value: str = "state", out: str = "running_last_state",
                 key: str = "user_id", order: str = END, tie: str = "position_id") -> DataFrame:
    """``last(value)`` over ``partitionBy(key).orderBy(desc(order))`` with the
    default frame (unbounded preceding to current row, peers included).

    The frame ends at the last peer of the current row, so the answer is the
    value of the peer with the greatest ``tie`` among rows sharing
    (key, order): a grouped ``max_by`` joined back on those two columns.
    """
    k, o = "_rl_key", "_rl_order"
    peers = df.groupBy(F.col(key).alias(k), F.col(order).alias(o)).agg(
        F.max_by(value, tie).alias(out))
    j = df.join(peers, F.col(key).eqNullSafe(F.col(k)) & F.col(order).eqNullSafe(F.col(o)), "left")
    return j.drop(k, o)

"""The nine end-to-end jobs (L1-L9), as DataFrame -> DataFrame functions.

Shape of every panel job: select the people -> clean their spells ->
restrict to the rows that count -> cell means per (occupation, place,
period).  The person-level steps are grouped aggregates and joins on the
person key; the periods are generated per distinct span (see
``workpanel.operators.cells``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from workpanel.functions.codes import occupation_major
from workpanel.functions.dates import month_span, year_span
from workpanel.operators.cells import cells_of_spans, month_cells, span_sums, year_cells
from workpanel.operators.cohorts import last_place, latest_education, movers, person_counts
from workpanel.operators.bloom import may_be_in
from workpanel.operators.skew import (AUTO, HOT_ROWS, SALT, hot_by_sketch, hot_keys, salt_rows, sketch,
                                      spread_join)
from workpanel.operators.education import education_wide
from workpanel.operators.expand import expand_months, expand_years, with_months, with_years
from workpanel.operators.places import attach_city, located_predicate, merge_city_mapper, split_located
from workpanel.operators.spells import END, START, backfill_start, clean_spells, close_open, fill_start, parse_dates
from workpanel.sources.writers import materialize

KEY, TIE, EDU_TIE = "user_id", "position_id", "education_id"

# A hook that writes a table once and reads it back.  The mover jobs apply it
# to the per-person counts and to the movers' rows: each later branch (fill
# donors, rows to fill, origin place, destination rows) reads those, so
# positions are scanned twice in all, once for each.
Stage = Callable[[DataFrame], DataFrame]


def stage_table(df: DataFrame) -> DataFrame:
    """The default ``Stage``: Parquet under the shared checkpoint folder."""
    return materialize(df.sparkSession, df, "mover_rows")


def _staged(df: DataFrame, stage: Stage | None) -> DataFrame:
    return df if stage is None else stage(df)


def with_tie(df: DataFrame, tie: str, cols: list[str]) -> DataFrame:
    """``df`` with a column ``tie`` that names its rows and orders ties.

    A table without row ids gets one: the values of ``cols`` by column name
    (nulls first), then a number that only tells equal rows apart.  The numbers
    depend on task order, so the table is written once and read back.
    """
    if tie in df.columns:
        return df
    own = [c for c in sorted(cols) if c in df.columns]
    rows = df.select(*own, F.monotonically_increasing_id().alias("_row"))
    return materialize(df.sparkSession, rows.select(*own, F.struct(*own, "_row").alias(tie)), "with_ids")


def _job_positions(positions: DataFrame, *more: str) -> DataFrame:
    """The columns a cell job reads, with row ids."""
    cols = [KEY, "startdate", "enddate", "country", "onet_code", "salary", *more]
    return with_tie(positions, TIE, cols).select(*dict.fromkeys([*cols, TIE]))


def _job_education(education: DataFrame) -> DataFrame:
    return with_tie(education, EDU_TIE, [KEY, "enddate", "university_location", "university_country"])


# ---- residents ------------------------------------------------------------

def resident_spells(positions: DataFrame, country: str, fallback: str, as_of=None,
                    order: str = "start") -> DataFrame:
    """Rows in ``country`` (filtered before the fill, so only they donate),
    cleaned."""
    rows = positions.filter(F.col("country") == F.lit(country))
    tied = with_tie(rows, TIE, rows.columns)
    spells = clean_spells(tied, fallback=fallback, as_of=as_of, key=KEY, tie=TIE, order=order)
    return spells if TIE in positions.columns else spells.drop(TIE)


def one_scan_sums(rows: DataFrame, keys: list[str], periods: Callable, bounds: list[str], fallback: str, as_of,
                  stage: Stage, exact_scale: int | None = 2) -> DataFrame:
    """``span_sums`` by ``keys`` and ``bounds`` of the cleaned spells of ``rows``, read once.

    Only rows without a start are filled, and only they donate (``fill_start``).
    So one grouped pass serves both kinds: a row with a start counts under its
    span, one without stays by itself, named by its person, end and row id.  The
    pass is written by ``stage``; donors and the rows that they fill are read
    from there.  ``periods`` adds the columns ``bounds`` to parsed spells.
    """
    if as_of is None:  # both parts close open ends on the same day
        as_of = rows.sparkSession.range(1).select(F.current_date()).first()[0]
    late, end, sums = "_late", "_end", ["_s", "_r", "_n"]
    parsed = parse_dates(rows).withColumns({late: F.col(START).isNull(), end: F.col(END)})
    spans = periods(close_open(parsed, as_of=as_of), START, END)
    alone = [F.when(F.col(late), F.col(c)).alias(c) for c in (KEY, end, TIE)]
    once = stage(span_sums(spans.select(*keys, *bounds, late, *alone, "salary"), [*keys, *bounds, late, KEY, end, TIE],
                           exact_scale=exact_scale))
    dated = once.filter(~F.col(late)).select(*keys, *bounds, *sums)
    missing = once.filter(late).select(*keys, KEY, TIE, F.lit(None).cast("date").alias(START), F.col(end).alias(END), *sums)
    filled = backfill_start(close_open(fill_start(missing, key=KEY, tie=TIE), as_of=as_of), fallback=fallback, flag=None)
    both = dated.unionByName(periods(filled, START, END).select(*keys, *bounds, *sums))
    return both.groupBy(*keys, *bounds).agg(*[F.sum(c).alias(c) for c in sums])


def resident_year(positions: DataFrame, country: str = "India", as_of=None,
                  mode: str = "as_coded", distinct_people: bool = False,
                  exact_scale: int | None = 2, order: str = "start", stage: Stage | None = None) -> DataFrame:
    """L1: ``onet_code, state, year, mean_salary, n_individuals``.

    With ``stage`` positions are read once: by ``one_scan_sums``, or, for the fill by end
    date, to which every row may donate, and distinct people, to write the residents' rows."""
    if stage is not None and order == "start" and not distinct_people:
        rows = _job_positions(positions.filter(F.col("country") == F.lit(country)), "state")
        sums = one_scan_sums(rows, ["onet_code", "state"], with_years, ["start_year", "end_year"], "years:3", as_of, stage, exact_scale)
        return cells_of_spans(sums, ["onet_code", "state"], year_span("start_year", "end_year", mode), "year")
    rows = _staged(_job_positions(positions.filter(F.col("country") == F.lit(country)), "state"), stage)
    spells = resident_spells(rows, country, "years:3", as_of, order)
    return year_cells(spells, ["onet_code", "state"], mode=mode,
                      distinct_people=distinct_people, exact_scale=exact_scale)


def resident_year_panel(positions: DataFrame, country: str = "India", as_of=None,
                        mode: str = "as_coded", drop_reversed: bool = False) -> DataFrame:
    """L1's panel: one row per spell and year."""
    spells = resident_spells(positions, country, "years:3", as_of)
    return expand_years(spells, mode=mode, drop_reversed=drop_reversed)


def resident_month(positions: DataFrame, country: str = "India", as_of=None,
                   exact_scale: int | None = 2, distinct_people: bool = False,
                   order: str = "start", stage: Stage | None = None) -> DataFrame:
    """L2: ``onet_code_f2, state, year_month, mean_salary, n_individuals``; ``stage`` as in L1."""
    if stage is not None and order == "start" and not distinct_people:
        rows = _job_positions(positions.filter(F.col("country") == F.lit(country)), "state")
        rows = rows.withColumn("onet_code_f2", occupation_major("onet_code"))
        keys, bounds = ["onet_code_f2", "state"], ["start_year_month", "end_year_month"]
        first, last = bounds
        sums = one_scan_sums(rows, keys, with_months, bounds, "days:1095", as_of, stage, exact_scale).filter(F.col(last) >= F.col(first))
        return cells_of_spans(sums, keys, month_span(first, last), "year_month").withColumn("year_month", F.date_format("year_month", "yyyy-MM"))
    rows = _staged(_job_positions(positions.filter(F.col("country") == F.lit(country)), "state"), stage)
    spells = resident_spells(rows, country, "days:1095", as_of, order)
    spells = spells.withColumn("onet_code_f2", occupation_major("onet_code"))
    return month_cells(spells, ["onet_code_f2", "state"], exact_scale=exact_scale,
                       distinct_people=distinct_people)


def resident_month_panel(positions: DataFrame, country: str = "India", as_of=None) -> DataFrame:
    """L2's panel: one row per spell and month."""
    return expand_months(resident_spells(positions, country, "days:1095", as_of))


# ---- movers ---------------------------------------------------------------

def mover_set(positions: DataFrame, origin: str, destination: str,
              ordered: bool = False) -> DataFrame:
    """``user_id, n_rows, mover`` for every person (one grouped pass)."""
    if ordered:
        return person_counts(parse_dates(positions), origin, destination, ordered=True,
                             start=START)
    return person_counts(positions, origin, destination)


def _hot(people: DataFrame, hot_rows: int | None) -> DataFrame | None:
    """People (movers or not) with more than ``hot_rows`` rows (``None``:
    never spread).  Non-movers count too: their rows also pass through the
    movers' join before it drops them."""
    return None if hot_rows is None else hot_keys(people, KEY, threshold=hot_rows)


def _broadcast_bytes(spark: SparkSession) -> int:
    """``spark.sql.autoBroadcastJoinThreshold`` in bytes; -1 where broadcasts are off."""
    return spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()


def _among(keys: DataFrame, people: DataFrame | None) -> DataFrame:
    return keys if people is None else keys.join(people, KEY, "left_semi")


def _movers_by_sketch(positions: DataFrame, origin: str, destination: str, ordered: bool,
                      stage: Stage, among: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None, int]:
    """Movers (written; those in ``among``, if given), the hot people or ``None``, and the number of movers, all from one
    scan: the sketch that names hot people watches the rows on their way to the
    movers' aggregate, and no row count of every person is shuffled."""
    src = parse_dates(positions) if ordered else positions
    seen, kept = Observation(), Observation()
    keys = movers(src.observe(seen, *sketch(KEY)), origin, destination, ordered=ordered, start=START if ordered else None)
    keys = stage(_among(keys, among).observe(kept, F.count(F.lit(1)).alias("n")))
    hot = hot_by_sketch(positions, KEY, seen.get["n_rows"], seen.get["top"])
    if hot is not None:
        hot = stage(hot)
        hot = None if hot.isEmpty() else hot
    return keys, hot, kept.get["n"]


def _salted_movers(positions: DataFrame, origin: str, destination: str, ordered: bool,
                   hot_rows: int | str | None, stage: Stage | None = None, among: DataFrame | None = None
                   ) -> tuple[DataFrame, DataFrame | None]:
    """Rows of movers (of those in ``among``, one row a person, if given), each with the bucket ``_salt`` (0 unless its person is
    hot), and the hot people; per-person tables join on (person, bucket).
    With ``stage`` the movers are written once, and nobody hot means no
    buckets at all.  Movers too many to be broadcast are first looked for in a Bloom
    filter on the scan, so that few rows of others are shuffled."""
    if hot_rows is None:
        # no row counts needed: the movers aggregate reads origin and
        # destination rows only (filter pushed to the scan)
        src = parse_dates(positions) if ordered else positions
        keys = movers(src, origin, destination, ordered=ordered, start=START if ordered else None)
        return positions.join(_among(keys, among), KEY, "left_semi"), None
    if hot_rows == AUTO and stage is not None:
        keys, hot, n = _movers_by_sketch(positions, origin, destination, ordered, stage, among)
        rows = positions
        if 16 * n > _broadcast_bytes(positions.sparkSession):
            rows = may_be_in(rows, keys, KEY, n)
        rows = rows if hot is None else salt_rows(rows, KEY, hot, TIE)
        return spread_join(rows, keys, KEY, "left_semi", hot), hot
    people = _staged(mover_set(positions, origin, destination, ordered), stage)
    hot = _hot(people, HOT_ROWS if hot_rows == AUTO else hot_rows)
    if stage is not None:
        hot = None if hot.isEmpty() else stage(hot)
    keys = _among(people.filter(F.col("mover")).select(KEY), among)
    rows = positions if hot is None else salt_rows(positions, KEY, hot, TIE)
    return spread_join(rows, keys, KEY, "left_semi", hot), hot


def _unsalt(df: DataFrame) -> DataFrame:
    return df.drop(SALT)


def mover_positions(positions: DataFrame, origin: str, destination: str,
                    ordered: bool = False, hot_rows: int | str | None = AUTO,
                    keys_stage: Stage | None = stage_table) -> DataFrame:
    """All rows (any country) of people with rows in both countries; the movers
    are written by ``keys_stage``."""
    return _unsalt(_salted_movers(positions, origin, destination, ordered, hot_rows, keys_stage)[0])


def positions_with_education(positions: DataFrame, education: DataFrame, origin: str,
                             destination: str, before: str | None = None,
                             stage: Stage | None = None, ordered: bool = False,
                             hot_rows: int | str | None = AUTO, keys_stage: Stage | None = None) -> DataFrame:
    """Mover rows with ``college_enddate, university_location`` of the latest
    home education.  With ``before`` only people whose latest home degree
    ended before it remain (the join becomes inner).  ``keys_stage`` writes the
    movers only, ``stage`` their rows too."""
    pos, hot = _salted_movers(positions, origin, destination, ordered, hot_rows, keys_stage or stage)
    pos = _staged(pos, stage)
    edu = latest_education(education, origin, before=before)
    return _unsalt(spread_join(pos, edu, KEY, "left" if before is None else "inner", hot))


def mover_university_year(positions: DataFrame, education: DataFrame, origin: str = "India",
                          destination: str = "United States", before: str | None = None,
                          as_of=None, stage: Stage | None = stage_table, ordered: bool = False,
                          mode: str = "as_coded", distinct_people: bool = False,
                          hot_rows: int | str | None = AUTO, exact_scale: int | None = 2,
                          order: str = "start") -> DataFrame:
    """L3 / L4: ``onet_code, university_location, year, mean_salary, n_individuals``
    over destination rows of movers.  A missing start falls back to the
    college end date, else three years before the end.  ``ordered``: only
    people whose first origin job started before their last destination
    job."""
    pos = positions_with_education(_job_positions(positions), _job_education(education), origin,
                                   destination, before, stage, ordered, hot_rows)
    spells = clean_spells(pos, fallback="years:3", prefer="college_enddate", as_of=as_of,
                          key=KEY, tie=TIE, order=order)
    dest = spells.filter(F.col("country") == F.lit(destination))
    return year_cells(dest, ["onet_code", "university_location"], mode=mode,
                      distinct_people=distinct_people, exact_scale=exact_scale)


def mover_rows(positions: DataFrame, origin: str, destination: str,
               education: DataFrame | None = None, before: str | None = None,
               stage: Stage | None = None, ordered: bool = False,
               hot_rows: int | str | None = AUTO, keys_stage: Stage | None = None) -> DataFrame:
    """Movers' rows; with ``before``, only people whose latest home degree
    ended before it."""
    return _unsalt(salted_mover_rows(positions, origin, destination, education, before,
                                      stage, ordered, hot_rows, keys_stage)[0])


def salted_mover_rows(positions: DataFrame, origin: str, destination: str,
                       education: DataFrame | None, before: str | None, stage: Stage | None,
                       ordered: bool, hot_rows: int | None, keys_stage: Stage | None = None
                       ) -> tuple[DataFrame, DataFrame | None]:
    """``mover_rows`` still carrying the bucket column, plus the hot people."""
    if before is not None and education is None:
        raise ValueError("a cut-off needs the education table")
    # the cut-off thins the movers' ids, so that their rows are joined once
    cut = None if before is None else latest_education(education, origin, before=before).select(KEY)
    pos, hot = _salted_movers(positions, origin, destination, ordered, hot_rows, keys_stage or stage, cut)
    return _staged(pos, stage), hot


def mover_spells(positions: DataFrame, origin: str, destination: str,
                 education: DataFrame | None = None, before: str | None = None,
                 as_of=None, stage: Stage | None = stage_table) -> DataFrame:
    """Movers' cleaned rows; the fill reads them three times, from what ``stage`` wrote."""
    pos = mover_rows(positions, origin, destination, education, before, stage)
    return clean_spells(pos, fallback="days:1095", as_of=as_of, key=KEY, tie=TIE)


def last_origin_place(rows: DataFrame, origin: str, place: str = "state",
                      out: str = "last_origin_state", as_of=None) -> DataFrame:
    """``user_id, <out>`` from raw rows.  Only the closed end date decides,
    and it does not depend on the start-date fill, so the fill is skipped."""
    ended = close_open(parse_dates(rows, {END: "enddate"}), as_of=as_of)
    return last_place(ended, origin, place=place, out=out, key=KEY, tie=TIE)


def positions_with_origin(positions: DataFrame, origin: str = "India",
                          destination: str = "United States", education: DataFrame | None = None,
                          before: str | None = None, as_of=None, place: str = "state",
                          out: str = "last_origin_state", stage: Stage | None = stage_table,
                          ordered: bool = False, hot_rows: int | str | None = AUTO,
                          order: str = "start") -> DataFrame:
    """Movers' cleaned destination rows with the place of their latest origin job."""
    rows, hot = salted_mover_rows(positions, origin, destination, education, before,
                                   stage, ordered, hot_rows)
    return spells_with_origin(rows, hot, origin, destination, as_of, place, out, order)


def spells_with_origin(rows: DataFrame, hot: DataFrame | None, origin: str, destination: str, as_of=None,
                       place: str = "state", out: str = "last_origin_state", order: str = "start") -> DataFrame:
    """``positions_with_origin`` from movers' rows (with their buckets where ``hot`` is given)."""
    home = last_origin_place(_unsalt(rows), origin, place, out, as_of)
    # Attach the per-person place before the fill: after the movers' join the
    # rows are still partitioned by (person, bucket), so this join needs no
    # shuffle of the rows (after the fill they are no longer so).
    spells = clean_spells(_unsalt(spread_join(rows, home, KEY, "left", hot)),
                          fallback="days:1095", as_of=as_of, key=KEY, tie=TIE, order=order)
    return spells.filter(F.col("country") == F.lit(destination))


def mover_origin_year(positions: DataFrame, origin: str = "India",
                      destination: str = "United States", education: DataFrame | None = None,
                      before: str | None = None, as_of=None, place: str = "state",
                      out: str = "last_origin_state", stage: Stage | None = stage_table,
                      ordered: bool = False, mode: str = "as_coded",
                      distinct_people: bool = False, hot_rows: int | str | None = AUTO,
                      exact_scale: int | None = 2, order: str = "start") -> DataFrame:
    """L5 / L6: ``onet_code, <out>, year, mean_salary, n_individuals``; spells
    whose end year is before their start year are left out."""
    education = None if education is None else _job_education(education)
    dest = positions_with_origin(_job_positions(positions, place), origin, destination, education,
                                 before, as_of, place, out, stage, ordered, hot_rows, order)
    return year_cells(dest, ["onet_code", out], drop_reversed=True, mode=mode,
                      distinct_people=distinct_people, exact_scale=exact_scale)


# ---- education and places ---------------------------------------------------

def education_profile(education: DataFrame, hot_rows: int | str | None = AUTO, **kw) -> DataFrame:
    """L7: one row per person, 18 columns.

    Rows are shuffled by person as they are, before they become 18 aggregates.
    Hot people, if a sketch of the table finds any, are combined before the
    shuffle instead; ``hot_rows=None``: everyone is."""
    tied = with_tie(education, EDU_TIE, education.columns) if kw.get("order") != "any" else education
    if hot_rows is None:
        return education_wide(tied, **kw)
    n, top = tied.agg(*sketch(KEY)).first()
    hot = (hot_by_sketch(tied, KEY, n, top) if hot_rows == AUTO else
           hot_by_sketch(tied, KEY, n, top, share=n + 1, least=hot_rows))
    return education_wide(tied, raw=True, hot=hot, **kw)


def city_mapper(parts: list[DataFrame]) -> DataFrame:
    """L8."""
    return merge_city_mapper(parts)


def positions_with_city(positions: DataFrame, mapper: DataFrame, null_safe: bool = True,
                        stage: Stage | None = None) -> tuple[DataFrame, DataFrame]:
    """L9: (located rows, ``user_id`` of unlocated rows).  With ``stage``, which has to keep the
    column ``LOCATED``, both come from one written table, and positions are read once."""
    rows = attach_city(positions, mapper, null_safe=null_safe)
    if stage is None:
        located, unlocated = split_located(rows)
        return located, unlocated.select(KEY)
    flagged = stage(rows.withColumn(LOCATED, located_predicate()))
    return flagged.filter(F.col(LOCATED)).drop(LOCATED), flagged.filter(~F.col(LOCATED)).select(KEY)


#: The flag of a staged located / unlocated table, which has a folder for each.
LOCATED = "_located"


def stage_located(df: DataFrame) -> DataFrame:
    """Both halves of L9 in one write, a folder each."""
    return materialize(df.sparkSession, df, "located", partition_by=[LOCATED])

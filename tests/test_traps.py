"""Hand tables: a few rows in, exact rows out, one per semantic trap."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from conftest import rows
from workpanel.functions.dates import fallback_start
from workpanel.operators.cells import cell_means, month_cells, year_cells
from workpanel.operators.clean import blank_sentinel
from workpanel.operators.cohorts import last_place, latest_education, movers, running_last
from workpanel.operators.education import WIDE_COLUMNS, education_wide
from workpanel.operators.expand import expand_months, expand_years
from workpanel.operators.places import (attach_city, mapper_conflicts, merge_city_mapper,
                                       split_located)
from workpanel.operators.spells import backfill_start, close_open, fill_start, parse_dates
from workpanel.plans import pipelines as L

D = date.fromisoformat
SPELL = "user_id long, position_id string, startdate string, enddate string"


def spells(spark, data, schema=SPELL):
    return parse_dates(spark.createDataFrame(data, schema))


def test_t1_missing_starts_sort_first_and_only_they_donate(spark):
    df = spells(spark, [
        (1, "a", None, "2001-01-01"),
        (1, "b", None, "2009-01-01"),
        (1, "c", "2000-01-01", "2003-01-01"),
        (1, "d", "2005-01-01", None),
        (1, "e", "2006-01-01", "2008-01-01"),
    ])
    got = dict(rows(fill_start(df), "position_id", "start_date_dt"))
    # a is first: nothing before it; b gets a's end; dated rows keep theirs.
    assert got == {"a": None, "b": D("2001-01-01"), "c": D("2000-01-01"),
                   "d": D("2005-01-01"), "e": D("2006-01-01")}


def test_t2_ties_broken_by_end_then_id(spark):
    df = spells(spark, [
        (1, "p2", None, "2003-01-01"),
        (1, "p1", None, "2003-01-01"),
        (1, "p3", None, None),
        (1, "p4", None, "2001-06-01"),
    ])
    got = dict(rows(fill_start(df), "position_id", "start_date_dt"))
    # order: p3 (null end), p4, p1, p2
    assert got == {"p3": None, "p4": None, "p1": D("2001-06-01"), "p2": D("2003-01-01")}


def test_order_end_lets_the_previous_job_donate(spark):
    df = spells(spark, [
        (1, "a", "1990-01-01", "1995-01-01"),
        (1, "b", None, "1999-01-01"),
        (2, "c", None, "1999-01-01"),
    ])
    got = dict(rows(fill_start(df, order="end"), "position_id", "start_date_dt"))
    assert got == {"a": D("1990-01-01"), "b": D("1995-01-01"), "c": None}
    got_start = dict(rows(fill_start(df), "position_id", "start_date_dt"))
    assert got_start["b"] is None  # as coded: a dated row never donates


def test_t3_lag_reads_raw_end_before_closing(spark):
    df = spells(spark, [(1, "a", None, None), (1, "b", None, "2001-01-01")])
    out = close_open(fill_start(df), as_of="2002-01-01")
    got = {r.position_id: (r.start_date_dt, r.end_date_dt) for r in out.collect()}
    assert got == {"a": (None, D("2002-01-01")), "b": (None, D("2001-01-01"))}


def test_t4_resident_filter_before_fill_mover_filter_after(spark):
    data = [(1, "a", None, "1999-01-01", "India"),
            (1, "b", None, "2000-05-01", "United States")]
    schema = SPELL + ", country string"
    pos = spark.createDataFrame(data, schema)
    res = L.resident_spells(pos.filter(F.lit(True)), "United States", "years:3", "2002-01-01")
    # resident: the India row cannot donate -> fallback 3 years before end
    assert [r.start_date_dt for r in res.collect()] == [D("1997-05-01")]
    sp = L.mover_spells(pos, "India", "United States", as_of="2002-01-01")
    got = {r.position_id: r.start_date_dt for r in sp.collect()}
    assert got["b"] == D("1999-01-01")  # mover: the India row donates


def test_t6_fallbacks_on_leap_day(spark):
    df = spark.createDataFrame([(D("2020-02-29"),)], "e date")
    r = df.select(fallback_start("e", "years:3").alias("y"),
                  fallback_start("e", "days:1095").alias("d")).first()
    assert (r.y, r.d) == (D("2017-02-28"), D("2017-03-01"))
    with pytest.raises(ValueError):
        fallback_start("e", "weeks:2")


def test_backfill_prefers_college_then_fallback_and_flags(spark):
    df = spark.createDataFrame(
        [("a", None, D("2001-05-05"), D("1995-01-01")),
         ("b", None, D("2001-05-05"), None),
         ("c", D("1999-01-01"), D("2001-05-05"), D("1990-01-01"))],
        "position_id string, start_date_dt date, end_date_dt date, college_enddate date")
    out = backfill_start(df, fallback="years:3", prefer="college_enddate")
    got = {r.position_id: (r.start_date_dt, r.start_date_flag) for r in out.collect()}
    assert got == {"a": (D("1995-01-01"), 1), "b": (D("1998-05-05"), 1),
                   "c": (D("1999-01-01"), 0)}


def test_t7_year_expansion_as_coded_and_forward(spark):
    df = spark.createDataFrame(
        [("n", D("1998-03-01"), D("2001-02-01")), ("same", D("2000-01-01"), D("2000-12-01")),
         ("rev", D("2005-01-01"), D("2003-01-01")), ("null", None, D("2003-01-01"))],
        "position_id string, start_date_dt date, end_date_dt date")
    def years(mode, drop=False):
        out = {}
        for r in expand_years(df, mode=mode, drop_reversed=drop).collect():
            out.setdefault(r.position_id, []).append(r.year)
        return {k: sorted(v) for k, v in out.items()}
    assert years("as_coded") == {"n": [1998, 1999, 2000], "same": [1999, 2000],
                                 "rev": [2002, 2003, 2004, 2005]}
    assert years("forward") == {"n": [1998, 1999, 2000], "same": [2000]}
    # T8: dropping reversed spells keeps the backwards same-year pair
    assert years("as_coded", drop=True) == {"n": [1998, 1999, 2000], "same": [1999, 2000]}


def test_t10_t11_months_inclusive_and_reversed_dropped(spark):
    df = spark.createDataFrame(
        [("a", D("2000-11-15"), D("2001-02-01")), ("b", D("2001-03-31"), D("2001-03-01")),
         ("c", D("2001-04-02"), D("2001-03-30"))],
        "position_id string, start_date_dt date, end_date_dt date")
    got = rows(expand_months(df), "position_id", "year_month")
    assert got == [("a", D("2000-11-01")), ("a", D("2000-12-01")), ("a", D("2001-01-01")),
                   ("a", D("2001-02-01")), ("b", D("2001-03-01"))]


def test_t9_sentinel_dates_parse_to_null_under_ansi(spark):
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"
    df = spells(spark, [(1, "a", "empty", ""), (1, "b", "2001-13-40", "1999-02-03")])
    got = rows(df, "position_id", "start_date_dt", "end_date_dt")
    assert got == [("a", None, None), ("b", None, D("1999-02-03"))]


def test_t12_t13_movers_unordered_and_ordered(spark):
    pos = spark.createDataFrame(
        [(1, "India", "2005-01-01"), (1, "United States", "2001-01-01"),
         (1, "United States", "2002-01-01"), (2, "India", "1990-01-01"),
         (2, "United States", "1995-01-01"), (3, "India", "1990-01-01"),
         (None, "India", None), (None, "United States", None)],
        "user_id long, country string, startdate string")
    assert rows(movers(pos, "India", "United States")) == [(1,), (2,)]
    p = parse_dates(pos, {"start_date_dt": "startdate"})
    assert rows(movers(p, "India", "United States", ordered=True, start="start_date_dt")) == [(2,)]


def test_t14_t15_counts_non_null_values_and_keeps_null_cells(spark):
    df = spark.createDataFrame(
        [("11", None, 2000, 10.0, 1), ("11", None, 2000, 20.0, 1), ("11", None, 2000, None, 2),
         (None, "S", 2001, None, 3)],
        "onet_code string, state string, year int, salary double, user_id long")
    got = rows(cell_means(df, ["onet_code", "state", "year"]))
    assert got == [(None, "S", 2001, None, 0), ("11", None, 2000, 15.0, 2)]
    ppl = rows(cell_means(df, ["onet_code", "state", "year"], distinct_people=True))
    assert ppl == [(None, "S", 2001, None, 0), ("11", None, 2000, 15.0, 1)]


def test_fused_cells_equal_panel_then_aggregate(spark):
    df = spark.createDataFrame(
        [("11", "S", D("1998-03-01"), D("2001-02-01"), 10.0, 1),
         ("11", "S", D("2000-01-01"), D("2000-06-01"), 20.25, 2),
         ("11", "S", D("2000-01-01"), D("2000-06-01"), None, 3),
         ("12", "T", D("2005-01-01"), D("2003-01-01"), 7.5, 4)],
        "onet_code string, state string, start_date_dt date, end_date_dt date, "
        "salary double, user_id long")
    for mode in ("as_coded", "forward"):
        for drop in (False, True):
            fused = year_cells(df, ["onet_code", "state"], mode=mode, drop_reversed=drop)
            plain = cell_means(expand_years(df, mode=mode, drop_reversed=drop),
                               ["onet_code", "state", "year"])
            assert rows(fused) == rows(plain)
    fused_m = month_cells(df, ["onet_code", "state"])
    plain_m = cell_means(expand_months(df).withColumn(
        "year_month", F.date_format("year_month", "yyyy-MM")), ["onet_code", "state", "year_month"])
    assert rows(fused_m) == rows(plain_m)


EDU = ("user_id long, education_id long, degree string, enddate string, university_name string, "
       "university_country string, university_location string, field string")


def test_t16_t17_latest_education_then_cutoff(spark):
    edu = spark.createDataFrame([
        (1, 10, "Bachelor", "1985-01-01", "U", "India", "T1", "F"),
        (1, 11, "Master", "1993-01-01", "U", "India", "T2", "F"),   # later degree disqualifies
        (2, 20, "Bachelor", "1988-01-01", "U", "India", "T3", "F"),
        (2, 21, "Bachelor", None, "U", "India", "T4", "F"),        # null date sorts last
        (3, 30, "Bachelor", None, "U", "India", "T5", "F"),        # only null: picked, never < cut
        (4, 40, "Bachelor", "1980-01-01", "U", "United States", "T6", "F"),
        (5, 50, "Bachelor", "1980-01-01", "U", "India", "T7", "F"),
        (5, 49, "Bachelor", "1980-01-01", "U", "India", "T8", "F"),  # tie -> smaller id
    ], EDU)
    got = rows(latest_education(edu, "India"))
    assert got == [(1, D("1993-01-01"), "T2"), (2, D("1988-01-01"), "T3"), (3, None, "T5"),
                   (5, D("1980-01-01"), "T8")]
    cut = rows(latest_education(edu, "India", before="1990-01-01"))
    assert cut == [(2, D("1988-01-01"), "T3"), (5, D("1980-01-01"), "T8")]


def test_t18_last_origin_place_and_running_last(spark):
    df = spark.createDataFrame([
        (1, "a", D("2000-01-01"), "India", "S1"),
        (1, "b", D("2001-01-01"), "India", None),      # latest: state is null
        (1, "c", D("2003-01-01"), "United States", "X"),
        (2, "d", D("2001-01-01"), "India", "S2"),
        (2, "e", D("2001-01-01"), "India", "S3"),      # tie on end -> smaller id wins
    ], "user_id long, position_id string, end_date_dt date, country string, state string")
    assert rows(last_place(df, "India")) == [(1, None), (2, "S2")]
    rl = dict(rows(running_last(df.filter("country = 'India'")), "position_id",
                   "running_last_state"))
    # default frame includes peers: the last peer (greatest id) of each end date
    assert rl == {"a": "S1", "b": None, "d": "S3", "e": "S3"}


def test_t19_t20_t21_education_wide(spark):
    edu = spark.createDataFrame([
        (1, 1, "Bachelor", "1990-01-01", "Old", "India", "L1", "F1"),
        (1, 2, "Bachelor", "1995-01-01", "empty", "India", None, "F2"),
        (1, 3, "high school", "1980-01-01", "HS", "India", "L3", None),  # case: Post Graduate
        (1, 4, None, "1999-01-01", "PG", "empty", "L4", "F4"),
        (2, 5, "High School", "1970-01-01", "H", "US", "L5", None),
    ], EDU)
    wide = {r.user_id: r for r in education_wide(edu).collect()}
    one = wide[1]
    assert one.college_name is None           # 'empty' (latest) wins, then becomes null
    assert one.college_location_raw == "L1"  # latest non-null for this column
    assert one.college_field == "F2"
    assert one.post_grad_name == "PG" and one.post_grad_country is None
    assert one.high_school_name is None
    assert wide[2].high_school_name == "H"
    first = {r.user_id: r for r in education_wide(edu, clean_first=True).collect()}
    assert first[1].college_name == "Old"    # cleaned first: the real value wins
    assert first[1].post_grad_country == "India"  # the 'empty' of the later degree is gone
    assert set(WIDE_COLUMNS) <= set(education_wide(edu).columns)
    assert len(WIDE_COLUMNS) == 18


def test_blank_sentinel_only_touches_strings(spark):
    df = spark.createDataFrame([(1, "empty", D("2000-01-01"), "x")],
                               "id long, a string, d date, b string")
    assert rows(blank_sentinel(df)) == [(1, None, D("2000-01-01"), "x")]


MAP = "location string, metro_area string, city string"


def test_t22_t23_t24_t25_city_lookup(spark):
    part0 = spark.createDataFrame([("L1", None, "C1"), ("L2", "M", "empty"), ("L3", "M", "C3")], MAP)
    part1 = spark.createDataFrame([("L1", None, "C1"), ("L3", "M", "C3b")], MAP)
    mapper = merge_city_mapper([part0, part1])
    assert mapper.count() == 4
    assert rows(mapper_conflicts(mapper)) == [("L3", "M", 2)]
    pos = spark.createDataFrame([(1, "L1", None), (2, "L2", "M"), (3, "L3", "M"), (4, "L9", "M")],
                                "user_id long, location_raw string, metro_area string")
    att = attach_city(pos, mapper)
    assert set(att.columns) == {"user_id", "location_raw", "metro_area", "location", "city"}
    assert att.count() == 5  # L3 matches two cities
    located, unlocated = split_located(att)
    assert rows(located, "user_id", "city") == [(1, "C1"), (3, "C3"), (3, "C3b")]
    assert rows(unlocated, "user_id") == [(2,), (4,)]
    plain, _ = split_located(attach_city(pos, mapper, null_safe=False))
    assert rows(plain, "user_id") == [(3,), (3,)]


def test_attach_city_suffixes_other_shared_columns(spark):
    pos = spark.createDataFrame([(1, "L1", "M", "x")],
                                "user_id long, location_raw string, metro_area string, extra string")
    m = spark.createDataFrame([("L1", "M", "C", "y")], MAP + ", extra string")
    att = attach_city(pos, m)
    assert set(att.columns) == {"user_id", "location_raw", "metro_area", "extra_pos",
                                "location", "city", "extra_map"}


def test_person_counts_cover_non_movers(spark):
    from workpanel.operators.cohorts import person_counts
    from workpanel.operators.skew import hot_keys
    pos = spark.createDataFrame(
        [(1, "India"), (1, "United States"), (2, "Kenya"), (2, "Kenya"), (2, "Kenya"),
         (3, "India"), (None, "India")], "user_id long, country string")
    got = rows(person_counts(pos, "India", "United States"), "user_id", "n_rows", "mover")
    assert got == [(1, 2, True), (2, 3, False), (3, 1, False)]
    # a person with many rows is hot whether or not they moved
    assert rows(hot_keys(person_counts(pos, "India", "United States"), "user_id",
                         threshold=2)) == [(2, 2)]  # 3 rows -> ceil(3 / 2) buckets


def test_top1_with_null_dates_and_null_ties_matches_row_number(spark):
    from pyspark.sql import Window
    from workpanel.operators.topk import first_by
    df = spark.createDataFrame([
        (1, None, D("2000-01-01"), "a"), (1, 5, D("2000-01-01"), "b"), (1, 7, None, "c"),
        (2, None, None, "d"), (2, 3, None, "e"), (3, None, None, "f")],
        "k long, id long, d date, v string")
    order = [("d", "desc", "last"), ("id", "asc", "last")]
    got = rows(first_by(df, "k", order, ["v"]))
    w = Window.partitionBy("k").orderBy(F.col("d").desc_nulls_last(), F.col("id").asc_nulls_last())
    plain = rows(df.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("k", "v"))
    assert got == plain == [(1, "b"), (2, "e"), (3, "f")]
    # the min_by form (string tie) agrees too
    order_s = [("d", "desc", "last"), ("v", "asc", "last")]
    w2 = Window.partitionBy("k").orderBy(F.col("d").desc_nulls_last(), F.col("v").asc_nulls_last())
    assert rows(first_by(df, "k", order_s, ["id"])) == rows(
        df.withColumn("rn", F.row_number().over(w2)).filter("rn = 1").select("k", "id"))

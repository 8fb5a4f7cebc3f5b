"""Each skew-safe rewrite against the plain form it replaces (brute force).

Random tables, seeded, with a planted hot person holding a third of all
rows, many ties and nulls.  The plain forms are the per-person windows the
reference uses; the rewrites must give the same rows.  Run under both
broadcast and sort-merge joins and at several shuffle widths.
"""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import rows
from workpanel.operators.cells import cell_means, month_cells, year_cells
from workpanel.operators.cohorts import last_place, latest_education, movers, running_last
from workpanel.operators.expand import expand_months, expand_years
from workpanel.operators.spells import END, START, fill_start, parse_dates

COUNTRIES = ["India", "United States", "Kenya", None]


def _date(rng, lo=1980, hi=2002):
    if rng.random() < 0.15:
        return None
    if rng.random() < 0.05:
        return "empty"
    d = date(lo, 1, 1) + timedelta(days=rng.randrange((hi - lo) * 365))
    return d.isoformat()


def positions(spark, seed, n=3000):
    rng = random.Random(seed)
    data = []
    for i in range(n):
        user = 0 if rng.random() < 0.34 else rng.randrange(1, 200)  # user 0 is hot
        # few distinct dates so that ties on end date are common
        end = _date(rng, 1990, 1993)
        data.append((user if rng.random() > 0.01 else None, f"p{i:05d}", _date(rng), end,
                     rng.choice(COUNTRIES), rng.choice(["S1", "S2", None]),
                     rng.choice(["11-1", "12-2", None]),
                     None if rng.random() < 0.1 else round(rng.uniform(1, 999), 2)))
    schema = ("user_id long, position_id string, startdate string, enddate string, "
              "country string, state string, onet_code string, salary double")
    return spark.createDataFrame(data, schema)


@pytest.fixture(params=["broadcast", "sortmerge"])
def join_mode(request, spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    old_p = spark.conf.get("spark.sql.shuffle.partitions")
    if request.param == "sortmerge":
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield request.param
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    spark.conf.set("spark.sql.shuffle.partitions", old_p)


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("order", ["start", "end"])
def test_fill_start_equals_lag_window(spark, join_mode, seed, order):
    p = parse_dates(positions(spark, seed))
    s, e = F.col(START), F.col(END)
    if order == "start":
        w = Window.partitionBy("user_id").orderBy(s.asc_nulls_first(), e.asc_nulls_first(),
                                                  F.col("position_id"))
    else:
        w = Window.partitionBy("user_id").orderBy(e.asc_nulls_first(), F.col("position_id"))
    plain = p.withColumn(START, F.coalesce(s, F.lag(END).over(w)))
    got = fill_start(p, order=order)
    cols = ("position_id", START)
    assert rows(got, *cols) == rows(plain, *cols)
    assert got.count() == p.count()


@pytest.mark.parametrize("seed", [3])
def test_top1_equals_row_number(spark, join_mode, seed):
    p = parse_dates(positions(spark, seed))
    w = Window.partitionBy("user_id").orderBy(F.col(END).desc_nulls_last(), F.col("position_id"))
    plain = (p.filter(F.col("country") == "India").withColumn("rn", F.row_number().over(w))
             .filter("rn = 1").select("user_id", F.col("state").alias("last_origin_state")))
    assert rows(last_place(p, "India")) == rows(plain)


@pytest.mark.parametrize("seed", [4])
def test_running_last_equals_default_frame(spark, join_mode, seed):
    p = parse_dates(positions(spark, seed)).filter(F.col("country") == "India")
    # the peers' internal order made explicit: within an end date, by id
    w = Window.partitionBy("user_id", END).orderBy(F.col("position_id").desc())
    plain = p.withColumn("running_last_state", F.first("state").over(w))
    got = running_last(p)
    cols = ("position_id", "running_last_state")
    assert rows(got, *cols) == rows(plain, *cols)


@pytest.mark.parametrize("seed", [5])
def test_movers_equals_self_join(spark, join_mode, seed):
    p = positions(spark, seed)
    a = p.filter(F.col("country") == "India").select("user_id")
    b = p.filter(F.col("country") == "United States").select("user_id")
    plain = a.join(b, "user_id").distinct()
    assert rows(movers(p, "India", "United States")) == rows(plain)


def test_latest_education_equals_row_number(spark, join_mode):
    rng = random.Random(9)
    data = [(0 if rng.random() < 0.3 else rng.randrange(1, 80), i, _date(rng, 1980, 1984),
             rng.choice(["India", "United States"]), rng.choice(["T1", "T2", None]))
            for i in range(1500)]
    edu = spark.createDataFrame(data, "user_id long, education_id long, enddate string, "
                                      "university_country string, university_location string")
    d = F.col("enddate").try_cast("date")
    w = Window.partitionBy("user_id").orderBy(d.desc_nulls_last(), F.col("education_id"))
    plain = (edu.filter("university_country = 'India'").withColumn("rn", F.row_number().over(w))
             .filter("rn = 1").select("user_id", d.alias("college_enddate"), "university_location"))
    assert rows(latest_education(edu, "India")) == rows(plain)


@pytest.mark.parametrize("seed", [6])
def test_fused_cells_equal_explode_then_aggregate(spark, seed):
    p = parse_dates(positions(spark, seed)).withColumn(END, F.coalesce(END, F.lit(date(2002, 1, 1))))
    p = p.withColumn(START, F.coalesce(START, F.date_sub(END, 1095)))
    keys = ["onet_code", "state"]
    for mode, drop in [("as_coded", False), ("as_coded", True), ("forward", False)]:
        a = year_cells(p, keys, mode=mode, drop_reversed=drop)
        b = cell_means(expand_years(p, mode=mode, drop_reversed=drop), keys + ["year"])
        assert rows(a) == rows(b)
    a = month_cells(p, keys)
    b = cell_means(expand_months(p).withColumn("year_month", F.date_format("year_month", "yyyy-MM")),
                   keys + ["year_month"])
    assert rows(a) == rows(b)
    # counts add up: every non-null salary in the panel is counted once
    panel = expand_years(p)
    total = year_cells(p, keys).agg(F.sum("n_individuals")).first()[0]
    assert total == panel.filter(F.col("salary").isNotNull()).count()


def test_same_result_at_any_shuffle_width(spark):
    from workpanel.plans import pipelines as L
    p = positions(spark, 7)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        results = []
        for n in ("1", "4", "200"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            results.append(rows(L.mover_origin_year(p, as_of="2002-01-01")))
        assert results[0] == results[1] == results[2]
        shuffled = p.orderBy(F.rand(3))
        assert rows(L.mover_origin_year(shuffled, as_of="2002-01-01")) == results[0]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_string_person_key_and_ansi_off(spark):
    """user_id as text and a session with ANSI off."""
    from workpanel.plans import pipelines as L
    p = positions(spark, 8).withColumn("user_id", F.col("user_id").cast("string"))
    base = rows(L.mover_origin_year(positions(spark, 8), as_of="2002-01-01"))
    assert rows(L.mover_origin_year(p, as_of="2002-01-01")) == base
    w = Window.partitionBy("user_id").orderBy(F.col(START).asc_nulls_first(),
                                              F.col(END).asc_nulls_first(), "position_id")
    q = parse_dates(p)
    plain = q.withColumn(START, F.coalesce(START, F.lag(END).over(w)))
    assert rows(fill_start(q), "position_id", START) == rows(plain, "position_id", START)
    old = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        assert rows(L.mover_origin_year(positions(spark, 8), as_of="2002-01-01")) == base
    finally:
        spark.conf.set("spark.sql.ansi.enabled", old)


@pytest.mark.parametrize("hot_rows", [0, 25])
def test_spread_joins_give_the_plain_join_results(spark, join_mode, hot_rows):
    """Hot people's rows spread over buckets: same rows as no spreading."""
    from conftest import SF0001
    from workpanel.plans import pipelines as L
    from workpanel.sources import fixtures as fx
    P, E = fx.positions(spark, SF0001), fx.education(spark, SF0001)
    for job in (lambda h: L.mover_origin_year(P, as_of="2002-01-01", hot_rows=h),
                lambda h: L.mover_origin_year(P, education=E, before="1990-01-01",
                                              as_of="2002-01-01", hot_rows=h),
                lambda h: L.mover_university_year(P, E, as_of="2002-01-01", hot_rows=h),
                lambda h: L.mover_university_year(P, E, before="1990-01-01",
                                                  as_of="2002-01-01", hot_rows=h)):
        assert rows(job(hot_rows)) == rows(job(None))
    assert (L.mover_positions(P, "India", "United States", hot_rows=hot_rows).count()
            == L.mover_positions(P, "India", "United States", hot_rows=None).count())

"""Plan shape: what the optimizer must (and must not) produce for the jobs."""

import re

import pytest

from conftest import SF0001, SF001, rows
from workpanel.plans import pipelines as L
from workpanel.session import scratch_path
from workpanel.sources import fixtures as fx
from workpanel.sources.readers import read_education, read_positions
from workpanel.sources.writers import write_table


@pytest.fixture(scope="module")
def tables(spark):
    pos = write_table(fx.positions(spark, SF0001), scratch_path(spark, "plan_positions"))
    edu = write_table(fx.education(spark, SF0001), scratch_path(spark, "plan_education"))
    return read_positions(spark, pos), read_education(spark, edu)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


JOBS = {
    "L1": lambda P, E: L.resident_year(P, "India", "2002-01-01"),
    "L2": lambda P, E: L.resident_month(P, "India", "2002-01-01"),
    "L3": lambda P, E: L.mover_university_year(P, E, as_of="2002-01-01"),
    "L4": lambda P, E: L.mover_university_year(P, E, before="1990-01-01", as_of="2002-01-01"),
    "L5": lambda P, E: L.mover_origin_year(P, as_of="2002-01-01"),
    "L6": lambda P, E: L.mover_origin_year(P, education=E, before="1990-01-01",
                                           as_of="2002-01-01"),
    "L7": lambda P, E: L.education_profile(E),
}


@pytest.mark.parametrize("job", sorted(JOBS))
def test_no_global_sort_no_python_and_no_row_level_person_window(tables, job):
    P, E = tables
    text = plan(JOBS[job](P, E))
    assert "rangepartitioning" not in text          # no global sort
    assert "EvalPython" not in text                 # no Python UDF
    assert "FlatMapGroupsInPandas" not in text
    # the only window is the fill's lag over distinct (person, end date)
    for w in re.findall(r"Window \[.*", text):
        assert "_fill_key" in w, w


@pytest.mark.parametrize("job", ["L1", "L2"])
def test_country_filter_reaches_the_scan(tables, job):
    P, E = tables
    text = plan(JOBS[job](P, E))
    assert "EqualTo(country,India)" in text


def test_column_pruning_on_resident_job(tables):
    P, E = tables
    text = plan(JOBS["L1"](P, E))
    for s in re.findall(r"ReadSchema: struct<([^>]*)>", text):
        assert "metro_area" not in s and "location_raw" not in s


def test_movers_are_a_semi_join_not_a_key_list(tables):
    P, E = tables
    text = plan(L.mover_positions(P, "India", "United States"))
    assert "LeftSemi" in text
    assert not re.search(r"In(Set)?\(user_id", text)  # no literal key list


def test_ansi_defaults_are_kept(spark):
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"


def test_mover_rows_are_not_reshuffled_after_the_fill(spark, tables):
    """With sort-merge joins (what AQE picks when the movers do not fit the
    broadcast threshold) the per-person place joins the rows while they are
    still partitioned by person: no shuffle sits on top of the fill's union."""
    P, E = tables
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = JOBS["L5"](P, E)
        df.collect()
        final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    lines = [l for l in final.splitlines() if l.strip()]
    for i, line in enumerate(lines):
        if line.strip().startswith("+- Union") or line.strip().startswith(":- Union"):
            assert "Exchange hashpartitioning(user_id" not in lines[i - 1], lines[i - 1]
    assert "SortMergeJoin" in final


def test_aqe_splits_hot_keys_in_the_fill_and_city_joins(spark):
    """A hot location / hot person: both joins keep their own shuffles on
    both sides, so AQE's skew-join rule can split the hot partition."""
    from pyspark.sql import functions as F
    from workpanel.operators.places import attach_city, merge_city_mapper
    from workpanel.operators.spells import fill_start, parse_dates
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
            "spark.sql.adaptive.coalescePartitions.enabled": "false",
            "spark.sql.shuffle.partitions": "16"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        hot = F.xxhash64("position_id") % 3 == 0
        p = (fx.positions(spark, SF001)
             .withColumn("location_raw", F.when(hot, F.lit("Loc_1")).otherwise(F.col("location_raw")))
             .withColumn("metro_area", F.when(hot, F.lit("Metro_1")).otherwise(F.col("metro_area")))
             .withColumn("user_id", F.when(hot, F.lit(0)).otherwise(F.col("user_id")))
             .withColumn("startdate", F.when(hot & (F.xxhash64("enddate") % 2 == 0), F.lit(None))
                         .otherwise(F.col("startdate"))))
        P = read_positions(spark, write_table(p, scratch_path(spark, "plan_hot")))
        mapper = merge_city_mapper(fx.city_mapper_parts(spark, SF001))
        for df in (attach_city(P, mapper), fill_start(parse_dates(P))):
            df.collect()
            final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
            assert "SortMergeJoin(skew=true)" in final
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


@pytest.mark.parametrize("job", ["L3", "L4", "L5", "L6"])
def test_mover_jobs_scan_positions_twice(tables, monkeypatch, job):
    """Once for the counts per person, once for the movers' rows; the final
    plan reads staged tables only."""
    scans, stage = [], L.stage_table

    def positions_scans(df):  # only the raw table has location_raw
        text = df._jdf.queryExecution().analyzed().toString()
        return sum("location_raw" in l for l in text.splitlines() if "Relation [" in l)

    def counted(df):
        scans.append(positions_scans(df))
        return stage(df)

    P, E = tables
    kw = {"stage": counted, "as_of": "2002-01-01"}
    cut = {"before": "1990-01-01"} if job in ("L4", "L6") else {}
    df = (L.mover_university_year(P, E, **cut, **kw) if job in ("L3", "L4")
          else L.mover_origin_year(P, education=E, **cut, **kw))
    assert positions_scans(df) == 0
    assert sum(scans) == 2


@pytest.mark.parametrize("job", ["L1", "L2"])
def test_resident_jobs_scan_positions_once(tables, job):
    """One scan, with the country pushed to it, into the staged table; the final plan reads that alone."""
    scans, stage = [], L.stage_table

    def counted(df):
        scans.extend(re.findall(r"FileScan parquet \[.*", plan(df)))
        return stage(df)

    P, E = tables
    run = L.resident_year if job == "L1" else L.resident_month
    df = run(P, "India", "2002-01-01", stage=counted)
    assert len(scans) == 1 and "EqualTo(country,India)" in scans[0] and "location_raw" not in scans[0]
    final = plan(df)
    assert "onet_code" in final and "startdate" not in final  # positions are not read again
    assert rows(df) == rows(run(P, "India", "2002-01-01"))


@pytest.mark.parametrize("mode", ["as_coded", "forward"])
def test_one_scan_cells_of_hard_rows(spark, mode):
    """Missing, equal and null ends, people and salaries, and rows that repeat but for their id."""
    P = spark.createDataFrame(
        [(i, u, s, e, "India", "Goa" if i % 3 else None, "15-1", v) for i, (u, s, e, v) in enumerate(
            [(1, None, "2000-05-01", 10.0), (1, None, "2000-05-01", 10.0), (1, None, None, 3.25), (1, None, "1998-01-01", None),
             (1, "1999-01-01", "2001-01-01", 7.0), (2, None, None, 1.0), (None, None, "2000-01-01", 2.0),
             (None, None, "2001-01-01", 4.0), (3, "2001-06-01", "1999-01-01", 5.0), (3, "bad", "2001-12-31", 1 / 3),
             (4, None, None, None), (2, "2000-01-01", None, float("nan"))] * 2)],
        "position_id long, user_id long, startdate string, enddate string, country string, state string, onet_code string, salary double")
    text = lambda df: sorted(map(str, df.collect()))
    new = L.resident_year(P, "India", "2002-01-01", mode=mode, stage=L.stage_table)
    assert text(new) == text(L.resident_year(P, "India", "2002-01-01", mode=mode)) and new.count() > 5
    assert text(L.resident_month(P, "India", "2002-01-01", stage=L.stage_table)) == text(L.resident_month(P, "India", "2002-01-01"))
    assert L.resident_year(P.limit(0), "India", None, stage=L.stage_table).count() == 0


def test_forced_buckets_need_no_broadcast(spark, tables):
    P, E = tables
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(L.mover_origin_year(P, as_of="2002-01-01", hot_rows=0))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "BroadcastExchange" not in text and "_salt" in text

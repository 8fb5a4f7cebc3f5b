"""Hypothesis search for inputs where the fill rewrite and the window differ."""

from datetime import date

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import rows
from workpanel.operators.spells import END, START, fill_start, parse_dates

DAYS = [None, "empty", "2000-01-01", "2000-01-02", "2001-06-30", "1999-12-31"]
spell = st.tuples(st.sampled_from([None, 0, 1, 2]), st.sampled_from(DAYS),
                  st.sampled_from(DAYS))


@settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(spell, min_size=1, max_size=14), st.sampled_from(["start", "end"]))
def test_fill_start_matches_window_on_any_input(spark, data, order):
    df = parse_dates(spark.createDataFrame(
        [(u, f"p{i:02d}", s, e) for i, (u, s, e) in enumerate(data)],
        "user_id long, position_id string, startdate string, enddate string"))
    s, e = F.col(START), F.col(END)
    keys = ([s.asc_nulls_first()] if order == "start" else []) + [e.asc_nulls_first(),
                                                                   F.col("position_id")]
    plain = df.withColumn(START, F.coalesce(s, F.lag(END).over(
        Window.partitionBy("user_id").orderBy(*keys))))
    assert rows(fill_start(df, order=order), "position_id", START) == \
        rows(plain, "position_id", START)


def test_fill_start_leaves_dated_rows_alone(spark):
    df = parse_dates(spark.createDataFrame([(1, "a", "2000-01-01", None)],
                                           "user_id long, position_id string, "
                                           "startdate string, enddate string"))
    assert fill_start(df).first()[START] == date(2000, 1, 1)


row = st.tuples(st.sampled_from([None, 0, 1]), st.sampled_from([None, "2000-01-01", "2000-01-02",
                                                                 "1999-05-05"]),
                st.sampled_from([None, "S1", "S2"]))


@settings(max_examples=20, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(row, min_size=1, max_size=12))
def test_top1_and_running_last_match_windows(spark, data):
    from workpanel.operators.cohorts import running_last
    from workpanel.operators.topk import first_by
    df = spark.createDataFrame(
        [(u, f"p{i:02d}", d, s) for i, (u, d, s) in enumerate(data)],
        "user_id long, position_id string, d string, state string").withColumn(
        "end_date_dt", F.col("d").try_cast("date"))
    w = Window.partitionBy("user_id").orderBy(F.col("end_date_dt").desc_nulls_last(),
                                              "position_id")
    plain = (df.withColumn("rn", F.row_number().over(w)).filter("rn = 1")
             .select("user_id", "state"))
    order = [("end_date_dt", "desc", "last"), ("position_id", "asc", "last")]
    assert rows(first_by(df, "user_id", order, ["state"])) == rows(plain)
    peers = Window.partitionBy("user_id", "end_date_dt").orderBy(F.col("position_id").desc())
    want = df.withColumn("running_last_state", F.first("state").over(peers))
    assert rows(running_last(df), "position_id", "running_last_state") == \
        rows(want, "position_id", "running_last_state")

"""Distinct people per cell and period by a sweep, against counting every period of every spell."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from conftest import rows
from workpanel.operators.cells import month_cells, people_events, year_cells
from workpanel.operators.expand import expand_months, expand_years

R = random.Random(4)
SCHEMA = "user_id long, state string, salary double, startdate string, enddate string"


@pytest.fixture(scope="module")
def spells(spark):
    def day():
        return None if R.random() < 0.05 else f"{R.randrange(1990, 2004)}-{R.randrange(1, 13):02d}-{R.randrange(1, 29):02d}"

    out = [(R.choice([1, 2, 3, 4, 5, None]), R.choice(["a", "b", None]), R.choice([1.0, 2.5, None]), day(), day()) for _ in range(400)]
    out += out[:50]  # repeated spells
    out += [(9, "a", 1.0, f"{1990 + k % 10}-01-01", f"{1991 + k % 10}-06-01") for k in range(3000)]  # a hot person
    out += [(8, "c", None, "1990-01-01", "1995-01-01")]  # a cell without a value
    df = spark.createDataFrame(out, SCHEMA).repartition(3)
    return df.select("user_id", "state", "salary", F.to_date("startdate").alias("startdate_clean"), F.to_date("enddate").alias("enddate_clean"))


def counted(panel, period):
    """The panel's distinct people, straight from its rows."""
    return panel.groupBy("state", period).agg(
        F.round(F.avg("salary"), 9).alias("mean_salary"),
        F.count_distinct(F.when(F.col("salary").isNotNull(), F.col("user_id"))).alias("n_individuals"))


def plain(df):
    return rows(df.withColumn("mean_salary", F.round("mean_salary", 9)))


@pytest.mark.parametrize("mode", ["as_coded", "forward"])
@pytest.mark.parametrize("drop", [True, False])
def test_years(spells, mode, drop):
    kw = dict(start="startdate_clean", end="enddate_clean", mode=mode, drop_reversed=drop)
    got = year_cells(spells, ["state"], distinct_people=True, **kw)
    assert plain(got.select("state", "year", "mean_salary", "n_individuals")) == rows(counted(expand_years(spells, **kw), "year"))


def test_months(spells):
    kw = dict(start="startdate_clean", end="enddate_clean")
    panel = expand_months(spells, **kw).withColumn("year_month", F.date_format("year_month", "yyyy-MM"))
    got = month_cells(spells, ["state"], distinct_people=True, **kw)
    assert plain(got.select("state", "year_month", "mean_salary", "n_individuals")) == rows(counted(panel, "year_month"))


def test_events_of_one_person(spark):
    spans = [(1, 1, 3), (1, 2, 2), (1, 4, 6), (1, 9, 9), (1, 9, 9), (1, 5, 5), (2, 3, 4), (None, 1, 9), (3, 5, 4), (4, None, 2)]
    got = people_events(spark.createDataFrame([("x", *s) for s in spans], "cell string, p long, a int, z int"), ["cell"], "p", "a", "z", "t")
    assert rows(got) == [("x", 1, 1), ("x", 3, 1), ("x", 5, -1), ("x", 7, -1), ("x", 9, 1), ("x", 10, -1)]


def test_no_row_for_each_period_of_a_spell(spells):
    """Only combined spans are spread over periods: each Generate stands on an aggregate or on the intervals."""
    got = year_cells(spells, ["state"], start="startdate_clean", end="enddate_clean", distinct_people=True)
    text = got._jdf.queryExecution().executedPlan().toString()
    lines = text.split("\n")
    generates = [k for k, line in enumerate(lines) if "Generate explode" in line]
    assert len(generates) == 2
    for k in generates:
        below = next(line for line in lines[k + 1:] if re.search(r"HashAggregate|Window|Scan|Exchange", line))
        assert "HashAggregate" in below or "Window" in below, below
    assert "count(distinct" not in text


def test_empty(spells):
    assert year_cells(spells.limit(0), ["state"], start="startdate_clean", end="enddate_clean", distinct_people=True).count() == 0
    by_cell = defaultdict(int)
    for r in year_cells(spells, ["state"], start="startdate_clean", end="enddate_clean", distinct_people=True).collect():
        by_cell[r["state"]] = max(by_cell[r["state"]], r["n_individuals"])
    assert by_cell["c"] == 0

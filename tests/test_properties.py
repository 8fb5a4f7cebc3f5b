"""Properties over the derived fixtures."""

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from workpanel.operators.cohorts import last_place, latest_education, movers
from workpanel.operators.expand import expand_months
from workpanel.operators.places import attach_city, merge_city_mapper, split_located
from workpanel.plans import pipelines as L
from workpanel.sources import fixtures as fx


@pytest.fixture(scope="module")
def P(spark):
    return fx.positions(spark, SF001).cache()


@pytest.fixture(scope="module")
def E(spark):
    return fx.education(spark, SF001).cache()


def test_movers_are_people_with_both_countries(P):
    m = movers(P, "India", "United States")
    india = P.filter("country = 'India'").select("user_id").distinct()
    us = P.filter("country = 'United States'").select("user_id").distinct()
    assert m.subtract(india.intersect(us)).count() == 0
    assert india.intersect(us).subtract(m).count() == 0


def test_one_row_per_person(P, E):
    spells = L.mover_spells(P, "India", "United States", as_of="2002-01-01")
    for df in (L.education_profile(E), latest_education(E, "India"),
               last_place(spells, "India")):
        assert df.groupBy("user_id").count().filter("count > 1").count() == 0


def test_located_plus_unlocated_is_every_joined_row(spark, P):
    mapper = merge_city_mapper(fx.city_mapper_parts(spark, SF001))
    att = attach_city(P, mapper)
    located, unlocated = split_located(att)
    assert located.count() + unlocated.count() == att.count() == 61560


def test_merged_lookup_is_idempotent(spark):
    parts = fx.city_mapper_parts(spark, SF001)
    once = merge_city_mapper(parts)
    twice = merge_city_mapper([once, once])
    assert once.count() == twice.count() == 26
    assert once.subtract(twice).count() == 0


def test_month_rows_are_months_between_plus_one(P):
    spells = L.resident_spells(P, "India", "days:1095", "2002-01-01")
    expected = (spells.withColumn("m0", F.trunc("start_date_dt", "MM"))
                .withColumn("m1", F.trunc("end_date_dt", "MM"))
                .filter("m1 >= m0")
                .select(F.sum(F.months_between("m1", "m0").cast("long") + 1)).first()[0])
    assert expand_months(spells).count() == expected


def test_cells_count_every_salaried_panel_row(P):
    panel = L.resident_year_panel(P, "India", "2002-01-01")
    cells = L.resident_year(P, "India", "2002-01-01")
    assert (cells.agg(F.sum("n_individuals")).first()[0]
            == panel.filter(F.col("salary").isNotNull()).count())

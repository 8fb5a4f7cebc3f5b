"""SQL surface: register the cleaned tables as temporary views.

Lets a user keep writing the aggregation step as SQL, e.g.::

    register_views(spark, positions, education, as_of="2002-01-01")
    spark.sql("SELECT onet_code, state, year, AVG(salary) AS mean_salary, "
              "COUNT(salary) AS n_individuals FROM panel_year GROUP BY 1, 2, 3")

The views are session-scoped plans over the given DataFrames.  What several views or
several branches of one share is written when they are registered (``stage``): the
movers and their rows, so that any number of queries read positions for them twice in all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from workpanel.functions.codes import occupation_major
from workpanel.operators.expand import expand_months, expand_years
from workpanel.plans import pipelines as L


def register_views(spark: SparkSession, positions: DataFrame,
                   education: DataFrame | None = None, country: str = "India",
                   origin: str = "India", destination: str = "United States",
                   as_of=None, prefix: str = "", stage: L.Stage | None = L.stage_table) -> list[str]:
    """Register and return the view names:

    * ``resident_spells`` / ``panel_year`` / ``panel_month``: rows in
      ``country``, cleaned (3-year fallback for years, 1095 days for months),
      one row per spell, per spell-year, per spell-month (with ``onet_code_f2``);
    * ``mover_spells``: movers' rows, cleaned with the 1095-day fallback;
    * ``positions_with_origin``: their destination rows with ``last_origin_state``,
      joined by (person, bucket) so that a person with very many rows is spread;
    * ``last_origin_place``: ``user_id, last_origin_state``;
    * with ``education``: ``latest_education`` and ``education_wide``.

    ``stage=None`` writes nothing; each view then reads positions for itself.
    """
    spells_y = L.resident_spells(positions, country, "years:3", as_of)
    spells_m = L.resident_spells(positions, country, "days:1095", as_of)
    salted, hot = L.salted_mover_rows(positions, origin, destination, None, None, stage, False, L.AUTO)
    rows = salted if hot is None else salted.drop(L.SALT)
    views = {
        "resident_spells": spells_y,
        "panel_year": expand_years(spells_y),
        "panel_month": expand_months(spells_m).withColumn("onet_code_f2",
                                                          occupation_major("onet_code")),
        "mover_spells": L.clean_spells(rows, fallback="days:1095", as_of=as_of,
                                       key=L.KEY, tie=L.TIE),
        "positions_with_origin": L.spells_with_origin(salted, hot, origin, destination, as_of),
        "last_origin_place": L.last_origin_place(rows, origin, as_of=as_of),
    }
    if education is not None:
        views["latest_education"] = L.latest_education(education, origin)
        views["education_wide"] = L.education_profile(education)
    for name, df in views.items():
        df.createOrReplaceTempView(prefix + name)
    return [prefix + n for n in views]

"""The SQL surface gives the same cells as the pipelines."""

from conftest import SF0001, rows
from workpanel.plans import pipelines as L
from workpanel.plans.views import register_views
from workpanel.sources import fixtures as fx

MEAN = ("CASE WHEN COUNT(salary) > 0 THEN CAST(SUM(CAST(salary AS DECIMAL(18,2))) AS DOUBLE) "
        "/ COUNT(salary) END AS mean_salary, COUNT(salary) AS n_individuals")


def test_sql_over_views_matches_pipelines(spark):
    P, E = fx.positions(spark, SF0001), fx.education(spark, SF0001)
    names = register_views(spark, P, E, as_of="2002-01-01", prefix="t_")
    assert "t_panel_year" in names and "t_education_wide" in names
    year = spark.sql(f"SELECT onet_code, state, year, {MEAN} FROM t_panel_year GROUP BY 1, 2, 3")
    assert rows(year) == rows(L.resident_year(P, "India", "2002-01-01"))
    month = spark.sql(f"SELECT onet_code_f2, state, date_format(year_month, 'yyyy-MM') AS year_month, "
                      f"{MEAN} FROM t_panel_month GROUP BY 1, 2, 3")
    assert rows(month) == rows(L.resident_month(P, "India", "2002-01-01"))
    origin = spark.sql(f"""
        SELECT onet_code, last_origin_state, year, {MEAN}
        FROM (SELECT s.*, l.last_origin_state, explode(sequence(year(start_date_dt), year(end_date_dt) - 1)) AS year
              FROM t_mover_spells s LEFT JOIN t_last_origin_place l USING (user_id)
              WHERE country = 'United States' AND year(end_date_dt) >= year(start_date_dt))
        GROUP BY 1, 2, 3""")
    assert rows(origin) == rows(L.mover_origin_year(P, as_of="2002-01-01"))
    assert spark.table("t_education_wide").count() == 150

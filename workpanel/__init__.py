"""workpanel: work-history panels, mover cohorts, education profiles and
place look-ups as Spark DataFrame plans.

Typical use::

    from workpanel import read_positions, resident_year
    cells = resident_year(read_positions(spark, "<positions folder>"), "India")
    cells.write.parquet("<out>")
"""

from workpanel.operators.cells import cell_means, month_cells, year_cells
from workpanel.operators.clean import blank_sentinel
from workpanel.operators.cohorts import (keep_keys, last_place, latest_education,
                                         movers, person_counts, running_last)
from workpanel.operators.education import education_marked, education_wide
from workpanel.operators.expand import expand_months, expand_years
from workpanel.operators.places import (attach_city, mapper_conflicts, merge_city_mapper,
                                        split_located, unlocated_users)
from workpanel.operators.spells import (backfill_start, clean_spells, close_open, fill_start,
                                        parse_dates)
from workpanel.plans.pipelines import (city_mapper, education_profile, mover_origin_year,
                                       mover_positions, mover_university_year,
                                       positions_with_city, resident_month, resident_year)
from workpanel.sources.readers import read_city_mapper, read_education, read_positions
from workpanel.sources.writers import materialize, write_table

__all__ = [
    "attach_city", "backfill_start", "blank_sentinel", "cell_means", "city_mapper",
    "clean_spells", "close_open", "education_marked", "education_profile", "education_wide",
    "expand_months", "expand_years", "fill_start", "keep_keys", "last_place",
    "latest_education", "mapper_conflicts", "materialize", "merge_city_mapper", "month_cells",
    "mover_origin_year", "mover_positions", "mover_university_year", "movers",
    "parse_dates", "person_counts", "positions_with_city", "read_city_mapper", "read_education",
    "read_positions", "resident_month", "resident_year", "running_last", "split_located",
    "unlocated_users", "write_table", "year_cells",
]

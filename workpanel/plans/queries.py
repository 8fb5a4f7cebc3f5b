"""Registered queries: ``name -> f(spark, sf_dir) -> DataFrame``.

Every query reads the test tables under ``sf_dir`` (through the fixture
derivation) and runs over all of their rows.  Parameters are fixed so that
the DuckDB oracles in ``oracle_sql`` compute the same thing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from workpanel.functions.codes import education_level, occupation_major
from workpanel.functions.dates import month_floor
from workpanel.operators.clean import blank_sentinel
from workpanel.operators.cohorts import (last_place, latest_education, movers,
                                        running_last)
from workpanel.operators.education import LEVEL, education_marked
from workpanel.operators.places import (attach_city, mapper_conflicts, merge_city_mapper,
                                       union_parts)
from workpanel.operators.spells import (END, FLAG, START, backfill_start, close_open,
                                        fill_start, parse_dates)
from workpanel.plans import pipelines as L
from workpanel.plans.oracle_sql import AS_OF, CUTOFF, DESTINATION, ORIGIN
from workpanel.session import scratch_path
from workpanel.sources import fixtures as fx
from workpanel.sources.readers import (SOURCE_FILE, read_city_mapper, read_education,
                                       read_positions, with_source_file)
from workpanel.sources.writers import read_back, write_table

Query = Callable[[SparkSession, str], DataFrame]


def _pos(spark, d):
    return fx.positions(spark, d)


def _edu(spark, d):
    return fx.education(spark, d)


def _mapper(spark, d):
    return merge_city_mapper(fx.city_mapper_parts(spark, d))


# ---- scans and sinks (write a derived table, read it back) -------------------

def q_scan_positions(spark, d):
    path = write_table(_pos(spark, d), scratch_path(spark, "positions"))
    return read_positions(spark, path)


def q_scan_education(spark, d):
    path = write_table(_edu(spark, d), scratch_path(spark, "education"))
    return read_education(spark, path)


def q_scan_city_csv(spark, d):
    paths = [write_table(p, scratch_path(spark, f"city_part{i}"), fmt="csv")
             for i, p in enumerate(fx.city_mapper_parts(spark, d))]
    return read_city_mapper(spark, paths)


def q_scan_old_dates(spark, d):
    """Dates five centuries earlier, written and read as dates before 1582."""
    old = _edu(spark, d).withColumn("enddate", F.add_months(F.col("enddate").try_cast("date"), -6000))
    path = write_table(old, scratch_path(spark, "education_dates"))
    e = read_education(spark, path, rebase=True)
    return e.select("education_id", "user_id", F.col("enddate").alias("enddate_dt"))


def q_sink_csv_roundtrip(spark, d):
    cells = q_cell_state_year(spark, d)
    path = write_table(cells, scratch_path(spark, "cells_csv"), fmt="csv")
    return read_back(spark, path, "csv", cells.schema)


def q_sink_ignore_roundtrip(spark, d):
    panel = q_panel_year(spark, d)
    path = scratch_path(spark, "panel_csv")
    write_table(panel, path, fmt="csv", mode="ignore")
    write_table(panel.limit(0), path, fmt="csv", mode="ignore")  # present: a no-op
    return read_back(spark, path, "csv", panel.schema)


def q_sink_parquet_roundtrip(spark, d):
    cells = q_cell_state_month(spark, d)
    path = write_table(cells, scratch_path(spark, "cells_parquet"))
    return read_back(spark, path, "parquet", cells.schema)


def q_sink_single_csv(spark, d):
    cells = q_cell_origin_year(spark, d)
    path = write_table(cells, scratch_path(spark, "cells_sorted_csv"), fmt="csv",
                       ordered=["onet_code", "last_origin_state", "year"])
    return read_back(spark, path, "csv", cells.schema)


def q_sink_city_mapper_parquet(spark, d):
    """The merged look-up, written and read back."""
    mapper = _mapper(spark, d)
    return read_back(spark, write_table(mapper, scratch_path(spark, "city_mapper")), "parquet", mapper.schema)


def q_sink_located_by_file(spark, d):
    """Located rows, one output folder per input file."""
    src = write_table(_pos(spark, d), scratch_path(spark, "positions"))
    rows = with_source_file(read_positions(spark, src))
    located, _ = L.positions_with_city(rows, _mapper(spark, d), stage=L.stage_located)
    path = write_table(located.hint("rebalance", SOURCE_FILE), scratch_path(spark, "located"), partition_by=[SOURCE_FILE])
    return spark.read.parquet(path).drop(SOURCE_FILE)


def q_sink_unlocated_text(spark, d):
    """Ids of unlocated rows as lines of text."""
    _, users = L.positions_with_city(_pos(spark, d), _mapper(spark, d))
    path = write_table(users, scratch_path(spark, "unlocated"), fmt="text")
    return spark.read.text(path).select(F.col("value").cast("long").alias("user_id"))


# ---- spell cleaning steps ---------------------------------------------------

def q_parse_dates(spark, d):
    return parse_dates(_pos(spark, d)).select("position_id", START, END)


def q_fill_start(spark, d):
    return fill_start(parse_dates(_pos(spark, d))).select("position_id", "user_id", START, END)


def q_fill_start_end_order(spark, d):
    return (fill_start(parse_dates(_pos(spark, d)), order="end")
            .select("position_id", "user_id", START, END))


def q_close_open(spark, d):
    return close_open(parse_dates(_pos(spark, d)), as_of=AS_OF).select("position_id", END)


def _all_rows_clean(spark, d, fallback):
    p = close_open(fill_start(parse_dates(_pos(spark, d))), as_of=AS_OF)
    return backfill_start(p, fallback=fallback).select("position_id", "user_id", START, END, FLAG)


def q_backfill_years3(spark, d):
    return _all_rows_clean(spark, d, "years:3")


def q_backfill_days1095(spark, d):
    return _all_rows_clean(spark, d, "days:1095")


def q_start_flag(spark, d):
    return L.resident_spells(_pos(spark, d), ORIGIN, "years:3", AS_OF).select("position_id", FLAG)


def q_backfill_college(spark, d):
    pos = L.positions_with_education(_pos(spark, d), _edu(spark, d), ORIGIN, DESTINATION, stage=L.stage_table)
    p = close_open(fill_start(parse_dates(pos)), as_of=AS_OF)
    return (backfill_start(p, fallback="years:3", prefer="college_enddate")
            .select("position_id", START, "college_enddate", FLAG))


def q_month_floor(spark, d):
    p = parse_dates(_pos(spark, d))
    return p.select("position_id", month_floor(START).alias("start_year_month"),
                    month_floor(END).alias("end_year_month"))


def q_date_parts(spark, d):
    p = parse_dates(_pos(spark, d))
    return p.select("position_id", F.year(START).alias("start_year"),
                    F.month(START).alias("start_month"), F.year(END).alias("end_year"),
                    F.month(END).alias("end_month"))


def q_occupation_major(spark, d):
    return _pos(spark, d).select("position_id", "onet_code",
                                 occupation_major("onet_code").alias("onet_code_f2"))


def q_filter_country(spark, d):
    return _pos(spark, d).filter(F.col("country") == ORIGIN)


def q_blank_sentinel(spark, d):
    return blank_sentinel(_edu(spark, d))


# ---- panels and cells ---------------------------------------------------------

def q_panel_year(spark, d):
    return L.resident_year_panel(_pos(spark, d), ORIGIN, AS_OF)


def q_panel_year_no_reversed(spark, d):
    return L.resident_year_panel(_pos(spark, d), ORIGIN, AS_OF, drop_reversed=True)


def q_panel_year_forward(spark, d):
    return L.resident_year_panel(_pos(spark, d), ORIGIN, AS_OF, mode="forward")


def q_panel_month(spark, d):
    return L.resident_month_panel(_pos(spark, d), ORIGIN, AS_OF)


def q_cell_state_year(spark, d):
    return L.resident_year(_pos(spark, d), ORIGIN, AS_OF, stage=L.stage_table)


def q_cell_state_year_forward(spark, d):
    return L.resident_year(_pos(spark, d), ORIGIN, AS_OF, mode="forward", stage=L.stage_table)


def q_cell_state_year_people(spark, d):
    return L.resident_year(_pos(spark, d), ORIGIN, AS_OF, distinct_people=True, stage=L.stage_table)


def q_cell_state_year_fractions(spark, d):
    """L1 with salaries in eighths: values beyond two decimals count in full."""
    pos = _pos(spark, d).withColumn("salary", F.floor("salary").cast("double") / 8)
    return L.resident_year(pos, ORIGIN, AS_OF, stage=L.stage_table)


def q_sql_cell_means(spark, d):
    """The reference's SQL surface: the panel as a temp view, then GROUP BY."""
    panel = q_panel_year(spark, d)
    panel.createOrReplaceTempView("workpanel_state_year_panel")
    return spark.sql("""
        SELECT onet_code, state, year,
               CASE WHEN COUNT(salary) > 0
                    THEN CAST(SUM(CAST(salary AS DECIMAL(18,2))) AS DOUBLE) / COUNT(salary)
               END AS mean_salary,
               COUNT(salary) AS n_individuals
        FROM workpanel_state_year_panel
        GROUP BY onet_code, state, year""")


def q_sql_cell_origin_year(spark, d):
    """L5 written as SQL over the registered views (``plans.views``)."""
    from workpanel.plans.views import register_views
    register_views(spark, _pos(spark, d), as_of=AS_OF, prefix="wp_")
    return spark.sql("""
        SELECT onet_code, last_origin_state, year,
               CASE WHEN COUNT(salary) > 0
                    THEN CAST(SUM(CAST(salary AS DECIMAL(18,2))) AS DOUBLE) / COUNT(salary)
               END AS mean_salary,
               COUNT(salary) AS n_individuals
        FROM (SELECT onet_code, salary, last_origin_state,
                     explode(sequence(year(start_date_dt), year(end_date_dt) - 1)) AS year
              FROM wp_positions_with_origin
              WHERE year(end_date_dt) >= year(start_date_dt)) t
        GROUP BY onet_code, last_origin_state, year""")


def q_cell_state_month(spark, d):
    return L.resident_month(_pos(spark, d), ORIGIN, AS_OF, stage=L.stage_table)


def q_cell_university_year(spark, d):
    return L.mover_university_year(_pos(spark, d), _edu(spark, d), ORIGIN, DESTINATION,
                                   as_of=AS_OF)


def q_cell_university_year_pre(spark, d):
    return L.mover_university_year(_pos(spark, d), _edu(spark, d), ORIGIN, DESTINATION,
                                   before=CUTOFF, as_of=AS_OF)


def q_cell_origin_year(spark, d):
    return L.mover_origin_year(_pos(spark, d), ORIGIN, DESTINATION, as_of=AS_OF)


def q_cell_origin_year_ordered(spark, d):
    return L.mover_origin_year(_pos(spark, d), ORIGIN, DESTINATION, as_of=AS_OF, ordered=True)


def q_cell_state_year_no_ids(spark, d):
    """L1 on positions without a row id."""
    return L.resident_year(_pos(spark, d).drop("position_id"), ORIGIN, AS_OF)


def q_cell_origin_year_no_ids(spark, d):
    """L5 on positions without a row id."""
    return L.mover_origin_year(_pos(spark, d).drop("position_id"), ORIGIN, DESTINATION, as_of=AS_OF)


def q_cell_state_month_people(spark, d):
    return L.resident_month(_pos(spark, d), ORIGIN, AS_OF, distinct_people=True, stage=L.stage_table)


def q_cell_origin_year_spread(spark, d):
    """L5 with every mover treated as hot: all rows spread over buckets."""
    return L.mover_origin_year(_pos(spark, d), ORIGIN, DESTINATION, as_of=AS_OF, hot_rows=0)


def q_cell_university_year_pre_spread(spark, d):
    """L4 with every mover treated as hot."""
    return L.mover_university_year(_pos(spark, d), _edu(spark, d), ORIGIN, DESTINATION,
                                   before=CUTOFF, as_of=AS_OF, hot_rows=0)


def q_cell_state_year_end_order(spark, d):
    """L1 with the fill ordered by end date (the previous job donates)."""
    return L.resident_year(_pos(spark, d), ORIGIN, AS_OF, order="end", stage=L.stage_table)


def q_cell_origin_year_pre(spark, d):
    return L.mover_origin_year(_pos(spark, d), ORIGIN, DESTINATION, education=_edu(spark, d),
                               before=CUTOFF, as_of=AS_OF)


def _stream_source(spark, rows, path, mode="errorifexists"):
    """Position files for streams that take one a batch: a file a core at most, or one
    for 20 million rows, so that batches do not grow with the table, and each of many
    small row groups, so that all cores read it."""
    return write_table(rows.coalesce(spark.sparkContext.defaultParallelism), path, mode=mode,
                       max_records_per_file=20_000_000, row_group_bytes=4 << 20)


def q_stream_cell_state_year(spark, d):
    """Structured Streaming: the positions arrive as Parquet files; the
    stateless cleaning and the cell aggregate run as a streaming query."""
    from workpanel.streaming.panel_stream import (latest_snapshot, read_positions_stream,
                                                  stream_year_cells, write_snapshots)
    src = _stream_source(spark, _pos(spark, d), scratch_path(spark, "stream_src"))
    out = scratch_path(spark, "stream_cells")
    cells = stream_year_cells(read_positions_stream(spark, src, max_files_per_trigger=1),
                              ORIGIN, as_of=AS_OF)
    write_snapshots(cells, out).awaitTermination()
    return latest_snapshot(spark, out)


def q_stream_cell_state_year_changes(spark, d):
    """The same in update mode: every batch writes the cells it changed, merged by cell
    when read.  The stream stops after half of the files and is started again."""
    from workpanel.streaming.panel_stream import (merged_changes, read_positions_stream,
                                                  stream_year_cells, write_changes)
    src, out, checkpoint = (scratch_path(spark, f"stream_{x}") for x in ("src", "changes", "checkpoint"))
    half = F.col("user_id") % 2 == 0
    for mode, part in (("errorifexists", half), ("append", F.coalesce(~half, F.lit(True)))):
        _stream_source(spark, _pos(spark, d).filter(part), src, mode)
        cells = stream_year_cells(read_positions_stream(spark, src, max_files_per_trigger=1), ORIGIN, as_of=AS_OF)
        write_changes(cells, out, checkpoint).awaitTermination()
    return merged_changes(spark, out, ["onet_code", "state", "year"])


def q_stream_located_rows(spark, d):
    """Structured Streaming: position files arrive; each row is joined to the
    static look-up and located rows are appended to Parquet."""
    from workpanel.streaming.panel_stream import (read_positions_stream, stream_located,
                                                  write_appends)
    src = _stream_source(spark, _pos(spark, d), scratch_path(spark, "stream_src"))
    out = scratch_path(spark, "stream_located")
    rows = read_positions_stream(spark, src, max_files_per_trigger=1)
    write_appends(stream_located(rows, _mapper(spark, d)), out).awaitTermination()
    return spark.read.parquet(out)


# ---- cohorts --------------------------------------------------------------------

def q_movers(spark, d):
    return movers(_pos(spark, d), ORIGIN, DESTINATION)


def q_movers_ordered(spark, d):
    p = parse_dates(_pos(spark, d))
    return movers(p, ORIGIN, DESTINATION, ordered=True, start=START)


def q_movers_positions(spark, d):
    return L.mover_positions(_pos(spark, d), ORIGIN, DESTINATION)


def q_latest_education(spark, d):
    return latest_education(_edu(spark, d), ORIGIN)


def q_education_before(spark, d):
    return latest_education(_edu(spark, d), ORIGIN, before=CUTOFF)


def q_positions_with_education(spark, d):
    return L.positions_with_education(_pos(spark, d), _edu(spark, d), ORIGIN, DESTINATION, keys_stage=L.stage_table)


def _mover_spells(spark, d):
    return L.mover_spells(_pos(spark, d), ORIGIN, DESTINATION, as_of=AS_OF)


def q_last_origin_state(spark, d):
    return last_place(_mover_spells(spark, d), ORIGIN)


def q_last_origin_state_unfilled(spark, d):
    """Same answer from the raw rows (no start-date fill needed)."""
    rows = L.mover_rows(_pos(spark, d), ORIGIN, DESTINATION, keys_stage=L.stage_table)
    return L.last_origin_place(rows, ORIGIN, as_of=AS_OF)


def q_positions_with_origin(spark, d):
    return L.positions_with_origin(_pos(spark, d), ORIGIN, DESTINATION, as_of=AS_OF)


def q_running_last_state(spark, d):
    home = _mover_spells(spark, d).filter(F.col("country") == ORIGIN)
    return running_last(home).select("position_id", "user_id", END, "state",
                                      "running_last_state")


# ---- education ------------------------------------------------------------------

def q_education_level(spark, d):
    return _edu(spark, d).select("education_id", "degree", education_level("degree").alias(LEVEL))


def q_education_marked(spark, d):
    return education_marked(_edu(spark, d))


def q_education_wide(spark, d):
    return L.education_profile(_edu(spark, d))


def q_education_wide_clean_first(spark, d):
    return L.education_profile(_edu(spark, d), clean_first=True)


def q_distinct_degrees(spark, d):
    return _edu(spark, d).select("degree").distinct()


# ---- places ---------------------------------------------------------------------

def q_city_mapper_union(spark, d):
    return union_parts(fx.city_mapper_parts(spark, d))


def q_city_mapper_merged(spark, d):
    return L.city_mapper(fx.city_mapper_parts(spark, d))


def q_mapper_conflicts(spark, d):
    return mapper_conflicts(_mapper(spark, d))


def q_attach_city(spark, d):
    return attach_city(_pos(spark, d), _mapper(spark, d))


def q_located_rows(spark, d):
    return L.positions_with_city(_pos(spark, d), _mapper(spark, d))[0]


def q_unlocated_users(spark, d):
    return L.positions_with_city(_pos(spark, d), _mapper(spark, d))[1]


def q_attach_city_plain_eq_located(spark, d):
    return L.positions_with_city(_pos(spark, d), _mapper(spark, d), null_safe=False)[0]


QUERIES: dict[str, Query] = {
    name[2:]: fn for name, fn in sorted(globals().items())
    if name.startswith("q_") and callable(fn)
}

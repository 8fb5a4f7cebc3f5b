"""Command-line entry for ``spark-submit``.

    spark-submit --py-files workpanel.zip workpanel/jobs.py resident-year \
        --positions <positions folder> --country India --out <folder> --format csv

Cluster sizing (executors, memory, cores) belongs to ``spark-submit`` /
the cluster's defaults, not to this code.  The job reads
``spark.checkpoint.dir`` from the session for its intermediate tables.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession

from workpanel.operators.cells import year_cells
from workpanel.operators.expand import expand_years
from workpanel.operators.places import mapper_conflicts
from workpanel.operators.skew import AUTO
from workpanel.plans import pipelines as L
from workpanel.session import build_session
from workpanel.sources.readers import (SOURCE_FILE, read_city_mapper, read_education,
                                       read_positions, with_source_file)
from workpanel.sources.writers import discard_staged, materialize, write_table


def _cells(p: argparse.ArgumentParser) -> None:
    p.add_argument("--fill-order", choices=["start", "end"], default="start",
                   help="order of spells in the fill of missing starts")
    p.add_argument("--plain-mean", action="store_true",
                   help="sum salaries as doubles only (default: cents exactly, others as doubles)")


def _cell_options(a) -> dict:
    return {"order": a.fill_order, "exact_scale": None if a.plain_mean else 2,
            "distinct_people": a.distinct_people}


def _common(p: argparse.ArgumentParser) -> None:
    p.add_argument("--out", required=True, help="output folder")
    p.add_argument("--format", choices=["csv", "parquet", "text"], default="parquet")
    p.add_argument("--mode", default="errorifexists",
                   choices=["errorifexists", "ignore", "overwrite", "append"])
    p.add_argument("--as-of", default=None,
                   help="date that closes open spells (default: today)")
    p.add_argument("--partition-by", nargs="*", default=None)


def _movers(p: argparse.ArgumentParser) -> None:
    p.add_argument("--positions", required=True)
    p.add_argument("--origin", default="India")
    p.add_argument("--destination", default="United States")
    p.add_argument("--education", default=None)
    p.add_argument("--before", default=None, help="keep people whose latest home degree "
                                                  "ended before this date")
    p.add_argument("--no-stage", action="store_true",
                   help="do not write the movers' rows to the checkpoint folder first")
    p.add_argument("--ordered", action="store_true",
                   help="movers only if the first origin job started before the last "
                        "destination job")
    p.add_argument("--years", choices=["as_coded", "forward"], default="as_coded")
    p.add_argument("--distinct-people", action="store_true")
    _cells(p)
    p.add_argument("--hot-rows", type=int, default=None,
                   help="people with more rows than this are spread over buckets in the "
                        "per-person joins; -1 turns spreading off")


def parser() -> argparse.ArgumentParser:
    ap = argparse.ArgumentParser(prog="workpanel")
    sub = ap.add_subparsers(dest="job", required=True)

    p = sub.add_parser("resident-year", help="L1: cells by occupation, state, year")
    p.add_argument("--positions", required=True)
    p.add_argument("--country", default="India")
    p.add_argument("--years", choices=["as_coded", "forward"], default="as_coded")
    p.add_argument("--distinct-people", action="store_true")
    _cells(p)
    p.add_argument("--panel-out", default=None,
                   help="also write the year panel here (skipped if it exists)")
    _common(p)

    p = sub.add_parser("resident-month", help="L2: cells by major group, state, month")
    p.add_argument("--positions", required=True)
    p.add_argument("--country", default="India")
    p.add_argument("--distinct-people", action="store_true")
    _cells(p)
    _common(p)

    p = sub.add_parser("mover-university-year", help="L3/L4: cells by university location")
    _movers(p)
    _common(p)

    p = sub.add_parser("mover-origin-year", help="L5/L6: cells by last origin place")
    _movers(p)
    p.add_argument("--place", default="state")
    p.add_argument("--place-name", default="last_origin_state")
    _common(p)

    p = sub.add_parser("education-wide", help="L7: one row per person")
    p.add_argument("--education", required=True)
    p.add_argument("--order", choices=["latest", "any"], default="latest")
    p.add_argument("--clean-first", action="store_true")
    _common(p)

    p = sub.add_parser("city-mapper", help="L8: merge city look-up CSV parts")
    p.add_argument("--city-csv", nargs="+", required=True)
    p.add_argument("--conflicts-out", default=None)
    _common(p)

    p = sub.add_parser("positions-with-city", help="L9: located rows and unlocated users")
    p.add_argument("--positions", required=True)
    p.add_argument("--mapper", default=None, help="merged look-up (Parquet)")
    p.add_argument("--city-csv", nargs="*", default=None)
    p.add_argument("--unlocated-out", required=True)
    p.add_argument("--plain-keys", action="store_true", help="null keys do not match")
    p.add_argument("--by-source-file", action="store_true",
                   help="one output folder per positions file (source_file=...)")
    _common(p)
    return ap


def _write(df: DataFrame, a, path: str | None = None, mode: str | None = None) -> None:
    # a side output may lack the columns that the main one is partitioned by
    write_table(df, path or a.out, fmt=a.format, mode=mode or a.mode,
                partition_by=None if path else a.partition_by)


def _stage(spark: SparkSession, a):
    """Write the movers' rows once so the later branches re-read that small
    table instead of the full positions."""
    if a.no_stage:
        return None
    return lambda df: materialize(spark, df, "mover_rows")


def _hot_rows(a) -> int | str | None:
    if a.hot_rows is None:
        return AUTO
    return None if a.hot_rows < 0 else a.hot_rows


def run(spark: SparkSession, a) -> None:
    if a.job == "resident-year":
        pos = read_positions(spark, a.positions)
        if a.panel_out:
            # Two outputs from one cleaning pass: stage the spells once.
            spells = L.resident_spells(pos, a.country, "years:3", a.as_of, a.fill_order)
            spells = materialize(spark, spells, "resident_spells")
            _write(expand_years(spells, mode=a.years), a, a.panel_out, mode="ignore")
            _write(year_cells(spells, ["onet_code", "state"], mode=a.years,
                              distinct_people=a.distinct_people,
                              exact_scale=None if a.plain_mean else 2), a)
        else:
            _write(L.resident_year(pos, a.country, a.as_of, a.years, stage=L.stage_table, **_cell_options(a)), a)
    elif a.job == "resident-month":
        _write(L.resident_month(read_positions(spark, a.positions), a.country, a.as_of, stage=L.stage_table,
                                **_cell_options(a)), a)
    elif a.job == "mover-university-year":
        if a.education is None:
            raise SystemExit("--education is required")
        _write(L.mover_university_year(
            read_positions(spark, a.positions), read_education(spark, a.education),
            a.origin, a.destination, a.before, a.as_of, stage=_stage(spark, a),
            ordered=a.ordered, mode=a.years, hot_rows=_hot_rows(a),
            **_cell_options(a)), a)
    elif a.job == "mover-origin-year":
        edu = read_education(spark, a.education) if a.education else None
        _write(L.mover_origin_year(
            read_positions(spark, a.positions), a.origin, a.destination, edu, a.before,
            a.as_of, a.place, a.place_name, stage=_stage(spark, a), ordered=a.ordered,
            mode=a.years, hot_rows=_hot_rows(a), **_cell_options(a)), a)
    elif a.job == "education-wide":
        _write(L.education_profile(read_education(spark, a.education), order=a.order,
                                   clean_first=a.clean_first), a)
    elif a.job == "city-mapper":
        mapper = L.city_mapper([read_city_mapper(spark, a.city_csv)])
        if a.conflicts_out:
            mapper = materialize(spark, mapper, "city_mapper")
            _write(mapper_conflicts(mapper), a, a.conflicts_out)
        _write(mapper, a)
    elif a.job == "positions-with-city":
        if a.mapper:
            mapper = spark.read.parquet(a.mapper)
        elif a.city_csv:
            # two outputs read the look-up: merge the CSV parts once
            mapper = materialize(spark, L.city_mapper([read_city_mapper(spark, a.city_csv)]), "city_mapper")
        else:
            raise SystemExit("give --mapper or --city-csv")
        pos = read_positions(spark, a.positions)
        if a.by_source_file:
            pos = with_source_file(pos)
            a.partition_by = (a.partition_by or []) + [SOURCE_FILE]
        # both outputs from one pass over the positions
        located, unlocated = L.positions_with_city(pos, mapper, not a.plain_keys, L.stage_located)
        if a.by_source_file:  # a file or a few for each input file, not one from every task
            located = located.hint("rebalance", SOURCE_FILE)
        _write(located, a)
        # one user id per line, repeats kept (one per unlocated row)
        write_table(unlocated, a.unlocated_out, fmt="text", mode=a.mode)


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = build_session(app=f"workpanel-{a.job}")
    try:
        run(spark, a)
    finally:
        discard_staged(spark)
    return 0


if __name__ == "__main__":
    sys.exit(main())

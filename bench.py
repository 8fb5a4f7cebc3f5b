"""Benchmark the nine jobs (L1-L9) at one scale factor.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

The work-history tables are first derived from the test tables and written
as Parquet under the shared checkpoint folder (timed apart as ``prepare``);
each job then reads them like a production run reads its Parquet folders
and is executed to the end with the ``noop`` sink (no driver collect).
Reported per job: median of ``BENCH_REPEAT`` (default 5) warm runs; beside
them, ``plain_forms`` times the straightforward plans for comparison
(``BENCH_PLAIN=0`` skips them, ``BENCH_PLAIN=all`` adds the slow key-list one).
Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from workpanel.plans import pipelines as L  # noqa: E402
from workpanel.plans.oracle_sql import AS_OF, CUTOFF, DESTINATION, ORIGIN  # noqa: E402
from workpanel.session import build_session, scratch_path  # noqa: E402
from workpanel.sources import fixtures as fx  # noqa: E402
from workpanel.sources.readers import read_city_mapper, read_education, read_positions  # noqa: E402
from workpanel.sources.writers import write_table  # noqa: E402


def prepare(spark, sf_dir):
    pos = write_table(fx.positions(spark, sf_dir), scratch_path(spark, "bench_positions"))
    edu = write_table(fx.education(spark, sf_dir), scratch_path(spark, "bench_education"))
    maps = [write_table(p, scratch_path(spark, f"bench_city{i}"), fmt="csv")
            for i, p in enumerate(fx.city_mapper_parts(spark, sf_dir))]
    return pos, edu, maps


def jobs(spark, pos_path, edu_path, map_paths):
    P = lambda: read_positions(spark, pos_path)
    E = lambda: read_education(spark, edu_path)
    M = lambda: L.city_mapper([read_city_mapper(spark, p) for p in map_paths])
    return {
        "L1_cell_state_year": lambda: L.resident_year(P(), ORIGIN, AS_OF, stage=L.stage_table),
        "L2_cell_state_month": lambda: L.resident_month(P(), ORIGIN, AS_OF, stage=L.stage_table),
        "L3_cell_university_year": lambda: L.mover_university_year(
            P(), E(), ORIGIN, DESTINATION, as_of=AS_OF),
        "L4_cell_university_year_pre": lambda: L.mover_university_year(
            P(), E(), ORIGIN, DESTINATION, before=CUTOFF, as_of=AS_OF),
        "L5_cell_origin_year": lambda: L.mover_origin_year(P(), ORIGIN, DESTINATION, as_of=AS_OF),
        "L6_cell_origin_year_pre": lambda: L.mover_origin_year(
            P(), ORIGIN, DESTINATION, education=E(), before=CUTOFF, as_of=AS_OF),
        "L7_education_wide": lambda: L.education_profile(E()),
        "L8_city_mapper_merged": M,
        "L9_located_rows": lambda: L.positions_with_city(P(), M())[0],
        "L9_unlocated_users": lambda: L.positions_with_city(P(), M())[1],
        "L1_panel_year": lambda: L.resident_year_panel(P(), ORIGIN, AS_OF),
    }


def plain_forms(spark, pos_path, edu_path, map_paths):
    """The straightforward plans, for comparison only: a global sort before a
    per-person window, the window ``lag`` fill, a self-join for the movers, a
    ``row_number`` top-1, a Python UDF and ``dropDuplicates``.  Same results as the jobs above
    but for ties (checked in tests/test_rewrites.py for the window parts).
    ``L5_key_list`` collects the movers to the driver and ships them back as ``isin``."""
    from functools import reduce

    from pyspark.sql import Window
    from pyspark.sql import functions as F
    from workpanel.functions.codes import KEPT_DEGREES, OTHER_LEVEL, occupation_major
    from workpanel.functions.dates import parse_date
    from workpanel.operators.cells import cell_means
    from workpanel.operators.education import WIDE_COLUMNS, education_marked
    from workpanel.operators.expand import expand_months, expand_years
    from workpanel.operators.spells import END, START, backfill_start, close_open, parse_dates

    def window_clean(df, fallback, **kw):
        df = parse_dates(df).orderBy("user_id", START)
        w = Window.partitionBy("user_id").orderBy(START)
        df = df.withColumn(START, F.coalesce(F.col(START), F.lag(END).over(w)))
        return backfill_start(close_open(df, as_of=AS_OF), fallback=fallback, **kw)

    def residents():
        return read_positions(spark, pos_path).filter(F.col("country") == ORIGIN)

    def l1():
        return cell_means(expand_years(window_clean(residents(), "years:3")), ["onet_code", "state", "year"])

    def l2():
        s = expand_months(window_clean(residents(), "days:1095")).withColumn("onet_code_f2", occupation_major("onet_code"))
        return cell_means(s.withColumn("year_month", F.date_format("year_month", "yyyy-MM")), ["onet_code_f2", "state", "year_month"])

    def mover_ids(p):
        a = p.filter(F.col("country") == ORIGIN).select("user_id")
        return a.join(p.filter(F.col("country") == DESTINATION).select("user_id"), "user_id").select("user_id")

    def mover_rows():
        p = read_positions(spark, pos_path)
        return p.join(mover_ids(p).distinct(), "user_id", "left_semi")

    def latest_degree(before):
        e = read_education(spark, edu_path).filter(F.col("university_country") == ORIGIN)
        w = Window.partitionBy("user_id").orderBy(F.col("college_enddate").desc_nulls_last())
        e = (e.withColumn("college_enddate", parse_date("enddate")).withColumn("rn", F.row_number().over(w)).filter("rn = 1")
             .select("user_id", "college_enddate", "university_location"))
        return e if before is None else e.filter(F.col("college_enddate") < F.lit(before).cast("date"))

    def university(before=None):
        rows = mover_rows().join(latest_degree(before), "user_id", "left" if before is None else "inner")
        s = window_clean(rows, "years:3", prefer="college_enddate").filter(F.col("country") == DESTINATION)
        return cell_means(expand_years(s), ["onet_code", "university_location", "year"])

    def origin(rows):
        s = window_clean(rows, "days:1095")
        w = Window.partitionBy("user_id").orderBy(F.col(END).desc())
        home = (s.filter(F.col("country") == ORIGIN).orderBy("user_id", END)
                .withColumn("rn", F.row_number().over(w)).filter("rn = 1")
                .select("user_id", F.col("state").alias("last_origin_state")))
        d = s.filter(F.col("country") == DESTINATION).join(home, "user_id", "left")
        d = expand_years(d, drop_reversed=True)
        return cell_means(d, ["onet_code", "last_origin_state", "year"])

    def key_list():
        p = read_positions(spark, pos_path)
        ids = [r[0] for r in mover_ids(p).collect()]
        return origin(p.filter(F.col("user_id").isin(ids)))

    def l7():
        level = F.udf(lambda x: x if x in KEPT_DEGREES else OTHER_LEVEL, "string")
        e = read_education(spark, edu_path).withColumn("degree", level("degree"))
        m = education_marked(e)
        return m.groupBy("user_id").agg(*[F.first(c, ignorenulls=True).alias(c)
                                          for c in WIDE_COLUMNS])

    def l8():
        parts = [read_city_mapper(spark, p) for p in map_paths]
        return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts).dropDuplicates()

    def l9(located):
        p, m = read_positions(spark, pos_path), l8().withColumnsRenamed({"metro_area": "m"})
        j = p.join(m, (p.location_raw == m.location) & (p.metro_area == m.m), "left")
        here = F.coalesce((F.col("location") != "empty") & (F.col("city") != "empty"), F.lit(False))
        return j.filter(here) if located else j.filter(~here).select("user_id")

    return {"L1_cell_state_year": l1, "L2_cell_state_month": l2, "L3_cell_university_year": university,
            "L4_cell_university_year_pre": lambda: university(CUTOFF), "L5_cell_origin_year": lambda: origin(mover_rows()),
            "L6_cell_origin_year_pre": lambda: origin(mover_rows().join(latest_degree(CUTOFF).select("user_id"), "user_id", "left_semi")),
            "L7_education_wide": l7, "L8_city_mapper_merged": l8, "L9_located_rows": lambda: l9(True),
            "L9_unlocated_users": lambda: l9(False), "L5_key_list": key_list}


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "5"))
    spark = build_session(f"local[{cpus}]", shuffle_partitions=cpus * 2,
                          extra={"spark.driver.memory": os.environ.get("BENCH_MEM", "16g")})
    t0 = time.time()
    paths = prepare(spark, sf_dir)
    prep = time.time() - t0
    times = {}
    for name, make in jobs(spark, *paths).items():
        run(make())  # warm-up
        runs = []
        for _ in range(repeat):
            t = time.time()
            run(make())
            runs.append(time.time() - t)
        times[name] = round(statistics.median(runs), 3)
    plain = {}
    which = os.environ.get("BENCH_PLAIN", "1")  # "0": none, "1": fast ones, "all"
    if which != "0":
        for name, make in plain_forms(spark, *paths).items():
            if name == "L5_key_list" and which != "all":
                continue  # the shipped key list takes minutes (382 s at sf0.1)
            run(make())
            runs = []
            for _ in range(min(repeat, 3)):
                t = time.time()
                run(make())
                runs.append(time.time() - t)
            plain[name] = round(statistics.median(runs), 3)
    sf = os.path.basename(sf_dir).removeprefix("sf")
    print(json.dumps({
        "metric": "sum of median job seconds (L1-L9)",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "prepare_sec": round(prep, 3),
        "plain_forms": plain,
        "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
        "cpus": cpus,
        "repeat": repeat,
    }))
    spark.stop()


if __name__ == "__main__":
    main()

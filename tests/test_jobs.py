"""End to end through the command-line entry."""

from conftest import SF0001, rows
from workpanel import jobs
from workpanel.plans.queries import QUERIES
from workpanel.session import scratch_path
from workpanel.sources import fixtures as fx
from workpanel.sources.writers import write_table


def test_cli_jobs_match_registered_queries(spark):
    pos = write_table(fx.positions(spark, SF0001), scratch_path(spark, "cli_pos"))
    edu = write_table(fx.education(spark, SF0001), scratch_path(spark, "cli_edu"))
    parts = [write_table(p, scratch_path(spark, f"cli_city{i}"), fmt="csv")
             for i, p in enumerate(fx.city_mapper_parts(spark, SF0001))]
    out = {k: scratch_path(spark, f"cli_{k}") for k in
           ["ly", "panel", "st", "sp", "ed", "co", "cm", "conf", "loc", "unloc"]}
    base = ["--as-of", "2002-01-01"]
    jobs.main(["resident-year", "--positions", pos, "--out", out["ly"],
               "--panel-out", out["panel"]] + base)
    jobs.main(["mover-origin-year", "--positions", pos, "--out", out["st"], "--hot-rows", "20"]
              + base)
    jobs.main(["mover-origin-year", "--positions", pos, "--education", edu, "--before",
               "1990-01-01", "--out", out["sp"], "--no-stage"] + base)
    jobs.main(["mover-university-year", "--positions", pos, "--education", edu,
               "--out", out["ed"]] + base)
    jobs.main(["education-wide", "--education", edu, "--out", out["co"]])
    jobs.main(["city-mapper", "--city-csv", *parts, "--out", out["cm"],
               "--conflicts-out", out["conf"]])
    jobs.main(["positions-with-city", "--positions", pos, "--mapper", out["cm"],
               "--out", out["loc"], "--unlocated-out", out["unloc"]])
    read = spark.read.parquet
    same = [("ly", "cell_state_year"), ("panel", "panel_year"), ("st", "cell_origin_year"),
            ("sp", "cell_origin_year_pre"), ("ed", "cell_university_year"),
            ("co", "education_wide"), ("cm", "city_mapper_merged"),
            ("conf", "mapper_conflicts"), ("loc", "located_rows"), ("unloc", "unlocated_users")]
    for key, q in same:
        expected = QUERIES[q](spark, SF0001)
        if key == "unloc":
            got = spark.read.schema("user_id long").csv(out[key])
        else:
            got = read(out[key]).select(*expected.columns)
        assert rows(got) == rows(expected), key


def test_cli_keeps_one_folder_per_positions_file(spark):
    pos_df = fx.positions(spark, SF0001).repartition(3)
    pos = write_table(pos_df, scratch_path(spark, "cli_pos_files"))
    parts = [write_table(p, scratch_path(spark, f"cli_cityf{i}"), fmt="csv")
             for i, p in enumerate(fx.city_mapper_parts(spark, SF0001))]
    loc, unloc = scratch_path(spark, "cli_loc_files"), scratch_path(spark, "cli_unloc_files")
    jobs.main(["positions-with-city", "--positions", pos, "--city-csv", *parts,
               "--out", loc, "--unlocated-out", unloc, "--by-source-file"])
    got = spark.read.parquet(loc)
    assert got.select("source_file").distinct().count() == 3
    assert got.count() == QUERIES["located_rows"](spark, SF0001).count()


def test_cli_month_cells_to_csv_and_order_any(spark):
    pos = write_table(fx.positions(spark, SF0001), scratch_path(spark, "cli_pos_m"))
    edu = write_table(fx.education(spark, SF0001), scratch_path(spark, "cli_edu_m"))
    out, wide = scratch_path(spark, "cli_month_csv"), scratch_path(spark, "cli_wide_any")
    jobs.main(["resident-month", "--positions", pos, "--out", out, "--format", "csv",
               "--as-of", "2002-01-01"])
    expected = QUERIES["cell_state_month"](spark, SF0001)
    got = spark.read.schema(expected.schema).option("header", True).csv(out)
    assert rows(got) == rows(expected)
    jobs.main(["education-wide", "--education", edu, "--out", wide, "--order", "any"])
    # order-free first(): one row per person, same people as the default
    assert rows(spark.read.parquet(wide).select("user_id")) == \
        rows(QUERIES["education_wide"](spark, SF0001).select("user_id"))

"""Readers and sinks."""

import os
from datetime import date

import pytest
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from conftest import SF0001, rows
from workpanel.session import ensure_checkpoint_dir, local_path, scratch_path
from workpanel.sources import fixtures as fx
from workpanel.sources.readers import read_city_mapper, read_education, read_positions
from workpanel.sources.writers import materialize, read_back, write_table


def test_checkpoint_dir_comes_from_the_session(spark):
    d = ensure_checkpoint_dir(spark)
    assert d
    assert scratch_path(spark, "x").startswith(d.rstrip("/"))


def test_positions_reader_checks_columns_and_carries_extras(spark):
    path = scratch_path(spark, "pos_extra")
    df = fx.positions(spark, SF0001).withColumn("extra", fx.F.lit(1))
    write_table(df, path)
    back = read_positions(spark, path)
    assert "extra" in back.columns and back.count() == df.count()
    bad = scratch_path(spark, "pos_bad")
    write_table(df.drop("country"), bad)
    with pytest.raises(ValueError, match="country"):
        read_positions(spark, bad)


def test_reader_ignores_non_parquet_files(spark):
    path = scratch_path(spark, "pos_glob")
    write_table(fx.positions(spark, SF0001), path)
    with open(os.path.join(local_path(path), "notes.txt"), "w") as fh:
        fh.write("not data\n")
    assert read_positions(spark, path).count() == 6000


def test_missing_path_raises(spark):
    with pytest.raises(AnalysisException):
        read_education(spark, scratch_path(spark, "nowhere"))


def test_city_csv_files_with_different_headers_line_up(spark):
    a = spark.createDataFrame([("L1", "M1", "C1")], "location string, metro_area string, city string")
    b = spark.createDataFrame([("C2", "L2", None, "x")],
                              "city string, location string, metro_area string, pop string")
    pa = write_table(a, scratch_path(spark, "csv_a"), fmt="csv")
    pb = write_table(b, scratch_path(spark, "csv_b"), fmt="csv")
    got = read_city_mapper(spark, [pa, pb])
    assert rows(got, "location", "metro_area", "city", "pop") == [
        ("L1", "M1", "C1", None), ("L2", None, "C2", "x")]
    assert dict(got.dtypes)["location"] == "string"


def test_old_dates_read_as_written(spark):
    df = spark.createDataFrame([(1, date(1200, 3, 1))], "id long, d date")
    path = write_table(df, scratch_path(spark, "old_dates"))
    assert read_positions(spark, path, needed=("id",)).first().d == date(1200, 3, 1)


def test_old_int96_timestamps_read_as_written(spark):
    """The reader's option, where the session alone would refuse timestamps before 1900."""
    conf = {"spark.sql.parquet.outputTimestampType": "INT96", "spark.sql.parquet.int96RebaseModeInWrite": "CORRECTED",
            "spark.sql.parquet.int96RebaseModeInRead": "LEGACY"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        df = spark.sql("select 1L as id, timestamp'1200-03-01 10:00:00' as t")
        path = write_table(df, scratch_path(spark, "old_timestamps"))
        seen = read_positions(spark, path, needed=("id",)).select(F.col("t").cast("string")).first()[0]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert seen == "1200-03-01 10:00:00"


def test_sink_modes(spark):
    df = spark.createDataFrame([(1, "a")], "id long, v string")
    path = scratch_path(spark, "modes")
    write_table(df, path, fmt="csv")
    with pytest.raises(AnalysisException):
        write_table(df, path, fmt="csv")                        # default: refuse
    write_table(df.limit(0), path, fmt="csv", mode="ignore")     # present: no-op
    assert rows(read_back(spark, path, "csv", df.schema)) == [(1, "a")]
    write_table(df, path, fmt="csv", mode="append")
    assert read_back(spark, path, "csv", df.schema).count() == 2


def test_ordered_write_gives_sorted_parts(spark):
    df = spark.range(0, 2000).selectExpr("id", "CAST(id % 97 AS INT) AS k")
    path = write_table(df.repartition(5), scratch_path(spark, "ordered"), fmt="csv",
                       ordered=["k", "id"])
    files = sorted(f for f in os.listdir(local_path(path)) if f.startswith("part-"))
    keys = []
    for f in files:
        with open(os.path.join(local_path(path), f)) as fh:
            next(fh)
            keys += [tuple(map(int, line.split(","))) for line in fh]
    assert keys == sorted(keys, key=lambda t: (t[1], t[0])) and len(keys) == 2000


def test_materialize_cuts_lineage(spark):
    df = fx.education(spark, SF0001)
    m = materialize(spark, df, "edu_mat")
    assert "Scan parquet" in m._jdf.queryExecution().executedPlan().toString()
    assert "orders" not in m._jdf.queryExecution().executedPlan().toString()
    assert m.count() == 1500


def test_city_csv_folder_with_mismatched_headers_fails_loudly(spark):
    import shutil
    a = spark.createDataFrame([("L1", "M1", "C1")], "location string, metro_area string, city string")
    b = spark.createDataFrame([("C2", "L2", "M2")], "city string, location string, metro_area string")
    pa = local_path(write_table(a.coalesce(1), scratch_path(spark, "hdr_a"), fmt="csv"))
    pb = local_path(write_table(b.coalesce(1), scratch_path(spark, "hdr_b"), fmt="csv"))
    folder = local_path(scratch_path(spark, "hdr_mixed"))
    os.makedirs(folder)
    for i, src in enumerate((pa, pb)):
        part = [f for f in os.listdir(src) if f.startswith("part-")][0]
        shutil.copy(os.path.join(src, part), os.path.join(folder, f"part{i}.csv"))
    with pytest.raises(Exception, match="(?i)header|schema"):
        read_city_mapper(spark, folder).collect()
    # the same files listed one by one line up by name
    got = read_city_mapper(spark, [os.path.join(folder, "part0.csv"), os.path.join(folder, "part1.csv")])
    assert rows(got, "location", "city") == [("L1", "C1"), ("L2", "C2")]


def test_text_output_takes_one_column(spark):
    df = spark.createDataFrame([(1, "a")], "id long, v string")
    with pytest.raises(ValueError):
        write_table(df, scratch_path(spark, "txt_bad"), fmt="text")
    path = write_table(df.select("id"), scratch_path(spark, "txt_ok"), fmt="text")
    assert [r.value for r in spark.read.text(path).collect()] == ["1"]


def test_unusable_types_are_refused_at_read(spark):
    import pytest
    path = scratch_path(spark, "text_salary")
    spark.createDataFrame([(1, "2000-01-01", None, "India", "12")],
                          "user_id long, startdate string, enddate string, country string, salary string"
                          ).write.parquet(path)
    with pytest.raises(ValueError, match="salary: string"):
        read_positions(spark, path)


def test_staged_tables_are_removed(spark):
    import os
    from workpanel.session import local_path
    from workpanel.sources import writers
    kept = list(writers._STAGED)
    writers._STAGED.clear()
    materialize(spark, spark.range(3), "to_remove")
    path = local_path(writers._STAGED[0])
    assert os.path.isdir(path)
    writers.discard_staged(spark)
    assert not os.path.exists(path)
    writers._STAGED.extend(kept)

"""How often the named queries derive their positions, and in which order tables are joined."""

import re

import pytest

from conftest import SF0001
from workpanel.plans import pipelines as L, queries as Q
from workpanel.session import scratch_path
from workpanel.sources import fixtures as fx


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_countries_are_filtered_before_orders_are_joined(spark):
    text = optimized(fx.positions(spark, SF0001).filter("country = 'India'"))
    leaves = re.findall(r"Relation \[(\w)_", text)
    assert leaves.index("n") < leaves.index("o"), leaves


@pytest.mark.parametrize("name, most", [("movers_positions", 1), ("positions_with_education", 1), ("last_origin_state_unfilled", 1),
                                        ("backfill_college", 0), ("last_origin_state", 0), ("running_last_state", 0),
                                        ("cell_state_year_people", 0), ("cell_state_month_people", 0),
                                        ("cell_state_year_end_order", 0)])
def test_positions_are_derived_once(spark, name, most):
    """What is left of the derivation in the last plan; the written tables have had one each."""
    assert len(re.findall(r"Relation \[l_", optimized(Q.QUERIES[name](spark, SF0001)))) <= most


def test_the_cut_off_thins_the_movers(spark, monkeypatch):
    """Rows of movers meet one table of people, not a second one by the cut-off."""
    pos, edu = fx.positions(spark, SF0001), fx.education(spark, SF0001)
    rows = L.mover_rows(pos, "India", "United States", edu, "1990-01-01", keys_stage=L.stage_table)
    assert optimized(rows).count("LeftSemi") == 1
    cut = L.latest_education(edu, "India", before="1990-01-01")
    plain = L.mover_positions(pos, "India", "United States").join(cut, "user_id", "left_semi")
    assert sorted(rows.collect()) == sorted(plain.collect()) != []


def test_stream_sources_are_few_files(spark):
    """No more files than cores, whatever the number of partitions; small row groups."""
    import glob
    from pyarrow.parquet import ParquetFile
    src = scratch_path(spark, "few_files")
    rows = spark.range(400_000).selectExpr("id", "cast(rand(1) as string) as t").repartition(30)
    Q._stream_source(spark, rows, src)
    files = glob.glob(f"{src.removeprefix('file:')}/*.parquet")
    assert len(files) <= spark.sparkContext.defaultParallelism == 4
    assert spark.read.parquet(src).count() == 400_000


def test_cell_state_has_a_partition_a_core(spark):
    import glob
    from workpanel.streaming.panel_stream import read_positions_stream, stream_year_cells, write_changes
    src, out, checkpoint = (scratch_path(spark, f"state_{x}") for x in ("src", "out", "ck"))
    fx.positions(spark, SF0001).coalesce(1).write.parquet(src)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        cells = stream_year_cells(read_positions_stream(spark, src), "India", as_of="2002-01-01")
        write_changes(cells, out, checkpoint).awaitTermination()
        assert spark.conf.get("spark.sql.shuffle.partitions") == "9"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    parts = [p for p in glob.glob(f"{checkpoint.removeprefix('file:')}/state/0/*") if p.rsplit("/", 1)[1].isdigit()]
    assert len(parts) == spark.sparkContext.defaultParallelism == 4

"""Structured Streaming form of the stateless part of the panel jobs.

Parsing dates, closing open spells, the start-date fallback, the year
expansion and the city join only look at one row (plus a static look-up),
so they run unchanged on a streaming DataFrame.  The start-date fill needs
each person's whole history in order (a late row would change answers
already given), so streamed spells go straight to the fallback; the
resulting cells equal the batch job run with the fill switched off.

The cell table is bounded (occupation x place x year), so it is kept as
streaming aggregate state.  It is emitted in ``complete`` mode, where each trigger
writes a snapshot of its own (``write_snapshots``), or in ``update`` mode, where it
writes only the cells that its rows changed (``write_changes``) and readers merge the
batches by cell (``merged_changes``).  Open spells close at a fixed ``as_of``: a
default of today would close rows of different batches on different days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from workpanel.operators.cells import cell_means
from workpanel.operators.expand import expand_years
from workpanel.operators.places import attach_city, split_located
from workpanel.operators.spells import backfill_start, close_open, parse_dates
from workpanel.session import scratch_path
from workpanel.sources.readers import POSITIONS_SCHEMA


def read_positions_stream(spark: SparkSession, path: str, schema=POSITIONS_SCHEMA,
                          max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(path)


def stream_spells(rows: DataFrame, as_of, fallback: str = "years:3") -> DataFrame:
    """parse -> close open ends -> flag + fallback (no fill, see module doc)."""
    return backfill_start(close_open(parse_dates(rows), as_of=as_of), fallback=fallback)


def stream_year_cells(rows: DataFrame, country: str, as_of, keys=("onet_code", "state"),
                      mapper: DataFrame | None = None) -> DataFrame:
    """Streaming L1 without the fill; ``mapper`` (static) attaches cities
    first when the keys need them."""
    rows = rows.filter(F.col("country") == F.lit(country))
    if mapper is not None:
        rows = attach_city(rows, mapper)
    panel = expand_years(stream_spells(rows, as_of=as_of))
    return cell_means(panel, list(keys) + ["year"])


def _run(writer, available_now: bool):
    w = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return w.start()


def _run_cells(spark: SparkSession, writer, available_now: bool):
    """``_run`` for the cell table: it is bounded, so its state has a partition a core at
    most, not one for each shuffle partition, all of which every batch would commit.  A new
    stream takes the number that is set when it starts, a restarted one that of its checkpoint."""
    name = "spark.sql.shuffle.partitions"
    old = spark.conf.get(name)
    spark.conf.set(name, min(int(old), spark.sparkContext.defaultParallelism))
    try:
        return _run(writer, available_now)
    finally:
        spark.conf.set(name, old)


def write_snapshots(cells: DataFrame, out: str, checkpoint: str | None = None,
                    available_now: bool = True, keep: int = 2):
    """Run the stream; every micro-batch writes the complete cell table to a
    folder of its own, ``out/batch=<id>`` (a repeated batch writes its own
    again), so readers of earlier batches are not disturbed; see
    ``latest_snapshot``.  The last ``keep`` snapshots stay, older ones are deleted.  The
    checkpoint lives under the shared checkpoint
    folder so a restarted driver resumes where it stopped."""
    spark = cells.sparkSession
    checkpoint = checkpoint or scratch_path(spark, "stream_checkpoint")

    def snapshot(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={epoch}")
        old = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/batch={epoch - keep}")
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    w = (cells.writeStream.outputMode("complete").foreachBatch(snapshot)
         .option("checkpointLocation", checkpoint))
    return _run_cells(spark, w, available_now)


def latest_snapshot(spark: SparkSession, out: str) -> DataFrame:
    """The newest batch under ``out``."""
    cells = spark.read.parquet(out)
    newest = cells.agg(F.max("batch").alias("batch"))
    return cells.join(newest, "batch", "left_semi").drop("batch")


def write_changes(cells: DataFrame, out: str, checkpoint: str | None = None, available_now: bool = True):
    """Run the stream in ``update`` mode: every micro-batch writes the cells it changed, with
    their new values, to ``out/batch=<id>``.  A batch that is repeated after a failure
    writes its own folder again, so each counts once."""
    spark = cells.sparkSession
    checkpoint = checkpoint or scratch_path(spark, "stream_checkpoint")

    def changes(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    w = (cells.writeStream.outputMode("update").foreachBatch(changes)
         .option("checkpointLocation", checkpoint))
    return _run_cells(spark, w, available_now)


def merged_changes(spark: SparkSession, out: str, keys: list[str], up_to: int | None = None) -> DataFrame:
    """The table of ``write_changes`` by its ``keys``: each cell as the last batch left
    it (``up_to``: the last batch to look at)."""
    rows = spark.read.parquet(out)
    if up_to is not None:
        rows = rows.filter(F.col("batch") <= up_to)
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_v"))
    return last.select(*keys, *[F.col(f"_v.{c}").alias(c) for c in values])


def compact_changes(spark: SparkSession, out: str, to: str, keys: list[str]) -> int:
    """Write the merged table as the one batch of a new folder ``to`` and return the
    batch's number; a stream that goes on with the same checkpoint may write there from then on."""
    last = spark.read.parquet(out).agg(F.max("batch")).first()[0]
    merged_changes(spark, out, keys, last).write.parquet(f"{to}/batch={last}")
    return last


def stream_located(rows: DataFrame, mapper: DataFrame, null_safe: bool = True) -> DataFrame:
    """L9 on a stream: each arriving position row joined to the static
    look-up (stream-static left join, no state), located rows only."""
    return split_located(attach_city(rows, mapper, null_safe=null_safe))[0]


def write_appends(rows: DataFrame, out: str, checkpoint: str | None = None,
                  available_now: bool = True):
    """Append a stateless stream to Parquet files at ``out``; the file sink's
    log plus the checkpoint make each input file count exactly once."""
    spark = rows.sparkSession
    checkpoint = checkpoint or scratch_path(spark, "stream_checkpoint")
    w = (rows.writeStream.format("parquet").outputMode("append").option("path", out)
         .option("checkpointLocation", checkpoint))
    return _run(w, available_now)
